"""Jobs driven by a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def audit_manifest(manifest: DataFrame, files: DataFrame, name: str, file_name: Column) -> DataFrame:
    """For each row of the manifest: number of files, size in whole KB, and status ok or missing. ``file_name`` gives the manifest's name for a file.

    Rows that repeat a name are audited each; a null name, and a file without size, is missing.
    """
    sizes = files.groupBy(file_name.alias(name)).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("__ql_bytes"))
    return manifest.join(sizes, name, "left").select(*manifest.columns, F.coalesce("n_files", F.lit(0)).alias("n_files"), S.round_half_up(F.col("__ql_bytes") / 1024).alias("kb"), F.when(F.col("__ql_bytes").isNull(), "missing").otherwise("ok").alias("status"))


def select_jobs(jobs: DataFrame, key: str, requested: Sequence[str]) -> DataFrame:
    """All jobs if none is requested; else those requested, with their ``request_pos``, as often as they are asked for. Unknown names are skipped."""
    if not requested:
        return jobs
    wanted = jobs.withColumn("request_pos", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(requested) - 1)), lambda k: F.get(F.array(*map(F.lit, requested)), k) == F.col(key))))
    return wanted
