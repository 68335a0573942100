"""A corpus pipeline over ``documents``: good documents, without repeated lines, near copies and secrets, packed for training."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import line_crf, line_dedup, ngram_join, packing, secret_scan
from quarryline.llm.common import released, table, written
from quarryline.llm.queries import vocabulary


def _changed(docs: DataFrame, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` after ``job``, n_chars counted anew. All but doc_id and text bear other names meanwhile, so none clashes with what ``job`` makes."""
    aside = {c: f"own_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = job(docs.withColumnsRenamed(aside))
    counted = F.char_length("text").cast("long")
    return out.select(*[(counted if c == "n_chars" else F.col(aside.get(c, c))).alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.7 or more; the field learns from labelled rows of ``docs`` that aren't held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~line_crf.held_out())
    return line_crf.accepted(docs, line_crf.train(docs, labels, most=3000), least=0.7)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in one of them."""
    return _changed(docs, lambda df: line_dedup.drop_repeated_lines(df, min_chars=40, min_docs=5))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return ngram_join.one_of_each(docs, size=5, percent=75)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    return _changed(docs, lambda df: secret_scan.redact(secret_scan.find_secrets(df)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), length=2048, end_id=1, keep_ids=False)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", near_duplicates),
    ("secret_scan", secrets),
    ("packing", pack),
]

#: The trained classifier has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each stage's result is written to the shared folder, for the next to read."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        released(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
