"""Tables that a job keeps for its own later steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}
_owned: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder if all runs on this machine, else an error."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _made.setdefault(app, "")
        if not folder:
            folder = _made[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back.

    The files survive lost executors, and later jobs read them instead of computing ``df`` again.
    What isn't released before goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quarryline_path = path
    return back


def own_folder(spark: SparkSession) -> str:
    """A folder of this application in the shared one, deleted at the end of the driver's Python."""
    folder = f"{shared_folder(spark)}/quarryline/{spark.sparkContext.applicationId}"
    if folder not in _owned:
        _owned.add(folder)
        atexit.register(_clear, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder)
    return folder


def _clear(jvm, conf, folder: str) -> None:
    with contextlib.suppress(Py4JError, OSError):  # if the JVM has ended first, nothing can be done
        place = jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(conf).delete(place, True)


def released(*frames: DataFrame) -> None:
    """Deletes the files behind frames that ``written`` made, once nothing reads them any more."""
    for df in frames:
        delete(df.sparkSession, df._quarryline_path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system its path names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
