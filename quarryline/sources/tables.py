"""Reading the tables, and writing what jobs make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder, in whatever file system the path names."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as rows (name without its ending, html)."""
    from pyspark.sql import functions as F

    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1), r"\.[^.]*$", "")
    return spark.read.text(path, wholetext=True).select(name.alias("name"), F.col("value").alias("html"))


def files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` with their sizes; their content is never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")


def write_sitemap(urls: DataFrame, path: str) -> None:
    """Rows (loc, lastmod, changefreq, priority) as sitemap XML."""
    urls.write.format("xml").option("rootTag", "urlset").option("rowTag", "url").mode("overwrite").save(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One text column as lines, for example records from ``to_record``."""
    df.select(column).write.mode("overwrite").text(path)
