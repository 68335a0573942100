"""Long texts made of ordered parts, for groups too large for one task: the text comes in chunks.

Parts are sorted by range over all tasks. What stands before a part is the sum of two: the lengths
of the group's earlier shares of the order, one for each task, and of the parts before it in its own
share. A part is cut where chunks end, and each chunk is joined by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import corpus
from ..sources.shared import written


def _numbered(parts: DataFrame) -> DataFrame:
    """``parts`` (g, the order k0, k1 ..., t) in order, with ``share`` (a task's part of the order), ``place`` in the group from 0 and ``of``, the group's number of parts."""
    order = ["g", *[c for c in parts.columns if c.startswith("k")], "t"]
    rows = written(parts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("share", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "parts")
    sizes = rows.groupBy(F.col("g").alias("g_"), F.col("share").alias("share_")).agg(F.count(F.lit(1)).alias("n"))
    shares = Window.partitionBy("g_").orderBy("share_")
    sizes = sizes.select("g_", "share_", _before("n", shares).alias("earlier"), F.sum("n").over(Window.partitionBy("g_")).alias("of"))
    within = F.row_number().over(Window.partitionBy("g", "share").orderBy("row")) - 1
    return _shared(rows.withColumn("place", within), sizes).withColumn("place", F.col("place") + F.col("earlier")).drop("earlier")


def _before(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _shared(rows: DataFrame, totals: DataFrame) -> DataFrame:
    return rows.join(totals, F.col("g").eqNullSafe(F.col("g_")) & (F.col("share") == F.col("share_"))).drop("g_", "share_")


def _chunked(placed: DataFrame, group: str, chunk: int) -> DataFrame:
    """``placed``: g, share, row and t, the piece of text that stands there."""
    placed = written(placed.select("g", "share", "row", "t"), "pieces")
    length = F.char_length("t").cast("long")
    totals = placed.groupBy(F.col("g").alias("g_"), F.col("share").alias("share_")).agg(F.sum(length).alias("n"))
    totals = totals.select("g_", "share_", _before("n", Window.partitionBy("g_").orderBy("share_")).alias("earlier"))
    sized = placed.withColumn("n", length)
    at = _before("n", Window.partitionBy("g", "share").orderBy("row"))
    found = _shared(sized.withColumn("at", at), totals).withColumn("at", F.col("at") + F.col("earlier"))
    last = F.floor((F.col("at") + F.greatest(F.col("n"), F.lit(1)) - 1) / chunk)
    cut = found.select("g", "at", "t", "row", F.explode(F.sequence(F.floor(F.col("at") / chunk), last)).alias("chunk"))
    start = F.greatest(F.lit(0), F.col("chunk") * chunk - F.col("at"))
    piece = F.substring(F.col("t"), (start + 1).cast("int"), (F.col("chunk") * chunk + chunk - F.col("at") - start).cast("int"))
    # Empty pieces are no part of a chunk, but for a group that has nothing else.
    pieces = cut.withColumn("t", piece).where((F.char_length("t") > 0) | (F.col("at") == 0))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "row", "t"))), lambda x: x["t"]), "")
    return pieces.groupBy("g", "chunk").agg(joined.alias("text")).select(F.col("g").alias(group), "chunk", (F.col("chunk") * chunk).alias("offset"), "text")


def assemble_chunks(parts: DataFrame, group: str, pos: str, text: str, sep: str = "", wrap: str | None = None, head: str = "", foot: str = "", chunk: int = 1 << 20) -> DataFrame:
    """The texts of ``corpus.assemble_ordered`` in chunks of ``chunk`` characters (the last may be shorter): the group, chunk (from 0), offset and text. A group's chunks, one after another, are its text; an empty text is one empty chunk."""
    body = F.coalesce(F.col(text), F.lit(""))
    if wrap:
        body = F.concat(F.lit(f"<{wrap}>"), body, F.lit(f"</{wrap}>"))
    placed = _numbered(parts.select(F.col(group).alias("g"), F.col(pos).alias("k0"), body.alias("t")))
    before = F.when(F.col("place") == 0, head).otherwise(sep)
    whole = placed.withColumn("t", F.concat(before, "t", F.when(F.col("place") == F.col("of") - 1, foot).otherwise("")))
    return _chunked(whole, group, chunk)


def render_chunks(df: DataFrame, row: Column, group: str, order: Sequence[str], between: str = "", twice: bool = False, chunk: int = 1 << 20) -> DataFrame:
    """The texts of ``corpus.render_rows`` in chunks, as in ``assemble_chunks``."""
    keys = [F.col(c).alias(f"k{i + 1}") for i, c in enumerate(order)]
    rows = df.select(F.col(group).alias("g"), F.coalesce(row, F.lit("")).alias("t"), F.explode(F.array(*[F.lit(i) for i in range(1 + twice)])).alias("k0"), *keys)
    placed = _numbered(rows)
    first = F.col("place") % F.expr(f"`of` DIV {1 + twice}") == 0
    return _chunked(placed.withColumn("t", F.concat(F.when(first, "").otherwise(between), "t")), group, chunk)


def differing(left: DataFrame, right: DataFrame, bits: Sequence[int] = (12, 24)) -> tuple[DataFrame, DataFrame]:
    """The rows of two tables (key, value) that stand in ranges of key hashes whose digests differ; ranges are halved ``bits`` times, level by level.

    A digest is the number of rows and two bitwise sums of their hashes, so it is made where the rows
    are, and only ranges that differ are looked into again. What is left grows with the differences,
    not with the tables. Rows without key are all left.
    """
    for level in bits:
        part = F.shiftrightunsigned(F.xxhash64("key"), 64 - level)

        def digests(df: DataFrame, side: str, part: Column = part) -> DataFrame:
            pair = F.struct("key", "value")
            return df.where("key IS NOT NULL").groupBy(part.alias("part")).agg(F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64(pair)), F.bit_xor(F.xxhash64(F.lit("again"), pair))).alias(f"digest{side}"))

        both = digests(left, "a").join(digests(right, "b"), "part", "full_outer")
        # At most 2^level ranges, and no more than there are rows that differ or stand by them.
        parts = written(both.where(~F.col("digesta").eqNullSafe(F.col("digestb"))).select(F.col("part").alias("part_")), "ranges")
        left, right = (df.where("key IS NOT NULL").join(parts, part == F.col("part_"), "left_semi").unionByName(df.where("key IS NULL")) for df in (left, right))
    return left, right


def differences(left: DataFrame, right: DataFrame, key: str, value: str, bits: Sequence[int] = (12, 24)) -> DataFrame:
    """The rows of ``corpus.differences``, for tables that hardly differ: only rows in ranges of keys whose digests differ are joined. Values that are equal have equal hashes; others have different ones, but for a chance of one in 2^64 and less."""
    slim = lambda df: df.select(F.col(key).alias("key"), F.col(value).alias("value"))
    a, b = differing(slim(left), slim(right), bits)
    return corpus.differences(a, b, "key", "value").withColumnRenamed("key", key)
