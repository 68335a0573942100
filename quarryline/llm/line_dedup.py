"""Line deduplication across documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, lower_ascii, released, without, written

#: Shared lines (24 bytes each) that are broadcast.
MOST_BROADCAST = 200_000


def line_key(line: Column) -> Column:
    """What two lines must share to count as the same: blanks stripped at both ends, A-Z in lower case."""
    return lower_ascii(F.trim(line, F.lit(BLANKS)))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops lines that many documents share, except in the document with the largest id.

    Lines are exploded with their position, normalised and hashed (two 64-bit hashes); distinct
    documents are counted per hash; the positions to drop are gathered per document, and the lines
    left are joined again by position. A line goes if its key has ``min_chars`` code points or more
    and stands in ``min_docs`` documents or more.

    Returns every column of ``docs`` with ``text_col`` replaced, and ``n_lines`` (before dropping)
    and ``n_dropped``; input columns of these names are replaced. A null or empty text is one empty
    line and comes back empty. Rows that repeat a ``doc_id`` count as one document; rows without
    ``doc_id`` count as none and keep their lines. An empty table gives an empty one.
    """
    base = docs.select(
        *without(docs, text_col, "n_lines", "n_dropped"),
        F.col(id_col).alias("__ql_id"),
        F.xxhash64(text_col).alias("__ql_row"),
        F.split(F.coalesce(text_col, F.lit("")), "\n").alias("__ql_lines"),
    )
    keys = written(
        base.where(F.col("__ql_id").isNotNull())
        .select("__ql_id", "__ql_row", F.posexplode("__ql_lines").alias("__ql_pos", "__ql_line"))
        .where(F.char_length("__ql_line") >= min_chars)
        .withColumn("__ql_key", line_key(F.col("__ql_line")))
        .where(F.char_length("__ql_key") >= min_chars)
        .select("__ql_id", "__ql_row", "__ql_pos", F.xxhash64("__ql_key").alias("__ql_h1"), F.xxhash64(F.lit("second"), "__ql_key").alias("__ql_h2")),
        "keys",
    )
    # Partial aggregation first reduces a hot line to one row for each task and document.
    shared = written(
        keys.groupBy("__ql_h1", "__ql_h2")
        .agg(F.count_distinct("__ql_id").alias("__ql_docs"), F.max("__ql_id").alias("__ql_keeper"))
        .where(F.col("__ql_docs") >= min_docs)
        .select("__ql_h1", "__ql_h2", "__ql_keeper"),
        "shared",
    )
    # Few shared lines go to every task; more are joined by a shuffle, in which Spark can split a hot line, as both sides are plain tables.
    few = shared.count() <= MOST_BROADCAST
    drops = written(
        keys.join(F.broadcast(shared) if few else shared, ["__ql_h1", "__ql_h2"])
        .where(F.col("__ql_id") != F.col("__ql_keeper"))
        .groupBy("__ql_id", "__ql_row")
        .agg(F.collect_set("__ql_pos").alias("__ql_drop")),
        "drops",
    )
    released(keys, shared)
    n = F.size("__ql_lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("__ql_drop")), lambda i: F.get("__ql_lines", i))
    joined = base.join(drops, ["__ql_id", "__ql_row"], "left")
    new = {
        text_col: F.when(F.col("__ql_drop").isNull(), F.array_join("__ql_lines", "\n")).otherwise(F.array_join(kept, "\n")),
        "n_lines": n.cast("long"),
        "n_dropped": F.coalesce(F.size("__ql_drop"), F.lit(0)).cast("long"),
    }
    order = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(*[new[c].alias(c) if c == text_col else F.col(f"`{c}`") for c in order], new["n_lines"].alias("n_lines"), new["n_dropped"].alias("n_dropped"))
