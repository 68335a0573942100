"""The trie of conversation prefixes, with totals over subtrees by centroid decomposition.

Each distinct sequence of a conversation's first d turns is a node; its parent lacks the last turn.
A node is known by two 64-bit hashes of its turns and their places, which add up along a
conversation, so a conversation of any length is numbered and hashed in parts, by several tasks.

Totals over subtrees come from splitting the forest of parent edges. A component's centroid is its
lowest node with at least half of the component below it. The component's total at and below the
centroid is added to the centroid and to every node on the way from it to the component's top; then
what hangs below the centroid, one component for each child, and what is left above it are split in
turn. Each is at most half as large, so there are logarithmically many rounds however deep or wide
the forest is. Components that many tasks share are split by joins: those below a centroid are the
nodes of conversations that pass through it, those above it are the prefixes of one of them.
Components small enough for a task are split there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_RUN, written

#: Nodes of a component, and of several small ones, that one task splits.
PART = 20_000


def _node(a: Column, b: Column) -> Column:
    return F.concat(F.hex(a), F.lit("."), F.hex(b))


def _xor(a: str | Column, b: str | Column) -> Column:
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return col(a).bitwiseXOR(F.coalesce(col(b), F.lit(0).cast("long")))


def _salted(df: DataFrame) -> DataFrame:
    """Adds ``a`` and ``b``, hashes of a turn at its place."""
    return df.withColumn("a", F.xxhash64("key", "pos")).withColumn("b", F.xxhash64(F.lit("second"), "key", "pos"))


def sorted_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """All turns in order of conversation and turn (null first; ties by a hash of role and text): conv, key (that hash), words, part (a task's share of the order) and row. Rows without conversation are left out."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(BLANK_RUN.replace("[", "[^"))).cast("long")
    slim = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), key.alias("key"), words.alias("words"))
    dealt = slim.repartitionByRange("conv", "turn", "key").sortWithinPartitions("conv", "turn", "key")
    return written(dealt.drop("turn").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "turns")


def _placed(turns: DataFrame, parts: DataFrame) -> DataFrame:
    """Adds ``place`` in the conversation, from 0, and the columns of ``parts``."""
    within = F.row_number().over(Window.partitionBy("conv", "part").orderBy("row")) - 1
    return turns.withColumn("place", within).join(parts, ["conv", "part"]).withColumn("place", F.col("place") + F.col("before"))


def rebuilt_members(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversation c as the first h turns of conversation c - c % family and then its own turns after its first h, with h = crc32(c) % most.

    Gives (1) a row for each conversation and each of its prefixes, the empty one included: conv,
    depth, node, parent, words of the last turn, and whether the conversation ends there; (2) a row
    for each conversation. ``family`` 1 leaves all conversations as they are.
    """
    runs = turns.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "runs")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    sizes = runs.groupBy("conv").agg(F.sum("n").alias("n")).withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % family)
    bases = runs.groupBy(F.col("conv").alias("base")).agg(F.sum("n").alias("n_base"))
    convs = sizes.join(bases, "base", "left").withColumn("shared", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = written(convs.withColumn("length", F.col("shared") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "conversations")

    opening = _placed(turns.where(F.col("conv") % family == 0), runs.drop("n")).where(F.col("place") < most - 1)
    opening = opening.select(F.col("conv").alias("base"), F.col("place").alias("pos"), "key", "words")
    shared = convs.select("conv", "base", "shared", "length").join(opening, "base").where("pos < shared")  # fewer than ``most`` for each conversation
    shared = written(_salted(shared.select("conv", "pos", "key", "words", "length")), "shared")
    prefix = shared.groupBy("conv").agg(F.bit_xor("a").alias("pa"), F.bit_xor("b").alias("pb"))

    parts = runs.drop("n").join(convs.select("conv", "h", "shared", "length").join(prefix, "conv", "left"), "conv")
    own = _placed(turns, parts).where("place >= h").withColumn("pos", F.col("place") - F.col("h") + F.col("shared"))
    upto = Window.partitionBy("conv", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    running = lambda c: _xor(F.bit_xor(c).over(upto), "p" + c).alias("x" + c)
    own = written(_salted(own).select("conv", "part", "pos", "words", "length", "a", "b", running("a"), running("b")), "own")
    # A part that begins within a conversation: one of each task's share at most, so no more rows than the sort has partitions.
    sums = own.join(F.broadcast(runs.where("before > 0").select("conv").distinct()), "conv", "left_semi").groupBy("conv", "part").agg(F.bit_xor("a").alias("sa"), F.bit_xor("b").alias("sb"))
    carry = sums.select("conv", "part", F.bit_xor("sa").over(earlier).alias("ca"), F.bit_xor("sb").over(earlier).alias("cb")).where("ca IS NOT NULL")
    own = own.join(F.broadcast(carry), ["conv", "part"], "left").withColumn("xa", _xor("xa", "ca")).withColumn("xb", _xor("xb", "cb"))

    through = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    first = shared.withColumn("xa", F.bit_xor("a").over(through)).withColumn("xb", F.bit_xor("b").over(through))
    names = ["conv", "pos", "words", "length", "a", "b", "xa", "xb"]
    below = own.select(names).unionByName(first.select(names))
    zero = F.lit(0).cast("long")
    below = below.select("conv", (F.col("pos") + 1).cast("long").alias("depth"), _node(F.col("xa"), F.col("xb")).alias("node"), _node(_xor("xa", "a"), _xor("xb", "b")).alias("parent"), "words", (F.col("pos") + 1 == F.col("length")).alias("last"))
    root = convs.select("conv", zero.alias("depth"), _node(zero, zero).alias("node"), F.lit(None).cast("string").alias("parent"), zero.alias("words"), (F.col("length") == 0).alias("last"))
    return written(below.unionByName(root), "members"), convs


def rolled_up(parents: Sequence[int], own: np.ndarray) -> np.ndarray:
    """Totals of ``own`` over the subtree of each node, by centroid decomposition. Parents stand before their children; a top has parent -1."""
    total = np.zeros_like(own)
    todo: list[list[int]] = []
    tops: dict[int, list[int]] = {}
    top = list(range(len(parents)))
    for v, p in enumerate(parents):
        if p >= 0:
            top[v] = top[p]
        tops.setdefault(top[v], []).append(v)
    todo += tops.values()
    size = [0] * len(parents)
    piece = [-1] * len(parents)
    while todo:
        part = todo.pop()
        if len(part) == 1:
            total[part[0]] += own[part[0]]
            continue
        for v in part:
            size[v] = 1
        first, centroid = part[0], part[0]
        for v in reversed(part):
            if 2 * size[v] >= len(part):
                centroid = v
                break
            if v != first:
                size[parents[v]] += size[v]
        below, above, hanging = [centroid], [], {}
        for v in part:
            piece[v] = -1
        piece[centroid] = centroid
        for v in part:
            if v == centroid:
                continue
            p = parents[v]
            if v != first and piece[p] >= 0:
                piece[v] = v if p == centroid else piece[p]
                hanging.setdefault(piece[v], []).append(v)
                below.append(v)
            else:
                above.append(v)
        found = own[below].sum(axis=0)
        v = centroid
        while True:
            total[v] += found
            if v == first:
                break
            v = parents[v]
        todo += [x for x in (above, *hanging.values()) if x]
    return total


def _split(open_: DataFrame, members: DataFrame, values: Sequence[str]) -> tuple[DataFrame, int]:
    """One round: every component of more than PART nodes is split at its centroid. Gives all nodes, and how many components were split. A node that is through has no component."""
    large = written(open_.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(f"n > {PART}"), "large")
    n_large = large.count()  # at most one for each PART nodes
    if not n_large:
        return open_, 0
    half = open_.join(large, "comp").where("2 * size >= n")
    centroids = written(half.groupBy("comp").agg(F.min_by(F.struct("node", "conv", "depth"), F.struct("size", "node")).alias("c")).select("comp", "c.*"), "centroids")
    to = centroids.select(F.col("comp"), F.col("node").alias("centroid"), F.col("depth").alias("at"))
    passing = members.join(to.withColumnRenamed("centroid", "parent"), "parent").select("comp", "conv", F.col("node").alias("child"))
    way = members.join(to.join(centroids.select("comp", "conv"), "comp"), "conv").where("depth < at").select("comp", "node", F.lit(True).alias("on_way"))
    found = open_.join(to, "comp", "left").join(passing, ["comp", "conv"], "left").join(way, ["comp", "node"], "left")
    through = F.coalesce(F.col("node") == F.col("centroid"), F.lit(False))
    below = F.col("child").isNotNull() & (F.col("depth") > F.col("at"))
    found = written(found.withColumn("through", through).withColumn("below", F.coalesce(below, F.lit(False))), "parted")
    sums = found.where("through OR below").groupBy("comp").agg(F.count(F.lit(1)).alias("t_size"), *[F.sum(v).alias(f"t_{v}") for v in values])
    adds = F.col("through") | F.coalesce("on_way", F.lit(False))
    comp = F.when(F.col("through"), None).when(F.col("below"), F.col("child")).otherwise(F.col("comp"))
    size = F.col("size") - F.when(F.coalesce("on_way", F.lit(False)), F.col("t_size")).otherwise(0)
    more = [(F.col(f"sum_{v}") + F.when(adds, F.col(f"t_{v}")).otherwise(0)).alias(f"sum_{v}") for v in values]
    return written(found.join(sums, "comp", "left").select("node", "parent", "conv", "depth", comp.alias("comp"), size.alias("size"), *values, *more), "split"), n_large


def subtree_totals(nodes: DataFrame, members: DataFrame, values: Sequence[str]) -> DataFrame:
    """For each node the sums of ``values`` (long) over its subtree, itself included: node and sum_<value>."""
    zero = F.lit(0).cast("long")
    sums = [f"sum_{v}" for v in values]
    if (total := nodes.count()) > PART:
        # Nodes below a node: those of which a conversation through it is the smallest member, but for its own smallest member's above.
        owned = written(nodes.groupBy("conv").agg(F.count(F.lit(1)).alias("owned"), F.min("depth").alias("from")), "owned")
        passing = members.select("node", "conv").join(owned.select("conv", "owned"), "conv").groupBy("node").agg(F.sum("owned").alias("size"))
        sized = nodes.join(passing, "node").join(owned.select("conv", "from"), "conv").withColumn("size", F.col("size") - F.col("depth") + F.col("from"))
        root = F.first(F.when(F.col("depth") == 0, F.col("node")), ignorenulls=True)
        top = nodes.where("depth = 0").agg(root).first()[0]
        open_ = written(sized.select("node", "parent", "conv", "depth", F.lit(top).alias("comp"), "size", *values, *[zero.alias(s) for s in sums]), "split")
        done = []
        while True:
            after, n = _split(open_, members, values)
            if not n:
                break
            done.append(after.where("comp IS NULL"))
            open_ = after.where("comp IS NOT NULL")
    else:
        open_, done = nodes.select("node", "parent", F.lit("").alias("comp"), "depth", *values, *[zero.alias(s) for s in sums]), []

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["comp", "depth"], ignore_index=True)
        at = {key: k for k, key in enumerate(zip(df["comp"], df["node"], strict=True))}
        parents = [at.get(key, -1) for key in zip(df["comp"], df["parent"], strict=True)]
        df[sums] = df[sums].to_numpy() + rolled_up(parents, df[list(values)].to_numpy())
        return df[["node", *sums]]

    tasks = max(1, -(-total // PART))
    spread = open_.withColumn("task", F.pmod(F.xxhash64("comp"), F.lit(tasks))).select("task", "comp", "node", "parent", "depth", *values, *sums)
    out = spread.groupBy("task").applyInPandas(solve, f"node string, {', '.join(f'{s} long' for s in sums)}")
    for df in done:
        out = out.unionByName(df.select("node", *sums))
    return out


def list_hashes(pairs: DataFrame, key: str, number: str) -> DataFrame:
    """SHA-256 of each key's numbers, ascending and joined by commas: ``key`` and ``sha``. Numbers are joined into pieces where they are sorted; a key's pieces run through one hash in order, none is held longer than that."""

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            keys, numbers = df[key].to_numpy(), df[number].to_numpy()
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
            yield pd.DataFrame([(keys[a], numbers[a], ",".join(map(str, numbers[a:b]))) for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)], columns=[key, "first", "piece"])

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for df in frames:
            out = []
            for k, piece in zip(df[key], df["piece"], strict=True):
                if k != now:
                    if now is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(piece.encode())
            yield pd.DataFrame(out, columns=[key, "sha"])
        if now is not None:
            yield pd.DataFrame([(now, sha.hexdigest())], columns=[key, "sha"])

    made = pairs.select(key, number).repartitionByRange(key, number).sortWithinPartitions(key, number).mapInPandas(pieces, f"{key} string, first long, piece string")
    return made.repartition(key).sortWithinPartitions(key, "first").select(key, "piece").mapInPandas(hashed, f"{key} string, sha string")


def trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 20, most: int = 4) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see ``rebuilt_members``): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by ``turn_col``, null first; equal ones by a hash of role and text. A null role or text
    is an empty one. Rows without id are left out; equal rows are turns of their own. A conversation
    without turns left is a member of the root alone. saved_tokens: over the subtree, the words of
    each node's last turn times its members but one. ends_sha256: of the members that end there. An
    empty table gives no rows.
    """
    members, _ = rebuilt_members(sorted_turns(conversations, id_col, turn_col, role_col, text_col), family, most)
    nodes = members.groupBy("node").agg(F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    nodes = written(nodes, "nodes")
    kids = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    nodes = nodes.join(kids, "node", "left").join(above, "parent", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = written(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "tree")
    totals = subtree_totals(nodes, members, ["leaf", "saved"])
    ends = list_hashes(members.where("last"), "node", "conv")
    out = nodes.join(totals, "node").join(ends, "node", "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", F.col("sum_leaf").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
