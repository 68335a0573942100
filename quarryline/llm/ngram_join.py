"""Jaccard join of documents on word n-grams, as a blocked sparse matrix product.

The incidence matrix has a row for each distinct set of n-grams and a column for each n-gram. The
product of the matrix with its transpose counts what two sets share, and it is never made whole:

1. Over the first half of the columns, block by block, it is counted how many of a row's entries are
   in columns that other rows have too. That bounds what the row can share with any other: rows
   with more entries alone than their size allows are discarded, and with them all their pairs.
2. For the rows left all columns are counted, block by block. Rows are discarded by what is alone in
   them, and the others' columns are put in order, the least frequent first.
3. Rows that share enough meet in the first columns of each. These entries are multiplied, in blocks
   of columns and rows; overlap counts are added up by pair, and pairs are discarded whose count, with
   all that can follow in the columns after, stays below what their sizes ask for.
4. For the pairs left the overlap over all columns is counted.

Only components are asked for, so not all pairs need their overlap: each row is first compared with
a leader of its columns, the pairs found are contracted, and then only pairs of rows in different
components remain to be compared; no such pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written
from .components import components

#: The first half of the columns.
HALF = np.uint64(1 << 63)
#: Ranges of columns of which a bit says whether a row has entries there.
BIT_BLOCKS = 1024
#: Entries that are packed together, entries in a block of columns, and rows of a column that are paired in one task.
PACK, BLOCK, ROWS = 500_000, 500_000, 512
#: Rows whose counts are added up in one task.
NODES = 100_000
#: Sets up to this number are looked up by a broadcast of their documents' ids; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 18), base % (1 << 64), dtype=np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if len(known) <= 1 << 20:
            _powers[base] = known
    return known[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts as 64-bit hashes, where each starts and ends among the bytes of all, and where each text starts (and the next would).

    A-Z count as a-z; words end at blanks, and a blank stands before and after each text.
    """
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    blank = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edges[0::2], edges[1::2]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
        word = _mixed((sums[end] - sums[start]) * _power(pow(_BASE, -1, 1 << 64), len(data))[start] + (end - start).astype(np.uint64))
    return word, start, end, np.cumsum([1, *(len(r) + 1 for r in raw)])


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted set of its ``size``-word n-grams as 64-bit hashes; one for the whole of a shorter text, none without words.

    All bytes are hashed at once: a word's hash is the difference of two prefix sums of a polynomial
    over its bytes.
    """
    word, start, _, first = words_of(texts)
    bounds = np.searchsorted(start, first)
    with np.errstate(over="ignore"):
        n = max(0, len(word) - size + 1)
        grams = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            grams += word[k : k + n] * _MIX[k]
        grams = _mixed(grams)
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= size:
                out.append(np.unique(grams[a : b - size + 1]))
            elif b > a:
                out.append(_mixed(np.array([(word[a:b] * _MIX[size : size + b - a]).sum() + _MIX[32 + b - a]], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def node_of(grams: np.ndarray) -> int:
    """A set's id: a hash of its members in any order."""
    with np.errstate(over="ignore"):
        return int(_mixed(np.array([_mixed(grams ^ _MIX[63]).sum() + np.uint64(len(grams))], dtype=np.uint64)).view(np.int64)[0])


def _bits(grams: np.ndarray) -> np.ndarray:
    """Which blocks of columns a set has entries in."""
    has = np.zeros(BIT_BLOCKS, dtype=bool)
    has[(grams >> np.uint64(64 - 10)).astype(np.int64)] = True
    return np.packbits(has).view(np.int64)


def _only_in(x: str, y: str):
    """At least so many entries of set ``x`` are not in ``y``: blocks where it alone has some."""
    return sum((F.bit_count(F.get(x, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(k))))) for k in range(1, BIT_BLOCKS // 64)), F.bit_count(F.get(x, F.lit(0)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(0))))))


def _may_link(percent: int):
    """Whether sets a and b (n_a, bits_a, n_b, bits_b) can share enough: their overlap is bounded by what each size leaves."""
    most = F.least(F.col("n_a") - _only_in("bits_a", "bits_b"), F.col("n_b") - _only_in("bits_b", "bits_a"))
    sized = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    return sized & ((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")))


def _in_groups(batches: Iterator[pa.RecordBatch], size: int, most_chars: int = 400_000) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Keys and n-gram sets of a few texts at a time; a very long text comes alone."""
    for batch in batches:
        keys, texts, chars = [], [], 0
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py() or ""
            if texts and chars + len(text) > most_chars:
                yield keys, shingle_sets(texts, size)
                keys, texts, chars = [], [], 0
            keys.append(key.as_py())
            texts.append(text)
            chars += len(text)
        if texts:
            yield keys, shingle_sets(texts, size)


def _cut(values: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    at = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *at], [*at, len(values)], strict=True)) if len(values) else []


def _profile(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document: id, n (its set's size), node, and half (its entries in the first half of the columns)."""
    key = docs.schema.fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def typed():
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        for keys, sets in _in_groups(typed(), size):
            columns = [len(s) for s in sets], [node_of(s) if len(s) else None for s in sets], [int(np.searchsorted(s, HALF)) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=kind), *(pa.array(c, type=pa.int64()) for c in columns)], ["id", "n", "node", "half"])

    return docs.mapInArrow(run, f"id {key}, n long, node long, half long")


def _short(node: np.ndarray) -> np.ndarray:
    """48 bits of a node, never 0."""
    return np.maximum(node.view(np.uint64) >> np.uint64(16), np.uint64(1))


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each column of the first half."""
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(31)).astype(np.int64)


def _packed(sets: list[np.ndarray], nodes: list[int], blocks: int) -> dict[str, list]:
    """Entries of several sets by blocks of columns: an entry of each column, with its row if no other set here has the column, and for the other rows how many of their entries here are in columns that several sets have.

    Each block has its own counts. So a task that runs again with its rows in another order changes
    nothing: a block gets its entries and counts from one packing, whichever that is.
    """
    h = np.concatenate(sets)
    own = np.repeat(_short(np.array(nodes, dtype=np.int64)), [len(s) for s in sets])
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    again = np.zeros(len(h), dtype=bool)
    again[1:] = h[1:] == h[:-1]
    several = again.copy()
    several[:-1] |= again[1:]
    known, where = own[several], _block(h[several], blocks)
    order = np.lexsort((known, where))
    known, where = known[order], where[order]
    begins = np.flatnonzero(np.r_[True, (known[1:] != known[:-1]) | (where[1:] != where[:-1])]) if len(known) else np.zeros(0, dtype=np.int64)
    known, where, times = known[begins], where[begins], np.diff(np.r_[begins, len(known)])
    own[several] = 0
    h, own = h[~again], own[~again]
    block = _block(h, blocks)
    spans = _cut(block)
    counts = [slice(*np.searchsorted(where, [block[a], block[a] + 1])) for a, _ in spans]
    entries = {"h": h.astype(np.uint32), "low": own.astype(np.uint32), "high": (own >> np.uint64(32)).astype(np.uint16)}
    more = {"known_low": known.astype(np.uint32), "known_high": (known >> np.uint64(32)).astype(np.uint16), "times": times.astype(np.uint32)}
    cells = {name: [x[a:b].tobytes() for a, b in spans] for name, x in entries.items()} | {name: [x[c].tobytes() for c in counts] for name, x in more.items()}
    return {"block": [int(block[a]) for a, _ in spans]} | cells


def _counted(rows: pd.DataFrame, parts: int) -> pd.DataFrame:
    """For the packed entries of a block: rows and how many of their entries are in columns that another row has too, packed by the part that adds them up."""
    read = lambda c, t: np.frombuffer(b"".join(rows[c]), dtype=t)
    joined = lambda low, high: read(low, np.uint32).astype(np.uint64) | read(high, np.uint16).astype(np.uint64) << np.uint64(32)
    h, own = read("h", np.uint32), joined("low", "high")
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    begins = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    column = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(h)]))
    several = (np.minimum.reduceat(own, begins) != np.maximum.reduceat(own, begins))[column] & (own > 0)
    column, own = column[several], own[several]
    order = np.lexsort((column, own))  # copies of a set from several packs count once
    column, own = column[order], own[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (column[1:] != column[:-1])
    short, n = np.unique(own[new], return_counts=True)
    short, n = np.concatenate([short, joined("known_low", "known_high")]), np.concatenate([n, read("times", np.uint32)])
    part = (short % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    short, n, part = short[order], n[order].astype(np.int32), part[order]
    spans = _cut(part)
    return pd.DataFrame({"part": [part[a] for a, _ in spans], "short": [short[a:b].tobytes() for a, b in spans], "n": [n[a:b].tobytes() for a, b in spans]})


def _shared_entries(docs: DataFrame, size: int, total: int, n_nodes: int) -> DataFrame:
    """For the first half of the columns, block by block: how many of a row's entries are in columns that another row has too.

    A row is ``short`` (48 bits of a node) and ``n``; rows that share nothing have none. Tasks pack many sets and sort
    their entries. A column that two sets of a pack have is counted there and then, and sent on as
    one mark; so no block gets more of a column than one entry from each pack, however many
    documents have it. Other entries go to their column's block in 10 bytes each. Blocks send their
    counts, packed again, to the parts that add them up by node.
    """
    blocks, parts = max(1, total // 2 // BLOCK), 1 + n_nodes // NODES
    kinds = {"block": pa.int64()} | {c: pa.binary() for c in ("h", "low", "high", "known_low", "known_high", "times")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            cells = _packed(held, nodes, blocks)
            return pa.RecordBatch.from_arrays([pa.array(cells[c], type=kind) for c, kind in kinds.items()], list(kinds))

        held, nodes, n_held, seen = [], [], 0, set()
        for _, sets in _in_groups(batches, size):
            for s in sets:
                s_half = s[: np.searchsorted(s, HALF)]
                node = node_of(s) if len(s_half) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                held.append(s_half)
                nodes.append(node)
                n_held += len(s_half)
            if n_held >= PACK:
                yield packed()
                held, nodes, n_held, seen = [], [], 0, set()
        if n_held:
            yield packed()

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        short, n = (np.frombuffer(b"".join(rows[c]), dtype=t) for c, t in (("short", np.int64), ("n", np.int32)))
        names, place = np.unique(short, return_inverse=True)
        return pd.DataFrame({"short": names, "n": np.bincount(place, weights=n).astype(np.int64)})

    cells = docs.mapInArrow(run, ", ".join(f"{c} {'long' if c == 'block' else 'binary'}" for c in kinds))
    counts = cells.groupBy("block").applyInPandas(lambda rows: _counted(rows, parts), "part long, short binary, n binary")
    return counts.groupBy("part").applyInPandas(added, "short long, n long")


def _rows(docs: DataFrame, size: int, percent: int, total: int) -> tuple[DataFrame, DataFrame]:
    """The matrix rows that may link with some other of ``docs``, and the packs they came from.

    A row is node, n, ``alone`` (entries in columns without another row), ``cols`` (its other
    columns, the least frequent first), ``weight`` (how frequent its first columns are) and ``bits``
    (which of 1024 ranges of columns it has entries in). Rows with too many entries alone are left out.
    Packs of sets are written; each asks, once for each of its columns, the column's block how many
    sets have it, and is answered once.
    """
    blocks = max(1, total // BLOCK)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, task = 0, TaskContext.get().partitionId()

        def packed(held: dict[int, np.ndarray]) -> pa.RecordBatch:
            nonlocal made
            made += 1
            sizes = np.array([len(s) for s in held.values()], dtype=np.int64)
            blobs = np.array(list(held), dtype=np.int64), sizes, np.concatenate(list(held.values()))
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | made], type=pa.int64()), *(pa.array([b.tobytes()], type=pa.binary()) for b in blobs)], ["pack", "nodes", "sizes", "grams"])

        held, n_held = {}, 0
        for _, sets in _in_groups(batches, size):
            for s in sets:
                if len(s) and (node := node_of(s)) not in held:
                    held[node] = s
                    n_held += len(s)
            if n_held >= PACK:
                yield packed(held)
                held, n_held = {}, 0
        if held:
            yield packed(held)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, blob in zip(batch.column(0), batch.column(1), strict=True):
                h, n = np.unique(np.frombuffer(blob.as_py(), dtype=np.uint64), return_counts=True)
                block = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
                spans = _cut(block)
                yield pa.RecordBatch.from_arrays([pa.array([block[a] for a, _ in spans], type=pa.int64()), pa.array([key.as_py()] * len(spans), type=pa.int64()), *(pa.array([x[a:b].tobytes() for a, b in spans], type=pa.binary()) for x in (h, n.astype(np.int32)))], ["block", "pack", "h", "n"])

    def answer(cells: pd.DataFrame) -> pd.DataFrame:
        h, n = (np.frombuffer(b"".join(cells[c]), dtype=t) for c, t in (("h", np.uint64), ("n", np.int32)))
        own = np.repeat(np.arange(len(cells)), cells["n"].str.len() // 4)
        order = np.argsort(h, kind="stable")
        h, n, own = h[order], n[order], own[order]
        begins = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        often = np.repeat(np.add.reduceat(n.astype(np.int64), begins), np.diff(np.r_[begins, len(h)]))
        keep = often > 1
        h, often, own = h[keep], np.minimum(often[keep], 1 << 30).astype(np.int32), own[keep]
        order = np.argsort(own, kind="stable")
        h, often, own = h[order], often[order], own[order]
        spans = _cut(own)
        return pd.DataFrame({"pack": [cells["pack"].iloc[own[a]] for a, _ in spans], "h": [h[a:b].tobytes() for a, b in spans], "often": [often[a:b].tobytes() for a, b in spans]})

    def rows_of(packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {k: [] for k in ("node", "n", "alone", "weight", "cols", "bits")}
        known, often = (np.frombuffer(b"".join(answers[c]), dtype=t) for c, t in (("h", np.uint64), ("often", np.int32)))
        order = np.argsort(known)
        known, often = known[order], often[order]
        for blobs in packs.itertuples():
            grams, at = np.frombuffer(blobs.grams, dtype=np.uint64), 0
            place = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
            df = np.where(known[place] == grams, often[place], 1) if len(known) else np.ones(len(grams), dtype=np.int32)
            for node, n in zip(np.frombuffer(blobs.nodes, dtype=np.int64), np.frombuffer(blobs.sizes, dtype=np.int64), strict=True):
                g, d = grams[at : at + n], df[at : at + n]
                at += n
                alone = int((d < 2).sum())
                first = int(n) - -(-percent * int(n) // 100) + 1 - alone
                if first > 0:
                    order = np.lexsort((g, d))[alone:]
                    for k, x in zip(found, (node, n, alone, int(d[order[:first]].sum()), g[order].view(np.int64), _bits(g)), strict=True):
                        found[k].append(x)
        return pd.DataFrame(found)

    packs = written(docs.mapInArrow(pack, "pack long, nodes binary, sizes binary, grams binary"), "packs")
    answers = packs.select("pack", "grams").mapInArrow(ask, "block long, pack long, h binary, n binary").groupBy("block").applyInPandas(answer, "pack long, h binary, often binary")
    rows = packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInPandas(rows_of, "node long, n long, alone long, weight long, cols array<long>, bits array<long>")
    return written(rows, "rows"), packs


def _overlaps(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) whose rows share enough columns. Sizes and ranges discard pairs before any row is fetched."""
    a, b = (rows.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    likely = written(pairs.join(a, "a").join(b, "b").where(_may_link(percent)).select("a", "b", "n_a", "n_b"), "likely")
    both = likely.join(rows.select(F.col("node").alias("a"), F.col("cols").alias("cols_a")), "a").join(rows.select(F.col("node").alias("b"), F.col("cols").alias("cols_b")), "b")
    overlap = F.size(F.array_intersect("cols_a", "cols_b"))
    # |A and B| * (100 + p) >= p * (|A| + |B|)
    links = written(both.where((100 + percent) * overlap >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "links")
    released(likely)
    return links


def _labels(rows: DataFrame, percent: int) -> DataFrame:
    """The components (id, component: nodes) of rows that share enough; rows without links are left out.

    Rows that share enough meet within the first n - s + 1 columns of each, s being what a row of n
    columns must share at least. Each row is compared with one of the leaders of these columns; then all pairs that meet
    in one and are still in different components are, in blocks of rows.
    """
    first = F.expr(f"n - ({percent} * n + 99) DIV 100 + 1 - alone").cast("int")
    posts = written(rows.select("node", "n", "weight", "alone", F.posexplode(F.slice("cols", 1, first)).alias("pos", "h")).select("h", "node", "n", "weight", (F.col("pos") + F.col("alone")).alias("pos")), "posts")
    leaders = written(posts.groupBy("h").agg(F.max(F.struct("weight", "node")).alias("top"), F.count(F.lit(1)).alias("m")).where("m > 1").select("h", F.col("top.node").alias("b")), "leaders")
    offers = posts.join(leaders, "h").where("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("c"))
    best = offers.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
    tested = written(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    linked = _overlaps(tested, rows, percent)
    label = written(components(linked), "labels")

    named = written(posts.join(label.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component", "weight"), "named")
    parts = F.ceil(F.count(F.lit(1)) / ROWS).cast("int")
    mixed = written(named.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y"), parts.alias("parts")).where("x <> y").select("h", "parts"), "mixed")
    dealt = named.join(mixed, "h").withColumn("deal", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    side = lambda x: [F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("pos").alias(f"pos_{x}"), F.col("label").alias(f"label_{x}")]
    a, b = dealt.select("h", F.col("deal").alias("i"), other.alias("j"), *side("a")), dealt.select("h", other.alias("i"), F.col("deal").alias("j"), *side("b"))
    least = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) DIV {100 + percent}")
    meet = (F.col("pos_a") <= F.col("n_a") - least) & (F.col("pos_b") <= F.col("n_b") - least)
    met = a.join(b, ["h", "i", "j"]).where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & meet)
    # Columns are in one order in all rows: after the last that both have here, each can share what it has left at most.
    summed = met.groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("c"), F.max("pos_a").alias("pos_a"), F.max("pos_b").alias("pos_b"))
    apart = summed.where(F.col("c") + F.least(F.expr("n_a - pos_a - 1"), F.expr("n_b - pos_b - 1")) >= least).select("a", "b")
    more = _overlaps(apart.join(tested, ["a", "b"], "left_anti"), rows, percent)
    used = [posts, leaders, tested, named, mixed, linked, more]
    if more.isEmpty():
        final = label
    else:
        final = written(components(linked.unionByName(more)), "labels")
        used.append(label)
    released(*used)
    return final


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, ``n_shingles`` and ``component_id``. Documents link if 100 * |A and B| >= percent * |A or B|.

    ``component_id`` is the smallest id reachable by links. Texts with equal sets link; a null text,
    or one without words, has an empty set and links with nothing. Every row keeps a result: rows
    that repeat an id are compared like others; a text that only rows without id have links with its
    copies alone, and their component's id is null. Other columns aren't read. Sets and n-grams are
    compared by 64-bit hashes. An empty table gives no rows.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    profile = written(_profile(slim, size), "profile")
    nodes = written(profile.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("doc"), F.min("n").alias("n"), F.min("half").alias("half")), "nodes")
    n_nodes, total = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    # A row whose entries so far are alone too often can't share ``percent`` of itself with any other.
    short = F.greatest(F.shiftrightunsigned("node", 16), F.lit(1)).alias("short")
    shared = _shared_entries(slim, size, total, n_nodes).withColumnRenamed("n", "shared")
    may = f"coalesce(shared, 0) >= half - n * {100 - percent} DIV 100 AND doc IS NOT NULL"
    left = written(nodes.withColumn("short", short).join(shared, "short", "left").where(may).select("doc", "n"), "left")
    size_left = left.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = left.select(F.col("doc").alias("id")).distinct()
    rows, packs = _rows(slim.join(F.broadcast(asked) if size_left[0] <= MOST_BROADCAST else asked, "id"), size, percent, size_left[1])
    counted = rows.agg(F.count(F.lit(1)), F.count_distinct("node")).first()
    if counted[0] != counted[1]:  # rows that repeat an id gave a set to several packs
        again, rows = rows, written(rows.dropDuplicates(["node"]), "rows")
        released(again)

    final = _labels(rows, percent)
    released(left, packs, rows)
    rooted = nodes.select("node", "doc").join(final.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("component", "node"))
    smallest = written(rooted.where("component IS NOT NULL").groupBy("root").agg(F.min("doc").alias("least")), "smallest")
    found = rooted.join(smallest, "root", "left").select("node", F.coalesce("least", "doc").alias("component_id"))
    return profile.join(found, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: those with its smallest id. Of rows that repeat that id all stay; rows without an id stay."""
    found = jaccard_components(docs.select(id_col, text_col), size, percent, id_col, text_col)
    gone = found.where(f"`{id_col}` <> component_id").select(F.col(id_col).alias("__ql_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__ql_gone"], "left_anti")
