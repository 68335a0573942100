"""Packing documents into training sequences by cutting-stock column generation.

Documents are tokenised once and cut at multiples of the sequence length. The pieces' lengths give
a histogram over a fixed number of length classes. A linear program over patterns (how many pieces
of each class fill a sequence) is solved by column generation, where a knapsack dynamic program
prices the columns. Rounded patterns say which ranks within each class go to which sequence.
Only the histogram and the patterns are on the driver, and the number of classes bounds both.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Length classes; a class is this share of a sequence.
CLASSES = 256
#: Words whose ids a Python worker keeps, in each of two generations.
MOST_WORDS = 150_000
END_ID = 1

_PLAIN = frozenset('.,!?;:|#$%&*"=()')
#: White space next to white space, but for two line ends before another character.
_BLANK = r"\t\x0b\f\r \x1c-\x1f\x{85}\p{Z}"
ODD = rf"[{_BLANK}][\n{_BLANK}]|\n[{_BLANK}]|\n\n\n|\n\n\z"
#: A letter before a character that is neither letter, number nor apostrophe: there a token ends.
_BREAK = r"(\p{L})([^\s\p{L}\p{N}'\x{85}\p{Z}\x1c-\x1f])"
#: Units that begin their text, that end it, and that have no space before them; and what stands between units.
FIRST, LAST, GLUED, BETWEEN = "\r", "\r\n", "\x01", "\x1f"
_WORD_START = re.compile(r"(?<=\S) (?=\S)")
#: Longest unit, in bytes, that is merged along with others.
MOST_BYTES = 48


class Merges:
    """Byte-pair merges of many words at a time: in each round every word makes its best merge, the leftmost of equal ones."""

    def __init__(self, tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        vocab, self.size = model["vocab"], 1 << 20
        visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        # The letter that byte-level vocabularies write for a byte: itself if visible, else the next one from U+0100 on.
        hidden = iter(range(0x100, 0x200))
        self.of_byte = np.array([vocab[chr(b if b in visible else next(hidden))] for b in range(256)], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.made))

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian 32-bit numbers; no word is empty."""
        never, out = len(self.made), [b""] * len(words)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbol = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word, name = np.repeat(np.arange(len(words)), length), np.arange(len(words))
        rank = np.full(len(symbol), never)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        while len(symbol):
            start = np.cumsum(length) - length
            best = np.minimum.reduceat(rank, start)
            done = best == never
            if done.any():
                gone = np.repeat(done, length)
                blob, at = symbol[gone].astype("<u4").tobytes(), 0
                for k, n in zip(name[done].tolist(), (4 * length[done]).tolist(), strict=True):
                    out[k] = blob[at : at + n]
                    at += n
                symbol, rank, word, length, name, best = symbol[~gone], rank[~gone], word[~gone], length[~done], name[~done], best[~done]
                continue
            at = np.flatnonzero(rank == np.repeat(best, length))
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            symbol[at] = self.made[best]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            place = at - np.arange(len(at))  # where the merged symbols stand after the others are gone
            symbol, rank, word, length = symbol[keep], rank[keep], word[keep], length - 1
            for left in (place[place > 0] - 1, place[place < len(symbol) - 1]):
                left = left[word[left] == word[left + 1]]
                rank[left] = self.rank(symbol[left], symbol[left + 1])
            ends = np.cumsum(length) - 1
            rank[ends] = never
        return out


class WordIds:
    """Ids of texts as little-endian 32-bit numbers.

    The tokenizer starts a new token at a single space between two other characters, at each of
    one or two line ends, and where other signs follow a letter. So where blanks don't meet
    otherwise a text's ids are those of its units: a word with the space before it, a line end, or
    what has no space before it. A batch is cut into units, and each that is new is merged along
    with all others. Texts in which blanks meet are cut only at single spaces. Units of several
    tokens, and texts with tokens of their own (such as an end of text), go to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(self.tokenizer)
        self.whole = "|".join([GLUED, BETWEEN, *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def raw(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def units(self, units: list[str]) -> list[bytes]:
        """The ids of different units. Those asked for last are remembered, in two generations."""
        known, old, new, whole = self.known, self.old, [], []
        for u in units:
            if u not in known:
                if u in old:
                    known[u] = old[u]
                else:
                    new.append(u)
        for u in new:
            head = u[0] if u else ""
            text = u[1:] if head == FIRST or head == GLUED else u if head == "\n" else " " + u
            word = text[1:] if text[:1] == " " else text
            if len(word) <= MOST_BYTES and (word.isalpha() and max(word) < "\u0500" or word and _PLAIN.issuperset(word)):
                whole.append((u, text.encode()))
            else:
                known[u] = self.raw(text)
        if whole:
            known.update(zip([u for u, _ in whole], self.merges.ids([t for _, t in whole]), strict=True))
        found = [known[u] for u in units]
        if len(known) > MOST_WORDS:
            self.known, self.old = {}, known
        return found

    def texts(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), ``end`` after each, and where each text's ids start (and the next would)."""
        whole = pc.match_substring_regex(texts, self.whole)
        rest = pc.if_else(whole, "", texts)
        odd = pc.match_substring_regex(rest, ODD).to_numpy(zero_copy_only=False)
        broken = pc.replace_substring_regex(pc.replace_substring(rest, "\n", f" \n {GLUED}"), _BREAK, rf"\1 {GLUED}\2")
        cuttable = pc.replace_substring(broken, " ", BETWEEN)
        if odd.any():
            by_word = pa.array([BETWEEN.join(_WORD_START.split(t)) for t in rest.filter(pa.array(odd)).to_pylist()], type=pa.string())
            cuttable = pc.replace_with_mask(cuttable, pa.array(odd), by_word)
        cut = pc.split_pattern(pc.binary_join_element_wise(FIRST, cuttable, BETWEEN + LAST, ""), BETWEEN)
        units = cut.flatten().dictionary_encode()
        names = units.dictionary.to_pylist()
        values = self.units([u for u in names if u != LAST])
        values.insert(names.index(LAST), end)
        whole = whole.to_numpy(zero_copy_only=False)
        values += [self.raw(texts[k].as_py()) + end for k in np.flatnonzero(whole)]
        at = units.indices.to_numpy().copy()
        first = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        # A text for the tokenizer was cut as an empty one, into its begin and its end.
        begin = first[:-1][whole]
        at[begin] = np.arange(len(values) - len(begin), len(values))
        at[begin + 1] = names.index(FIRST) if len(begin) else 0
        length = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        flat, start = np.frombuffer(b"".join(values), dtype="<u4"), np.cumsum(length) - length
        n = length[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(start[at] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[first]


def _groups(texts: pa.Array, most: int = 3_000_000) -> list[tuple[int, int]]:
    """Cuts a batch into spans of texts with about ``most`` bytes; a longer text comes alone."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = np.flatnonzero(np.diff(size // most)) + 1
    return [(a, b) for a, b in zip([0, *at], [*at, len(size)], strict=True) if b > a]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def tokenised_pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = END_ID, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, and with ``keep_ids`` the piece's ids.

    Each text's ids and then ``end_id`` are cut at multiples of ``length``.
    """
    kind = docs.schema[id_col].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        last = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in _groups(texts):
                ids, first = words.texts(texts.slice(a, b - a), last)
                total = np.diff(first)
                pieces = -(-total // length)
                own = np.repeat(np.arange(b - a), pieces)
                start = (np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
                size = np.minimum(total[own] - start, length)
                begin = first[own] + start
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * x : 4 * (x + n)]) for x, n in zip(begin.tolist(), size.tolist(), strict=True)]
                arrays = [batch.column(0).take(pa.array(own + a)), *(pa.array(c, type=pa.int64()) for c in (start, size, crc, total[own]))]
                if keep_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), type=pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, schema)


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of classes 1..n with total size up to ``capacity``: its value, and how many of each class."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=int)
    for room in range(1, capacity + 1):
        n = min(room, len(values))
        sums = best[room - 1 :: -1][:n] + values[:n]
        k = int(sums.argmax())
        best[room], pick[room] = (sums[k], k + 1) if sums[k] > best[room - 1] else (best[room - 1], 0)
    counts, room = np.zeros(len(values), dtype=int), capacity
    while room > 0:
        size = pick[room]
        if size:
            counts[size - 1] += 1
        room -= max(size, 1)
    return float(best[capacity]), counts


def patterns(histogram: np.ndarray, gap: float = 5e-4, most_rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, so that every piece of the histogram has a place.

    ``histogram[k]`` counts pieces of class k + 1; a sequence has room for ``len(histogram)`` units.
    Columns are added until the relaxed program is within ``gap`` of its optimum. Its solution is rounded down; what stays over, less than one use of each
    pattern, is placed by first fit in decreasing order.
    """
    room = len(histogram)
    used = np.flatnonzero(histogram)
    if not len(used):
        return []
    demand = histogram[used].astype(float)
    columns = np.diag((room // (used + 1)).astype(float))
    inverse = np.diag(1 / columns.diagonal())
    values = np.zeros(room)
    for _ in range(most_rounds):
        values[used] = np.maximum(inverse.sum(axis=0), 0)
        worth, counts = knapsack(values, room)
        if worth <= 1 + gap:
            break
        step, level = (inverse * counts[used]).sum(axis=1), (inverse * demand).sum(axis=1)
        ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        k = int(ratio.argmin())
        columns[:, k] = counts[used]
        row = inverse[k] / step[k]
        inverse -= np.outer(step, row)
        inverse[k] = row
    level = (inverse * demand).sum(axis=1)
    found: dict[tuple[int, ...], int] = {}
    left = histogram.astype(int).copy()
    for k in np.argsort(-level):
        column = np.zeros(room, dtype=int)
        column[used] = columns[:, k].round().astype(int)
        times = int(max(0, np.floor(level[k] + 1e-6)))
        times = min([times, *(left[column > 0] // column[column > 0])])
        if times:
            found[tuple(column)] = found.get(tuple(column), 0) + times
            left -= times * column
    bins: list[list[int]] = []
    free: list[int] = []
    for size in range(room, 0, -1):
        for _ in range(left[size - 1]):
            k = next((i for i, f in enumerate(free) if f >= size), None)
            if k is None:
                bins.append([])
                free.append(room)
                k = len(bins) - 1
            bins[k].append(size)
            free[k] -= size
    for sizes in bins:
        column = tuple(np.bincount(np.array(sizes) - 1, minlength=room))
        found[column] = found.get(column, 0) + 1
    return [(np.array(c), n) for c, n in found.items()]


def places(found: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """For each class and pattern: class, its ranks from and to, pieces of it in a sequence, and the pattern's first sequence."""
    rows, first = [], 0
    at = np.zeros(len(found[0][0]) if found else 0, dtype=int)
    for column, times in found:
        for k in np.flatnonzero(column):
            rows.append((int(k) + 1, int(at[k]), int(at[k] + times * column[k]), int(column[k]), first))
            at[k] += times * column[k]
        first += times
    return rows


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = END_ID, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 5_000) -> DataFrame:
    """Packs all documents into sequences of at most ``length`` tokens.

    Returns one row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and
    offset, and ``ids`` if ``keep_ids``. A null or empty text is its end id alone, so every row of
    ``docs`` has a piece; repeated rows are packed as often as they come, null ids stay null; other
    columns aren't read. An empty table gives no rows. A piece is never cut for a better fit, only
    at multiples of ``length``; padding comes from rounding lengths up to classes
    (``length / 256``) and from the last few sequences. If classes don't divide ``length``, longer
    pieces than its whole units have a class of their own and a sequence each.
    """
    spark = docs.sparkSession
    pieces = written(tokenised_pieces(docs, tokenizer, length, end_id, keep_ids, id_col, text_col), "pieces")
    unit = -(-length // CLASSES)
    classed = pieces.withColumn("__ql_class", F.ceil(F.col("length") / unit).cast("int"))
    counts = {r[0]: r[1] for r in classed.groupBy("__ql_class").count().collect()}
    room = length // unit
    histogram = np.array([counts.get(k + 1, 0) for k in range(room)])
    found = [(np.append(column, 0), times) for column, times in patterns(histogram)]
    alone = counts.get(room + 1, 0)
    if alone:
        found.append((np.eye(room + 1, dtype=int)[room], alone))
    rows = places(found)
    plan = spark.createDataFrame(rows or [(0, 0, 0, 1, 0)], "__ql_class int, __ql_from long, __ql_to long, __ql_each long, __ql_first long")
    # Ranks within a class: its pieces are dealt into buckets, ranked there, and moved up by the buckets before.
    buckets = (int(histogram.sum()) + alone) // bucket_rows + 1
    dealt = classed.withColumn("__ql_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = dealt.groupBy("__ql_class", "__ql_bucket").agg(F.count(F.lit(1)).alias("__ql_n"))
    upto = Window.partitionBy("__ql_class").orderBy("__ql_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("__ql_class", "__ql_bucket", F.coalesce(F.sum("__ql_n").over(upto), F.lit(0)).alias("__ql_before"))
    own = Window.partitionBy("__ql_class", "__ql_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("__ql_rank", F.row_number().over(own)).join(before, ["__ql_class", "__ql_bucket"]).withColumn("__ql_rank", F.col("__ql_rank") - 1 + F.col("__ql_before"))
    # The plan has a row for each class of each pattern, at most CLASSES patterns and those of the remainder.
    placed = ranked.join(F.broadcast(plan), "__ql_class").where("__ql_rank >= __ql_from AND __ql_rank < __ql_to")
    placed = placed.withColumn("sequence_id", F.expr("__ql_first + (__ql_rank - __ql_from) DIV __ql_each"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "__ql_rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(*pieces.columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves from pieces with their ids: sequence_id, ids and n_tokens. A sequence has a bounded number of pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
    return joined.withColumn("n_tokens", F.size("ids").cast("long"))
