"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad, by features of the line and of its neighbours and by the label
before it. Forward-backward gives each line's chance of being good; weighted by the lines' lengths
these make the document's score. The field is trained here, on a bounded sample of labelled
documents whose lines take the document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import words_of

#: Kinds of bytes that features count.
_SMALL, _CAPITAL, _DIGIT, _SYMBOL, _BANG, _STOP, _WIDE, _OTHER = range(8)
_KIND = np.full(256, _OTHER, dtype=np.int64)
_KIND[ord("a") : ord("z") + 1] = _SMALL
_KIND[ord("A") : ord("Z") + 1] = _CAPITAL
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[[ord(c) for c in "#*$%&|<>"]] = _SYMBOL
_KIND[ord("!")] = _BANG
_KIND[[ord(c) for c in ".,;:?"]] = _STOP
_KIND[128:] = _WIDE
OWN = ("symbols", "symbols_high", "bangs", "bangs_high", "capitals", "capitals_high", "digits", "stops", "same_word", "same_word_high", "seen_word", "word_length", "long_words", "few_words", "empty", "log_length")
N_FEATURES = 3 * len(OWN) + 3


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of all texts, the lines' lengths in bytes (1 for an empty one), and where each text's lines start (and the next would)."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", dtype=np.uint8)
    breaks = np.flatnonzero(data == 10)
    length = np.diff(breaks) - 1
    n = len(length)
    line_of = np.repeat(np.arange(n), length + 1)
    kinds = np.bincount(line_of * 8 + _KIND[data[:-1]], minlength=8 * n).reshape(n, 8).astype(float)
    word, start, end, _ = words_of(texts)
    place = np.searchsorted(breaks, start) - 1
    words = np.bincount(place, minlength=n).astype(float)
    size = np.bincount(place, weights=end - start, minlength=n)
    same = np.zeros(len(word), dtype=bool)
    same[1:] = (word[1:] == word[:-1]) & (place[1:] == place[:-1])
    first = np.searchsorted(breaks, np.cumsum([0, *(len(r) + 1 for r in raw)]))
    doc = np.searchsorted(first, place, side="right") - 1
    # A pair of words that came before in its text.
    with np.errstate(over="ignore"):
        pair = (word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]) ^ (doc[:-1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    again = np.ones(len(word), dtype=bool)
    again[np.unique(pair, return_index=True)[1]] = False
    again[-1:] = False
    many = np.maximum(words, 1)
    letters = np.maximum(kinds[:, _SMALL] + kinds[:, _CAPITAL], 1)
    per_word = lambda k: np.minimum(kinds[:, k] / many, 2)
    capitals = kinds[:, _CAPITAL] / letters
    same_word = np.bincount(place, weights=same, minlength=n) / many
    seen = np.bincount(place, weights=again, minlength=n) / many
    mean = size / many
    own = np.stack([per_word(_SYMBOL), per_word(_SYMBOL) > 0.3, per_word(_BANG), per_word(_BANG) > 0.3, capitals, capitals > 0.4, per_word(_DIGIT), per_word(_STOP), same_word, same_word > 0.2, seen, np.minimum(mean / 10, 2), mean > 12, words < 5, words == 0, np.log1p(length) / 5], axis=1)
    begins, ends = np.zeros(n), np.zeros(n)
    begins[first[:-1]] = 1
    ends[first[1:] - 1] = 1
    before = np.vstack([np.zeros((1, own.shape[1])), own[:-1]]) * (1 - begins)[:, None]
    after = np.vstack([own[1:], np.zeros((1, own.shape[1]))]) * (1 - ends)[:, None]
    return np.hstack([own, before, after, begins[:, None], ends[:, None], np.ones((n, 1))]), np.maximum(length, 1), first


@dataclass
class Field:
    """Weights of a good line's features, and of each step from a label to a label (0 bad, 1 good)."""

    weights: np.ndarray
    steps: np.ndarray

    def marginals(self, features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chance of good for each line, and expected steps for each text (from, to)."""
        good = features @ self.weights
        score = np.stack([np.zeros(len(good)), good], axis=1)
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        start, length = first[:-1][order], length[order]
        ahead, back = score.copy(), np.zeros_like(score)
        most = int(length[0]) if len(length) else 0
        active = [int(np.searchsorted(-length, -t, side="left")) for t in range(most + 1)]
        for t in range(1, most):
            at = start[: active[t]] + t if length[active[t] - 1] > t else start[: int((length > t).sum())] + t
            ahead[at] += np.logaddexp(ahead[at - 1, :1] + self.steps[0], ahead[at - 1, 1:] + self.steps[1])
        pairs = np.zeros((len(length), 2, 2))
        whole = np.zeros(len(good))
        end = start + length - 1
        total = np.logaddexp(ahead[end, 0], ahead[end, 1])
        for t in range(most - 2, -1, -1):
            k = int((length > t + 1).sum())
            at = start[:k] + t
            onward = score[at + 1] + back[at + 1]
            both = self.steps[None] + onward[:, None, :]
            back[at] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            pairs[:k] += np.exp(ahead[at][:, :, None] + both - total[:k, None, None])
        whole[np.concatenate([np.arange(s, s + n) for s, n in zip(start, length, strict=True)]) if len(start) else []] = np.repeat(total, length)
        unsorted = np.zeros_like(pairs)
        unsorted[order] = pairs
        return np.exp(ahead[:, 1] + back[:, 1] - whole), unsorted


def fit(samples: list[tuple[np.ndarray, int]], rounds: int = 120, rate: float = 0.1, decay: float = 1e-4) -> Field:
    """Climbs the conditional likelihood of the lines' labels, each text weighing the same. ``samples`` are (features, label)."""
    field = Field(np.zeros(N_FEATURES), np.zeros((2, 2)))
    if not samples:
        return field
    features = np.vstack([f for f, _ in samples])
    length = np.array([len(f) for f, _ in samples])
    label = np.array([y for _, y in samples])
    first = np.concatenate([[0], np.cumsum(length)])
    share = np.repeat(1 / length, length) / len(samples)
    truth = np.repeat(label, length)
    seen = np.zeros((len(samples), 2, 2))
    seen[np.arange(len(samples)), label, label] = length - 1
    size = N_FEATURES + 4
    mean, spread = np.zeros(size), np.zeros(size)
    for k in range(1, rounds + 1):
        chance, pairs = field.marginals(features, first)
        slope = features.T @ ((truth - chance) * share)
        slope_steps = ((seen - pairs) / length[:, None, None]).mean(axis=0)
        g = np.concatenate([slope - decay * field.weights, slope_steps.ravel() - decay * field.steps.ravel()])
        mean, spread = 0.9 * mean + 0.1 * g, 0.999 * spread + 0.001 * g * g
        move = rate * (mean / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.999**k)) + 1e-9)
        field.weights += move[:N_FEATURES]
        field.steps += move[N_FEATURES:].reshape(2, 2)
    return field


def _in_groups(batches: Iterator[pa.RecordBatch], most_chars: int = 400_000) -> Iterator[tuple[list, list[str], list]]:
    for batch in batches:
        columns = [batch.column(k) for k in range(batch.num_columns)]
        group, chars = [], 0
        for row in zip(*columns, strict=True):
            text = row[1].as_py() or ""
            if group and chars + len(text) > most_chars:
                yield [list(x) for x in zip(*group, strict=True)]
                group, chars = [], 0
            group.append((row[0].as_py(), text, row[2].as_py() if len(row) > 2 else None))
            chars += len(text)
        if group:
            yield [list(x) for x in zip(*group, strict=True)]


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, most_lines: int = 200_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fits the field on at most ``most`` documents and ``most_lines`` lines of each label.

    Documents are taken by a hash of their ids; one whose lines are more than what is left is passed
    over, so the driver holds at most ``2 * most_lines`` lines' features whatever texts there are.
    ``labels`` has ids and labels 0 or 1; rows with a null don't count, and an id with several
    labels takes the highest. Rows that repeat an id are taken together. Texts with no label at all
    give a field that scores 0.5.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__ql_id")).agg(F.max(label_col).cast("int").alias("__ql_y"))
    first = [known.where(f"__ql_y = {y}").orderBy(F.xxhash64("__ql_id"), "__ql_id").limit(most) for y in (0, 1)]
    # At most 2 * ``most`` ids are broadcast, and as many line counts come back.
    texts_of = docs.select(F.col(id_col).alias("__ql_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__ql_text"))
    sizes = texts_of.join(F.broadcast(first[0].unionByName(first[1])), "__ql_id").groupBy("__ql_id", "__ql_y").agg(F.sum(F.size(F.split("__ql_text", "\n")).cast("long")).alias("lines"))
    left, taken = [most_lines, most_lines], []
    for r in sizes.orderBy(F.xxhash64("__ql_id"), "__ql_id").collect():
        if r["lines"] <= left[r["__ql_y"]]:
            left[r["__ql_y"]] -= r["lines"]
            taken.append((r["__ql_id"], r["__ql_y"]))
    kind = sizes.schema["__ql_id"].dataType.simpleString()
    chosen = texts_of.join(F.broadcast(docs.sparkSession.createDataFrame(taken, f"__ql_id {kind}, __ql_y int")), "__ql_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, ys in _in_groups(batches):
            features, _, first = line_features(texts)
            parts = [features[a:b].astype(np.float32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, type=pa.binary()), pa.array(ys, type=pa.int32())], ["features", "y"])

    rows = chosen.mapInArrow(run, "features binary, y int").collect()
    rows.sort(key=lambda r: (r["y"], bytes(r["features"])))  # the same sum in any order of tasks
    return fit([(np.frombuffer(r["features"], dtype=np.float32).reshape(-1, N_FEATURES).astype(float), r["y"]) for r in rows])


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id and ``score``, the length-weighted chance of its lines to be good, from 0 to 1.

    A null or empty text is one empty line of weight 1. Rows are scored one by one: repeated rows
    get equal scores, null ids stay; other columns aren't read. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_of = None

        def typed():
            nonlocal type_of
            for b in batches:
                type_of = b.schema.field(0).type
                yield b

        for ids, texts, _ in _in_groups(typed()):
            features, length, first = line_features(texts)
            chance, _ = field.marginals(features, first)
            weighted = np.add.reduceat(chance * length, first[:-1]) / np.add.reduceat(length, first[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=type_of), pa.array(np.clip(weighted, 0, 1), type=pa.float64())], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def accepted(docs: DataFrame, field: Field, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``least`` or more; null and empty texts are scored as one empty line."""
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = pa.array(range(batch.num_rows), type=pa.int64())
            keep = np.zeros(batch.num_rows, dtype=bool)
            for rows, texts, _ in _in_groups([pa.RecordBatch.from_arrays([place, batch.column(at)], ["place", "text"])]):
                features, length, first = line_features(texts)
                chance, _ = field.marginals(features, first)
                keep[rows] = np.add.reduceat(chance * length, first[:-1]) / np.add.reduceat(length, first[:-1]) >= least
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
