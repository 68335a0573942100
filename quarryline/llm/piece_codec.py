"""Exact encoding with a merge-type (BPE) piece model by backtracking, and decoding.

A word is a run of spaces and what follows up to the next space; no piece of such a model goes on
past the end of a word, so words are encoded one by one. Within a word, an Aho-Corasick automaton
gives the pieces that start at each place, longest first. Going from left to right, a piece is
taken if it and the piece before it stay apart when their text is merged anew; if none fits, the
place is marked as failed in a bitfield and the piece before it gives way to a shorter one.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent

#: How the model writes a space.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words in each of two generations, and pairs of pieces, that a Python worker remembers.
MOST_WORDS = 250_000
MOST_PAIRS = 400_000
_NEVER = float("inf")
_WORD = re.compile(" +[^ ]*")


def model_pieces(data: bytes) -> list[tuple[str, float, int]]:
    """Text, score and type of each piece, from the model file's protocol-buffer fields."""

    def fields(buf: memoryview) -> Iterator[tuple[int, object]]:
        at = 0

        def varint() -> int:
            nonlocal at
            out = shift = 0
            while True:
                b = buf[at]
                at += 1
                out |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return out

        while at < len(buf):
            tag = varint()
            number, wire = tag >> 3, tag & 7
            if wire == 0:
                yield number, varint()
            elif wire == 2:
                n = varint()
                yield number, buf[at : at + n]
                at += n
            else:
                n = 4 if wire == 5 else 8
                yield number, buf[at : at + n]
                at += n

    found = []
    for number, value in fields(memoryview(data)):
        if number == 1:
            piece = dict(fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            found.append((bytes(piece[1]).decode(), score, piece.get(3, NORMAL)))
    return found


class PieceModel:
    """Encoder and decoder; ranks order the merges, the best score first."""

    def __init__(self, data: bytes):
        pieces = model_pieces(data)
        self.texts = [p[0] for p in pieces]
        self.bytes = {int(t[1:-1], 16): k for k, (t, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.silent = {k for k, (_, _, kind) in enumerate(pieces) if kind == CONTROL}
        self.unknown = next((k for k, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        scored = sorted({-s for _, s, kind in pieces if kind == NORMAL})
        place = {s: k for k, s in enumerate(scored)}
        self.ids = {t: k for k, (t, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.rank = {t: place[-s] for t, s, kind in pieces if kind == NORMAL}
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("pieces of this model go on past the end of a word")
        n_by_rank: dict[int, int] = {}
        for r in self.rank.values():
            n_by_rank[r] = n_by_rank.get(r, 0) + 1
        self.tied = {t for t, r in self.rank.items() if n_by_rank[r] > 1 and len(t) > 1}
        self._edges: dict[str, tuple[list, list] | None] = {}
        self._apart: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t in self.ids:
            if len(t) == 1 or self.edges(t) or self.merged(t)[0] == [t]:  # other pieces can't come from merging
                self.automaton.add_word(t, t)
        self.automaton.make_automaton()
        self.plain = set(self.ids.values())
        self.neighbours = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        self._shorter: dict[str, str | None] = {}
        self._fragments = Recent(self._backtrack, MOST_WORDS)

    def merged(self, text: str) -> tuple[list[str], list[tuple[int, str, str]]]:
        """The pieces of ``text`` by merging the best pair again and again, the leftmost first; and the merges made."""
        parts, made, rank = list(text), [], self.rank
        while len(parts) > 1:
            best, at = min((rank.get(a + b, _NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best is _NEVER:
                break
            made.append((best, parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, made

    def edges(self, piece: str) -> tuple[list, list] | None:
        """What stands at the right end and at the left end of ``piece`` as it is merged, from whole to character: text, rank it comes at, rank it goes at. None if its merges don't come in the order of ranks, or if merging doesn't give it."""
        if piece not in self._edges:
            parts, made = self.merged(piece)
            ranks = [m[0] for m in made]
            sound = len(parts) == 1 and ranks == sorted(ranks) and not any(a + b in self.tied for _, a, b in made)
            self._edges[piece] = None
            if sound:
                halves = {a + b: (a, b) for _, a, b in made}
                ends = []
                for side in (1, 0):
                    text, goes, steps = piece, _NEVER, []
                    while text in halves:
                        steps.append((text, self.rank[text], goes))
                        goes, text = self.rank[text], halves[text][side]
                    steps.append((text, -1, goes))
                    ends.append(steps)
                self._edges[piece] = (ends[0], ends[1])
        return self._edges[piece]

    def apart(self, left: str, right: str) -> bool:
        """Whether the two pieces stay apart when their text is merged anew."""
        key = left, right
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= MOST_PAIRS:
                self._apart.clear()
            known = self._apart[key] = self._stay(left, right)
        return known

    def _stay(self, left: str, right: str) -> bool:
        a, b = self.edges(left), self.edges(right)
        if a is None or b is None:
            return self.merged(left + right)[0] == [left, right]
        rank, i, j = self.rank, 0, 0
        ends, starts = a[0], b[1]
        while True:
            x, x_comes, x_goes = ends[i]
            y, y_comes, y_goes = starts[j]
            both = rank.get(x + y)
            # Two merges of the same rank: the one further left comes first.
            if both is not None and both < x_goes and both <= y_goes:
                return False
            if x_comes < 0 and y_comes < 0:
                return True
            # Back in time: the end that came last is taken apart.
            if x_comes >= y_comes:
                i += 1
            else:
                j += 1

    def longest(self, word: str, at: int) -> str | None:
        """The longest piece that starts at ``at``."""
        for end, t in self.automaton.iter_long(word, at):
            return t if end - len(t) + 1 == at else None
        return None

    def shorter(self, piece: str) -> str | None:
        """The next shorter piece that ``piece`` starts with."""
        if piece not in self._shorter:
            self._shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.automaton), None)
        return self._shorter[piece]

    def fragments(self, word: str) -> list[str]:
        """Cuts a word between characters that no piece holds side by side."""
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.neighbours]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def word(self, word: str) -> list[int]:
        """Ids of a word; characters that are no pieces become their bytes."""
        out: list[int] = []
        for part in self.fragments(word):
            out += self._fragments[part]
        return out

    def _backtrack(self, word: str) -> list[int]:
        stop = len(word)
        taken: list[str] = []
        failed = 0  # bit p: from place p on there is no way to the end
        at, last, known = 0, "", self._apart
        t = self.longest(word, 0)
        if t is None:  # then it is a single character, as no piece holds it
            return [self.bytes.get(b, self.unknown) for b in word.encode()]
        while True:
            while t is not None:
                if not failed >> (at + len(t)) & 1:
                    if not last:
                        break
                    fits = known.get((last, t))
                    if self.apart(last, t) if fits is None else fits:
                        break
                t = self.shorter(t)
            if t is not None:
                taken.append(t)
                last = t
                at += len(t)
                if at == stop:
                    return [self.ids[t] for t in taken]
                t = self.longest(word, at)
            else:
                failed |= 1 << at
                gone = taken.pop()
                at -= len(gone)
                t = self.shorter(gone)
                last = taken[-1] if taken else ""

    def encode(self, text: str) -> list[int]:
        return [i for w in words(text) for i in self.word(SPACE + w.replace(" ", SPACE))]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that make no character become replacement characters, and the space before the text goes."""
        text = self.pieces_text(ids)
        return text[1:] if text.startswith(" ") else text

    def pieces_text(self, ids: list[int]) -> str:
        if self.plain.issuperset(ids):
            return "".join([self.texts[i] for i in ids]).replace(SPACE, " ")
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending = bytearray()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.texts[i].replace(SPACE, " "))
        return "".join(out) + pending.decode(errors="replace")


def words(text: str) -> list[str]:
    """The words of a text, each without the one space before it (the first word's is added by the model)."""
    if not text:
        return []
    text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " ":
        return [w[1:] for w in _WORD.findall(" " + text)]
    return text.split(" ")


class WordMemory:
    """``ids`` has a word's ids joined by commas. ``odd``: some word's ids decode to other text than a space and the word."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.odd = False
        self.ids = Recent(self.encoded, MOST_WORDS)

    def encoded(self, word: str) -> str:
        ids = self.model.word(SPACE + word.replace(" ", SPACE))
        self.odd = self.odd or self.model.pieces_text(ids) != " " + word
        return ",".join(map(str, ids))

    def decoded(self, split: list[str]) -> str:
        """What the ids of these words decode to."""
        if not self.odd:
            return " " + " ".join(split)
        return self.model.pieces_text([int(i) for w in split for i in self.ids[w].split(",")])


_loaded: dict[str, WordMemory] = {}


def memory(path: str) -> WordMemory:
    """One for each Python worker."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = WordMemory(PieceModel(f.read()))
    return _loaded[path]


#: What ``encode_documents`` can give for each text.
OUTPUTS = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, model: str, outputs: tuple[str, ...] = ("ids",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text with the model file at ``model``, a path that each executor has.

    Returns ``doc_id`` and ``outputs``, of ``OUTPUTS``. A null text counts as empty: no ids, and an
    empty text again. Rows are taken one by one, so repeated rows and null ids give equal results;
    other columns aren't read. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memory(model)
        types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
        for batch in batches:
            columns: dict[str, list] = {o: [] for o in outputs}
            for text in batch.column(1):
                split = words(text.as_py() or "")
                ids = ",".join(map(known.ids.__getitem__, split))
                if "ids" in columns:
                    columns["ids"].append(np.fromstring(ids, dtype=np.int32, sep=","))
                if "n_tokens" in columns:
                    columns["n_tokens"].append(ids.count(",") + 1 if ids else 0)
                if "ids_sha256" in columns:
                    columns["ids_sha256"].append(sha(ids))
                if "decoded" in columns or "decoded_sha256" in columns:
                    back = known.decoded(split)[1:] if split else ""
                    if "decoded" in columns:
                        columns["decoded"].append(back)
                    if "decoded_sha256" in columns:
                        columns["decoded_sha256"].append(sha(back))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, type=types.get(o, pa.string())) for o, v in columns.items())], ["doc_id", *outputs])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind.simpleString()}, " + ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs))


def decode_ids(encoded: DataFrame, model: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the text of ``ids_col``; null ids give null. An input column ``out`` is replaced."""

    @F.pandas_udf("string")
    def texts(column):
        m = memory(model).model
        return column.map(lambda ids: None if ids is None else m.decode(list(ids)))

    return encoded.withColumn(out, texts(ids_col))
