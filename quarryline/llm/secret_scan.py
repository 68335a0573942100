"""Secret scan by a trigram inverted index, with DataFrame functions only.

Each rule's regex gives a Boolean query over trigrams: the text must hold all trigrams of one of
the query's alternatives. The index has postings for the trigrams that the rules ask for; the
postings are intersected per alternative, and the regex verifies the candidates. A rule whose
regex has no mandatory trigram scans every text. Regexes are read by the parser of Python's re
module, under the names that it has since Python 3.11.
"""

from __future__ import annotations

import re._constants as op
import re._parser as sre
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without, written


@dataclass(frozen=True)
class SecretRule:
    """Leftmost non-overlapping matches of ``pattern``; those fail whose ``group`` is shorter than ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Order decides between spans with the same start.
BASE_RULES: tuple[SecretRule, ...] = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES: tuple[SecretRule, ...] = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

#: Candidates (a key and a few kinds each) that are broadcast.
MOST_BROADCAST = 200_000
#: Spans that are put together at a time, and characters in a piece of a text that is cut up.
RUN, PIECE = 256, 1024
#: Above so many alternatives a part of a regex counts as unknown text.
MOST_WORDINGS = 32


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, each a set of lower-case trigrams that every match must hold; None if some match need hold none."""

    def literals(items) -> list[set[tuple[str, ...]]]:
        """For a sequence: its possible wordings, each a tuple of literal runs with unknown text between them."""
        wordings: set[tuple[str, ...]] = {("",)}
        for kind, arg in items:
            more = piece(kind, arg)
            joined = {w[:-1] + (w[-1] + m[0], *m[1:]) for w in wordings for m in more}
            wordings = joined if len(joined) <= MOST_WORDINGS else {w + ("",) for w in wordings}
        return wordings

    def piece(kind, arg) -> set[tuple[str, ...]]:
        unknown = {("", "")}
        if kind is op.LITERAL:
            return {(chr(arg).lower(),)}
        if kind is op.IN and all(k is op.LITERAL for k, _ in arg):
            return {(chr(c).lower(),) for _, c in arg}
        if kind is op.SUBPATTERN:
            return literals(arg[3])
        if kind is op.BRANCH:
            return set().union(*(literals(x) for x in arg[1]))
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, what = arg
            inner = literals(what)
            if (least, most) == (0, 1):
                return inner | {("",)}
            if least:
                return {(*m, "") for m in inner}
        return unknown

    grams = {frozenset(r[i : i + 3] for r in w for i in range(len(r) - 2)) for w in literals(sre.parse(pattern))}
    return None if frozenset() in grams else sorted(grams, key=sorted)


def candidates(docs: DataFrame, rules: Sequence[SecretRule]) -> DataFrame:
    """``__ql_key`` and the kinds whose trigram query a text answers. ``docs`` has ``__ql_key`` and ``__ql_text``.

    One posting is a trigram and a text's key; only trigrams that some rule asks for are posted.
    """
    terms = [(r.kind, k, t) for r in rules for k, alt in enumerate(trigram_query(r.pattern) or []) for t in sorted(alt)]
    need: dict[tuple[str, int], int] = {}
    asks: dict[str, list[tuple[str, int]]] = {}
    for kind, k, t in terms:
        need[kind, k] = need.get((kind, k), 0) + 1
        asks.setdefault(t, []).append((kind, k))
    # Lower case of other letters doesn't matter here: it can only add a candidate.
    low = docs.select("__ql_key", F.lower("__ql_text").alias("__ql_low"))
    # A filter that is always true would go; a projection that many conditions read stays below them.
    postings = low.select("__ql_key", F.explode(F.array_compact(F.array(*[F.when(F.contains("__ql_low", F.lit(t)), F.lit(t)) for t in asks]))).alias("gram"))
    lists = F.create_map(*[x for t, who in asks.items() for x in (F.lit(t), F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("alt"), F.lit(need[kind, k]).alias("need")) for kind, k in who]))])
    # Equal rows share a key; each trigram of a text counts once.
    asked = postings.distinct().select("__ql_key", F.inline(lists[F.col("gram")]))
    full = asked.groupBy("__ql_key", "kind", "alt", "need").agg(F.count(F.lit(1)).alias("n")).where("n = need")
    return full.groupBy("__ql_key").agg(F.collect_set("kind").alias("__ql_kinds"))


def _with(value: Column, use) -> Column:
    """``use(value)``, with the value made once, however often it is read."""
    return F.transform(F.array(value), use)[0]


def _in_runs(items: Column, start: Column, run, join) -> Column:
    """Goes through an array in runs of RUN items: ``run(state, items of a run)`` gives what a run makes, ``join(state, that)`` the state after it. A state grows by whole runs, so an array of any length takes little more than linear time."""
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / RUN).cast("int"))
    return F.aggregate(starts, start, lambda acc, k: _with(run(acc, F.slice(items, k * RUN + 1, F.lit(RUN))), lambda made: join(acc, made)))


def _spans(text: Column, rule: SecretRule, order: int) -> Column:
    """Start, kind and end of the rule's matches, from the matches and the text between them."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern)
    none = F.array().cast("array<struct<start:int,kind_at:int,end:int,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["0"])
        end = start + F.char_length(x["1"])
        checked = x["1"] if not rule.group else F.regexp_extract(x["1"], rule.pattern, rule.group)
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind_at"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        good = x["1"].isNotNull() & (F.char_length(checked) >= rule.least)
        return F.struct(F.coalesce(end, start).alias("at"), F.when(good, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def run(acc: Column, items: Column) -> Column:
        return F.aggregate(items, F.struct(acc["at"].alias("at"), none.alias("out")), step)

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    join = lambda acc, made: F.struct(made["at"].alias("at"), F.concat(acc["out"], made["out"]).alias("out"))
    found = _with(F.arrays_zip(between.alias("0"), matches.alias("1")), lambda parts: _in_runs(parts, start, run, join)["out"])
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(none)


def find_secrets(docs: DataFrame, rules: Sequence[SecretRule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``secrets``: the spans of every rule by start, then by the rule's place (start, kind_at, end, kind; code points, end exclusive).

    Null texts count as empty and have no spans. Postings are kept by a hash of id and text, so null
    ids and repeated rows are scanned like any other row. An input column ``secrets`` is replaced.
    """
    base = docs.select(*without(docs, "secrets"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__ql_text"), F.xxhash64(id_col, text_col).alias("__ql_key"))
    # Few candidates go to every task, so texts stay where they are; more are joined by a shuffle.
    found_in = written(candidates(base, rules), "candidates")
    joined = base.join(F.broadcast(found_in) if found_in.count() <= MOST_BROADCAST else found_in, "__ql_key", "left")
    text = F.col("__ql_text")
    spans = []
    for k, r in enumerate(rules):
        found = _spans(text, r, k)
        scans = trigram_query(r.pattern) is None
        spans.append(found if scans else F.when(F.array_contains("__ql_kinds", r.kind), found).otherwise(F.array().cast("array<struct<start:int,kind_at:int,end:int,kind:string>>")))
    return joined.withColumn("secrets", F.array_sort(F.concat(*spans))).select(*without(docs, "secrets"), "secrets")


def redact(found: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """Replaces each span of ``secrets`` in the text by ``mark``; spans that overlap are replaced once. A null text stays null."""
    text = F.col(f"`{text_col}`")
    empty = F.array().cast("array<string>")

    def part(pieces: Column, start: Column, end: Column) -> Column:
        """The text from ``start`` to ``end``, out of pieces of PIECE characters: a character is found by its piece, not from the text's begin."""
        i, j = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
        first = F.substring(F.get(pieces, i), F.pmod(start, F.lit(PIECE)) + 1, F.lit(PIECE))
        last = F.substring(F.get(pieces, j), F.lit(1), F.pmod(end - 1, F.lit(PIECE)) + 1)
        one = F.substring(F.get(pieces, i), F.pmod(start, F.lit(PIECE)) + 1, end - start)
        several = F.concat(first, F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), last)
        return F.when(start >= end, "").when(i == j, one).otherwise(several)

    def marked(pieces: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            clear = x["start"] >= acc["at"]
            said = F.array(F.concat(part(pieces, acc["at"], x["start"]), F.lit(mark)))
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(clear, F.concat(acc["out"], said)).otherwise(acc["out"]).alias("out"))

        run = lambda acc, spans: F.aggregate(spans, F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        join = lambda acc, made: F.struct(made["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(made["out"], ""))).alias("out"))
        done = _in_runs(F.col("secrets"), F.struct(F.lit(0).alias("at"), empty.alias("out")), run, join)
        return _with(done, lambda acc: F.concat(F.array_join(acc["out"], ""), part(pieces, acc["at"], F.char_length(text))))

    redacted = _with(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), marked)
    return found.withColumn(text_col, F.when(F.size("secrets") > 0, redacted).otherwise(text))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` for each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
