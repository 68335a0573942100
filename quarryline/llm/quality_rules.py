"""Quality rules as a ledger of failure bits, with DataFrame functions only.

``ledger`` measures every document and evaluates every rule once. Policies are versioned sets of
rules; applying one, or finding what each of its rules does alone, needs only the stored bits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, without

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper")


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails``, an SQL condition on the measures, is true."""

    name: str
    fails: str


#: The position of a rule is its bit. Rules are only ever added at the end, so stored ledgers stay valid.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("exclamations", "10 * n_marks > 2 * n_words"),
    Rule("capitals", "n_words > 0 AND 100 * n_upper > 40 * word_chars"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)"),
)

#: Version by name: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "exclamations"),
    "v2": ("few_words", "repeated_windows", "symbols", "exclamations", "capitals", "word_length"),
    "v2_strict": ("few_words", "repeated_windows", "symbols", "repeated_lines", "exclamations", "capitals", "word_length"),
}


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """The bits of the rules named."""
    at = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << at[n] for n in set(names))


def measures(text: Column) -> dict[str, Column]:
    """Measures that need the text alone; the words and repeated windows come from ``ledger``."""
    gone = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    return {
        "word_chars": F.char_length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": gone(SYMBOLS).cast("long"),
        "n_marks": gone("!").cast("long"),
        "n_upper": F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
    }


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """Adds the measures and ``failed_bits``, bit k set where rule k fails.

    Words are runs of characters other than blanks. A 3-word window is compared by a 64-bit hash
    within its text; the windows are sorted with their positions, and a window equal to a neighbour
    marks its three words. A null text has no words and no lines with a word; empty texts likewise.
    Every row is measured by itself, so repeated rows get equal results and any id may be null.
    Input columns named like the new ones are replaced.
    """
    names = (*MEASURES, "failed_bits")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = without(docs, *names)
    one = docs.select(
        *kept,
        *[c.alias(f"__ql_{k}") for k, c in measures(text).items()],
        F.array_remove(F.split(text, BLANK_RUN), "").alias("__ql_words"),
        F.filter(F.split(text, "\n"), lambda line: F.length(F.trim(line, F.lit(BLANKS))) > 0).alias("__ql_lines"),
    )
    n = F.size("__ql_words")
    last = F.greatest(n - 2, F.lit(0))
    starts = F.slice(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), F.lit(1), last)
    windows = F.transform(starts, lambda i: F.struct(F.xxhash64(F.get("__ql_words", i), F.get("__ql_words", i + 1), F.get("__ql_words", i + 2)).alias("h"), i.alias("i")))
    # Fresh attributes for arrays that lambdas read: the generator keeps Spark from computing them for each element.
    two = one.select(*kept, *[f"__ql_{k}" for k in measures(text)], n.cast("long").alias("__ql_n_words"), F.size("__ql_lines").cast("long").alias("__ql_n_lines"), (F.size("__ql_lines") - F.size(F.array_distinct("__ql_lines"))).cast("long").alias("__ql_n_dup_lines"), F.inline(F.array(F.struct(F.sort_array(windows).alias("__ql_w")))))
    same = lambda x, k: F.coalesce(F.get("__ql_w", k)["h"] == x["h"], F.lit(False))
    marked = F.filter("__ql_w", lambda x, k: same(x, k - 1) | same(x, k + 1))
    places = F.sort_array(F.transform(marked, lambda x: x["i"]))
    # Each marked window covers three words, or up to the next marked one.
    run = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i + 3 - a["end"])).alias("n"), (i + 3).alias("end")), lambda a: a["n"].cast("long"))
    three = two.select(*kept, *[F.col(f"__ql_{k}").alias(k) for k in MEASURES if k != "n_repeat_words"], run.alias("n_repeat_words"))
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(rules)), F.lit(0).cast("long"))
    return three.withColumn("failed_bits", bits)


def apply_policy(entries: DataFrame, policy: str | Sequence[str], out: str = "kept", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds ``out``: true where no rule of the policy failed."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return entries.withColumn(out, F.col("failed_bits").bitwiseAND(F.lit(mask(names, rules))) == 0)


def ablations(entries: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents the rule fails, documents it alone rejects, and documents the policy keeps.

    The ledger is first counted by its bits: 2 to the number of rules rows at most, whatever its size.
    """
    counts = entries.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    pairs = [(p, name, mask(names, rules), mask([name], rules)) for p, names in policies.items() for name in names]
    # The rules are a short fixed list, so each bit pattern is exploded to them without a join.
    terms = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("m"), F.lit(b).cast("long").alias("b")) for p, r, m, b in pairs])).alias("x")
    hit = F.col("failed_bits").bitwiseAND(F.col("m"))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0))).cast("long")
    return counts.select("failed_bits", "n", terms).select("failed_bits", "n", "x.*").groupBy("policy", "rule").agg(count(hit.bitwiseAND(F.col("b")) != 0).alias("n_failed"), count(hit == F.col("b")).alias("n_alone"), count(hit == 0).alias("n_kept"))
