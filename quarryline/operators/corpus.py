"""Jobs over pages, their parts and their links. Each takes and returns DataFrames; none collects."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.shared import released, written


def assemble_ordered(parts: DataFrame, group: str, pos: str, text: str, sep: str = "", wrap: str | None = None, head: str = "", foot: str = "") -> DataFrame:
    """Joins each group's texts in order of ``pos`` (ties by text), each in an element ``wrap`` if given, between ``head`` and ``foot``. A null text counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    if wrap:
        body = F.concat(F.lit(f"<{wrap}>"), body, F.lit(f"</{wrap}>"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), body.alias("t"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["t"]), sep)
    return parts.groupBy(group).agg(F.concat(F.lit(head), joined, F.lit(foot)).alias("html"), F.count(F.lit(1)).alias("n_parts"))


def lookup_default(df: DataFrame, dim: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left lookup; ``default`` only where the value is null. ``dim`` has one row for each key."""
    return df.join(dim.select(key, F.col(value).alias("__ql_value")), key, "left").withColumn(value, S.if_null(F.col("__ql_value"), F.lit(default))).drop("__ql_value")


def lookup_or_fallback(df: DataFrame, dim: DataFrame, key: str, value: str, render: Column, fallback: Column, out: str = "rendered") -> DataFrame:
    """Left lookup; where the value is null or empty, ``fallback`` of the left row, else ``render`` of the value.

    ``dim`` has one row for each key; a null key finds nothing. A column of ``df`` named like
    ``value`` isn't the one looked up: it is left out before the lookup.
    """
    found = F.col(value).isNotNull() & (F.col(value) != "")
    return df.drop(value).join(dim.select(key, value), key, "left").withColumn(out, F.when(found, render).otherwise(fallback)).drop(value)


def extract_pairs(pages: DataFrame, tag: str, attr: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Each element ``tag`` with attribute ``attr`` and plain text inside: id, pos (from 0), attribute value, content. Null html gives no rows."""
    pattern = rf'<{tag}\b[^>]*?\s{attr}="([^"]*)"[^>]*>([^<]*)</{tag}>'
    both = F.arrays_zip(F.regexp_extract_all(html_col, F.lit(pattern), F.lit(1)).alias("value"), F.regexp_extract_all(html_col, F.lit(pattern), F.lit(2)).alias("content"))
    return pages.select(id_col, F.posexplode(both).alias("pos", "pair")).select(id_col, "pos", F.col("pair.value").alias("value"), F.col("pair.content").alias("content"))


#: Elements without content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Pairs(HTMLParser):
    """Elements with an attribute, markup inside included; an element within another names it as its parent. One way through the source, whatever is left open."""

    def __init__(self, attr: str, source: str):
        super().__init__(convert_charrefs=False)
        self.attr, self.source, self.rows = attr, source, []
        self.open: list[tuple[str, dict | None]] = []
        self.often: Counter[str] = Counter()  # of the open elements' names
        self.above: list[dict] = []  # the open elements that have the attribute
        self.lines = [0, *accumulate(len(line) + 1 for line in source.split("\n"))]

    def place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        value = dict(attrs).get(self.attr)
        row = None
        if value is not None:
            row = {"pos": len(self.rows), "tag": tag, "value": value, "parent_pos": self.above[-1]["pos"] if self.above else None, "start": self.place() + len(self.get_starttag_text()), "content": "" if tag in _VOID else None}
            self.rows.append(row)
        if tag not in _VOID:
            self.open.append((tag, row))
            self.often[tag] += 1
            if row:
                self.above.append(row)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        while self.often[tag]:
            name, row = self.open.pop()
            self.often[name] -= 1
            if row is not None:
                self.above.pop()
                row["content"] = self.source[row["start"] : max(row["start"], self.place())]
            if name == tag:
                return


def nested_pairs(pages: DataFrame, attr: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every element with ``attr``, whatever markup is in it: id, pos, tag, value (references decoded), content (markup kept), parent_pos. Null html gives no rows; an element never closed goes on to the end, one that can't have content (img, input ...) has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for key, source in zip(df.iloc[:, 0], df.iloc[:, 1], strict=True):
                if source:
                    p = _Pairs(attr, source)
                    p.feed(source)
                    p.close()
                    out += [{id_col: key, "pos": r["pos"], "tag": r["tag"], "value": r["value"], "content": source[r["start"] :] if r["content"] is None else r["content"], "parent_pos": r["parent_pos"]} for r in p.rows]
            yield pd.DataFrame(out, columns=[id_col, "pos", "tag", "value", "content", "parent_pos"]).astype({"parent_pos": "Int64"})

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {kind}, pos long, tag string, value string, content string, parent_pos long")


def render_rows(df: DataFrame, row: Column, group: str, order: Sequence[str], between: str = "", twice: bool = False) -> DataFrame:
    """Each group's rows, rendered by ``row`` and joined in order (ties by what is rendered, nulls first); ``twice`` writes the whole two times over. A row rendered as null counts as empty."""
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], F.coalesce(row, F.lit("")).alias("t"))))
    text = F.array_join(F.transform(ordered, lambda x: x["t"]), between)
    return df.groupBy(group).agg((F.repeat(text, 2) if twice else text).alias("html"))


def pick_locale(df: DataFrame, lang: str, first: Column, english: Column) -> DataFrame:
    """``text``: ``english`` for 'en', else ``first``; ``direction``: rtl for 'ar' alone."""
    return df.withColumn("text", F.when(F.col(lang) == "en", english).otherwise(first)).withColumn("direction", F.when(F.col(lang) == "ar", "rtl").otherwise("ltr"))


def match_links(pages: DataFrame, links: DataFrame, id_col: str = "page_id", url_col: str = "url", href_col: str = "value") -> DataFrame:
    """``links`` with the page's normalised path, the link's, and whether they are the same (null if either is). Links of no page go; a page's id that repeats gives its links again."""
    paths = pages.select(id_col, S.normalise_path(F.col(url_col)).alias("page_path"))
    return links.join(paths, id_col).withColumn("link_path", S.normalise_path(F.col(href_col), strip_index=False)).withColumn("current", F.col("link_path") == F.col("page_path"))


def classify_path(path: Column, prefixes: Sequence[str]) -> tuple[Column, Column]:
    """Kind of a path (asset below one of the prefixes, else html), and its shared-cache rule."""
    asset = F.regexp_like(path, F.lit("^/(" + "|".join(prefixes) + ")"))
    return F.when(asset, "asset").otherwise("html"), F.when(asset, "immutable").otherwise("s-maxage=300, stale-while-revalidate=600")


def build_sitemap(pages: DataFrame, rules: DataFrame, key: Column, frequency: str = "monthly", priority: float = 0.5, url_col: str = "url") -> DataFrame:
    """A row for each URL: loc, lastmod, changefreq and priority by the rule for its ``key``, else by default. ``rules`` has one row for each key."""
    r = rules.select(F.col("key").alias("__ql_key"), "changefreq", "priority", "lastmod")
    return pages.withColumn("__ql_key", key).join(r, "__ql_key", "left").select(F.col(url_col).alias("loc"), "lastmod", F.coalesce("changefreq", F.lit(frequency)).alias("changefreq"), F.coalesce("priority", F.lit(priority)).alias("priority"))


def page_metadata(pages: DataFrame, template: str, defaults: Mapping[str, str], html_col: str = "html") -> DataFrame:
    """Adds title (the page's own through ``template``, with %s, else the default), description and page language, each by fallback, so for null html too. Input columns of these names are replaced."""
    own = F.regexp_extract(html_col, "<title>([^<]*)</title>", 1)
    found = lambda p: F.regexp_extract(html_col, p, 1)
    return (
        pages.withColumn("title", F.when(own != "", F.format_string(template, own)).otherwise(F.lit(defaults["title"])))
        .withColumn("description", S.if_empty(found('<meta name="description" content="([^"]*)"'), F.lit(defaults["description"])))
        .withColumn("page_lang", S.if_empty(found('<html[^>]* lang="([^"]*)"'), F.lit(defaults["lang"])))
    )


def to_record(df: DataFrame, kind: str, fields: Mapping[str, Column], out: str = "record") -> DataFrame:
    """Adds a nested JSON record; fields that are null are left out."""
    return df.withColumn(out, F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), *[c.alias(k) for k, c in fields.items()])))


def differences(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ, or that one side lacks: key, status (changed, left_only, right_only). Two nulls are equal. Keys are unique on each side; null keys match nothing, so each is on one side alone."""
    a, b = left.select(key, F.col(value).alias("__ql_a"), F.lit(True).alias("__ql_in_a")), right.select(key, F.col(value).alias("__ql_b"), F.lit(True).alias("__ql_in_b"))
    both = a.join(b, key, "full_outer").where(F.col("__ql_in_a").isNull() | F.col("__ql_in_b").isNull() | ~F.col("__ql_a").eqNullSafe(F.col("__ql_b")))
    return both.select(key, F.when(F.col("__ql_in_b").isNull(), "left_only").when(F.col("__ql_in_a").isNull(), "right_only").otherwise("changed").alias("status"))


def unplaced(parts: DataFrame, placements: DataFrame, key: str) -> DataFrame:
    """Parts that no placement names; a part with a null key is never named."""
    return parts.join(placements.select(key).distinct(), key, "left_anti")


def missing_targets(links: DataFrame, targets: DataFrame, path: str) -> DataFrame:
    """Links whose path is no target's; a null path never is."""
    return links.join(targets.select(path).distinct(), path, "left_anti")


#: Bits of a filter for each path, bits that a path sets, bits in a row of the filter, and rows that are broadcast at most (4 KB each).
BITS, HASHES, ROW_BITS, MOST_ROWS = 16, 4, 32_768, 4096


def _bits(path: Column, rows: int) -> tuple[Column, list[Column]]:
    """The filter's row of a path, and its places there."""
    places = [F.pmod(F.xxhash64(F.lit(k), path), F.lit(ROW_BITS)) for k in range(HASHES)]
    return F.pmod(F.xxhash64(path), F.lit(rows)), places


def path_filter(targets: DataFrame, path: str) -> DataFrame | None:
    """A filter that tells paths that surely are no target's: ``__ql_row`` and ``__ql_bits``, a bitmap. Each task sets the bits of its own targets, and only bitmaps are shuffled. None where the filter would be too large to broadcast."""
    n = targets.agg(F.approx_count_distinct(path)).first()[0]
    rows = max(1, -(-n * BITS // ROW_BITS))
    if rows > MOST_ROWS:
        return None
    row, places = _bits(F.col(path), rows)
    bits = targets.where(F.col(path).isNotNull()).select(row.alias("__ql_row"), F.explode(F.array(*places)).alias("__ql_bit"))
    made = bits.groupBy("__ql_row").agg(F.bitmap_construct_agg("__ql_bit").alias("__ql_bits"))
    return made.withColumn("__ql_rows", F.lit(rows))


def missing_targets_filtered(links: DataFrame, targets: DataFrame, path: str) -> DataFrame:
    """The rows of ``missing_targets``. A filter of the targets' paths goes to where the links are; those that it doesn't know are missing and stay there, and only others are joined with the targets."""
    made = path_filter(targets, path)
    if made is None:
        return missing_targets(links, targets, path)
    made = written(made, "filter")
    first = made.head(1)
    rows = first[0]["__ql_rows"] if first else 1
    row, places = _bits(F.col(path), rows)
    byte = lambda p: F.conv(F.hex(F.substring("__ql_bits", (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    has = [F.getbit(byte(p), (p % 8).cast("int")) == 1 for p in places]
    known = F.coalesce(F.col(path).isNotNull() & functools.reduce(lambda x, y: x & y, has), F.lit(False))
    tested = links.join(F.broadcast(made.drop("__ql_rows")), row == F.col("__ql_row"), "left").withColumn("__ql_known", known).select(*links.columns, "__ql_known")
    surely = tested.where(~F.col("__ql_known")).drop("__ql_known")
    return surely.unionByName(missing_targets(tested.where("__ql_known").drop("__ql_known"), targets, path).select(*links.columns))


def price_with_tax(df: DataFrame, text: str, rate: float = 0.15) -> DataFrame:
    """Adds net, tax and gross (two decimals), and whether the price is for a month. A minus before the number, at the text's begin or after a space, counts; a text without a price, or with one of more than 20 digits before the point, gives nulls."""
    digits = F.replace(F.regexp_extract(F.col(text), r"((?:(?<!\S)[-\u2212])?[0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(","), F.lit(""))
    net = F.replace(digits, F.lit("\u2212"), F.lit("-")).try_cast("decimal(22,2)")
    tax = F.round(net * F.lit(rate).cast("decimal(4,2)"), 2).cast("decimal(22,2)")
    return df.withColumn("net", net).withColumn("tax", tax).withColumn("gross", (net + tax).cast("decimal(23,2)")).withColumn("monthly", F.regexp_like(F.col(text), F.lit("/ *(شهري|month)")))


def expand_tiers(own: DataFrame, includes: DataFrame, excluded: DataFrame) -> DataFrame:
    """Features of each tier: its own and all that the tiers it includes have, but for those it excludes.

    What a tier excludes it hasn't got, so a tier that includes it doesn't get that from it either,
    though it may from elsewhere. ``own`` (tier, feature), ``includes`` (tier, part), ``excluded``
    (tier, feature). Each round hands on what the round before has found new, as many rounds as the
    longest chain that still brings something; cycles are harmless. Rows with a null name nothing,
    repeated rows count once, and empty tables give what is left.
    """
    known = lambda df, *names: df.select(*names).dropna().distinct()
    upward = written(known(includes, "tier", "part").select(F.col("tier").alias("__ql_up"), F.col("part").alias("tier")), "includes")
    barred = written(known(excluded, "tier", "feature"), "excluded")
    new = written(known(own, "tier", "feature").join(barred, ["tier", "feature"], "left_anti"), "features")
    found, rounds = new, [new]
    while new.head(1):
        reached = new.join(upward, "tier").select(F.col("__ql_up").alias("tier"), "feature").distinct()
        new = written(reached.join(barred, ["tier", "feature"], "left_anti").join(found, ["tier", "feature"], "left_anti"), "features")
        rounds.append(new)
        if len(rounds) < 16:
            found = found.unionByName(new)
        else:  # many small tables become one
            found = written(found.unionByName(new), "features")
            released(*rounds[:-1])
            rounds = [found, new]
    released(upward, barred)
    return found
