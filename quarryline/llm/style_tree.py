"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a style node is a path of elements with their class
and id. For each style node two entropies over the host's pages say how much it varies: of the
sequences of its child elements (presentation) and of the features of its own text, runs of words
that hold all of it (content). Nodes whose words come again from page to page have low importance; a
branch's importance is the mean of its nodes', weighted by their text, times that of its role (a
menu, a notice, an advert ... has little, text outside an article less than in it). Branches of low
importance are removed from each page.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written

#: Elements whose source isn't text: all up to their end tag goes.
_RAW = frozenset("script style noscript template textarea svg iframe".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'>]++|"[^"]*"|'[^']*')*+)>""")
#: The same where a quote that never ends has been met: a tag then ends at its first >.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_LETTER = re.compile(r"</?[a-zA-Z]")
_HIDDEN = re.compile(r"""(?<![\w:-])(?:hidden(?![\w:-])|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.I)
_QUOTED = re.compile(r"""(?<!style)(?<!style )=\s*(?:"[^"]*"|'[^']*')""", re.I)
_STYLE = re.compile(r"""(?<![\w:-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements that only dress text; text goes on across them.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new one of these ends an open one of the same set.
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_BLOCK_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
#: Elements whose text isn't the page's.
_NO_TEXT = frozenset("head title button select option object canvas audio video map".split())
#: Roles of low importance, by element and by names in class, id and role.
_NO_TAGS = frozenset("nav footer aside form dialog menu".split())
_NO_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar widget related recommended share sharing social cookie cookies consent notice alert popup modal overlay newsletter subscribe subscription comment comments reply replies respond disqus form search login signup copyright pagination pager skip contentinfo complementary".split())
#: These make a name with a word above, as in site-footer or reader-comments; other words (has-sidebar, comments-open) don't.
_PLAIN_WORDS = frozenset("site page top bottom left right main primary secondary global box list section wrap wrapper container area block bar slot unit panel link links item items posts reader user button buttons thread inner".split())
#: Roles of low importance unless they stand in the article.
_OUTER_TAGS, _OUTER_WORDS = frozenset({"header"}), frozenset({"header", "masthead", "topbar", "legal"})
_MAIN_TAGS = frozenset({"article", "main"})
#: Elements of the whole page, whose names say nothing about a part of it.
_WHOLE = frozenset({"html", "body"})

#: Weights of a role of low importance and of what stands outside the article, and by how much more text in it counts when branches are compared.
ROLE, OUTSIDE, CENTRAL = 0.25, 0.5, 8.0
#: So many pages are added to those that have a node: few pages that agree, or differ, say little.
PRIOR = 2.0
#: Texts of up to so many words have all runs of three as features; others, by length, in the end one for so many words (a power of two).
SHORT, CHOSEN = 12, ((24, 2), (48, 4), (math.inf, 32))
_NAME_PARTS = re.compile(r"[-_]+")


def _named(names: set[str], words: frozenset[str]) -> bool:
    """Whether a whole name is one of ``words``, or is made of them and plain words."""
    for name in names:
        if name in words:
            return True
        parts = set(_NAME_PARTS.split(name))
        if len(parts) > 1 and not words.isdisjoint(parts) and parts <= words | _PLAIN_WORDS:
            return True
    return False


_paths: dict[tuple[int, str], int] = {}


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _path(parent: int, sign: str) -> int:
    key = parent, sign
    if key not in _paths:
        if len(_paths) > 200_000:
            _paths.clear()
        _paths[key] = _hash(f"{parent}/{sign}")
    return _paths[key]


def tokens(source: str) -> Iterator[tuple[str, bool, str, str]]:
    """Pieces of a page in order: (text, False, "", "") and tags ("", whether it ends an element, name, attributes).

    One way through the source: each character is looked at a bounded number of times, whatever is
    wrong with the markup. Comments, and elements whose source isn't text, are left out.
    """
    at, last, tag = 0, source.rfind(">"), _TAG
    while True:
        open_ = source.find("<", at)
        if open_ < 0 or open_ > last:
            break
        if open_ > at:
            yield source[at:open_], False, "", ""
        if source.startswith("<!--", open_):
            end = source.find("-->", open_ + 4)
            at = len(source) if end < 0 else end + 3
        elif source[open_ + 1 : open_ + 2] in ("!", "?"):
            at = source.find(">", open_) + 1
        elif not _LETTER.match(source, open_):
            yield "<", False, "", ""
            at = open_ + 1
        else:
            m = tag.match(source, open_)
            if m is None:
                tag = _PLAIN_TAG
                m = tag.match(source, open_)
            at = m.end()
            name = m[2].lower()
            if name in _RAW:
                if not m[1] and not m[3].endswith("/"):
                    end = _raw_end(name).search(source, at)
                    at = end.end() if end else len(source)
                continue
            yield "", bool(m[1]), name, m[3]
    if at < len(source):
        yield source[at:], False, "", ""


@functools.cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def features(text: str) -> set[str]:
    """Runs of words that hold every word of a text. A text of up to three words is one run, one of up to SHORT words is all its runs of three. A longer one is cut before words that a hash chooses, so that equal passages have equal runs: at every other word or so at its start, then ever more seldom, as CHOSEN has it for its length; what stands before the first cut is runs of three."""
    words = text.split(" ")
    if len(words) <= 3:
        return {text}
    if len(words) <= SHORT:
        return {" ".join(words[k : k + 3]) for k in range(len(words) - 2)}
    cuts, mask = [], 1
    most = next(seldom for n, seldom in CHOSEN if len(words) <= n)
    for k, word in enumerate(words):
        h = crc32(word.encode())
        if h & mask == 0:
            cuts.append(k)
            while mask < most - 1 and h & (2 * mask + 1) == 0:
                mask = 2 * mask + 1
    head = range(cuts[0] if cuts else len(words) - 2)
    return {" ".join(words[k : k + 3]) for k in head} | {" ".join(words[a:b]) for a, b in zip(cuts, [*cuts[1:], len(words)], strict=False)}


class Page:
    """A page as nodes and blocks of text (node, text).

    Of each node: parent, path, ``silent`` (it is or stands in an element without text of the page),
    ``low`` (its own role is of low importance), ``soft`` (by a name or as a form, so it may be a
    wrapper of the page), ``main`` (it is or stands in an article), tag and child elements.
    """

    def __init__(self, source: str):
        self.parent, self.path, self.silent, self.low, self.soft, self.main, self.tag, self.children = [-1], [0], [False], [False], [False], [False], [""], [[]]
        self.blocks: list[tuple[int, str]] = []
        stack: list[tuple[str, int]] = [("", 0)]
        text: list[str] = []

        def flush() -> None:
            if text:
                words = html.unescape("".join(text)).split()
                if words:
                    self.blocks.append((stack[-1][1], " ".join(words)))
                text.clear()

        for piece, closes, name, attributes in tokens(source):
            if not name:
                text.append(piece)
                continue
            if name in _INLINE:
                continue
            if name == "br":
                text.append(" ")
                continue
            flush()
            if closes:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                continue
            ends = _ENDS.get(name) or ({"p"} if name in _BLOCK_ENDS_P else ())
            while stack[-1][0] in ends:
                stack.pop()
            up = stack[-1][1]
            style = " ".join(x for s in _STYLE.findall(attributes) for x in s).lower() if attributes else ""
            sign = f"{name} {style}" if style else name
            names = set(style.split())
            self.children[up].append(sign)
            if name in _VOID:
                continue
            inside = self.main[up]
            firm = name in _NO_TAGS and name != "form" or not inside and name in _OUTER_TAGS
            soft = name == "form" or name not in _WHOLE and (_named(names, _NO_WORDS) or not inside and _named(names, _OUTER_WORDS))
            hidden = bool(attributes) and bool(_HIDDEN.search(_QUOTED.sub("", attributes)))
            self.parent.append(up)
            self.path.append(_path(self.path[up], sign))
            self.silent.append(self.silent[up] or name in _NO_TEXT or hidden)
            self.low.append(firm or soft)
            self.soft.append(soft and not firm)
            self.tag.append(name)
            self.main.append(inside or name in _MAIN_TAGS or "main" in names)
            self.children.append([])
            stack.append((name, len(self.parent) - 1))
        flush()

    def text(self, worth: dict[tuple[int, int], tuple[float, float]], least: float) -> str:
        """The page's blocks without branches of low importance; ``worth`` has the entropy of style nodes (path, 0) and of blocks (path, hash), each with the number of pages it comes from.

        A block's importance is its entropy, with PRIOR pages more: where the text is expected (in
        an article, or anywhere if there is none) these all differ, elsewhere they agree. A branch's
        importance is the mean of its blocks', weighted by their length, times its role's weight. A
        branch with most of what is important on the page is judged by its parts. Where all goes but
        for text of no low role, that stays; a page of nothing but such roles has no text.
        """
        size = len(self.parent)
        blocks = [(n, t) for n, t in self.blocks if not self.silent[n]]
        central = any(self.main[n] for n, _ in blocks)
        weight, value, vote = [0.0] * size, [0.0] * size, [0.0] * size
        own: list[float] = []
        for n, t in blocks:
            path, w = self.path[n], len(t)
            inside = not central or self.main[n]
            seen = [worth.get((path, 0), (1.0, 0.0))]
            if worth and (path, h := _hash(t)) in worth:
                seen.append(worth[path, h])
            x = min((h * m + (PRIOR if inside else 0.0)) / (m + PRIOR) for h, m in seen)
            y = x * (1.0 if inside else OUTSIDE)
            own.append(y)
            v = max(x, 0.01) * w * (CENTRAL if self.main[n] else 1.0)
            while n >= 0:
                weight[n] += w
                value[n] += y * w
                vote[n] += v
                n = self.parent[n]
        low = self._roles({n for n, _ in blocks})
        role, gone = [1.0] * size, [False] * size
        for n in range(1, size):
            up = self.parent[n]
            role[n] = min(role[up], ROLE if low[n] else 1.0)
            gone[n] = gone[up] or 2 * vote[n] <= vote[0] and value[n] * role[n] < least * weight[n]
        kept = [t for (n, t), y in zip(blocks, own, strict=True) if not gone[n] and y * role[n] >= least]
        return "\n\n".join(kept or [t for n, t in blocks if role[n] == 1.0 and self.main[n]] or [t for n, t in blocks if role[n] == 1.0])

    def _roles(self, spoken: set[int]) -> list[bool]:
        """Which nodes have a role of low importance. Where every article stands in such a role, those that hold one have none; nor has one by name, or a form, that wraps the page: it holds a first heading and a paragraph, and all text that stands in no other such role. ``spoken``: nodes with text."""
        size, low = len(self.parent), list(self.low)

        def under() -> list[int]:
            """The topmost role that each node stands in, or 0."""
            top = [0] * size
            for n in range(1, size):
                top[n] = top[self.parent[n]] or (n if low[n] else 0)
            return top

        def holders(tag: frozenset[str]) -> list[bool]:
            found = [False] * size
            for n in range(size - 1, 0, -1):
                found[self.parent[n]] |= found[n] or self.tag[n] in tag
            return found

        top = under()
        if not any(top[n] == 0 and self.tag[n] in _MAIN_TAGS for n in range(1, size)):
            low = [x and not h for x, h in zip(low, holders(_MAIN_TAGS), strict=True)]
        heading, paragraph = holders(frozenset({"h1"})), holders(frozenset({"p"}))
        while True:
            top = under()
            tops = {top[n] for n in spoken}
            wrappers = [n for n in tops if n and self.soft[n] and heading[n] and paragraph[n]]
            if 0 in tops or not wrappers:
                return low
            for n in wrappers:
                low[n] = False


def host_of(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _shapes(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """host, page (a hash of its source) and parts, once for each source of a host: (node, kind, values) with a hash of child elements (kind 0), of each feature of own text (1) and of each block of it (2), and 0 where there is own text (3)."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.list_(pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("values", pa.list_(pa.int64()))]))
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            hosts, keys, parts = [], [], []
            for host, key, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (host, key) in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add((host, key))
                page = Page(source.as_py() or "")
                shapes: dict[int, list[str]] = {}
                texts: dict[int, list[str]] = {}
                for k, path in enumerate(page.path):
                    shapes.setdefault(path, []).extend(page.children[k])
                for k, t in page.blocks:
                    texts.setdefault(page.path[k], []).append(t)
                found = [(p, 0, [_hash(",".join(c))]) for p, c in shapes.items()] + [(p, 1, list({_hash(f) for t in ts for f in features(t)})) for p, ts in texts.items()]
                found += [(p, 2, [_hash(t) for t in set(ts)]) for p, ts in texts.items()] + [(p, 3, [0]) for p in texts]
                hosts.append(host)
                keys.append(key)
                parts.append([{"node": p, "kind": k, "values": v} for p, k, v in found])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, type=pa.string()), pa.array(keys, type=pa.int64()), pa.array(parts, type=part)], ["host", "page", "parts"])

    sources = pages.select(host_of(url_col).alias("host"), F.xxhash64(html_col).alias("page"), html_col).where("host <> ''")
    return sources.mapInArrow(shapes, "host string, page long, parts array<struct<node:long,kind:int,values:array<long>>>").dropDuplicates(["host", "page"])


def _values(shapes: DataFrame) -> DataFrame:
    """A row for each value: host, page, node, kind, value."""
    return shapes.select("host", "page", F.inline("parts")).select("host", "page", "node", "kind", F.explode("values").alias("value"))


def _counts(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """For each host, node and kind: m, how many values its pages have (of kinds 0 and 3 one each), and s, the sum of n * ln n over these, n being the pages with a value; for kind 2 a row for each block (else 0) that more than one page has.

    Only hashes and counts are shuffled, and a host with many pages is counted in many tasks.
    """
    values = _values(_shapes(pages, url_col, html_col)).groupBy("host", "node", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    block = F.when(F.col("kind") == 2, F.col("value")).otherwise(0).alias("block")
    return values.where("kind <> 2 OR n > 1").groupBy("host", "node", "kind", block).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))


def _nodes(counts: DataFrame) -> DataFrame:
    of = lambda kind, x: F.max(F.when(F.col("kind") == kind, F.col(x)))
    found = counts.where("kind <> 2").groupBy("host", "node").agg(of(0, "m").alias("n_pages"), of(3, "m").alias("n_text"), of(0, "s").alias("s0"), of(1, "m").alias("m1"), of(1, "s").alias("s1"))
    # A value's entropy over the pages that have it, in their number's logarithm, taken from 1 and averaged.
    mean = lambda s, m, n: F.when(F.col(n) > 1, 1 - F.col(s) / F.col(m) / F.log(n)).when(F.col(n) == 1, 1.0)
    return found.select("host", "node", "n_pages", "n_text", mean("s0", "n_pages", "n_pages").alias("presentation"), mean("s1", "m1", "n_text").alias("content"))


def style_nodes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The style tree's nodes: host, node, n_pages, n_text (pages with own text), and the entropies ``presentation`` and ``content``, from 0 (all pages alike) to 1 (all differ). Copies of a page on a host count once."""
    return _nodes(_counts(pages, url_col, html_col))


def _judged(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """By host, node and block: an entropy (``worth``) and the pages it comes from: of nodes (block 0) with text, and of blocks that pages repeat (1 less the entropy of a block over pages). Nodes and blocks of a single page aren't listed; nothing speaks against them."""
    counts = written(_counts(pages, url_col, html_col), "style")
    nodes = _nodes(counts).where("n_text > 1")
    # Importance by content; varying children make up for little of it.
    own = nodes.select("host", "node", F.lit(0).cast("long").alias("block"), F.greatest("content", F.coalesce("presentation", F.lit(0.0)) * 0.5).alias("worth"), F.col("n_text").alias("pages"))
    blocks = counts.where("kind = 2").join(nodes.select("host", "node", "n_text"), ["host", "node"])
    judged = written(own.unionByName(blocks.select("host", "node", "block", (1 - F.log("m") / F.log("n_text")).alias("worth"), F.col("n_text").alias("pages"))), "judged")
    released(counts)
    return judged


def main_text(pages: DataFrame, least: float = 0.3, url_col: str = "url", html_col: str = "html", most_broadcast: int = 200_000) -> DataFrame:
    """Every column of ``pages`` but the html, and ``text`` and ``n_chars``: the main text of each page.

    Blocks have single spaces and are joined by an empty line; nothing is cut off. The style tree
    judges every page; roles and an article or main element are weights on its branches. Entropies
    count by the number of a host's pages they come from, and copies of a page count once. Null html
    counts as empty and gives an empty text; a null or unreadable url gives no host, and such a page
    is judged by roles alone. A page of nothing but menus, notices, forms and the like has an empty
    text; one whose text the tree alone would take away keeps it. Repeated rows get equal
    results, null ids stay; input columns named ``text`` or ``n_chars`` are replaced. An empty table
    gives an empty one.
    """
    judged = _judged(pages, url_col, html_col)
    keep = [c for c in pages.columns if c.lower() not in {"text", "n_chars", html_col.lower()}]
    joined = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html_col).alias("__ql_html"), host_of(url_col).alias("__ql_host"))
    known = None
    if judged.count() <= most_broadcast:
        by_host: dict[str, dict[tuple[int, int], tuple[float, float]]] = {}
        for r in judged.collect():
            by_host.setdefault(r["host"], {})[r["node"], r["block"]] = r["worth"], float(r["pages"])
        known = pages.sparkSession.sparkContext.broadcast(by_host)
        joined = joined.withColumn("__ql_worth", F.lit(None).cast("array<struct<node:long,block:long,worth:double,pages:long>>"))
    else:
        # Each page gets the entries of its own nodes, so none has those of its whole host.
        part = _values(_shapes(pages, url_col, html_col)).where("kind > 0").select("host", "page", "node", F.when(F.col("kind") == 2, F.col("value")).otherwise(0).alias("block"))
        own = part.join(judged, ["host", "node", "block"]).groupBy(F.col("host").alias("__ql_host"), F.col("page").alias("__ql_page")).agg(F.collect_list(F.struct("node", "block", "worth", "pages")).alias("__ql_worth"))
        joined = joined.withColumn("__ql_page", F.xxhash64("__ql_html")).join(own, ["__ql_host", "__ql_page"], "left")
    joined = joined.select(*[f"`{c}`" for c in keep], "__ql_html", "__ql_host", "__ql_worth")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 3
            texts = []
            for source, host, worth in zip(batch.column(n), batch.column(n + 1), batch.column(n + 2), strict=True):
                own = known.value.get(host.as_py(), {}) if known else {(x["node"], x["block"]): (x["worth"], float(x["pages"])) for x in worth.as_py() or ()}
                texts.append(Page(source.as_py() or "").text(own, least))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], [*keep, "text", "n_chars"])

    return joined.mapInArrow(extract, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string", "n_chars long"]))
