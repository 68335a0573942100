"""The style tree's entropies and their effect, and markup that is broken or hostile."""

import math
import time
from collections import Counter

import pytest

pytest.importorskip("quarryline.llm")
from quarryline.llm import style_tree  # noqa: E402


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(3)


def texts(spark, rows, **more):
    return [r.text for r in style_tree.main_text(frame(spark, rows), **more).orderBy("page_id").collect()]


def entropy(values):
    n = len(values)
    return -sum(c / n * math.log(c / n) for c in Counter(values).values()) / math.log(n) if n > 1 else 1.0


def content(texts):
    """Mean over each page's features of one less their entropy over the pages."""
    pages = [{f for t in ts for f in style_tree.features(t)} for ts in texts]
    often = Counter(f for fs in pages for f in fs)
    return sum(c * (1 - math.log(c) / math.log(len(pages))) for c in often.values()) / sum(often.values()) if len(pages) > 1 else 1.0


def test_entropies_by_brute_force(spark):
    rows = [("http://a.example/", f"<div class='top'>Same {k % 3}</div><ul>{'<li>x</li>' * (k % 2 + 1)}</ul><p>Own {k}</p>") for k in range(9)]
    rows += rows[:4]  # copies count once
    pages = [style_tree.Page(h) for h in dict.fromkeys(h for _, h in rows)]
    shapes, own = {}, {}
    for p in pages:
        at, said = {}, {}
        for k, path in enumerate(p.path):
            at.setdefault(path, []).extend(p.children[k])
        for k, t in p.blocks:
            said.setdefault(p.path[k], []).append(t)
        for path, c in at.items():
            shapes.setdefault(path, []).append(tuple(c))
        for path, t in said.items():
            own.setdefault(path, []).append(tuple(t))
    got = {r.node: r for r in style_tree.style_nodes(frame(spark, rows)).collect()}
    assert got.keys() == shapes.keys() and len(got) == 5
    for node, r in got.items():
        assert r.n_pages == len(shapes[node]) and r.presentation == pytest.approx(entropy(shapes[node]))
        assert (r.content is None) == (node not in own) and (node not in own or r.content == pytest.approx(content(own[node])))
    assert sorted({round(r.content, 6) for r in got.values() if r.content is not None})[-1] == 1.0


def test_results_come_from_the_tree(spark):
    """Menus and footers without telling names go by entropy alone, in and out of the article; without the tree they stay."""
    page = lambda k: f"<div class='a1'>Home Shop Contact</div><article><p class='x'>Read our other stories</p><p>Story {k} is about {k * 7}</p></article><div class='z9'>All of this is ours</div>"
    rows = [("http://many.example/", page(k)) for k in range(12)]
    assert texts(spark, rows) == [f"Story {k} is about {k * 7}" for k in range(12)]
    assert style_tree.Page(page(3)).text({}, 0.3) == "Read our other stories\n\nStory 3 is about 21"
    bare = [("http://bare.example/", h.replace("article", "div")) for _, h in rows]
    assert texts(spark, bare) == [f"Story {k} is about {k * 7}" for k in range(12)]
    assert style_tree.Page(bare[3][1]).text({}, 0.3).startswith("Home Shop Contact")


def test_few_pages_are_judged_little(spark):
    """Two pages of a host that share a paragraph keep it; there is no number of pages from which on all changes."""
    rows = [("http://two.example/", f"<article><p>Shared words</p><p>Own words {k}</p></article>") for k in range(2)]
    assert texts(spark, rows) == [f"Shared words\n\nOwn words {k}" for k in range(2)]


def test_content_beside_an_article_stays_if_it_varies(spark):
    rows = [("http://lead.example/", f"<div class='lead'>Lead number {k}</div><article><p>Story {k} and more {k}</p></article>") for k in range(9)]
    assert texts(spark, rows) == [f"Lead number {k}\n\nStory {k} and more {k}" for k in range(9)]


@pytest.mark.parametrize("most_broadcast", [200_000, 0])
def test_nulls_copies_and_empty(spark, most_broadcast):
    df = spark.createDataFrame([(None, "http://n.example/", "<p>A</p>"), (1, None, None), (1, None, None), (2, "http://n.example/", ""), (3, "::", "<p>B")], "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in style_tree.main_text(df, most_broadcast=most_broadcast).collect()))
    assert got == [(0, "A", 1), (1, "", 0), (1, "", 0), (2, "", 0), (3, "B", 1)]


@pytest.mark.parametrize("unit", ['<a "', "<a '>", '<p x=">">"', "<", "<!", "<!--", "<script>", "</", "<svg/>", "<a b='\"'>\"", "&lt;<", "<div>", "<textarea x='"])
def test_broken_markup_takes_linear_time(unit):
    took = []
    for n in (20_000, 80_000):
        start = time.process_time()
        list(style_tree.tokens(unit * n))
        took.append(time.process_time() - start)
    assert took[1] < 12 * took[0] + 0.5


def test_tokens():
    said = [(t, n) for t, _, n, _ in style_tree.tokens("a<b x='>'>c</B ><!-- d --><script>e</script >f<SVG/>g<br/>1 < 2 > 3<i \"unended>h</i>")]
    assert said == [("a", ""), ("", "b"), ("c", ""), ("", "b"), ("f", ""), ("g", ""), ("", "br"), ("1 ", ""), ("<", ""), (" 2 > 3", ""), ("", "i"), ("h", ""), ("", "i")]


def test_a_footer_that_differs_by_a_word_goes():
    """Words that come again make a node unimportant, though no two pages have the same text there."""
    assert style_tree.features("a b") == {"a b"} and style_tree.features("a b c d") == {"a b c", "b c d"}
    long = " ".join(f"w{k}" for k in range(300))
    assert 8 < len(style_tree.features(long)) < 40 and style_tree.features(long) > style_tree.features(long[3:]) - {"w1 w2 w3"}


@pytest.mark.parametrize("most_broadcast", [200_000, 0])
def test_nearly_equal_text_goes(spark, most_broadcast):
    page = lambda k: f"<div class='a1'><p>Story {k} tells of {k * 7} and {k * 3} more</p></div><div class='z9'>All of this is ours and is made for you by us in {1900 + k} here</div>"
    assert texts(spark, [("http://near.example/", page(k)) for k in range(12)], most_broadcast=most_broadcast) == [f"Story {k} tells of {k * 7} and {k * 3} more" for k in range(12)]


@pytest.mark.parametrize("n", [1, 3, 4, 12, 13, 40, 700])
def test_features_hold_every_word(n):
    """No part of a text goes unlooked at: a word changed anywhere changes the features, but only few of a long text's."""
    words = [f"w{k * k % 9973}" for k in range(n)]
    found = style_tree.features(" ".join(words))
    assert {w for f in found for w in f.split(" ")} == set(words)
    for k in range(n):
        other = style_tree.features(" ".join([*words[:k], "changed", *words[k + 1 :]]))
        assert other != found and (n < 100 or len(found - other) <= 8)
