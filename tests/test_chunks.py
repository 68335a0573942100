"""Texts in chunks, and differences by digests."""

import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import chunks, corpus


def whole(df, key):
    out = {}
    for r in df.collect():
        assert (r[key], r.chunk) not in {(k, c) for k in out for c in out[k]} or r.chunk not in out[r[key]]
        out.setdefault(r[key], {})[r.chunk] = (r.offset, r.text)
    texts = {}
    for k, found in out.items():
        assert sorted(found) == list(range(len(found)))
        texts[k] = "".join(found[c][1] for c in range(len(found)))
        assert all(found[c][0] == sum(len(found[i][1]) for i in range(c)) for c in found)
    return texts, {k: max(len(t) for _, t in found.values()) for k, found in out.items()}


@pytest.fixture(scope="module")
def parts(spark):
    """One group with most parts, an empty one, nulls, ties, repeated rows, and a text longer than many chunks."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcü€𝄞") for _ in range(r.randrange(0, 9)))
    rows = [(1, r.randrange(60), word(), k, "x") for k in range(400)] + [(2, k, word(), 1, "x") for k in range(5)]
    rows += [(3, 1, None, 1, "x"), (4, None, "last" * 200, 1, "x"), (4, 1, "b", 1, "x"), (4, 1, "b", 1, "x"), (None, 1, "n", 1, "x"), (5, 0, "", 0, "")]
    return spark.createDataFrame(rows, "g long, pos long, t string, share long, row string").repartition(5)


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
@pytest.mark.parametrize("more", [{}, {"sep": ", ", "wrap": "p", "head": "<<", "foot": ">>"}])
def test_chunks_make_the_text(spark, parts, chunk, more):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, longest = whole(chunks.assemble_chunks(parts, "g", "pos", "t", chunk=chunk, **more), "g")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {r.g: r.html for r in corpus.assemble_ordered(parts, "g", "pos", "t", **more).collect()}
    assert got == want and max(longest.values()) <= chunk
    assert chunks.assemble_chunks(parts.limit(0), "g", "pos", "t").count() == 0


@pytest.mark.parametrize("twice", [False, True])
def test_rendered_chunks(parts, twice):
    row = F.concat(F.lit("<"), "t", F.lit(">"))
    got, _ = whole(chunks.render_chunks(parts, row, "g", ["pos", "share"], between="; ", twice=twice, chunk=50), "g")
    assert got == {r.g: r.html for r in corpus.render_rows(parts, row, "g", ["pos", "share"], between="; ", twice=twice).collect()}


def sides(spark, changed=()):
    left = [(k, str(k % 7)) for k in range(3000)] + [(None, "a"), (5000, None), (5001, None)]
    right = [(k, v) for k, v in left if k not in (17, 18)] + [(9000, "new")]
    right = [(k, "other" if k in (40, 41, 5001) or k in changed else v) for k, v in right]
    return [spark.createDataFrame(x, "k long, v string").repartition(4) for x in (left, right)]


@pytest.mark.parametrize("bits", [(4, 8), (12, 24), (6,)])
def test_differences_by_digest(spark, bits):
    left, right = sides(spark)
    rows = lambda df: sorted((r.k is None, r.k or 0, r.status) for r in df.collect())
    got = chunks.differences(left, right, "k", "v", bits)
    assert rows(got) == rows(corpus.differences(left, right, "k", "v")) and got.count() == 8
    assert chunks.differences(left.limit(0), right.limit(0), "k", "v", bits).count() == 0
    assert rows(chunks.differences(left, right.limit(0), "k", "v", bits)) == rows(corpus.differences(left, right.limit(0), "k", "v"))


def test_rows_joined_grow_with_the_differences(spark):
    """Of two tables of 3,000 rows those are joined that differ, and hardly any other."""
    for changed, most in (((), 20), (range(100, 200), 130)):
        a, b = chunks.differing(*(df.withColumnsRenamed({"k": "key", "v": "value"}) for df in sides(spark, changed)))
        assert a.count() < most and b.count() < most
    same = spark.range(1000).select(F.col("id").alias("key"), F.col("id").alias("value"))
    a, b = chunks.differing(same, same.repartition(3))
    assert a.count() == b.count() == 0


def test_filtered_targets(spark, monkeypatch):
    """The same rows; links that the filter doesn't know are joined with nothing."""
    targets = spark.range(3000).select(F.concat(F.lit("/p/"), F.col("id").cast("string")).alias("path")).unionByName(spark.createDataFrame([(None,), ("",), ("",)], "path string"))
    links = spark.range(20_000).select((F.col("id") * 7 + 1).alias("n"), F.concat(F.lit("/p/"), (F.col("id") * 3 % 90_000).cast("string")).alias("path")).unionByName(spark.createDataFrame([(5, None), (6, ""), (6, "")], "n long, path string"))
    rows = lambda df: sorted((r.n, r.path or "null") for r in df.collect())
    want = rows(corpus.missing_targets(links, targets, "path"))
    asked = []
    plain = corpus.missing_targets
    monkeypatch.setattr(corpus, "missing_targets", lambda df, *more: (asked.append(df.count()), plain(df, *more))[1])
    assert rows(corpus.missing_targets_filtered(links, targets, "path")) == want and len(want) > 18_000
    # 1,002 links have targets; of the others one in a hundred may be sent to the join for nothing.
    assert 1002 <= asked[0] < 1002 + 400
    assert rows(corpus.missing_targets_filtered(links, targets.limit(0), "path")) == rows(links)
    assert corpus.missing_targets_filtered(links.limit(0), targets, "path").count() == 0
    monkeypatch.setattr(corpus, "MOST_ROWS", 0)
    assert rows(corpus.missing_targets_filtered(links, targets, "path")) == want
