"""The first product of the n-gram join against counts over whole columns."""

import random

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("quarryline.llm")
from quarryline.llm import ngram_join  # noqa: E402


def texts(n=60, seed=3):
    """Texts of their own that share one passage, some near copies, and copies in many tasks."""
    r = random.Random(seed)
    own = lambda k: [f"w{r.randrange(10**7)}" for _ in range(k)]
    passage, base = own(40), own(120)
    out = [own(r.randint(10, 90)) + passage + own(10) for _ in range(n)]
    out += [[*base[:k], "changed", *base[k + 1 :]] for k in range(0, 100, 9)]
    out += [own(30), ["few", "words"], *[base] * 5]
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("pack", [500, 2_000_000])
def test_shared_entries(spark, monkeypatch, pack):
    monkeypatch.setattr(ngram_join, "PACK", pack)
    monkeypatch.setattr(ngram_join, "BLOCK", 2000)
    monkeypatch.setattr(ngram_join, "NODES", 30)
    rows = texts()
    sets = {ngram_join.node_of(s): s for s in ngram_join.shingle_sets(rows)}
    columns, often = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    want = {}
    for node, s in sets.items():
        half = s[s < ngram_join.HALF]
        if n := int((often[np.searchsorted(columns, half)] > 1).sum()):
            want[int(ngram_join._short(np.array([node]))[0])] = n
    docs = spark.createDataFrame(list(enumerate(rows)), "id long, text string").repartition(8)
    found = ngram_join._shared_entries(docs, 5, 2 * 9000, 70).collect()
    got = {r.short: r.n for r in found}
    assert len(got) == len(found)
    assert got.keys() == want.keys() and all(got[k] >= n for k, n in want.items())
    copied = int(ngram_join._short(np.array([ngram_join.node_of(ngram_join.shingle_sets(rows[-1:])[0])]))[0])
    assert {k: n for k, n in got.items() if k != copied} == {k: n for k, n in want.items() if k != copied}


def test_rows_keep_only_what_may_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PACK", 1000)
    monkeypatch.setattr(ngram_join, "BLOCK", 500)
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "id long, text string").repartition(4)
    made, _ = ngram_join._rows(docs, 5, 75, 9000)
    got = {r.node: r for r in made.dropDuplicates(["node"]).collect()}
    sets = {ngram_join.node_of(s): s for s in ngram_join.shingle_sets(rows)}
    assert {n for k, n in zip(range(len(rows)), map(ngram_join.node_of, ngram_join.shingle_sets(rows)), strict=True) if 60 <= k < 72} <= got.keys()
    for node, r in got.items():
        assert r.n == len(sets[node]) and r.alone + len(r.cols) == r.n and r.alone <= r.n // 4
        assert set(r.cols) <= set(sets[node].view(np.int64).tolist())


@pytest.mark.parametrize("rows_of_a_column", [3, 512])
def test_hot_columns_are_paired_in_blocks(spark, monkeypatch, rows_of_a_column):
    """Many texts whose first columns are in all of them, but that link in chains at most."""
    from . import brute

    monkeypatch.setattr(ngram_join, "ROWS", rows_of_a_column)
    r = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    docs = {}
    for i in range(60):
        words = base.copy()
        for k in r.sample(range(0, 60, 6), r.randint(1, 3)):
            words[k] = f"v{k % 3}"
        docs[i] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(df).collect()}
    assert got == brute.jaccard(docs)


def test_blocks_of_different_packings(monkeypatch):
    """A task that runs again may pack its rows in another order; blocks read before and after still add up to no less than what rows share."""
    rows = [t for t in texts(24, seed=8) if t]
    sets = {ngram_join.node_of(s): s[s < ngram_join.HALF] for s in ngram_join.shingle_sets(rows)}
    columns, often = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    want = {int(ngram_join._short(np.array([n]))[0]): int((often[np.searchsorted(columns, s)] > 1).sum()) for n, s in sets.items()}
    for seed in range(4):
        orders = []
        for _ in range(2):
            nodes = list(sets)
            random.Random(seed).shuffle(nodes)
            seed += 100
            cut = len(nodes) // 2
            orders.append([ngram_join._packed([sets[n] for n in part], part, 7) for part in (nodes[:cut], nodes[cut:])])
        got = {}
        for block in range(7):
            cells = [{k: v[cell["block"].index(block)] for k, v in cell.items()} for cell in orders[block > 0] if block in cell["block"]]
            for r in ngram_join._counted(pd.DataFrame(cells), 1).itertuples():
                for short, n in zip(np.frombuffer(r.short, np.uint64), np.frombuffer(r.n, np.int32), strict=True):
                    got[int(short)] = got.get(int(short), 0) + int(n)
        assert all(got.get(k, 0) >= n for k, n in want.items()) and sum(want.values()) > 500
