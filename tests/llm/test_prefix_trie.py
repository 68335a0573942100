"""The prefix trie against a plain version, also with components too large for a task and conversations in many parts."""

import random

import numpy as np
import pytest

from . import brute

pytest.importorskip("quarryline.llm")
from quarryline.llm import prefix_trie  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int"


def talk(seed=5, n=70):
    """Conversations with shared beginnings, exact copies, ties, nulls, gaps and a very long one."""
    r = random.Random(seed)
    opening, rows = ["hello there", "how are you today", None, ""], []
    for c in [*range(-25, n), 400, 401, 421]:
        for t in range(r.choice([0, 1, 2, 3, 4, 6])):
            rows.append((c, t if r.random() < 0.95 else None, r.choice(["user", "bot"]) if t % 2 else "user", r.choice(opening) if r.random() < 0.8 else f"own {c} {t}\n words"))
    rows += [(c, t, "user", f"same {t}") for c in (500, 501, 502, 520, 540) for t in range(5)]
    rows += [(600, t % 90, "user", f"long {t % 7}") for t in range(300)] + [(601, t, "bot", f"long {t % 7}") for t in range(40)]
    rows += [(None, 1, "user", "nobody's"), (700, 0, None, None), (700, 0, None, None)]
    r.shuffle(rows)
    return rows


def nodes(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("part", [20_000, 150, 9])
def test_trie(spark, monkeypatch, part):
    monkeypatch.setattr(prefix_trie, "PART", part)
    rows = talk()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*x, "mine", 7) for x in rows], SCHEMA).repartition(5)
        parts = prefix_trie.sorted_turns(df).where("conv = 600").select("part").distinct().count()
        out = prefix_trie.trie(df)
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1
    want = brute.prefix_trie(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_plain_conversations(spark):
    """Without families the trie is that of the conversations themselves."""
    rows = [(c, t, "u", x) for c, text in enumerate(["a b c", "a b", "a b d", "e", "a b"]) for t, x in enumerate(text.split())]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in prefix_trie.trie(df, family=1).collect()}
    assert got == {(0, 0): (None, 5, 2, 3, 6), (0, 1): (0, 4, 1, 2, 6), (0, 2): (0, 4, 2, 2, 3), (0, 3): (0, 1, 0, 1, 0), (2, 3): (0, 1, 0, 1, 0), (3, 1): (0, 1, 0, 1, 0)}


def test_no_conversation(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(empty).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b", "", 1)], SCHEMA)).count() == 0


@pytest.mark.parametrize("shape", ["random", "chain", "star", "forest"])
def test_rolled_up(shape):
    """Totals by centroids against sums along parents."""
    r, n = random.Random(2), 400
    parents = [{"random": lambda v: r.randrange(v) if v else -1, "chain": lambda v: v - 1, "star": lambda v: 0 if v else -1, "forest": lambda v: -1 if v % 50 == 0 else r.randrange(v - v % 50, v)}[shape](v) for v in range(n)]
    own = np.array([[r.randrange(9), 1] for _ in range(n)])
    want = own.copy()
    for v in range(n - 1, -1, -1):
        if parents[v] >= 0:
            want[parents[v]] += want[v]
    assert (prefix_trie.rolled_up(parents, own) == want).all()


def test_long_lists_are_hashed_in_pieces(spark):
    import hashlib

    df = spark.range(60_000).selectExpr("CAST(id % 3 = 0 AS string) AS node", "id * 7 - 1000 AS conv")
    got = {r.node: r.sha for r in prefix_trie.list_hashes(df.repartition(7), "node", "conv").collect()}
    for name, keep in (("true", 0), ("false", 1)):
        assert got[name] == hashlib.sha256(",".join(str(i * 7 - 1000) for i in range(60_000) if (i % 3 > 0) == keep).encode()).hexdigest()
