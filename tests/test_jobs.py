"""Cases that the driver's tables lack, and models of the state machines."""

import random

from pyspark.sql import functions as F

from quarryline.functions import scalar as S
from quarryline.operators import corpus, leads, sequence
from quarryline.streaming import state


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_scalars(spark):
    s = F.lit
    assert one(spark, S.encode_component(s("a b&c=d+e!~*'()/%\nسعر"))) == "a%20b%26c%3Dd%2Be!~*'()%2F%25%0A%D8%B3%D8%B9%D8%B1"
    assert one(spark, S.trim_unicode(s(" ﻿\t a b  "))) == "a b"
    assert one(spark, S.two_digits(s(7))) == "07" and one(spark, S.two_digits(s(123))) == "123"
    assert [one(spark, S.round_half_up(s(x))) for x in (-2.5, 2.5, 2.4)] == [-2, 3, 2]
    assert one(spark, S.if_null(s(""), s("d"))) == "" and one(spark, S.if_empty(s(""), s("d"))) == "d"
    assert one(spark, S.to_number(s(" "))) == 0.0 and one(spark, S.to_number(s("4.5"))) == 4.5 and one(spark, F.isnan(S.to_number(s("x"))))
    assert one(spark, S.with_suffix(s(15), F.lit(None).cast("string"))) == "15"


def test_paths(spark):
    cases = {"https://a.example/": "/", "https://a.example": "/", "https://a.example/a/": "/a", "https://a.example/a//": "/a", "https://a.example/index.html": "/", "https://a.example/xindex.html": "/x", "https://a.example/p?q=/z#f": "/p", "/é b/": "/é b", "#top": "/"}
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", S.normalise_path(F.col("u")).alias("p")).collect()
    assert {r.u: r.p for r in got} == cases
    assert one(spark, S.normalise_path(F.lit("/a/index.html/"), strip_index=False)) == "/a/index.html"


def test_nested_pairs(spark):
    source = '<p data-en="One &amp; two">واحد <b>و</b> اثنان</p><div data-en="outer">x<span data-en="in">y</span></div><i data-en="open">z'
    rows = corpus.nested_pairs(spark.createDataFrame([(1, source), (2, None)], "page_id long, html string"), "data-en").orderBy("pos").collect()
    assert [(r.tag, r.value, r.content, r.parent_pos) for r in rows] == [("p", "One & two", "واحد <b>و</b> اثنان", None), ("div", "outer", 'x<span data-en="in">y</span>', None), ("span", "in", "y", 1), ("i", "open", "z", None)]


def test_assembly_and_lookup(spark):
    parts = spark.createDataFrame([("r", 2, "b"), ("r", 1, "a"), ("r", 5, None), ("s", 1, "")], "route string, pos int, html string")
    assert {r.route: r.html for r in corpus.assemble_ordered(parts, "route", "pos", "html", sep="|").collect()} == {"r": "a|b|", "s": ""}
    dim = spark.createDataFrame([("r", ""), ("s", None)], "route string, v string")
    df = spark.createDataFrame([("r",), ("s",), ("t",)], "route string")
    assert {r.route: r.v for r in corpus.lookup_default(df, dim, "route", "v", "d").collect()} == {"r": "", "s": "d", "t": "d"}
    assert {r.route: r.rendered for r in corpus.lookup_or_fallback(df, dim, "route", "v", F.col("v"), F.lit("f")).collect()} == {"r": "f", "s": "f", "t": "f"}


def test_prices_and_tiers(spark):
    df = spark.createDataFrame([("3,500 ر.س",), ("250 ر.س/شهريًا",), ("ask",), (None,)], "p string")
    got = [(r.net and float(r.net), r.tax and float(r.tax), r.monthly) for r in corpus.price_with_tax(df, "p").collect()]
    assert got == [(3500.0, 525.0, False), (250.0, 37.5, True), (None, None, False), (None, None, None)]
    own = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "tier string, feature string")
    inc = spark.createDataFrame([("b", "a"), ("c", "b")], "tier string, part string")
    exc = spark.createDataFrame([("c", "y")], "tier string, feature string")
    assert {tuple(r) for r in corpus.expand_tiers(own, inc, exc).collect()} == {("a", "x"), ("b", "x"), ("b", "y"), ("c", "x"), ("c", "z")}


def test_lead_round_trip(spark):
    df = spark.createDataFrame([(" a & b ", "100% + 'x' (y)!~*\nسطر"), (None, None)], "name string, message string")
    made = leads.compose_lead(df, "https://chat.example/s", "T", {"Name": F.col("name"), "Message": F.col("message")})
    got = [r.message for r in leads.decode_links(made.select("link"), "link").collect()]
    assert got == ["T\nName: a & b\nMessage: 100% + 'x' (y)!~*\nسطر", "T\nName: \nMessage: "]


def events(seed=3, n=400):
    r = random.Random(seed)
    return [(r.randrange(8), r.randrange(60), i, r.choice(["a", "b", "c", None]), r.choice([None, r.uniform(-5, 5)])) for i in range(n)]


SCHEMA = "k long, t long, event_id long, item string, value double"


def model(rows):
    toggled, opened, smooth = {}, {}, {}
    flips, now, level = {}, {}, {}
    for k, _, i, item, value in sorted(rows, key=lambda e: (e[1], e[2])):
        flips[k] = (flips.get(k, 0) + (item == "a")) % 2
        toggled[i] = "on" if flips[k] else "off"
        if item is not None:
            now[k] = None if now.get(k) == item else item
            opened[i] = now[k]
        if value is not None:
            level[k] = value if k not in level else level[k] + (value - level[k]) * 0.2
            smooth[k] = level[k]
    return toggled, opened, smooth


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("t"))


def test_sequences_match_models(spark):
    rows = events()
    df, (toggled, opened, smooth) = frame(spark, rows), model(rows)
    assert {r.event_id: r.state for r in sequence.toggle_state(df, "k", F.coalesce(F.col("item") == "a", F.lit(False)), "off", "on").collect()} == toggled
    assert {r.event_id: r.open_item for r in sequence.exclusive_toggle(df, "k", "item").collect()} == opened
    got = {r.k: r.ema for r in sequence.ema(df, "k", "value").collect()}
    assert {k: round(v, 9) for k, v in got.items() if v is not None} == {k: round(v, 9) for k, v in smooth.items()}


def test_initially_open_item(spark):
    df = frame(spark, [(1, 1, 1, "a", None), (1, 2, 2, "a", None), (2, 1, 3, "b", None)])
    assert {r.event_id: r.open_item for r in sequence.exclusive_toggle(df, "k", "item", initial="a").collect()} == {1: None, 2: "a", 3: "b"}


def test_streams_match_models(spark, tmp_path):
    rows = sorted(events(seed=5), key=lambda e: (e[1], e[2]))
    cut = next(i for i in range(len(rows) // 2, len(rows)) if rows[i][1] != rows[i - 1][1])
    place = f"file://{tmp_path}"
    frame(spark, rows[:cut]).coalesce(1).write.parquet(f"{place}/in/a")
    frame(spark, rows[cut:]).coalesce(1).write.parquet(f"{place}/in/b")
    toggled, opened, smooth = model(rows)
    stream = lambda: spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{place}/in")
    got = state.drained(state.toggle_stream(stream(), "k", "item", "a", "off", "on")).collect()
    assert {r.event_id: r.state for r in got} == toggled
    got = state.drained(state.exclusive_stream(stream(), "k", "item")).collect()
    assert {r.event_id: r.open_item for r in got} == opened


def test_proximity_has_no_cross_join(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.0), (3, 1.0, 0.0), (4, -0.2, -0.2), (5, 0.0, 0.0), (6, None, 0.0)], "id long, x double, y double")
    pairs = sequence.proximity_pairs(points, "id", "x", "y", 1.0)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (4, 5), (3, 5), (1, 3)} - {(1, 3), (3, 5)}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
