"""Every job on empty tables, nulls, ties, repeated rows and columns with clashing names; and what the driver's tables never hold."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarryline.functions import scalar as S
from quarryline.operators import corpus, leads, manifest, sequence
from quarryline.plans.queries import ASSET_PREFIXES
from quarryline.sources import shared, tables
from quarryline.streaming import state

UTC = datetime.UTC
TS = [datetime.datetime(2024, 1, 1, 0, m, tzinfo=UTC) for m in (0, 0, 5, 50)]
EVENTS = [(1, TS[0], 1, "a", 1.0), (1, TS[1], 2, "a", None), (1, TS[2], 3, None, 40.0), (1, TS[3], 4, "b", 50.0), (1, None, 5, "a", 2.0), (None, TS[0], 6, "a", 3.0), (2, TS[0], 7, None, None)]
EVENTS_SCHEMA = "k long, ts timestamp, event_id long, item string, value double, __ql_run int, late boolean, n long"


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([(*e, 9, True, 9) for e in EVENTS], EVENTS_SCHEMA)


@pytest.fixture(scope="module")
def pages(spark):
    html = '<html lang="ar"><title>T</title><a href="/p/">x</a><a href="https://e.example/q">y</a></html>'
    rows = [(1, "https://a.example/p/index.html", html, "old"), (1, "https://a.example/p/index.html", html, "old"), (2, None, None, None), (None, "", "", ""), (3, "https://a.example/bim/m", "<title></title>", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, title string")


LINKS = "page_id long, pos int, value string, content string"


def run_all(spark, events, pages):
    """Each job over the given tables."""
    dim = events.where("k IS NOT NULL").groupBy("k").agg(F.max("item").alias("item"))
    links = corpus.extract_pairs(pages, "a", "href")
    yield "C1", corpus.assemble_ordered(pages, "page_id", "title", "html", wrap="div")
    yield "C2", corpus.lookup_default(events, dim, "k", "item", "none")
    yield "C3", corpus.lookup_or_fallback(events, dim, "k", "item", F.upper("item"), F.lit("none"))
    yield "C4", links
    yield "C4b", corpus.nested_pairs(pages, "href")
    yield "C5", corpus.render_rows(pages, F.concat(F.lit("<"), S.escape_attribute(F.col("url"))), "page_id", ["url"], twice=True)
    yield "C6", corpus.pick_locale(pages, "title", F.col("url"), F.col("html"))
    yield "C7", pages.select(S.normalise_path(F.col("url")).alias("path"))
    yield "C8", corpus.match_links(pages, links)
    yield "C9", pages.select(corpus.classify_path(S.url_path(F.col("url")), ASSET_PREFIXES)[0].alias("kind"))
    yield "C10", corpus.build_sitemap(pages, spark.createDataFrame([("x", "daily", 1.0, None)], "key string, changefreq string, priority double, lastmod date"), F.col("title"))
    yield "C11", corpus.page_metadata(pages, "%s!", {"title": "D", "description": "d", "lang": "en"})
    yield "C12", corpus.to_record(pages, "Page", {"url": F.col("url"), "title": F.col("title")})
    yield "C13a", corpus.differences(dim, dim.where("k > 1"), "k", "item")
    yield "C13b", corpus.unplaced(pages, links, "page_id")
    yield "C13c", corpus.missing_targets(links.select(S.normalise_path(F.col("value")).alias("path")), pages.select(S.normalise_path(F.col("url")).alias("path")), "path")
    yield "C14", corpus.price_with_tax(pages, "title")
    tier = events.select(F.col("item").alias("tier"), F.col("event_id").cast("string").alias("feature"))
    yield "C15", corpus.expand_tiers(tier, events.select(F.col("item").alias("tier"), F.lit("a").alias("part")), tier.limit(0))
    yield "L1", leads.compose_lead(pages, "https://c.example", "T", {"Name": F.col("title")})
    yield "L2", leads.compose_request(pages, "https://c.example", "About %s", F.col("title"))
    yield "L3", leads.decode_links(pages, "url")
    yield "S1", sequence.latest_preference(events, "k", "item", ["a", "b"], "none")
    yield "S2", sequence.toggle_state(events, "k", F.col("item") == "a", "off", "on")
    yield "S3", sequence.exclusive_toggle(events, "k", "item")
    yield "S4", sequence.first_per_session(events, "k")
    yield "S5", sequence.threshold_cross(events, "k", "value", 30.0)
    yield "S6", sequence.ring_nav(events, "k", "event_id", "item")
    yield "S7", sequence.rotation_slot(events, 4)
    yield "S8", sequence.ema(events, "k", "value")
    yield "S9", events.select(*[c.alias(f"c{i}") for i, c in enumerate(sequence.ramp(F.col("value"), F.col("k")))])
    yield "S10", sequence.proximity_pairs(events, "event_id", "value", "k", 5.0)
    yield "S10b", sequence.near_point(events, "event_id", "value", "k", (0.0, 1.0), 5.0)
    yield "M1", manifest.audit_manifest(pages.select(F.col("title").alias("name")), pages.select("title", F.length("html").alias("length")), "name", F.col("title"))
    yield "M2", manifest.select_jobs(pages, "title", ["old", "none", "old"])


def test_all_jobs_on_odd_rows(spark, events, pages):
    got = {name: df.collect() for name, df in run_all(spark, events, pages)}
    assert len(got) == 34
    by = lambda name, key, value: {r[key]: r[value] for r in got[name]}
    assert [(r.k, r.item) for r in got["C2"]].count((1, "b")) == 5 and {r.item for r in got["C2"] if r.k is None or r.k == 2} == {"none"}
    assert {r.rendered for r in got["C3"] if r.k == 1} == {"B"} and {r.rendered for r in got["C3"] if r.k != 1} == {"none"}
    assert {r.current for r in got["C8"]} == {True, False} and sum(r.current for r in got["C8"]) == 4
    assert sorted(r.kind for r in got["C9"]) == ["asset", "html", "html", "html", "html"]
    assert {(r.title, r.page_lang) for r in got["C11"]} == {("T!", "ar"), ("D", "en")}
    assert by("S1", "k", "preference") == {1: "b", 2: "none", None: "a"}
    assert by("S2", "event_id", "state") == {5: "on", 1: "off", 2: "on", 3: "on", 4: "on", 6: "on", 7: "off"}
    assert by("S3", "event_id", "open_item") == {5: "a", 1: None, 2: "a", 4: "b", 6: "a"}
    assert {i: (s, m) for i, s, m in ((r.event_id, r.session, r["mode"]) for r in got["S4"])}[4] == (1, "full")
    assert [r.event_id for r in got["S5"] if r.first_crossing] == [3]
    x = 2.0
    for v in (1.0, 40.0, 50.0):
        x += (v - x) * 0.2
    ema = {r.k: (r.ema, r.n) for r in got["S8"]}
    assert ema[1] == (pytest.approx(x), 4) and ema[2] == (None, 0) and ema[None] == (pytest.approx(3.0), 1)
    assert {r.name: r.status for r in got["M1"]}["old"] == "ok" and {r.status for r in got["M1"] if r.name is None} == {"missing"}
    assert sorted((r.title, r.request_pos) for r in got["M2"]) == [("old", 0), ("old", 0), ("old", 2), ("old", 2)]
    assert {r.event_id for r in got["S10b"]} == {1, 5}
    assert sorted((r.k, r.status) for r in got["C13a"]) == [(1, "left_only")]


def test_all_jobs_on_empty_tables(spark, events, pages):
    assert all(df.count() == 0 for _, df in run_all(spark, events.limit(0), pages.limit(0)))


def test_select_jobs_without_request(pages):
    assert manifest.select_jobs(pages, "title", []).count() == 5


def test_locale_and_asset_branches(spark):
    df = spark.createDataFrame([("ar", "/bim/x"), ("en", "/bimx"), ("fr", "/_next/a"), (None, "/assets"), ("ar", None)], "lang string, path string")
    kind, cache = corpus.classify_path(F.col("path"), ASSET_PREFIXES)
    got = [tuple(r) for r in corpus.pick_locale(df, "lang", F.lit("A"), F.lit("E")).select("text", "direction", kind, cache).collect()]
    page = "s-maxage=300, stale-while-revalidate=600"
    assert got == [("A", "rtl", "asset", "immutable"), ("E", "ltr", "html", page), ("A", "ltr", "asset", "immutable"), ("A", "ltr", "html", page), ("A", "rtl", "html", page)]


def test_tiers_of_any_depth_and_cycles(spark):
    chain = [(f"t{k}", f"t{k - 1}") for k in range(1, 9)] + [("x", "y"), ("y", "x"), ("x", "t2"), (None, "t1"), ("t1", None), ("t3", "t2")]
    own = [(f"t{k}", f"f{k}") for k in range(9)] + [("y", "g"), (None, "h"), ("t1", None)]
    frame = lambda rows, names: spark.createDataFrame(rows, f"{names[0]} string, {names[1]} string")
    got = {tuple(r) for r in corpus.expand_tiers(frame(own, ("tier", "feature")), frame(chain, ("tier", "part")), frame([("t8", "f0"), ("x", "g")], ("tier", "feature"))).collect()}
    want = {(f"t{k}", f"f{j}") for k in range(9) for j in range(k + 1)} - {("t8", "f0")}
    want |= {(t, f) for t in "xy" for f in ("f0", "f1", "f2", "g")} - {("x", "g")}
    assert got == want


def test_exclusions_on_the_way(spark):
    """Everything in a tier is what that tier has: what it excludes doesn't come through it, but may come another way."""
    frame = lambda rows, names: spark.createDataFrame(rows, f"{names[0]} string, {names[1]} string")
    chain = [(f"t{k}", f"t{k - 1}") for k in range(1, 24)] + [("t5", "side"), ("t9", "t11"), ("t2", "t2")]
    own = [("t0", "f"), ("t0", "g"), ("side", "g"), ("t3", "x"), ("t3", "g")]
    excluded = [("t3", "g"), ("t7", "x"), ("t20", "f"), ("t20", "f"), (None, "f"), ("t1", None)]
    got = {tuple(r) for r in corpus.expand_tiers(frame(own, ("tier", "feature")), frame(chain, ("tier", "part")), frame(excluded, ("tier", "feature"))).collect()}
    has, parts = {}, {}
    for t, p in chain:
        parts.setdefault(t, set()).add(p)
    for _ in range(60):
        for t in {t for t, _ in own} | set(parts):
            has[t] = ({f for o, f in own if o == t} | {f for p in parts.get(t, ()) for f in has.get(p, ())}) - {f for e, f in excluded if e == t}
    assert got == {(t, f) for t, fs in has.items() for f in fs}
    assert ("t4", "g") not in got and ("t5", "g") in got and ("t19", "f") in got and ("t20", "f") not in got and ("t23", "f") not in got


def nested(spark, *sources):
    df = spark.createDataFrame(list(enumerate(sources)), "page_id long, html string")
    out = {}
    for r in corpus.nested_pairs(df, "data-x").orderBy("page_id", "pos").collect():
        out.setdefault(r.page_id, []).append((r.tag, r.value, r.content, r.parent_pos))
    return [out.get(k, []) for k in range(len(sources))]


def test_nested_pairs_with_other_line_ends(spark):
    for end in ("\r", "\x0b", "\x0c", "\x1c", "\x85", "\u2028", "\u2029", "\r\n", "\n"):
        assert nested(spark, f'<p>z{end}y</p>\n<p data-x="1">a{end}bc</p>') == [[("p", "1", f"a{end}bc", None)]]


def test_nested_pairs_of_void_elements(spark):
    for tag in "area base br col embed hr img input link meta param source track wbr".split():
        got = nested(spark, f'<div data-x="o">a<{tag} data-x="v">b<{tag} data-x="w"/>c</div>d')
        assert got == [[("div", "o", f'a<{tag} data-x="v">b<{tag} data-x="w"/>c', None), (tag, "v", "", 0), (tag, "w", "", 0)]]


def test_nested_pairs_take_linear_time():
    import time

    n = 100_000
    for source in ("<p>" * n, "<p><b></i>" * (n // 2), '<p data-x="1">' * (n // 4) + "</q>" * (n // 4), "<a></b>" * n):
        start = time.process_time()
        p = corpus._Pairs("data-x", source)
        p.feed(source)
        p.close()
        assert time.process_time() - start < 2


def test_prices_with_signs_and_many_digits(spark):
    df = spark.createDataFrame([("-5.10 SAR",), ("from \u22121,000",), ("10-20",), ("A-7 costs 3",), ("123,456,789,012.34 / month",), ("9" * 30,), ("none",), (None,)], "price string")
    got = [(str(r.net) if r.net is not None else None, str(r.gross) if r.gross is not None else None, r.monthly) for r in corpus.price_with_tax(df, "price").collect()]
    assert got[:4] == [("-5.10", "-5.87", False), ("-1000.00", "-1150.00", False), ("10.00", "11.50", False), ("7.00", "8.05", False)]
    assert got[4][0] == "123456789012.34" and got[4][2] and got[5][0] is None and got[6][0] is None and got[7][0] is None


def test_session_and_slot_totals(spark, events):
    got = {(r.k, r.first_at.minute, r.n) for r in sequence.session_totals(events.drop("n"), "k").collect()}
    assert got == {(1, 0, 3), (1, 50, 1), (None, 0, 1), (2, 0, 1)}
    slots = sequence.slot_totals(events.drop("n"), 4, 60_000, most=F.max("value")).orderBy("start_ms").collect()
    assert [(r.n, r.most) for r in slots] == [(4, 3.0), (1, 40.0), (1, 50.0)] and all(r.slot == r.start_ms // 60_000 % 4 for r in slots)
    assert sequence.session_totals(events.limit(0).drop("n"), "k").count() == sequence.slot_totals(events.limit(0).drop("n"), 4).count() == 0


def test_long_keys_are_spread_by_time(spark):
    rows = [(1, TS[0] + datetime.timedelta(hours=5 * i), i, float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, event_id long, value double")
    for init in (None, 3.0):
        r = rows[0][3] if init is None else init
        for row in rows:
            r += (row[3] - r) * 0.2
        for bucket in ("hour", "day", "year"):
            assert sequence.ema(df, "k", "value", init=init, bucket=bucket).first().ema == pytest.approx(r)


def model(rows):
    """Sessions and crossings of (k, ts, id, value) rows by a plain loop."""
    session, crossing, last, above, crossed, number = {}, {}, {}, {}, set(), {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        new = k not in last or t - last[k] >= 1800
        number[k] = number.get(k, -1) + new
        session[i] = (number[k], "full" if new else "instant")
        last[k] = t
        up = v is not None and v > 30
        cross = up and not above.get(k, False)
        crossing[i] = (up, cross, cross and k not in crossed)
        above[k] = up
        crossed |= {k} if cross else set()
    return session, crossing


def test_streams_over_a_folder_of_files(spark, tmp_path):
    """A table as Spark writes it, several files in more than one micro-batch."""
    import random

    r = random.Random(4)
    rows = sorted(((r.randrange(6), r.randrange(30_000), i, r.choice([None, r.uniform(0, 60)])) for i in range(300)), key=lambda x: (x[1], x[2]))
    df = spark.createDataFrame(rows, "user_id long, t long, event_id long, value double").withColumn("ts", F.timestamp_seconds("t"))
    place = f"file://{tmp_path}"
    df.where("t < 15000").coalesce(1).write.parquet(f"{place}/events.parquet")
    import time

    time.sleep(1.1)  # files are taken in order of their times
    df.where("t >= 15000").coalesce(1).write.mode("append").parquet(f"{place}/events.parquet")
    stream = lambda: state.file_stream(spark, place, "events", files_per_trigger=1)
    session, crossing = model(rows)
    got = state.drained(state.session_stream(stream(), "user_id")).collect()
    assert {x.event_id: (x.session, x["mode"]) for x in got} == session and not any(x.late for x in got)
    got = state.drained(state.cross_stream(stream(), "user_id", "value", 30.0)).collect()
    assert {x.event_id: (x.above, x.crossing, x.first_crossing) for x in got} == crossing
    assert state.drained(state.first_stream(stream(), "user_id", delay="2 days")).count() == 6


def test_late_rows_are_named_and_state_expires(spark, tmp_path):
    place, day = f"file://{tmp_path}", 86_400
    batches = [[(1, 10, 1), (1, 30, 2), (1, None, 6)], [(1, 20, 3), (1, 40, 4), (None, 50, 9)], [(2, 40 * day, 5)], [(2, 41 * day, 7)], [(1, 41 * day, 8)]]
    import time

    for rows in batches:
        spark.createDataFrame(rows, "user_id long, t long, event_id long").select("user_id", F.timestamp_seconds("t").alias("ts"), "event_id", F.lit("a").alias("item")).coalesce(1).write.mode("append").parquet(f"{place}/events.parquet")
        time.sleep(1.1)
    run = lambda expire: {x.event_id: (x.state, x.late) for x in state.drained(state.toggle_stream(state.file_stream(spark, place, "events", 1), "user_id", "item", "a", "off", "on", expire=expire)).collect()}
    kept = run(None)
    assert kept == {6: ("on", False), 1: ("off", False), 2: ("on", False), 3: (None, True), 4: ("off", False), 5: ("on", False), 7: ("off", False), 8: ("on", False)}
    forgotten = run("1 day")
    assert forgotten[8] == ("on", False) and forgotten[4] == ("off", False)


def test_sources_and_sinks(spark, tmp_path):
    place = f"file://{tmp_path}"
    urls = spark.createDataFrame([("https://a.example/", "2024-01-01", "weekly", 1.0), ("https://a.example/b&c", None, "monthly", 0.5)], "loc string, lastmod string, changefreq string, priority double")
    tables.write_sitemap(urls.coalesce(1), f"{place}/sitemap")
    text = "".join(p.read_text() for p in (tmp_path / "sitemap").glob("part-*"))
    assert text.count("<url>") == 2 and "<loc>https://a.example/b&amp;c</loc>" in text and text.count("<lastmod>") == 1 and "<urlset>" in text
    records = corpus.to_record(urls, "WebPage", {"url": F.col("loc"), "date": F.col("lastmod")})
    tables.write_lines(records, "record", f"{place}/lines")
    lines = sorted(line for p in (tmp_path / "lines").glob("part-*") for line in p.read_text().splitlines())
    assert len(lines) == 2 and '"date"' in lines[0] and '"date"' not in lines[1]
    (tmp_path / "frags").mkdir()
    (tmp_path / "frags" / "hero.html").write_text("<p>one\ntwo</p>")
    (tmp_path / "frags" / "empty.html").write_text("")
    assert {r.name: r.html for r in tables.fragments(spark, f"{place}/frags/*.html").collect()}["hero"] == "<p>one\ntwo</p>"
    found = tables.files(spark, f"{place}/frags")
    wanted = spark.createDataFrame([("hero",), ("gone",)], "name string")
    audited = manifest.audit_manifest(wanted, found, "name", F.regexp_extract("path", r"/([^/]+)\.html$", 1))
    assert {r.name: (r.status, r.n_files, r.kb) for r in audited.collect()} == {"hero": ("ok", 1, 0), "gone": ("missing", 0, None)}


def test_shared_folder(spark):
    df = shared.written(spark.range(3), "three")
    path = df._quarryline_path
    assert path.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir")) and df.count() == 3
    shared.released(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


@pytest.mark.parametrize("end", ["", "spark.stop()"])
def test_shared_tables_go_with_the_driver(tmp_path, end):
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
from quarryline.sources import shared
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
assert shared.written(spark.range(3), "three").count() == 3
import os
assert os.listdir("{tmp_path}/quarryline")
{end}
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True)
    assert list((tmp_path / "quarryline").iterdir()) == []
