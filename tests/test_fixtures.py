"""Small literal tables with the shapes that the jobs were made for."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarryline.functions import scalar as S
from quarryline.operators import corpus, manifest, sequence


def test_bilingual_markup(spark):
    html = '<a data-en="Home">الرئيسية</a><p data-en="Build &amp; run">بناء</p><h1 data-en="One <b>two</b>">واحد <b>اثنان</b></h1><b data-en="">فارغ</b>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [(r.pos, r.value, r.content) for r in corpus.extract_pairs(pages, "a", "data-en").collect()] == [(0, "Home", "الرئيسية")]
    got = [(r.tag, r.value, r.content) for r in corpus.nested_pairs(pages, "data-en").orderBy("pos").collect()]
    assert got == [("a", "Home", "الرئيسية"), ("p", "Build & run", "بناء"), ("h1", "One <b>two</b>", "واحد <b>اثنان</b>"), ("b", "", "فارغ")]


def test_logos_and_monograms(spark):
    names = spark.createDataFrame([("a", 'The "A"'), ("b", "B"), ("c", "C")], "code string, en string")
    logos = spark.createDataFrame([("a", "/a.png"), ("b", "")], "code string, path string")
    render = F.concat(F.lit('<img src="'), "path", F.lit('" alt="'), S.escape_attribute(F.col("en")), F.lit('">'))
    got = corpus.lookup_or_fallback(names, logos, "code", "path", render, F.concat(F.lit("<i>"), "code", F.lit("</i>")))
    assert {r.code: r.rendered for r in got.collect()} == {"a": '<img src="/a.png" alt="The &quot;A&quot;">', "b": "<i>b</i>", "c": "<i>c</i>"}


def test_reports_by_language(spark):
    reports = spark.createDataFrame([("مشروع", "Project", 0, "ar"), ("مبنى", "Building", 100, "en"), ("جسر", "Bridge", 30, "de")], "ar string, en string, pct int, lang string")
    percent, early, late = sequence.ramp(F.col("pct"), F.lit(100))
    got = corpus.pick_locale(reports, "lang", F.col("ar"), F.col("en")).select("text", "direction", percent, early, late).collect()
    assert [tuple(r)[:3] for r in got] == [("مشروع", "rtl", 0.0), ("Building", "ltr", 100.0), ("جسر", "ltr", 30.0)]
    assert [r[4] for r in got] == [0.0, 1.0, pytest.approx((0.3 / 0.62 - 0.22) / 0.5)]


def test_placements_and_parts(spark):
    placed = spark.createDataFrame([("/", 9, "hero"), ("/", 2, "intro"), ("/about", 1, "intro"), ("/about", 5, "gone")], "route string, pos int, name string")
    parts = spark.createDataFrame([("hero", "<h1>H</h1>"), ("intro", ""), ("spare", "<p>S</p>")], "name string, html string")
    bodies = corpus.lookup_default(placed, parts, "name", "html", "")
    assert {r.route: (r.html, r.n_parts) for r in corpus.assemble_ordered(bodies, "route", "pos", "html", wrap="div").collect()} == {"/": ("<div></div><div><h1>H</h1></div>", 2), "/about": ("<div></div><div></div>", 2)}
    assert [r.name for r in corpus.unplaced(parts, placed, "name").collect()] == ["spare"]
    changed = spark.createDataFrame([("hero", "<h1>h</h1>"), ("intro", "")], "name string, html string")
    assert {r.name: r.status for r in corpus.differences(parts, changed, "name", "html").collect()} == {"hero": "changed", "spare": "left_only"}


def test_sitemap_rules_and_metadata(spark):
    pages = spark.createDataFrame([("https://a.example/", "<title>Home</title>"), ("https://a.example/x", "<title></title>"), ("https://a.example/y", None)], "url string, html string")
    rules = spark.createDataFrame([("/", "weekly", 1.0, None)], "key string, changefreq string, priority double, lastmod date")
    got = {r["loc"]: (r.changefreq, r.priority) for r in corpus.build_sitemap(pages, rules, S.normalise_path(F.col("url"))).collect()}
    assert got == {"https://a.example/": ("weekly", 1.0), "https://a.example/x": ("monthly", 0.5), "https://a.example/y": ("monthly", 0.5)}
    made = corpus.page_metadata(pages, "%s | Site", {"title": "Site", "description": "All", "lang": "ar"}).collect()
    assert [(r.title, r.description, r.page_lang) for r in made] == [("Home | Site", "All", "ar"), ("Site", "All", "ar"), ("Site", "All", "ar")]


def test_organisation_record(spark):
    rows = [Row(name="Org", phone=None, sameAs=["https://a.example", "https://b.example"], alternateName=[]), Row(name=None, phone="1", sameAs=None, alternateName=["O"])]
    df = spark.createDataFrame(rows, "name string, phone string, sameAs array<string>, alternateName array<string>")
    fields = {"name": F.col("name"), "contactPoint": F.struct(F.col("phone").alias("telephone")), "sameAs": F.col("sameAs"), "alternateName": F.col("alternateName")}
    one, two = (json.loads(r.record) for r in corpus.to_record(df, "Organization", fields).collect())
    assert one == {"@context": "https://schema.org", "@type": "Organization", "name": "Org", "contactPoint": {}, "sameAs": ["https://a.example", "https://b.example"], "alternateName": []}
    assert two == {"@context": "https://schema.org", "@type": "Organization", "contactPoint": {"telephone": "1"}, "alternateName": ["O"]}


def test_requested_jobs(spark):
    jobs = spark.createDataFrame([("home", 1), ("about", 2), ("home", 3)], "view string, n int")
    got = manifest.select_jobs(jobs, "view", ["about", "nowhere", "home", "about"]).orderBy("request_pos", "n").collect()
    assert [(r.view, r.n, r.request_pos) for r in got] == [("about", 2, 0), ("home", 1, 2), ("home", 3, 2), ("about", 2, 3)]


def test_rings(spark):
    df = spark.createDataFrame([("g", 1, "a"), ("g", 2, "b"), ("g", 2, "c"), ("h", None, "z")], "grp string, pos int, name string")
    assert {r.name: (r.previous, r.next, r.label) for r in sequence.ring_nav(df, "grp", "pos", "name").collect()} == {"a": ("c", "b", "01 / 03"), "b": ("a", "c", "02 / 03"), "c": ("b", "a", "03 / 03"), "z": ("z", "z", "01 / 01")}
