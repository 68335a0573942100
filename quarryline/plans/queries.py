"""The registered queries over the given tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import chunks, corpus, leads, manifest, sequence
from ..sources.shared import written
from ..sources.tables import table
from ..streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ASSET_PREFIXES = ("_next/", "assets/", "brand/", "clients/", "media/", "projects/", "tours/", "bim/")

# SQL for what several queries share.
_PATH = "regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
_HREFS = """SELECT page_id, url, unnest(range(len(v)))::INTEGER AS pos, unnest(v) AS value, unnest(c) AS content
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a\\b[^>]*?\\shref="([^"]*)"[^>]*>([^<]*)</a>', 1) AS v,
               regexp_extract_all(html, '<a\\b[^>]*?\\shref="([^"]*)"[^>]*>([^<]*)</a>', 2) AS c FROM pages)"""


def _page_path(u: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace({_PATH.format(u=u)}, 'index\\.html$', ''), '/+$', ''), ''), '/')"


def _link_path(u: str) -> str:
    return f"coalesce(nullif(regexp_replace({_PATH.format(u=u)}, '/+$', ''), ''), '/')"


def _encode(text: str) -> str:
    return f"""replace(replace(replace(replace(replace(url_encode({text}), '%21', '!'), '%2A', '*'), '%27', chr(39)), '%28', '('), '%29', ')')"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT conv_id, '<main>' || string_agg('<div>' || coalesce(text, '') || '</div>', '' ORDER BY turn, text) || '</main>' AS html, count(*)::BIGINT AS n_parts FROM conversations GROUP BY conv_id")
def c1_assemble_ordered(spark, d):
    return corpus.assemble_ordered(table(spark, d, "conversations"), "conv_id", "turn", "text", wrap="div", head="<main>", foot="</main>")


@query("SELECT d.doc_id, d.lang, coalesce(l.quality, -1)::INTEGER AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def c2_lookup_default(spark, d):
    return corpus.lookup_default(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id", "quality", -1).select("doc_id", "lang", "quality")


@query("""SELECT c_custkey, CASE WHEN n.name IS NOT NULL AND n.name <> '' THEN '<img alt="' || n.name || '">' ELSE '<b>' || c_nationkey || '</b>' END AS rendered
FROM customer c LEFT JOIN (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS name FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey""")
def c3_lookup_or_fallback(spark, d):
    names = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.col("n_name")).alias("name"))
    render, fallback = F.concat(F.lit('<img alt="'), "name", F.lit('">')), F.concat(F.lit("<b>"), F.col("c_nationkey").cast("string"), F.lit("</b>"))
    return corpus.lookup_or_fallback(table(spark, d, "customer").select("c_custkey", "c_nationkey"), names, "c_nationkey", "name", render, fallback).select("c_custkey", "rendered")


def _links(spark, d):
    return corpus.extract_pairs(table(spark, d, "pages").select("page_id", "html"), "a", "href")


@query(f"SELECT page_id, pos, value, content FROM ({_HREFS})")
def c4_extract_pairs(spark, d):
    return _links(spark, d)


@query(f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, 'a' AS tag, value, content FROM ({_HREFS})")
def c4_nested_pairs(spark, d):
    return corpus.nested_pairs(table(spark, d, "pages").select("page_id", "html"), "href").select("page_id", "pos", "tag", "value", "content")


@query("SELECT n_regionkey, repeat(string_agg('<li title=\"' || replace(n_name, '\"', '&quot;') || '\">' || n_name || '</li>', '' ORDER BY n_nationkey), 2) AS html FROM nation GROUP BY n_regionkey")
def c5_render_rows(spark, d):
    row = F.concat(F.lit('<li title="'), S.escape_attribute(F.col("n_name")), F.lit('">'), "n_name", F.lit("</li>"))
    return corpus.render_rows(table(spark, d, "nation"), row, "n_regionkey", ["n_nationkey"], twice=True)


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'en:' || source ELSE 'ar:' || source END AS text, CASE WHEN lang = 'ar' THEN 'rtl' ELSE 'ltr' END AS direction FROM documents")
def c6_pick_locale(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return corpus.pick_locale(docs, "lang", F.concat(F.lit("ar:"), "source"), F.concat(F.lit("en:"), "source")).select("doc_id", "text", "direction")


@query(f"SELECT page_id, {_page_path('url')} AS path FROM pages")
def c7_normalise_path(spark, d):
    return table(spark, d, "pages").select("page_id", S.normalise_path(F.col("url")).alias("path"))


@query(f"SELECT page_id, value, {_link_path('value')} AS link_path, {_page_path('url')} AS page_path, {_link_path('value')} = {_page_path('url')} AS current FROM ({_HREFS})")
def c8_match_links(spark, d):
    return corpus.match_links(table(spark, d, "pages"), _links(spark, d)).select("page_id", "value", "link_path", "page_path", "current")


@query(f"""SELECT kind, cache, count(*)::BIGINT AS n FROM (SELECT CASE WHEN asset THEN 'asset' ELSE 'html' END AS kind,
CASE WHEN asset THEN 'immutable' ELSE 's-maxage=300, stale-while-revalidate=600' END AS cache
FROM (SELECT regexp_matches({_PATH.format(u='value')}, '^/({"|".join(ASSET_PREFIXES)})') AS asset FROM ({_HREFS}))) GROUP BY kind, cache""")
def c9_classify_path(spark, d):
    kind, cache = corpus.classify_path(S.url_path(F.col("value")), ASSET_PREFIXES)
    return _links(spark, d).groupBy(kind.alias("kind"), cache.alias("cache")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT url AS loc, r.lastmod, coalesce(r.changefreq, 'monthly') AS changefreq, coalesce(r.priority, 0.5)::DOUBLE AS priority FROM pages
LEFT JOIN (VALUES ('en', 'weekly', 1.0, '2024-01-01'), ('fr', 'daily', 0.8, NULL)) r(key, changefreq, priority, lastmod)
ON regexp_extract(url, '^[a-z]+://[^/]*/([a-z]+)/', 1) = r.key""")
def c10_build_sitemap(spark, d):
    rules = spark.createDataFrame([("en", "weekly", 1.0, "2024-01-01"), ("fr", "daily", 0.8, None)], "key string, changefreq string, priority double, lastmod string").withColumn("lastmod", F.col("lastmod").cast("date"))
    return corpus.build_sitemap(table(spark, d, "pages").select("url"), rules, F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1)).withColumn("lastmod", F.col("lastmod").cast("string"))


@query("""SELECT page_id, CASE WHEN t <> '' THEN t || ' — Library' ELSE 'Library' END AS title, 'All pages' AS description, coalesce(nullif(l, ''), 'ar') AS page_lang
FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1) AS l FROM pages)""")
def c11_page_metadata(spark, d):
    made = corpus.page_metadata(table(spark, d, "pages"), "%s — Library", {"title": "Library", "description": "All pages", "lang": "ar"})
    return made.select("page_id", "title", "description", "page_lang")


@query("""SELECT s_suppkey, s_name AS name, n_name AS country, CASE WHEN s_acctbal >= 0 THEN 'credit' END AS standing, 'Organization' AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def c12_to_record(spark, d):
    both = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    fields = {"name": F.col("s_name"), "address": F.struct(F.col("n_name").alias("addressCountry")), "standing": F.when(F.col("s_acctbal") >= 0, "credit"), "sameAs": F.array("s_name", "n_name")}
    part = lambda p: F.get_json_object("record", p)
    return corpus.to_record(both, "Organization", fields).select("s_suppkey", part("$.name").alias("name"), part("$.address.addressCountry").alias("country"), part("$.standing").alias("standing"), part("$['@type']").alias("kind"))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'left_only' WHEN a.doc_id IS NULL THEN 'right_only' ELSE 'changed' END AS status
FROM (SELECT doc_id, quality AS v FROM labels) a FULL OUTER JOIN (SELECT doc_id, toxic AS v FROM labels WHERE doc_id % 3 <> 0) b ON a.doc_id = b.doc_id
WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.v IS DISTINCT FROM b.v""")
def c13_differences(spark, d):
    labels = table(spark, d, "labels")
    return corpus.differences(labels.select("doc_id", F.col("quality").alias("v")), labels.where("doc_id % 3 <> 0").select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def c13_unplaced(spark, d):
    return corpus.unplaced(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(f"SELECT path, count(*)::BIGINT AS n_links FROM (SELECT {_link_path('value')} AS path FROM ({_HREFS})) l WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE {_page_path('p.url')} = l.path) GROUP BY path")
def c13_missing_targets(spark, d):
    links = _links(spark, d).select(S.normalise_path(F.col("value"), strip_index=False).alias("path"))
    return corpus.missing_targets(links, table(spark, d, "pages").select(S.normalise_path(F.col("url")).alias("path")), "path").groupBy("path").agg(F.count(F.lit(1)).alias("n_links"))


@query(f"""SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host,
CASE WHEN value LIKE 'mailto:%' THEN 'mail' WHEN value LIKE 'tel:%' THEN 'phone' WHEN value LIKE 'https:%' THEN 'secure' WHEN value LIKE 'http:%' THEN 'plain' WHEN value LIKE '#%' THEN 'anchor' WHEN value LIKE '/%' THEN 'path' ELSE 'relative' END AS scheme,
(length({_link_path('value')}) - length(replace({_link_path('value')}, '/', '')))::INTEGER AS depth, count(*)::BIGINT AS n_links FROM ({_HREFS}) GROUP BY ALL""")
def c13_links_by_host(spark, d):
    links = table(spark, d, "pages").select("page_id", S.url_host(F.col("url")).alias("host")).join(_links(spark, d), "page_id")
    path = S.normalise_path(F.col("value"), strip_index=False)
    depth = (F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit("")))).cast("int")
    return links.groupBy("host", S.link_scheme(F.col("value")).alias("scheme"), depth.alias("depth")).agg(F.count(F.lit(1)).alias("n_links"))


@query("""SELECT month, count(*)::BIGINT AS n, sum(net)::DOUBLE AS net, sum(round(net * 0.15, 2))::DOUBLE AS tax, sum(net + round(net * 0.15, 2))::DOUBLE AS gross
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_totalprice::DECIMAL(12,2) AS net FROM orders) GROUP BY month""")
def c14_price_with_tax(spark, d):
    priced = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.concat(F.format_number(F.col("o_totalprice").cast("decimal(12,2)"), 2), F.lit(" ر.س")).alias("price"))
    total = lambda c: F.sum(c).cast("double").alias(c)
    return corpus.price_with_tax(priced, "price").groupBy("month").agg(F.count(F.lit(1)).alias("n"), total("net"), total("tax"), total("gross"))


@query("""WITH RECURSIVE own AS (SELECT DISTINCT 'N' || c_nationkey AS tier, c_mktsegment AS feature FROM customer),
inc AS (SELECT 'R' || n_regionkey AS tier, 'N' || n_nationkey AS part FROM nation UNION SELECT 'W', 'R' || r_regionkey FROM region UNION SELECT * FROM (VALUES ('A', 'W'), ('B', 'A'), ('W', 'B'))),
exc AS (SELECT 'R' || r_regionkey AS tier, 'MACHINERY' AS feature FROM region UNION SELECT 'A', 'BUILDING'),
f AS (SELECT tier, feature FROM own ANTI JOIN exc USING (tier, feature)
  UNION SELECT inc.tier, f.feature FROM f JOIN inc ON inc.part = f.tier LEFT JOIN exc ON exc.tier = inc.tier AND exc.feature = f.feature WHERE exc.tier IS NULL)
SELECT tier, feature FROM f""")
def c15_expand_tiers(spark, d):
    """Nations in regions in the world, which is in A, A in B and B in the world again; regions leave out one feature and A another."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    own = table(spark, d, "customer").select(name("N", "c_nationkey").alias("tier"), F.col("c_mktsegment").alias("feature")).distinct()
    includes = nation.select(name("R", "n_regionkey").alias("tier"), name("N", "n_nationkey").alias("part")).unionByName(region.select(F.lit("W").alias("tier"), name("R", "r_regionkey").alias("part")))
    includes = includes.unionByName(spark.createDataFrame([("A", "W"), ("B", "A"), ("W", "B")], "tier string, part string"))
    excluded = region.select(name("R", "r_regionkey").alias("tier"), F.lit("MACHINERY").alias("feature")).unionByName(spark.createDataFrame([("A", "BUILDING")], "tier string, feature string"))
    return corpus.expand_tiers(own, includes, excluded)


_TARGET = "https://chat.example.com/send"
_LEAD = f"'{_TARGET}?text=' || " + _encode("'New request' || chr(10) || 'Name: ' || coalesce(role, '') || chr(10) || 'Company: ' || chr(10) || 'Type: ' || CASE WHEN turn % 2 = 0 THEN 'Villa & garden' ELSE '' END || chr(10) || 'Message: ' || regexp_replace(coalesce(text, ''), '^[\\s\\p{Z}\\x{FEFF}]+|[\\s\\p{Z}\\x{FEFF}]+$', '', 'g')")


def _leads(spark, d):
    fields = {"Name": F.col("role"), "Company": F.lit(None).cast("string"), "Type": F.when(F.col("turn") % 2 == 0, " Villa & garden "), "Message": F.col("text")}
    return leads.compose_lead(table(spark, d, "conversations"), _TARGET, "New request", fields)


@query(f"SELECT conv_id, turn, {_LEAD} AS link FROM conversations")
def l1_compose_lead(spark, d):
    return _leads(spark, d).select("conv_id", "turn", "link")


@query(f"SELECT p_partkey, '{_TARGET}?text=' || {_encode(chr(39) + 'Hello, I want to ask about (' + chr(39) + ' || p_name || ' + chr(39) + ')!' + chr(39))} AS link FROM part")
def l2_compose_request(spark, d):
    return leads.compose_request(table(spark, d, "part"), _TARGET, "Hello, I want to ask about (%s)!", F.col("p_name")).select("p_partkey", "link")


@query(f"""SELECT '{_TARGET}' AS target, turn, count(*)::BIGINT AS n, sum(length('New request' || chr(10) || 'Name: ' || coalesce(role, '') || chr(10) || 'Company: ' || chr(10) || 'Type: ' || CASE WHEN turn % 2 = 0 THEN 'Villa & garden' ELSE '' END || chr(10)
|| 'Message: ' || regexp_replace(coalesce(text, ''), '^[\\s\\p{{Z}}\\x{{FEFF}}]+|[\\s\\p{{Z}}\\x{{FEFF}}]+$', '', 'g')))::BIGINT AS n_chars FROM conversations GROUP BY turn""")
def l3_decode_links(spark, d):
    return leads.decode_links(_leads(spark, d), "link").groupBy("target", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("message")).cast("long").alias("n_chars"))


_S1 = "SELECT user_id, coalesce(arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type IN ('click', 'view')), 'none') AS preference FROM events GROUP BY user_id"
_S2 = "CASE WHEN sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) % 2 = 0 THEN 'dark' ELSE 'light' END AS state"
_S3 = """WITH r AS (SELECT *, sum(CASE WHEN p IS NULL OR p = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run
  FROM (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type IS NOT NULL))
SELECT event_id, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) % 2 = 1 THEN event_type END AS open_item FROM r"""
_S4 = """WITH s AS (SELECT event_id, user_id, ts, sum(CASE WHEN ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
SELECT event_id, user_id, session::BIGINT AS session, CASE WHEN row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) = 1 THEN 'full' ELSE 'instant' END AS mode FROM s"""
_S5 = """WITH f AS (SELECT event_id, user_id, ts, coalesce(value > 30, false) AS above FROM events),
c AS (SELECT *, above AND NOT coalesce(lag(above) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS crossing FROM f)
SELECT event_id, above, crossing, crossing AND sum(crossing::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS first_crossing FROM c"""


@query(_S1)
def s1_latest_preference(spark, d):
    return sequence.latest_preference(table(spark, d, "events"), "user_id", "event_type", ["click", "view"], "none")


@query(f"SELECT event_id, user_id, {_S2} FROM events")
def s2_toggle_state(spark, d):
    return sequence.toggle_state(table(spark, d, "events"), "user_id", F.col("event_type") == "click", "dark", "light").select("event_id", "user_id", "state")


@query(_S3)
def s3_exclusive_toggle(spark, d):
    return sequence.exclusive_toggle(table(spark, d, "events"), "user_id", "event_type").select("event_id", "user_id", "open_item")


@query(_S4)
def s4_first_per_session(spark, d):
    return sequence.first_per_session(table(spark, d, "events"), "user_id").select("event_id", "user_id", "session", "mode")


@query(_S5)
def s5_threshold_cross(spark, d):
    return sequence.threshold_cross(table(spark, d, "events"), "user_id", "value", 30.0).select("event_id", "above", "crossing", "first_crossing")


@query("""SELECT n_nationkey, coalesce(lead(n_name) OVER w, first(n_name) OVER a) AS next, coalesce(lag(n_name) OVER w, last(n_name) OVER a) AS previous,
printf('%02d / %02d', row_number() OVER w, count(*) OVER a) AS label FROM nation
WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey), a AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def s6_ring_nav(spark, d):
    return sequence.ring_nav(table(spark, d, "nation"), "n_regionkey", "n_nationkey", "n_name").select("n_nationkey", "next", "previous", "label")


# epoch_ms rounds to the nearest millisecond, which may be in the next period; // and % go towards zero before the epoch.
_PERIOD = "((epoch_us(ts) - (epoch_us(ts) % 6500000 + 6500000) % 6500000) // 6500000)"


@query(f"SELECT event_id, (({_PERIOD} % 4 + 4) % 4)::BIGINT AS slot FROM events")
def s7_rotation_slot(spark, d):
    return sequence.rotation_slot(table(spark, d, "events"), 4).select("event_id", "slot")


@query("SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id) FILTER (WHERE value IS NOT NULL), lambda r, x: r + (x - r) * 0.2), 6) AS ema, count(value)::BIGINT AS n FROM events GROUP BY user_id")
def s8_ema(spark, d):
    return sequence.ema(table(spark, d, "events"), "user_id", "value").select("user_id", F.round("ema", 6).alias("ema"), "n")


@query("""SELECT l_orderkey, l_linenumber, round(s * 100, 6) AS percent, round(e, 6) AS early, round(greatest(0.0, least(1.0, (e - 0.22) / 0.5)), 6) AS late
FROM (SELECT *, greatest(0.0, least(1.0, s / 0.62)) AS e FROM (SELECT l_orderkey, l_linenumber, CASE WHEN m > 0 THEN l_extendedprice / m ELSE 0 END AS s
FROM (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS m FROM lineitem)))""")
def s9_ramp(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    most = F.max("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    percent, early, late = sequence.ramp(F.col("l_extendedprice"), F.col("m"))
    return lines.withColumn("m", most).select("l_orderkey", "l_linenumber", F.round(percent, 6).alias("percent"), F.round(early, 6).alias("early"), F.round(late, 6).alias("late"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS distance, round(0.15 * (1 - sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 0.02), 9) AS weight
FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) a JOIN (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) b
ON a.vec_id < b.vec_id AND abs(a.x - b.x) < 0.02 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 0.02""")
def s10_proximity_pairs(spark, d):
    pairs = sequence.proximity_pairs(_points(spark, d), "vec_id", "x", "y", 0.02)
    return pairs.select("a", "b", F.round("distance", 9).alias("distance"), F.round("weight", 9).alias("weight"))


def _points(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


@query("""SELECT vec_id, round(d, 9) AS distance, round(0.28 * (1 - d / 0.1), 9) AS weight FROM (SELECT vec_id, sqrt((x - 0.05) * (x - 0.05) + (y + 0.02) * (y + 0.02)) AS d
FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)) WHERE d < 0.1""")
def s10_near_point(spark, d):
    return sequence.near_point(_points(spark, d), "vec_id", "x", "y", (0.05, -0.02), 0.1).select("vec_id", F.round("distance", 9).alias("distance"), F.round("weight", 9).alias("weight"))


@query(f"""WITH f AS (SELECT {_page_path('url')} AS name, count(*) AS n_files, sum(octet_length(encode(html))) AS bytes FROM pages GROUP BY 1),
w AS (SELECT {_page_path('url')} AS name FROM pages UNION SELECT {_link_path('value')} FROM ({_HREFS}))
SELECT name, coalesce(n_files, 0)::BIGINT AS n_files, CASE WHEN bytes IS NULL THEN '' ELSE floor(bytes / 1024 + 0.5)::BIGINT || ' KB' END AS size,
CASE WHEN bytes IS NULL THEN 'missing' ELSE 'ok' END AS status FROM w LEFT JOIN f USING (name)""")
def m1_audit_manifest(spark, d):
    pages = table(spark, d, "pages").select(S.normalise_path(F.col("url")).alias("path"), F.octet_length("html").alias("length"))
    wanted = pages.select(F.col("path").alias("name")).union(_links(spark, d).select(S.normalise_path(F.col("value"), strip_index=False))).distinct()
    audited = manifest.audit_manifest(wanted, pages, "name", F.col("path"))
    return audited.select("name", "n_files", S.if_null(S.with_suffix(F.col("kb"), F.lit(" KB")), F.lit("")).alias("size"), "status")


@query("""SELECT p_partkey, p_type, r.pos::INTEGER AS request_pos FROM part JOIN (SELECT unnest(['SMALL', 'ECONOMY', 'SMALL', 'NO SUCH']) AS k, unnest([0, 1, 2, 3]) AS pos) r ON split_part(p_type, ' ', 1) = r.k""")
def m2_select_jobs(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_type", F.split("p_type", " ")[0].alias("kind"))
    return manifest.select_jobs(parts, "kind", ["SMALL", "ECONOMY", "SMALL", "NO SUCH"]).select("p_partkey", "p_type", "request_pos")


@query(_S1)
def s1_latest_stream(spark, d):
    latest = sequence.latest_preference(state.file_stream(spark, d, "events"), "user_id", "event_type", ["click", "view"], "none")
    return state.drained(latest, "complete")


def _in_order(spark, d, make, *args):
    """A stream over the events in shuffled files, one a micro-batch, applied in order of event time."""
    mixed = written(table(spark, d, "events").repartition(3, "event_id"), "shuffled")
    clock = state.Clock(spark)
    events = spark.readStream.schema(mixed.schema).option("maxFilesPerTrigger", 1).parquet(mixed._quarryline_path).withColumn("ts", F.col("ts").cast("timestamp"))
    return state.drained(make(clock.beside(events), "user_id", *args, delay="60 days"), clock=clock)


@query(f"SELECT event_id, user_id, {_S2} FROM events")
def s2_toggle_stream(spark, d):
    return _in_order(spark, d, state.toggle_stream, "event_type", "click", "dark", "light").select("event_id", "user_id", "state")


@query(_S3)
def s3_exclusive_stream(spark, d):
    return _in_order(spark, d, state.exclusive_stream, "event_type").select("event_id", "user_id", "open_item")


@query(_S4)
def s4_first_stream(spark, d):
    return _in_order(spark, d, state.session_stream).select("event_id", "user_id", "session", "mode")


@query("SELECT user_id, count(*)::BIGINT AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id")
def s4_once_stream(spark, d):
    once = state.first_stream(state.file_stream(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", delay="365 days")
    return state.drained(once).join(table(spark, d, "events").select("event_id", "user_id"), ["event_id", "user_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(_S5)
def s5_cross_stream(spark, d):
    return _in_order(spark, d, state.cross_stream, "value", 30.0).select("event_id", "above", "crossing", "first_crossing")


@query("SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda r, x: r + (x - r) * 0.2), 6) AS ema FROM events GROUP BY user_id")
def s8_ema_stream(spark, d):
    steps = _in_order(spark, d, state.ema_stream, "value")
    order = table(spark, d, "events").select("event_id", "ts")
    return steps.join(order, "event_id").groupBy("user_id").agg(F.round(F.max_by("ema", F.struct("ts", "event_id")), 6).alias("ema"))


_SESSIONS = """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_at, count(*)::BIGINT AS n, (count(*) FILTER (WHERE event_type = 'click'))::BIGINT AS n_clicks
FROM (SELECT *, sum(CASE WHEN ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, session"""
_SLOTS = f"""SELECT period * 6500 AS start_ms, ((period % 4 + 4) % 4)::BIGINT AS slot, count(*)::BIGINT AS n, sum(value::DECIMAL(20,4))::DOUBLE AS total
FROM (SELECT *, {_PERIOD} AS period FROM events WHERE ts IS NOT NULL) GROUP BY period"""


def _sessions(events):
    said = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    found = sequence.session_totals(events, "user_id", "30 minutes", n_clicks=F.count_if(F.col("event_type") == "click"))
    return found.select("user_id", "first_at", "last_at", "n", "n_clicks"), lambda df: df.select("user_id", said("first_at"), said("last_at"), "n", "n_clicks")


@query(_SESSIONS)
def s4_session_totals(spark, d):
    found, shown = _sessions(table(spark, d, "events"))
    return shown(found)


@query(_SESSIONS)
def s4_session_totals_stream(spark, d):
    clock = state.Clock(spark)
    found, shown = _sessions(clock.beside(state.file_stream(spark, d, "events")).withWatermark("ts", "1 hour"))
    return shown(state.drained(found, clock=clock).where("user_id IS NOT NULL"))


def _slots(events):
    return sequence.slot_totals(events, 4, 6500, total=F.sum(F.col("value").cast("decimal(20,4)")).cast("double"))


@query(_SLOTS)
def s7_slot_totals(spark, d):
    return _slots(table(spark, d, "events"))


@query(_SLOTS)
def s7_slot_totals_stream(spark, d):
    clock = state.Clock(spark)
    found = _slots(clock.beside(state.file_stream(spark, d, "events")).withWatermark("ts", "1 hour"))
    return state.drained(found, clock=clock)


def _in_chunks(whole: str, key: str, chunk: int) -> str:
    return f"SELECT {key}, chunk, chunk * {chunk} AS offset, substr(html, chunk * {chunk} + 1, {chunk}) AS text FROM (SELECT {key}, html, unnest(range(greatest(1, (length(html) + {chunk} - 1) // {chunk}))) AS chunk FROM ({whole}))"


@query(_in_chunks(ORACLE_SQL["c1_assemble_ordered"], "conv_id", 700))
def c1_assemble_chunks(spark, d):
    return chunks.assemble_chunks(table(spark, d, "conversations"), "conv_id", "turn", "text", wrap="div", head="<main>", foot="</main>", chunk=700)


@query(_in_chunks(ORACLE_SQL["c5_render_rows"], "n_regionkey", 64))
def c5_render_chunks(spark, d):
    row = F.concat(F.lit('<li title="'), S.escape_attribute(F.col("n_name")), F.lit('">'), "n_name", F.lit("</li>"))
    return chunks.render_chunks(table(spark, d, "nation"), row, "n_regionkey", ["n_nationkey"], twice=True, chunk=64)


@query("""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'left_only' WHEN a.o_orderkey IS NULL THEN 'right_only' ELSE 'changed' END AS status
FROM (SELECT o_orderkey, o_orderstatus AS v FROM orders WHERE o_orderkey % 501 <> 7) a
FULL OUTER JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 997 = 5 THEN '?' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 701 <> 9) b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.v IS DISTINCT FROM b.v""")
def c13_differences_by_digest(spark, d):
    """Two states of the orders, of which few rows differ."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    before = orders.where("o_orderkey % 501 <> 7").withColumnRenamed("o_orderstatus", "v")
    after = orders.where("o_orderkey % 701 <> 9").select("o_orderkey", F.when(F.col("o_orderkey") % 997 == 5, "?").otherwise(F.col("o_orderstatus")).alias("v"))
    return chunks.differences(before, after, "o_orderkey", "v")


def shifted_points(spark, d):
    """The embeddings, and each of them once more with every component moved by up to 0.04; moved ones have odd ids."""
    points = table(spark, d, "embeddings").select("vec_id", "embedding")
    noise = lambda k: (F.pmod(F.xxhash64("vec_id", k), F.lit(2001)) - 1000) / 25_000
    moved = points.select((F.col("vec_id") * 2 + 1).alias("vec_id"), F.transform("embedding", lambda x, k: x.cast("double") + noise(k)).alias("v"))
    return points.select((F.col("vec_id") * 2).alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).unionByName(moved)


@query()
def s10_near_pairs(spark, d):
    """Approximate, so without SQL: the tests measure how many pairs are found."""
    found = sequence.near_pairs(shifted_points(spark, d), "vec_id", "v", 64, 0.3)
    return found.select("a", "b", F.round("distance", 9).alias("distance"), F.round("weight", 9).alias("weight"))


@query(ORACLE_SQL["c13_missing_targets"])
def c13_missing_filtered(spark, d):
    links = _links(spark, d).select(S.normalise_path(F.col("value"), strip_index=False).alias("path"))
    return corpus.missing_targets_filtered(links, table(spark, d, "pages").select(S.normalise_path(F.col("url")).alias("path")), "path").groupBy("path").agg(F.count(F.lit(1)).alias("n_links"))
