"""The training-data operators against plain versions, on texts that tables seldom hold."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import brute

pytest.importorskip("quarryline.llm")
from quarryline.llm import license_scan, line_crf, line_dedup, metric_join, ngram_join, packing, piece_codec, quality_rules, secret_scan, style_tree  # noqa: E402
from quarryline.llm.components import components  # noqa: E402
from quarryline.llm.queries import vocabulary  # noqa: E402

SECRET = 'token = "0123456789abcdef0123456789abcdef"'
LINE = "This LINE is shared by many documents, word for word."


def corpus():
    r = random.Random(7)
    word = lambda: "".join(r.choice("aeinrstlo") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() + ("\n" if r.random() < 0.1 else "") for _ in range(n))
    base = [text(r.randint(60, 120)) for _ in range(12)]
    texts = [None, "", " \t\n", "one", "five words make one set", *base, *base[:3], base[0]]
    for b in base[:4]:  # near copies: a chain, and some just apart
        words = b.split(" ")
        for cut in (3, 6, 15):
            texts.append(" ".join([*words[:cut], "CHANGED", *words[cut + 1 :]]))
    texts += [f"{b}\n  {LINE.upper() if k % 2 else LINE}\t\n{b[:20]}" for k, b in enumerate(base[4:11])]
    texts += [text(9000), "€ " + SECRET + "\n" + "AKIA" + "Q" * 20 + " passwd: x api_key='secret=token:abcdef'", "### $$$ " * 200, "GO NOW!! " * 300, "a a a a a a"]
    texts += ["Released under the MIT License. Licensed under CC BY-NC 4.0", "This work is licensed under the GNU General Public License, version 3."]
    return dict(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with columns whose names the operators use themselves."""
    rows = [(i, t, i, "x", [1], True) for i, t in corpus().items()]
    return spark.createDataFrame(rows, "doc_id long, text string, n_lines long, secrets string, ids array<int>, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def nameless(spark):
    """Rows that repeat, and rows without id."""
    return spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, SECRET), (None, SECRET), (None, None), (None, LINE)], "doc_id long, text string")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_line_dedup(docs, none, nameless):
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == ["doc_id", "text", "secrets", "ids", "kept", "n_lines", "n_dropped"]
    want = brute.line_dedup(corpus())
    assert by_id(out, "n_lines", "n_dropped", "text") == want
    assert sum(w[1] for w in want.values()) > 6
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert line_dedup.drop_repeated_lines(nameless, min_docs=2).agg(F.sum("n_dropped")).first()[0] == 0


def test_repeated_rows_count_once(spark):
    same = spark.createDataFrame([(1, LINE)] * 4 + [(2, LINE), (3, "x\n" + LINE + "\n" + LINE)], "doc_id long, text string")
    out = line_dedup.drop_repeated_lines(same, min_docs=3)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "")] * 4 + [(2, ""), (3, "x\n" + LINE + "\n" + LINE)]


def test_hot_lines_can_be_split(docs, monkeypatch):
    """Without the broadcast the join's sides are plain tables, so Spark may split a line that very many documents hold."""
    plans = {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    from quarryline.llm.common import written

    monkeypatch.setattr(line_dedup, "written", noted)
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", 0)
    spark = docs.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert by_id(line_dedup.drop_repeated_lines(docs), "n_lines", "n_dropped", "text") == brute.line_dedup(corpus())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plans["drops"][plans["drops"].index("SortMergeJoin") :]
    assert join.count("Exchange hashpartitioning(__ql_h1") == 2 and "Aggregate" not in join


def test_quality_rules(docs, none, nameless):
    entries = quality_rules.ledger(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert by_id(entries, *names) == {i: brute.measures(t) for i, t in corpus().items()}
    judged = quality_rules.apply_policy(quality_rules.apply_policy(entries, "base", "base_passed"), "v2")
    rows = by_id(judged, "base_passed", "kept", "failed_bits")
    for i, t in corpus().items():
        n, _, _, _, again = brute.measures(t)
        assert rows[i][0] == (not (n < 50 or 100 * again > 50 * n)) and (rows[i][0] or not rows[i][1])
    effects = {(r.policy, r.rule): r for r in quality_rules.ablations(entries).collect()}
    assert effects["base", "few_words"].n_kept == sum(r[0] for r in rows.values())
    alone = quality_rules.mask(["few_words"])
    assert effects["v2", "few_words"].n_alone == sum(r[2] & quality_rules.mask(quality_rules.POLICIES["v2"]) == alone for r in rows.values())
    assert quality_rules.ledger(none).count() == 0 and quality_rules.ledger(nameless).count() == 6


def test_native_plans_have_no_python(docs):
    for df in (line_dedup.drop_repeated_lines(docs), quality_rules.ledger(docs), secret_scan.find_secrets(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_secrets(docs, none, nameless):
    base = [r.kind for r in secret_scan.BASE_RULES]
    found = secret_scan.find_secrets(docs)
    for r in found.collect():
        spans = [s for s in r.secrets if s.kind in base]
        joined = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)
        counts = tuple(sum(s.kind == k for s in spans) for k in base)
        assert (*counts, hashlib.sha256(joined.encode()).hexdigest()) == brute.secrets(corpus()[r.doc_id])
    clean = by_id(secret_scan.redact(found), "text")
    assert all((clean[i] == t) == (not any(brute.secrets(t)[:3])) for i, t in corpus().items() if t)
    assert not any(any(brute.secrets(t)[:3]) for t in clean.values())
    assert secret_scan.find_secrets(none).count() == 0
    assert sorted(len(r.secrets) for r in secret_scan.find_secrets(nameless).collect()) == [0, 0, 0, 0, 2, 2]


def test_candidates_beyond_the_broadcast(docs, monkeypatch):
    few = by_id(secret_scan.find_secrets(docs), "secrets")
    monkeypatch.setattr(secret_scan, "MOST_BROADCAST", 0)
    assert by_id(secret_scan.find_secrets(docs), "secrets") == few


def test_more_secret_rules(spark):
    texts = ["-----BEGIN RSA PRIVATE KEY-----\nMIIEow==\n-----END RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "xoxb-1234567890-abc", "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh12"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = by_id(secret_scan.find_secrets(df).withColumn("k", F.transform("secrets", lambda s: s["kind"])), "k")
    assert kinds == {0: ["private_key"], 1: ["github"], 2: ["slack"], 3: ["jwt"]}


def test_trigram_queries():
    ask = secret_scan.trigram_query
    assert ask("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert ask("[0-9a-f]{24,}") is None
    assert set(ask("(?:abc|abd)x?[0-9]efg")) == {frozenset(s) for s in ({"abc", "bcx", "efg"}, {"abc", "efg"}, {"abd", "bdx", "efg"}, {"abd", "efg"})}
    alternatives = ask(secret_scan.BASE_RULES[0].pattern)
    assert sum(not any(b < a for b in alternatives) for a in alternatives) == 6


def test_classifier(spark, docs, none, nameless):
    sf = "/root/testdata/sf0.01"
    real, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = line_crf.train(real, labels.where(~line_crf.held_out()))
    test = line_crf.score(real, field).join(labels.where(line_crf.held_out()), "doc_id").select((F.col("score") >= 0.7).cast("int").alias("p"), "quality").collect()
    assert len(test) > 50 and sum(r.p == r.quality for r in test) / len(test) >= 0.95
    scores = by_id(line_crf.score(docs, field), "score")
    assert len(scores) == len(corpus()) and all(0 <= s <= 1 for s in scores.values()) and scores[0] == scores[1]
    assert line_crf.train(real, labels.limit(0)).weights.max() == 0
    twice = real.unionByName(real).withColumn("__ql_y", F.lit(1))
    some = line_crf.train(twice, labels.unionByName(labels.withColumn("quality", F.lit(0))), most=20, most_lines=300)
    assert np.isfinite(some.weights).all() and (some.weights != field.weights).any()
    assert line_crf.train(real, labels, most=20, most_lines=0).weights.max() == 0
    kept = line_crf.accepted(docs, field)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.7}
    assert line_crf.score(none, field).count() == 0 and line_crf.score(nameless, field).count() == 6
    assert by_id(line_crf.score(docs, line_crf.train(docs, labels.limit(0))), "score")[5] == pytest.approx(0.5)


def test_forward_backward():
    """Marginals of short chains equal sums over all labelings."""
    rng = np.random.default_rng(0)
    field = line_crf.Field(rng.normal(size=line_crf.N_FEATURES), rng.normal(size=(2, 2)))
    features, first = rng.normal(size=(9, line_crf.N_FEATURES)), np.array([0, 4, 5, 9])
    chance, pairs = field.marginals(features, first)
    for d, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        weight = {}
        for bits in range(1 << (b - a)):
            ys = [bits >> k & 1 for k in range(b - a)]
            weight[tuple(ys)] = np.exp(sum((features[a + k] @ field.weights) * y for k, y in enumerate(ys)) + sum(field.steps[x, y] for x, y in zip(ys, ys[1:], strict=False)))
        total = sum(weight.values())
        for k in range(b - a):
            assert chance[a + k] == pytest.approx(sum(w for ys, w in weight.items() if ys[k]) / total)
        assert pairs[d].sum() == pytest.approx(b - a - 1)


@pytest.mark.parametrize("cell", [4000, 6])
def test_metric_join(spark, monkeypatch, cell):
    monkeypatch.setattr(metric_join, "CELL", cell)
    monkeypatch.setattr(metric_join, "BLOCK", 16 if cell == 6 else 2048)
    monkeypatch.setattr(metric_join, "MOST_PIVOTS", 2048 if cell == 4000 else 20)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(9, 8))
    rows = [(i, (centre[i % 9] + rng.normal(size=8) * 0.3).round(3).tolist(), i % 2) for i in range(90)]
    rows += [(90, rows[0][1], 0), (91, rows[0][1], 1), (92, [2 * x for x in rows[1][1]], 1), (93, None, 0), (94, [0.0] * 8, 0), (95, [float("nan")] * 8, 0), (96, [1.0, None] * 4, 0), (97, rows[0][1], None), (98, [], 1), (99, [1.0, 0.0], 1), (100, [1.0, 0.01], 1)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<double>, label int, id string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.near_vectors(df).collect()}
    want = brute.near(rows)
    assert got == want and sum(n for n, _ in want.values()) > 100
    assert metric_join.near_vectors(df.limit(0)).count() == 0


def test_metric_join_of_odd_ids(spark):
    """Null ids, rows that repeat an id, and equal vectors under several ids."""
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(None, v, 1), (4, v, 1), (2, [0.99, 0.01, 0.0], 1), (7, w, 1), (7, w, 1), (None, [0.0, 0.0, 1.0], 1), (None, None, 1), (3, v, 2)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in metric_join.near_vectors(df).collect()))
    assert got == [(0, 0, 0, True), (0, 0, 0, True), (0, 2, 2, False), (2, 2, 2, True), (3, 0, 3, True), (4, 2, 2, False), (7, 1, 7, True), (7, 1, 7, True)]


def test_pivots_and_rings_save_work(spark, monkeypatch):
    """On vectors in clusters few of all pairs are compared, and what is found is the same."""
    monkeypatch.setattr(metric_join, "CELL", 20)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(25, 16))
    x = centre.repeat(24, axis=0) + rng.normal(size=(600, 16)) * 0.25
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.near_vectors(df).collect()}
    assert got == brute.near(rows)
    classes = df.selectExpr("vec_id AS id", "0L AS kind", "1L AS weight", "embedding AS vec")
    shown = metric_join._shown(classes, np.sqrt(2 - 2 * 0.93) + 1e-9, 600)
    monkeypatch.setattr(metric_join, "BLOCK", 16)
    compared = metric_join._near_rings(shown)[1].agg(F.sum(F.col("n_own") * F.col("n_near"))).first()[0]
    assert compared < 0.25 * 600 * 600 and shown.count() < 4 * 600


def test_pieces_equal_the_library(docs, none, nameless):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    out = piece_codec.encode_documents(docs, path, ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"))
    for r in piece_codec.decode_ids(out, path, out="again").collect():
        want = library.encode(corpus()[r.doc_id] or "")
        assert r.ids == want and r.decoded == library.decode(want) == r.again and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert piece_codec.encode_documents(none, path).count() == 0 and piece_codec.encode_documents(nameless, path).count() == 6


def test_pieces_of_odd_texts():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.memory(path).model
    r = random.Random(1)
    chars = [t for t in model.texts if len(t) < 4]
    odd = ["▁x", "▁▁▁ a▁b", "    x     y", "        " * 5 + "z", "\x00a", "中文 字 🎉 ok", "a" * 40, "\n\n\n", "=========", "<s>hi</s>", "<unk>", " ", "ﬁ ½"]
    odd += ["".join(r.choice(chars) for _ in range(30)).replace("▁", " ") for _ in range(300)]
    for t in odd:
        ids = library.encode(t)
        assert model.encode(t) == ids and model.decode(ids) == library.decode(ids)


def test_licenses(docs, none, nameless):
    found = license_scan.find_licenses(docs)
    for r in found.collect():
        base = [p for p in r.places if not p.template]
        firsts = [p.first for p in base]
        got = (r.n_words, len(base), min(firsts, default=None), max(firsts, default=None), ",".join(sorted({p.label for p in base})))
        assert got == brute.licenses(corpus()[r.doc_id])
    labels = by_id(found.withColumn("l", license_scan.labels_of(F.col("places"), True)), "l")
    assert {"cc-by,cc-by-nc-4.0,mit,mit-statement", "gpl,gpl-3.0"} <= set(labels.values())
    assert license_scan.find_licenses(none).count() == 0 and license_scan.find_licenses(nameless).count() == 6


def test_template_markup():
    a = license_scan.compiled("x", "Granted <<beginOptional>>free <<beginOptional>>of charge<<endOptional>><<endOptional>> to <<var;name=who;words=1-2>> forever")
    hits = lambda t: a.matches(license_scan.words_of(t.encode()))
    assert hits("GRANTED, free of charge: to all people forever!") == [(0, 8)]
    assert hits("so granted to me forever granted free to me forever") == [(1, 4), (5, 5)]
    assert hits("granted of charge to me forever") == hits("granted to forever") == hits("granted to one two three forever") == []


def wording(template):
    """A template's text with its optional regions, and something for its replaceable ones."""
    import re

    def filled(m):
        if m[1] != "var":
            return ""
        named = re.search(r"match=([^;>|]+)", m[2])
        return named[1] if named else "Any Body At All"[: 8 if "words=0-" in m[2] or "1-3" in m[2] else 15]

    return license_scan._MARK.sub(filled, template)


def required(template):
    """A template without its optional regions."""
    import re

    inner = re.compile(r"<<beginOptional>>(?:(?!<<beginOptional>>|<<endOptional>>).)*<<endOptional>>", re.S)
    while inner.search(template):
        template = inner.sub(" ", template)
    return template


def test_whole_license_texts(spark):
    """Each template's wording is found under its label; with any one mandatory word changed it isn't."""
    import re

    texts = {label: wording(t[-1]) for label, t in license_scan.TEMPLATES.items()}
    rows, want = [], {}
    for label, t in texts.items():
        want[len(rows)] = label
        rows.append("Copyright someone\n" + t + "\nThe end.")
        short = wording(required(license_scan.TEMPLATES[label][-1]))
        words = [m for m in re.finditer(r"[A-Za-z]{4,}", short) if m[0].lower().encode() in license_scan.compiled(label, license_scan.TEMPLATES[label][-1]).mandatory]
        for m in words[:: max(1, len(words) // 5)]:
            want[len(rows)] = None
            rows.append(short[: m.start()] + "changed" + short[m.end() :])
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = license_scan.find_licenses(df)
    for r in found.withColumn("score", license_scan.confidence(F.col("places"), F.col("n_words"))).collect():
        labels = {p.label for p in r.places if p.template}
        if want[r.doc_id]:
            assert want[r.doc_id] in labels and 0.75 < r.score <= 1
            whole = {"bsd-2-clause", "bsd-3-clause", "mit-text", "isc-text", "mpl-2.0", "lgpl-2.1", "lgpl-3.0"}
            assert len(labels & whole) <= 1
    changed = {r.doc_id: {p.label for p in r.places if p.template} for r in found.collect() if want[r.doc_id] is None}
    label = None
    for i in range(len(rows)):
        label = want[i] or label
        assert want[i] or label not in changed[i], rows[i]


def test_choices_in_templates():
    a = license_scan.compiled("x", "<<var;name=act;match=released|licensed>> under it")
    hits = lambda t: a.matches(license_scan.words_of(t.encode()))
    assert hits("Released under it, LICENSED under it") == [(0, 3), (3, 3)] and hits("sold under it") == []


def test_ngram_join(spark, docs, none, nameless):
    out = by_id(ngram_join.jaccard_components(docs), "n_shingles", "component_id")
    assert out == brute.jaccard(corpus())
    assert len({c for _, c in out.values()}) < len(out) - 8
    one = ngram_join.one_of_each(docs)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, (_, c) in out.items() if i == c}
    assert ngram_join.jaccard_components(none).count() == 0
    assert sorted((r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(nameless.where("doc_id = 1")).collect()) == [(1, 1), (2, 1), (2, 1)]
    assert ngram_join.one_of_each(nameless).count() == 6


def test_ngram_join_needs_the_second_product(spark):
    """Chains and stars in which a leader isn't near to all."""
    r = random.Random(11)
    base = [f"w{k}" for k in range(200)]
    texts = {}
    for i in range(120):
        words = base.copy()
        for k in r.sample(range(200), r.randint(1, 6)):
            words[k] = f"x{r.randrange(10**6)}"
        texts[i] = " ".join(words)
    got = by_id(ngram_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), "n_shingles", "component_id")
    assert got == brute.jaccard(texts)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 99), (101, 99), (7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99, 101: 99}


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_style_tree(spark):
    rows = [(i, f"http://h.example/{i}", page(f"<div class='top'><span>Our site</span> says hello</div><div class='text'><p>Story {i} tells &amp; ends<br>here</p><p>More {i * 7}</p></div><div class='links'>All rights</div>")) for i in range(12)]
    rows += [(20, "http://one.example/", page("<header>Head</header><article><h1>A  b</h1><p><b>One<br><p>Two &lt;x&gt;</p><aside>no</aside><div class='comments'>no</div></article><footer>F</footer>")), (21, None, None), (22, "bad url", ""), (23, "http://h.example/x", "<p>bare " + "word " * 30000)]
    df = spark.createDataFrame([(*r, "old", 5) for r in rows], "page_id long, url string, html string, text string, host long")
    out = style_tree.main_text(df)
    assert out.columns == ["page_id", "url", "host", "text", "n_chars"]
    got = {r.page_id: r.text for r in out.collect()}
    assert all(got[i] == f"Story {i} tells & ends here\n\nMore {i * 7}" for i in range(12))
    assert got[20] == "A b\n\nOne\n\nTwo <x>" and got[21] == got[22] == "" and len(got[23]) == 4 + 5 * 30000
    assert style_tree.main_text(df.limit(0)).count() == 0


def test_packing(docs, none, nameless):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    packed = packing.pack(docs, path)
    rows = packed.toPandas()
    for i, parts in rows.sort_values("start").groupby("doc_id"):
        ids = [*library.encode(corpus()[i] or "", add_special_tokens=False).ids, 1]
        assert [x for p in parts["ids"] for x in p] == ids and (parts["doc_tokens"] == len(ids)).all()
        assert [zlib.crc32(np.array(p, dtype="<u4").tobytes()) for p in parts["ids"]] == parts["ids_crc32"].tolist()
        assert parts["start"].tolist() == [0, *parts["length"].cumsum().tolist()[:-1]]
    assert set(rows["doc_id"]) == set(corpus())
    for _, parts in rows.sort_values("offset").groupby("sequence_id"):
        assert parts["offset"].tolist() == [0, *parts["length"].cumsum().tolist()[:-1]] and parts["length"].sum() <= 2048
    whole = packing.sequences(packed).toPandas()
    assert whole["n_tokens"].sum() == rows["length"].sum() and len(whole) <= rows["length"].sum() // 2048 + 3
    assert packing.pack(none, path).count() == 0 and packing.pack(nameless, path).count() == 6


def test_patterns_cover_the_histogram():
    for n in (0, 1, 40, 20_000):
        histogram = np.bincount(np.minimum(256, 1 + np.random.default_rng(n).gamma(2, 40, n).astype(int)), minlength=257)[1:]
        found = packing.patterns(histogram)
        assert (sum((c * k for c, k in found), np.zeros(256, dtype=int)) == histogram).all()
        assert all((c * np.arange(1, 257)).sum() <= 256 for c, _ in found)
    assert sum(k for _, k in found) <= 1.005 * (histogram * np.arange(1, 257)).sum() / 256 + 1


def test_word_ids_equal_the_library():
    """Against an unaltered tokenizer: where blanks meet, tokens of the vocabulary's own stand, or units touch."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    words, library = packing.WordIds(path), Tokenizer.from_file(path)
    end = "<|endoftext|>"
    texts = ["", " ", "a  b", " a b ", "\n a", "a \n\n b", "don't  stop", "x\x1cy z", "é ü z  q", "\t\t a\r\n", "\r", "\x01", "a\u3000 b", "x.\ny it's", "٣ ½ a²b", "a\n\nb c\n", "n.\n", "x\u00a0 y.", "w" * 400]
    texts += [end, f"{end} a", f"a{end}", f"a {end} b.", f"one\n{end}\ntwo", f"{end}{end}", "<|endoftext", "a <|ENDOFTEXT|> b"]
    r = random.Random(2)
    signs = [" ", " ", "\n", "a", "Be", "é", ".", "!(", "'s", "'", "1", "²", "中", "🎉", "\t", "\x85", "-", end]
    texts += ["".join(r.choice(signs[: 11 if k % 2 else None]) for _ in range(r.randint(1, 12))) for k in range(4000)]
    for _ in range(2):  # the second time from memory
        ids, first = words.texts(pa.array(texts, type=pa.string()), np.array([1], dtype="<u4").tobytes())
        for t, x, y in zip(texts, first[:-1], first[1:], strict=True):
            assert ids[x:y].tolist() == [*library.encode(t, add_special_tokens=False).ids, 1], t


def test_spans_of_a_batch():
    import pyarrow as pa

    texts = pa.array(["a" * n for n in (3, 0, 50, 9, 9, 1, 30)])
    spans = packing._groups(texts, 20)
    assert [a for a, _ in spans] + [7] == [0] + [b for _, b in spans] and (2, 3) in spans and packing._groups(texts.slice(0, 0)) == []
