"""Each stage of the pipeline against a plain version, on its own input."""

import numpy as np
import pytest

from . import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from quarryline.llm.common import written  # noqa: E402

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, made = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        made.append(written(stage(spark, made[-1], SF), name))
    good, lines, single, clean, packed = made[1:]
    assert all(df.columns == columns for df in made[1:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum((i in texts(good)) == bool(q) for i, q in labels.items()) >= 0.95 * len(labels)
    assert texts(lines) == {i: t for i, (_, _, t) in brute.line_dedup(texts(good)).items()}
    assert set(texts(single)) == {i for i, (_, c) in brute.jaccard(texts(lines)).items() if i == c}
    before, after = texts(single), texts(clean)
    assert before.keys() == after.keys() and all((after[i] == t) == (not any(brute.secrets(t)[:3])) for i, t in before.items())
    assert not any(any(brute.secrets(t)[:3]) for t in after.values())
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    rows = packed.toPandas()
    assert set(rows["doc_id"]) == set(after) and rows.groupby("sequence_id")["length"].sum().max() <= 2048
    whole = rows.groupby("doc_id")["length"].sum()
    assert np.array_equal(whole.to_numpy(), rows.groupby("doc_id")["doc_tokens"].first().to_numpy())


def test_run_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_odd_rows(spark, tmp_path):
    """Null ids, null and empty texts, repeated rows, one very long text, and columns named like those the stages make."""
    import random

    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n)) + "."
    shared = "A line that is shared by more than five documents of this table."
    texts = [f"{words(60)}\n{shared}\n{words(60)}" for _ in range(8)] + [words(30_000), None, "", "!!! ### $$$ " * 60]
    rows = [(i, t, "en", "web", 1, i, "mine", 7, "kept") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, words(80), None, None, None, 1, "mine", 7, "kept"), (50, texts[1] + " token = abcdef123456", "en", "web", 1, 1, "mine", 7, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines long, secrets string, __ql_id int, ids string")
    place = f"file://{tmp_path}"
    docs.repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(8)] + [(11, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    made = [spark.read.parquet(f"{place}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        made.append(written(stage(spark, made[-1], place), name))
    good, lines, single, clean, packed = made[1:]
    assert all(df.schema == made[0].schema for df in made[1:-1])
    assert all({(x.secrets, x.ids) for x in df.collect()} == {("mine", "kept")} for df in made[1:-1])
    assert {x.n_lines for x in clean.collect()} <= {x.n_lines for x in docs.collect()}
    ids = [x.doc_id for x in good.collect()]
    assert 11 not in ids and ids.count(0) == 3 and None in ids and 8 in ids
    assert sum(shared in (x.text or "") for x in lines.collect()) == 1
    assert 50 not in [x.doc_id for x in single.collect()] and None in [x.doc_id for x in single.collect()]
    assert packed.where("doc_id = 8").count() > 20 and packed.where("doc_id IS NULL").count() == 1
    assert corpus_pipeline.run(spark, place).count() == packed.count()
