"""Every piece has a place, whatever the length of a sequence."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quarryline.llm")
from quarryline.llm import packing  # noqa: E402
from quarryline.llm.queries import vocabulary  # noqa: E402


@pytest.mark.parametrize("length", [7, 257, 1023, 1024, 2050])
def test_no_piece_is_lost(spark, length):
    texts = [None, "", "one", *(" ".join(f"word{k}" for k in range(n)) for n in (3, 60, 250, 400, 700, 1500))]
    docs = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id long, text string").repartition(3)
    path = vocabulary("byte_bpe_50k.json")
    want = packing.tokenised_pieces(docs, path, length).select("doc_id", "start", "length", "ids_crc32")
    packed = packing.pack(docs, path, length=length).cache()
    got = packed.select("doc_id", "start", "length", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where(F.col("length") == length).count() > 0
    for _, parts in packed.toPandas().sort_values("offset").groupby("sequence_id"):
        assert parts["offset"].tolist() == [0, *parts["length"].cumsum().tolist()[:-1]] and parts["length"].sum() <= length
