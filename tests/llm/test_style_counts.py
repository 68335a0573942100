"""A style node is judged by how many different pages have it, not by their share of the host."""

import pytest

pytest.importorskip("quarryline.llm")
from quarryline.llm import style_tree  # noqa: E402


@pytest.mark.parametrize("most_broadcast", [200_000, 0])
def test_hot_host_and_copies(spark, most_broadcast):
    page = lambda k, extra="": f"<div class='text'>Story {k} of many</div>{extra}"
    rows = [("http://hot.example/", page(k, "<div class='note'>Section note</div>" if k < 6 else "")) for k in range(200)]
    rows += [("http://copies.example/", page(0))] * 60 + [("http://copies.example/", page(k, "<p>also</p>")) for k in range(1, 7)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    got = [r.text for r in style_tree.main_text(df, most_broadcast=most_broadcast).orderBy("page_id").collect()]
    assert got == [f"Story {k} of many" for k in [*range(200), *[0] * 60, *range(1, 7)]]
