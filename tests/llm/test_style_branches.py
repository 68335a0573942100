"""The style tree decides on every page; roles only weigh."""

import pytest

pytest.importorskip("quarryline.llm")
from quarryline.llm import style_tree  # noqa: E402


def texts(spark, rows, **more):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    return [r.text for r in style_tree.main_text(df, **more).orderBy("page_id").collect()]


@pytest.mark.parametrize("most_broadcast", [200_000, 0])
def test_tree_judges_in_and_out_of_articles(spark, most_broadcast):
    body = "<div>Always here</div><div class='lead'>Lead {0} of story number {0}</div><article><p>Story {0} tells a lot of {0}</p><p>Press the button to go on</p><div class='box'>Same on all pages</div><p>It ends with {0}</p></article>"
    got = texts(spark, [(f"http://a.example/{k}", body.format(k)) for k in range(20)], most_broadcast=most_broadcast)
    assert got == [f"Lead {k} of story number {k}\n\nStory {k} tells a lot of {k}\n\nIt ends with {k}" for k in range(20)]
