"""Rows that repeat are scanned by every rule."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quarryline.llm")
from quarryline.llm import secret_scan  # noqa: E402

TEXTS = {
    "assign": "password = hunter2hunter2",
    "access": "AKIA" + "Q" * 20,
    "hex": "0123456789abcdef" * 2,
    "private_key": "-----BEGIN RSA PRIVATE KEY-----\nMIIEow==\n-----END RSA PRIVATE KEY-----",
    "github": "ghp_" + "a1B2" * 9,
    "slack": "xoxb-1234567890-abc",
    "google": "AIza" + "b3-_X" * 7,
    "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh12",
}


def test_equal_rows_keep_their_secrets(spark):
    assert list(TEXTS) == [r.kind for r in secret_scan.RULES]
    rows = [(i, f"so {t} it is", kind) for i, (kind, t) in enumerate(TEXTS.items())]
    again = [r for i, t, kind in rows for r in [(i, t, kind)] * 3 + [(None, t, kind)] * 2]
    df = spark.createDataFrame(again, "doc_id long, text string, want string").repartition(3)
    found = secret_scan.find_secrets(df)
    got = found.select("want", F.transform("secrets", lambda s: s["kind"]).alias("kinds")).collect()
    assert len(got) == len(again) and all(r.want in r.kinds for r in got)
    clean = secret_scan.redact(found).select("text", "want").collect()
    assert not any(TEXTS[r.want] in r.text for r in clean)
