"""Texts with very many secrets, and long ones: the same spans and texts, in about linear time."""

import re
import time

import pytest

from . import brute

pytest.importorskip("quarryline.llm")
from quarryline.llm import secret_scan  # noqa: E402


def redacted(text, mark="[SECRET]"):
    """By the base rules alone."""
    spans = [(m.start(), m.end()) for m in brute.ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secret_scan.find_secrets(df, secret_scan.BASE_RULES)
    return found, {r.doc_id: r.text for r in secret_scan.redact(found).collect()}


def test_runs_and_pieces(spark, monkeypatch):
    """Ends of runs and pieces in every place, characters beyond 16 bits, overlapping spans."""
    monkeypatch.setattr(secret_scan, "RUN", 3)
    monkeypatch.setattr(secret_scan, "PIECE", 7)
    key = "0123456789abcdef01234567"
    texts = ["x" * k + f"€𝄞token={key} " * n + "end" * m for k in range(9) for n in range(8) for m in (0, 1, 5)] + [f"token={key}", key * 5, f"passwd: {key}\n\nsecret=a", "token=password=secret:abcdef" * 4]
    found, got = scanned(spark, texts)
    assert [got[k] for k in range(len(texts))] == [redacted(t) for t in texts]
    spans = {r.doc_id: len(r.secrets) for r in found.collect()}
    assert all(spans[k] == sum(brute.secrets(t)[:3]) for k, t in enumerate(texts))


def test_fifty_thousand_secrets_in_one_text(spark):
    """Four times the secrets take about four times as long, not sixteen."""
    line = "some words token=0123456789abcdef0123456789 and more\n"
    scanned(spark, [line])
    took = []
    for n in (12_500, 50_000):
        start = time.time()
        _, got = scanned(spark, [line * n])
        took.append(time.time() - start)
        assert got[0] == "some words [SECRET] and more\n" * n
    assert took[1] < 8 * took[0] + 2
