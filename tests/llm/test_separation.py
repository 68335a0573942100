"""The training-data operators can be taken away, and their SQL gives their rows."""

import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

pytest.importorskip("quarryline.llm")
from quarryline.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

HERE = Path(__file__).resolve().parents[2]
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_nothing_else_imports_these():
    for path in HERE.rglob("*.py"):
        name = path.relative_to(HERE).as_posix()
        if name.startswith(("quarryline/llm/", "tests/llm/")) or name in ("corpus_pipeline.py", "__spark_entry__.py"):
            continue
        assert not re.search(r"^\s*(from|import)\s+\S*llm|import corpus_pipeline", path.read_text(), re.M), name


def test_the_rest_works_without_them(tmp_path):
    for path in HERE.rglob("*.py"):
        name = path.relative_to(HERE).as_posix()
        if not name.startswith(("quarryline/llm/", "tests/")) and name != "corpus_pipeline.py":
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text(path.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    # A part that is there but broken is an error, not an absence.
    (tmp_path / "quarryline/llm").mkdir()
    (tmp_path / "quarryline/llm/__init__.py").write_text("")
    (tmp_path / "quarryline/llm/queries.py").write_text("import no_such_module")
    broken = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert broken.returncode and "no_such_module" in broken.stderr


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_operators_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    columns, named = sorted(ours.columns), [d[0] for d in theirs.description]
    assert columns == sorted(named)
    rows = lambda found: sorted(map(str, found))
    assert rows(tuple(r[c] for c in columns) for r in ours.collect()) == rows(tuple(r[named.index(c)] for c in columns) for r in theirs.fetchall())
