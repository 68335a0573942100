"""The slot queries and their SQL where a period ends within a millisecond, and before the epoch."""

import duckdb
import pytest

import __spark_entry__ as entry

#: Microseconds since the epoch: about the ends of periods of 6.5 s, on either side of the epoch.
TIMES = [k * 6_500_000 + d for k in (-5, -1, 0, 1, 4, 262164603) for d in (-1001, -501, -500, -499, -1, 0, 1, 499, 500, 999)]


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    folder = tmp_path_factory.mktemp("slots")
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, make_timestamp(?), 1, 'click', 1.5)", list(enumerate(TIMES)))
    con.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder, con


def test_rotation_slot(spark, place):
    got = {r.event_id: r.slot for r in entry.queries()["s7_rotation_slot"](spark, f"file://{place[0]}").collect()}
    assert got == dict(place[1].execute(entry.oracle_sql()["s7_rotation_slot"]).fetchall())
    assert got == {k: t // 6_500_000 % 4 for k, t in enumerate(TIMES)}


@pytest.mark.parametrize("name", ["s7_slot_totals", "s7_slot_totals_stream"])
def test_slot_totals(spark, place, name):
    """A stream's watermark begins at the epoch, so Spark takes earlier rows of a stream for late ones."""
    least = 0 if name.endswith("stream") else min(TIMES) - 6_500_000
    got = sorted(map(tuple, entry.queries()[name](spark, f"file://{place[0]}").select("start_ms", "slot", "n", "total").collect()))
    assert got == [r for r in sorted(place[1].execute(entry.oracle_sql()[name]).fetchall()) if r[0] * 1000 >= least]
    assert {r[0] for r in got} == {t // 6_500_000 * 6500 for t in TIMES if t >= least}
