"""Streams in order of event time: any order of arrival within the delay gives the rows of the batch jobs."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from quarryline.operators import sequence
from quarryline.streaming import state

START = datetime.datetime(2024, 1, 1)
SCHEMA = "user_id long, ts timestamp, event_id long, item string, value double"


def rows(seed, n=160):
    r = random.Random(seed)
    return [(r.choice([1, 1, 2, 3, None]), START + datetime.timedelta(minutes=r.choice([r.randrange(3000), 100, 130])), i, r.choice(["a", "a", "b", None]), r.choice([None, 10.0, 40.0, 50.0])) for i in range(n)]


def stored(spark, place, batches):
    """Files that are taken one after another, each a micro-batch."""
    for k, batch in enumerate(batches):
        if k:
            time.sleep(1.1)
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{place}/events.parquet")


def ran(spark, place, make, **more):
    clock = state.Clock(spark)
    stream = make(clock.beside(state.file_stream(spark, place, "events", 1)), **more)
    return {r.event_id: tuple(r)[2:] for r in state.drained(stream, clock=clock).collect()}


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    place, data = f"file://{tmp_path_factory.mktemp('shuffled')}", rows(3)
    mixed = list(data)
    random.Random(1).shuffle(mixed)
    stored(spark, place, [mixed[:50], mixed[50:110], mixed[110:]])
    return place, spark.createDataFrame([d for d in data if d[0] is not None], SCHEMA)


def batch(df, *columns):
    return {r.event_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_toggle(spark, shuffled):
    got = ran(spark, shuffled[0], state.toggle_stream, key="user_id", action="item", on="a", first="off", second="on", delay="3 days")
    assert got == batch(sequence.toggle_state(shuffled[1], "user_id", F.col("item") == "a", "off", "on"), "state")


def test_exclusive(spark, shuffled):
    got = ran(spark, shuffled[0], state.exclusive_stream, key="user_id", item="item", initial="a", delay="3 days")
    assert got == batch(sequence.exclusive_toggle(shuffled[1], "user_id", "item", "a"), "open_item")


def test_sessions(spark, shuffled):
    got = ran(spark, shuffled[0], state.session_stream, key="user_id", delay="3 days")
    assert got == batch(sequence.first_per_session(shuffled[1], "user_id"), "session", "mode")


def test_crossings(spark, shuffled):
    got = ran(spark, shuffled[0], state.cross_stream, key="user_id", value="value", cut=30.0, delay="3 days")
    assert got == batch(sequence.threshold_cross(shuffled[1], "user_id", "value", 30.0), "above", "crossing", "first_crossing")


def test_only_rows_behind_the_watermark_are_late(spark, tmp_path):
    """Within the delay any order will do; what comes later is dropped, and nothing else is touched."""
    at = lambda minutes: START + datetime.timedelta(minutes=minutes)
    place = f"file://{tmp_path}"
    stored(spark, place, [[(1, at(0), 1, "a", None), (1, at(30), 3, "a", None)], [(1, at(20), 2, "a", None)], [(1, at(120), 6, "a", None)], [(1, at(119), 5, "b", None)], [(1, at(50), 9, "a", None), (1, at(90), 4, "a", None), (2, at(119), 7, "a", None)]])
    got = ran(spark, place, state.toggle_stream, key="user_id", action="item", on="a", first="off", second="on", delay="1 hour")
    assert got == {1: ("on",), 2: ("off",), 3: ("on",), 4: ("off",), 5: ("off",), 6: ("on",), 7: ("on",)}


def test_state_is_forgotten(spark, tmp_path):
    at = lambda days: START + datetime.timedelta(days=days)
    place = f"file://{tmp_path}"
    stored(spark, place, [[(1, at(0), 1, "a", None)], [(2, at(9), 2, "a", None)], [(2, at(10), 3, "a", None)], [(1, at(11), 4, "a", None)]])
    run = lambda expire: ran(spark, place, state.toggle_stream, key="user_id", action="item", on="a", first="off", second="on", delay="1 hour", expire=expire)
    assert run("2 days") == {1: ("on",), 2: ("on",), 3: ("off",), 4: ("on",)}
    assert run(None)[4] == ("off",)
