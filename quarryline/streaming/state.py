"""Streaming forms of the jobs that keep state.

With ``delay``, rows are applied in order of event time, then id, whatever their order of arrival: a
row waits in the state of its group of keys until the watermark, which stands ``delay`` behind the latest time seen,
has passed it. Results are then those of the batch jobs; only rows behind the watermark on arrival
are too late, and are dropped and counted by Spark. Waiting rows are on disk, in RocksDB; those of a
group of keys are read when one falls due, and sorted in one task. A row without time goes before all that wait.

Without ``delay``, rows are applied as they arrive, those of a micro-batch in order; a row without
time comes first. A row older than the last one its key has applied comes too late: it is returned
with ``late`` true and no result, and changes nothing. A key's rows of one micro-batch are in one
task's memory, so ``files_per_trigger`` bounds them.

Rows without key are left out. With ``expire``, a key's state is forgotten once event time has moved
on by so much.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import delete, own_folder

_NO_TIME = -(1 << 63)
#: Keys are dealt to so many groups; a group's waiting rows are in one task's memory when some fall due.
GROUPS = 1024


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream, be it one file or a folder of files; its ``ts`` becomes an instant in UTC."""
    path = f"{folder}/{name}.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # One file of that name, or a folder of files with names of their own.
    first = table.select(F.input_file_name().alias("f")).head()
    if first and first["f"].rstrip("/").endswith(f"/{name}.parquet"):
        stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    else:
        stream = reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


class _Waiting(StatefulProcessor):
    """Holds the rows of a group of keys until the watermark has passed them, then applies ``step`` to each key's in order.

    Rows that come in one micro-batch are kept as one piece of Arrow data, and the states of the
    group's keys as one value, so that Spark's state is asked a few times for each group, not for
    each row or key.
    """

    def __init__(self, start: tuple, step: Callable, columns: list[str], expire: str | None, needed: bool):
        self.start, self.step, self.columns, self.needed = start, step, columns, needed
        self.keep = int(pd.Timedelta(expire).total_seconds() * 1000) if expire else None

    def init(self, handle) -> None:
        self.handle = handle
        self.rows, self.now = handle.getListState("rows", "first long, data binary"), handle.getValueState("now", "data binary")

    @staticmethod
    def _piece(rows: list[tuple]) -> tuple[int, bytes]:
        """The first time of the rows (key, time, id, value), and the rows."""
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["key", "at", "id", "value"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as to:
            to.write_batch(batch)
        return min(r[1] for r in rows), sink.getvalue().to_pybytes()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        for df in rows:
            df = df.set_axis(["group", "key", "ts", "at", "id", "value"], axis=1)  # names may be lost on the way
            # The clock's rows have no key; they may not be left out any earlier, or event time would not move on.
            df = df[df["key"].notna() & df["value"].notna()] if self.needed else df[df["key"].notna()]
            found += zip(*[c.astype(object).where(c.notna(), None).tolist() for c in (df["key"], df["at"], df["id"], df["value"])], strict=True)
        if found:
            first, data = self._piece(found)
            self.rows.appendValue((first, data))
            self.handle.registerTimer(max(0, -(-first // 1000)))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        due: dict[object, list[tuple]] = {}
        rest: list[tuple] = []
        later: list[tuple[int, bytes]] = []
        for first, data in self.rows.get():
            if first > mark * 1000:
                later.append((first, bytes(data)))
                continue
            for k, *row in zip(*[c.to_pylist() for c in pa.ipc.open_stream(bytes(data)).read_all().columns], strict=True):
                if row[0] <= mark * 1000:
                    due.setdefault(k, []).append(row)
                else:
                    rest.append((k, *row))
        states: dict[object, tuple] = pickle.loads(bytes(self.now.get()[0])) if self.now.exists() else {}
        out = []
        for k, own in due.items():
            last, *now = states.get(k, (None, *self.start))
            now = tuple(now)
            for at, i, value in sorted(own, key=lambda r: (r[0], r[1] is not None, r[1])):
                now, made = self.step(now, value, None if at == _NO_TIME else at)
                last = at
                out.append((k, i, *made))
            states[k] = (last, *now)
        if due:
            later += [self._piece(rest)] if rest else []
            self.rows.put(later) if later else self.rows.clear()
        nexts = [-(-first // 1000) for first, _ in later]
        known = len(states)
        if self.keep is not None:
            waits = {k for _, data in later for k in pa.ipc.open_stream(data).read_all().column(0).to_pylist()}
            ends = {k: max(s[0], 0) // 1000 + self.keep for k, s in states.items() if k not in waits}
            states = {k: s for k, s in states.items() if ends.get(k, mark + 1) > mark}
            nexts += [end for end in ends.values() if end > mark]
        if due or len(states) < known:
            self.now.update((pickle.dumps(states),)) if states else self.now.clear()
        if nexts:
            self.handle.registerTimer(max(0, min(nexts)))
        yield pd.DataFrame(out, columns=self.columns, dtype=object)

    def close(self) -> None:
        pass


def _in_order(events: DataFrame, key: str, ts: str, id_col: str, value: str, result: str, start: tuple, step: Callable, expire: str | None, delay: str, needed: bool) -> DataFrame:
    """As ``_keyed``, in order of event time; result rows are key, id and the columns of ``result``. Keys are dealt to GROUPS groups, whose rows wait together."""
    names, kinds = [c.strip().split(" ")[0] for c in result.split(",")], dict(events.dtypes)
    group = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(GROUPS))).otherwise(-1)  # rows without key by themselves
    at = F.coalesce(F.unix_micros(ts), F.lit(_NO_TIME))
    slim = events.withWatermark(ts, delay).select(group.alias("__ql_group"), F.col(key).alias("__ql_key"), F.col(ts).alias("__ql_ts"), at.alias("__ql_at"), F.col(id_col).alias("__ql_id"), F.col(value).alias("__ql_value"))
    held = _Waiting(start, step, ["__ql_key", "__ql_id", *names], expire, needed)
    made = slim.groupBy("__ql_group").transformWithStateInPandas(held, f"__ql_key {kinds[key]}, __ql_id {kinds[id_col]}, {result}", "Append", "EventTime")
    return made.select(F.col("__ql_key").alias(key), F.col("__ql_id").alias(id_col), *names)


class Clock:
    """Rows of time alone, beside a stream's own: they let event time move on where no more rows come, so that all that waits falls due."""

    def __init__(self, spark: SparkSession):
        self.spark, self.place, self.schema, self.ts = spark, f"{own_folder(spark)}/clock-{uuid.uuid4().hex}", None, None

    def beside(self, events: DataFrame, ts: str = "ts") -> DataFrame:
        """``events`` with the clock's rows, in which all but ``ts`` is null."""
        self.schema, self.ts = events.schema, ts
        self.spark.createDataFrame([], self.schema).write.parquet(self.place)
        return events.unionByName(self.spark.readStream.schema(self.schema).parquet(self.place))

    def stop(self) -> None:
        """Moves event time beyond all rows."""
        at = lambda f: F.lit("2262-01-01" if f.name == self.ts else None).cast(f.dataType).alias(f.name)
        self.spark.range(1).select(*[at(f) for f in self.schema]).write.mode("append").parquet(self.place)


def _keyed(events: DataFrame, key: str, ts: str, id_col: str, value: str, result: str, state: str, start: tuple, step: Callable, expire: str | None, delay: str | None, needed: bool = False) -> DataFrame:
    """Applies ``step(state, value, time) -> (state, result)`` to each key's rows in order, if ``needed`` to those with a value; result rows are key, id, the columns of ``result`` and ``late``. Times are microseconds, or None."""
    names = [c.strip().split(" ")[0] for c in result.split(",")]
    if delay:
        return _in_order(events, key, ts, id_col, value, result, start, step, expire, delay, needed)
    events = events.where(F.col(value).isNotNull()) if needed else events
    columns = ["__ql_key", "__ql_id", *names, "late"]

    def run(group: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        last_ts, last_id, *now = kept.get if kept.exists else (None, None, *start)
        rows = pd.concat(list(frames))
        rows["__ql_at"] = [_NO_TIME if pd.isna(t) else t.value // 1000 for t in rows["__ql_ts"]]
        out = []
        for t, i, v in rows.sort_values(["__ql_at", "__ql_id"])[["__ql_at", "__ql_id", "__ql_value"]].itertuples(index=False, name=None):
            if last_ts is not None and (t, i) <= (last_ts, last_id):
                out.append((group[0], i, *[None] * len(names), True))
                continue
            last_ts, last_id = int(t), i
            now, found = step(now, None if pd.isna(v) else v, None if t == _NO_TIME else t)
            out.append((group[0], i, *found, False))
        kept.update((last_ts, last_id, *now))
        if expire and last_ts is not None and last_ts > 0:
            kept.setTimeoutTimestamp(max(last_ts // 1000 + int(pd.Timedelta(expire).total_seconds() * 1000), kept.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    kinds = dict(events.dtypes)
    dated = events.withWatermark(ts, expire) if expire else events
    slim = dated.where(F.col(key).isNotNull()).select(F.col(key).alias("__ql_key"), F.col(ts).alias("__ql_ts"), F.col(id_col).alias("__ql_id"), F.col(value).alias("__ql_value"))
    timeout = GroupStateTimeout.EventTimeTimeout if expire else GroupStateTimeout.NoTimeout
    made = slim.groupBy("__ql_key").applyInPandasWithState(run, f"__ql_key {kinds[key]}, __ql_id {kinds[id_col]}, {result}, late boolean", f"last_ts long, last_id {kinds[id_col]}, {state}", "append", timeout)
    return made.select(F.col("__ql_key").alias(key), F.col("__ql_id").alias(id_col), *names, "late")


def toggle_stream(events: DataFrame, key: str, action: str, on: str, first: str, second: str, ts: str = "ts", id_col: str = "event_id", expire: str | None = None, delay: str | None = None) -> DataFrame:
    """``state`` after each event; it flips where column ``action`` is ``on``."""

    def step(now, value, _):
        flips = (now[0] + (value == on)) % 2
        return (flips,), (second if flips else first,)

    return _keyed(events, key, ts, id_col, action, "state string", "flips int", (0,), step, expire, delay)


def exclusive_stream(events: DataFrame, key: str, item: str, initial: str | None = None, ts: str = "ts", id_col: str = "event_id", expire: str | None = None, delay: str | None = None) -> DataFrame:
    """``open_item`` after each event that has an item."""

    def step(now, value, _):
        item_now = None if now[0] == value else value
        return (item_now,), (item_now,)

    return _keyed(events, key, ts, id_col, item, "open_item string", "open_item string", (initial,), step, expire, delay, True)


def session_stream(events: DataFrame, key: str, gap: str = "30 minutes", ts: str = "ts", id_col: str = "event_id", expire: str | None = None, delay: str | None = None) -> DataFrame:
    """``session`` and ``mode`` of each event: full for a session's first one, instant for later ones."""
    pause = int(pd.Timedelta(gap).total_seconds() * 1_000_000)

    def step(now, _, time):
        session, before = now
        new = session < 0 or before is not None and time is not None and time >= before + pause
        if new:
            session += 1
        return (session, time), (session, "full" if new else "instant")

    return _keyed(events, key, ts, id_col, id_col, "session long, mode string", "session long, before long", (-1, None), step, expire, delay)


def cross_stream(events: DataFrame, key: str, value: str, cut: float, ts: str = "ts", id_col: str = "event_id", expire: str | None = None, delay: str | None = None) -> DataFrame:
    """``above`` (strictly), ``crossing`` (above now and not before) and ``first_crossing`` of each event; a null value is not above."""

    def step(now, x, _):
        before, crossed = now
        above = x is not None and bool(x > cut)
        crossing = above and not before
        return (above, crossed or crossing), (above, crossing, crossing and not crossed)

    return _keyed(events, key, ts, id_col, value, "above boolean, crossing boolean, first_crossing boolean", "before boolean, crossed boolean", (False, False), step, expire, delay)


def ema_stream(events: DataFrame, key: str, value: str, alpha: float = 0.2, init: float | None = None, ts: str = "ts", id_col: str = "event_id", expire: str | None = None, delay: str | None = None) -> DataFrame:
    """``ema`` after each event with a value."""

    def step(now, x, _):
        r = now[0]
        r = float(x) if r is None else r + (x - r) * alpha
        return (r,), (r,)

    return _keyed(events, key, ts, id_col, value, "ema double", "r double", (init,), step, expire, delay, True)


def first_stream(events: DataFrame, key: str, ts: str = "ts", delay: str = "30 minutes") -> DataFrame:
    """One event of each key within the watermark, the first to arrive, with all its columns: the once-only gate. Its state goes as the watermark moves on."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def drained(stream: DataFrame, mode: str = "append", clock: Clock | None = None) -> DataFrame:
    """Runs ``stream`` over all that is there and gives what it wrote, in the folder that all machines share. With a ``clock`` the stream runs on until nothing waits any more. The checkpoint is deleted at the end."""
    spark = stream.sparkSession
    place = f"{own_folder(spark)}/stream-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for again in (False, True) if clock else (False,):
            if again:
                clock.stop()
            writer = stream.writeStream.option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
            if mode == "append":
                query = writer.format("parquet").option("path", f"{place}/out").start()
            else:
                query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{place}/out")).start()
            query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    delete(spark, f"{place}/state")
    if clock:
        delete(spark, clock.place)
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
