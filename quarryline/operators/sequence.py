"""State from event sequences, and jobs on ordered rows. Order is always time, then id."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.shared import released, written


#: A key with more rows than this is split into so many segments of its time; so many keys at most are split.
ROWS, SEGMENTS, MOST_HOT = 1_000_000, 256, 1000
#: A cell with more points than this is joined in parts.
DENSE = 10_000
#: How many directions a key of near points may have, and what share of the pairs just within the distance may be missed.
PROJECTIONS, MISSED = range(4, 17), 0.0002


def _split(events: DataFrame, key: str, ts: str, rows: int) -> tuple[DataFrame, bool]:
    """Adds ``__ql_seg``, the segment of time of a key with more than ``rows`` rows (else 0), ``__ql_hot``, whether the key is split, and tells whether any is.

    Segments end at quantiles of a key's times, so each has about as many rows; rows of one time stay
    together, and rows without time are in the first. Beyond the MOST_HOT largest keys, none of which
    has a MOST_HOT-th of all rows, keys stay whole.
    """
    sizes = events.groupBy(F.col(key).alias("__ql_key")).agg(F.count(F.lit(1)).alias("__ql_n"))
    large = sizes.where(F.col("__ql_n") > rows)
    if not large.head(1):
        return events.withColumns({"__ql_seg": F.lit(0), "__ql_hot": F.lit(False)}), False
    hot = written(large.orderBy(F.desc("__ql_n")).limit(MOST_HOT), "hot")
    same = F.col(key).eqNullSafe(F.col("__ql_key"))
    shares = [k / SEGMENTS for k in range(1, SEGMENTS)]
    cuts = events.join(F.broadcast(hot), same).groupBy("__ql_key").agg(F.percentile_approx(ts, shares, 20 * SEGMENTS).alias("__ql_cuts"))
    cuts = written(cuts.withColumn("__ql_hot", F.lit(True)), "cuts")  # MOST_HOT * SEGMENTS times at most
    released(hot)
    seg = F.greatest(F.coalesce(F.size(F.filter("__ql_cuts", lambda c: c < F.col(ts))), F.lit(0)), F.lit(0))
    found = events.join(F.broadcast(cuts), same, "left").withColumn("__ql_seg", seg)
    return found.withColumn("__ql_hot", F.coalesce("__ql_hot", F.lit(False))).drop("__ql_key", "__ql_cuts"), True


def _summed(split: DataFrame, key: str, **made: Column) -> DataFrame:
    """Each segment of the keys that are split, as what it does to a state: ``__ql_key``, ``__ql_at`` and the columns ``made``."""
    return split.where("__ql_hot").groupBy(F.col(key).alias("__ql_key"), F.col("__ql_seg").alias("__ql_at")).agg(*[c.alias(name) for name, c in made.items()])


def _entered(split: DataFrame, key: str, entries: DataFrame) -> DataFrame:
    """Rows with the state at their segment's begin; null where a key isn't split. There are MOST_HOT * SEGMENTS entries at most."""
    same = F.col(key).eqNullSafe(F.col("__ql_key")) & (F.col("__ql_seg") == F.col("__ql_at"))
    return split.join(F.broadcast(entries), same, "left").drop("__ql_key", "__ql_at")


def _ordered(key: str, ts: str, id_col: str):
    return Window.partitionBy(key, "__ql_seg").orderBy(ts, id_col)


def _upto(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def _segments():
    return Window.partitionBy("__ql_key").orderBy("__ql_at")


def _kept(events: DataFrame, *made: str) -> list[str]:
    """The columns of ``events`` that aren't replaced."""
    return [f"`{c}`" for c in events.columns if c.lower() not in made]


def _before(column: str) -> Column:
    """The sum over a key's earlier segments."""
    return F.coalesce(F.sum(column).over(_segments().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def latest_preference(events: DataFrame, key: str, value: str, allowed: Sequence[str] | None, default: str, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """The last value of each key, of those allowed and not empty; ``default`` for keys without one."""
    good = F.col(value).isNotNull() & (F.col(value) != "")
    if allowed is not None:
        good = good & F.col(value).isin(*allowed)
    last = F.max_by(F.when(good, F.col(value)), F.when(good, F.struct(ts, id_col)))
    return events.groupBy(key).agg(F.coalesce(last, F.lit(default)).alias("preference"))


def toggle_state(events: DataFrame, key: str, action: Column, first: str, second: str, ts: str = "ts", id_col: str = "event_id", rows: int = ROWS) -> DataFrame:
    """Adds ``state`` after each event: it starts as ``first`` and flips at each action.

    Keys with more than ``rows`` rows are split by time: a segment's flips are counted, summed up over
    the segments before, and all segments are then gone through side by side.
    """
    split, hot = _split(events.withColumn("__ql_act", F.when(action, 1).otherwise(0)), key, ts, rows)
    flips = F.sum("__ql_act").over(_upto(_ordered(key, ts, id_col)))
    if hot:
        split = _entered(split, key, _summed(split, key, __ql_n=F.sum("__ql_act")).select("__ql_key", "__ql_at", _before("__ql_n").alias("__ql_flips")))
        flips = flips + F.coalesce("__ql_flips", F.lit(0))
    return split.withColumn("state", F.when(flips % 2 == 0, first).otherwise(second)).select(*_kept(events, "state"), "state")


def exclusive_toggle(events: DataFrame, key: str, item: str, initial: str | None = None, ts: str = "ts", id_col: str = "event_id", rows: int = ROWS) -> DataFrame:
    """Adds ``open_item`` after each event: acting on an item opens it and closes any other; acting on the open one closes it. Events without item don't act and are left out.

    Keys with more than ``rows`` rows are split by time. What a segment of one item does depends on
    whether that item is open before; after more than one item only the last run of equal ones counts.
    """
    split, hot = _split(events.where(F.col(item).isNotNull()), key, ts, rows)
    w = _ordered(key, ts, id_col)
    before = F.lag(item).over(w)
    split = split.withColumn("__ql_run", F.sum(F.when(before.isNull() | (before == F.col(item)), 0).otherwise(1)).over(_upto(w)))
    split = split.withColumn("__ql_place", F.row_number().over(Window.partitionBy(key, "__ql_seg", "__ql_run").orderBy(ts, id_col)))
    opened = (F.col(item) == F.lit(initial)) if initial is not None else F.lit(False)
    if hot:
        order = F.struct(ts, id_col)
        ends = _summed(split, key, __ql_item=F.max_by(item, order), __ql_odd=F.max_by("__ql_place", order) % 2, __ql_single=F.max("__ql_run") == 0)
        earlier = F.lag("__ql_item").over(_segments())
        goes_on = F.col("__ql_single") & F.coalesce(earlier == F.col("__ql_item"), F.lit(False))
        ends = ends.withColumn("__ql_first", F.lag("__ql_at").over(_segments()).isNull()).withColumn("__ql_chain", F.sum(F.when(goes_on, 0).otherwise(1)).over(_upto(_segments())))
        from_start = F.when(F.col("__ql_first") & F.col("__ql_single") & F.coalesce(F.col("__ql_item") == F.lit(initial), F.lit(False)), 1).otherwise(0)
        ends = ends.withColumn("__ql_open", F.sum(F.col("__ql_odd") + from_start).over(_upto(Window.partitionBy("__ql_key", "__ql_chain").orderBy("__ql_at"))) % 2 == 1)
        ends = ends.select("__ql_key", "__ql_at", "__ql_first", F.when(F.lag("__ql_open").over(_segments()), earlier).alias("__ql_entry"))
        split = _entered(split, key, ends)
        opened = F.when(F.coalesce("__ql_first", F.lit(True)), opened).otherwise(F.coalesce(F.col("__ql_entry") == F.col(item), F.lit(False)))
    place = F.col("__ql_place") + F.when((F.col("__ql_run") == 0) & opened, 1).otherwise(0)
    return split.withColumn("open_item", F.when(place % 2 == 1, F.col(item))).select(*_kept(events, "open_item"), "open_item")


def first_per_session(events: DataFrame, key: str, gap: str = "30 minutes", ts: str = "ts", id_col: str = "event_id", rows: int = ROWS) -> DataFrame:
    """Adds ``session`` (from 0) and ``mode``: full for a session's first event, instant for later ones. A pause of ``gap`` or more ends a session.

    Keys with more than ``rows`` rows are split by time; a segment gets the time of the last event
    before it and the number of sessions begun until then.
    """
    split, hot = _split(events, key, ts, rows)
    w, pause = _ordered(key, ts, id_col), F.expr(f"INTERVAL {gap}")
    split = split.withColumn("__ql_last", F.lag(ts).over(w)).withColumn("__ql_top", F.row_number().over(w) == 1)
    carried = F.lit(0)
    if hot:
        sums = _summed(split, key, __ql_from=F.min(ts), __ql_to=F.max(ts), __ql_n=F.sum(F.when(F.col(ts) >= F.col("__ql_last") + pause, 1).otherwise(0)))
        sums = sums.withColumn("__ql_before", F.lag("__ql_to").over(_segments())).withColumn("__ql_later", F.lag("__ql_at").over(_segments()).isNotNull())
        sums = sums.withColumn("__ql_n", F.col("__ql_n") + F.when(F.col("__ql_from") >= F.col("__ql_before") + pause, 1).otherwise(0))
        split = _entered(split, key, sums.select("__ql_key", "__ql_at", "__ql_before", "__ql_later", _before("__ql_n").alias("__ql_sessions")))
        split = split.withColumn("__ql_last", F.coalesce("__ql_last", "__ql_before")).withColumn("__ql_top", F.col("__ql_top") & ~F.coalesce("__ql_later", F.lit(False)))
        carried = F.coalesce("__ql_sessions", F.lit(0))
    new = F.coalesce(F.col(ts) >= F.col("__ql_last") + pause, F.lit(False))
    found = split.withColumn("__ql_new", new).withColumn("session", F.sum(F.col("__ql_new").cast("int")).over(_upto(w)) + carried)
    return found.withColumn("mode", F.when(F.col("__ql_new") | F.col("__ql_top"), "full").otherwise("instant")).select(*_kept(events, "session", "mode"), "session", "mode")


def threshold_cross(events: DataFrame, key: str, value: str, cut: float, ts: str = "ts", id_col: str = "event_id", rows: int = ROWS) -> DataFrame:
    """Adds ``above`` (strictly), ``crossing`` (above now and not before) and ``first_crossing`` of the key's events. A null value is not above.

    Keys with more than ``rows`` rows are split by time; a segment gets whether the event before it
    was above, and the number of crossings until then.
    """
    split, hot = _split(events.withColumn("above", F.coalesce(F.col(value) > cut, F.lit(False))), key, ts, rows)
    w, order = _ordered(key, ts, id_col), F.struct(ts, id_col)
    split = split.withColumn("__ql_was", F.lag("above").over(w))
    carried = F.lit(0)
    if hot:
        sums = _summed(split, key, __ql_from=F.min_by("above", order), __ql_to=F.max_by("above", order), __ql_n=F.sum((F.col("above") & ~F.coalesce("__ql_was", F.lit(False))).cast("int")))
        sums = sums.withColumn("__ql_before", F.lag("__ql_to").over(_segments()))
        sums = sums.withColumn("__ql_n", F.col("__ql_n") - (F.col("__ql_from") & F.coalesce("__ql_before", F.lit(False))).cast("int"))
        split = _entered(split, key, sums.select("__ql_key", "__ql_at", "__ql_before", _before("__ql_n").alias("__ql_crossed")))
        split = split.withColumn("__ql_was", F.coalesce("__ql_was", "__ql_before"))
        carried = F.coalesce("__ql_crossed", F.lit(0))
    crossed = split.withColumn("crossing", F.col("above") & ~F.coalesce("__ql_was", F.lit(False)))
    count = F.sum(F.col("crossing").cast("int")).over(_upto(w)) + carried
    return crossed.withColumn("first_crossing", F.col("crossing") & (count == 1)).select(*_kept(events, "above", "crossing", "first_crossing"), "above", "crossing", "first_crossing")


def ring_nav(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Adds ``next`` and ``previous`` in a ring, and the label ``place / count`` with two digits. Rows without ``order`` come first; ties go by name. A lone row is its own neighbour."""
    w = Window.partitionBy(group).orderBy(order, name)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        df.withColumn("next", F.coalesce(F.lead(name).over(w), F.first(name).over(whole)))
        .withColumn("previous", F.coalesce(F.lag(name).over(w), F.last(name).over(whole)))
        .withColumn("label", F.format_string("%02d / %02d", F.row_number().over(w), F.count(F.lit(1)).over(whole)))
    )


def rotation_slot(events: DataFrame, n: int, period_ms: int = 6500, ts: str = "ts") -> DataFrame:
    """Adds ``slot``: which of ``n`` items shows at the event, when they change every ``period_ms`` from the epoch on; null without time. Each row is taken by itself, so a stream works as well."""
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    return events.withColumn("slot", F.pmod(F.floor(ms / period_ms), F.lit(n)))


def session_totals(events: DataFrame, key: str, gap: str = "30 minutes", ts: str = "ts", **totals: Column) -> DataFrame:
    """A row for each session of each key: first_at, last_at, ``n`` events and the aggregates ``totals``. A pause of ``gap`` or more ends a session.

    Sessions are merged from part to part, so a key's events needn't meet in order; on a stream with
    a watermark a session is given once the watermark has passed its end. Events without time are in
    no session; those without key have sessions of their own.
    """
    found = events.groupBy(key, F.session_window(ts, gap).alias("__ql_span")).agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in totals.items()])
    return found.drop("__ql_span")


def slot_totals(events: DataFrame, n: int, period_ms: int = 6500, ts: str = "ts", **totals: Column) -> DataFrame:
    """A row for each period with events: start_ms, ``slot`` (which of ``n`` items shows), ``n`` events and the aggregates ``totals``. On a stream with a watermark a period is given once it is over. Events without time are in none."""
    found = events.groupBy(F.window(ts, f"{period_ms} milliseconds").alias("__ql_span")).agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in totals.items()])
    start = F.unix_millis(F.col("__ql_span.start").cast("timestamp"))
    return found.select(start.alias("start_ms"), F.pmod(F.floor(start / period_ms), F.lit(n)).alias("slot"), "n", *totals)


def ema(events: DataFrame, key: str, value: str, alpha: float = 0.2, init: float | None = None, ts: str = "ts", id_col: str = "event_id", bucket: str = "day") -> DataFrame:
    """The smoothed value of each key after its last event, ``ema``, and ``n`` values: r += (x - r) * alpha, from ``init`` or the first value.

    A value that k others follow weighs alpha * (1 - alpha)^k. Values are weighed within each key and
    ``bucket`` of time, and each bucket then by the number of values after it, so a key with very
    many events is spread over tasks. Null values are left out; rows without time come first; a key
    without values has ``init``, else null. An empty table gives no rows.
    """
    x, order = F.col(value).cast("double"), F.struct(ts, id_col)
    after = Window.partitionBy(key, "__ql_bucket").orderBy(F.desc(ts), F.desc(id_col)).rowsBetween(Window.unboundedPreceding, -1)
    faded = lambda n: F.pow(F.lit(1.0 - alpha), n)
    ranked = events.withColumn("__ql_bucket", F.date_trunc(bucket, F.col(ts))).withColumn("__ql_after", F.coalesce(F.count(value).over(after), F.lit(0)))
    parts = ranked.groupBy(key, "__ql_bucket").agg(F.count(value).alias("__ql_n"), F.sum(x * alpha * faded(F.col("__ql_after"))).alias("__ql_sum"), F.min(F.when(x.isNotNull(), F.struct(order.alias("o"), x.alias("x")))).alias("__ql_first"))
    later = Window.partitionBy(key).orderBy(F.desc("__ql_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    weighed = parts.withColumn("__ql_sum", F.col("__ql_sum") * faded(F.coalesce(F.sum("__ql_n").over(later), F.lit(0))))
    whole = weighed.groupBy(key).agg(F.sum("__ql_n").alias("n"), F.sum("__ql_sum").alias("__ql_sum"), F.min("__ql_first").alias("__ql_first"))
    start = F.lit(init).cast("double") if init is not None else F.col("__ql_first.x")
    return whole.select(key, (F.coalesce("__ql_sum", F.lit(0.0)) + start * faded(F.col("n"))).alias("ema"), "n")


def ramp(value: Column, height: Column) -> tuple[Column, Column, Column]:
    """Percent of ``height`` (0 unless it is positive), and a ramp of two segments over the same share, from 0 to 1. A null value gives nulls if the height is positive, else 0."""
    share = F.when(height > 0, value / height).otherwise(0.0)
    early = S.clamp(share / 0.62)
    return share * 100, early, S.clamp((early - 0.22) / 0.5)


def proximity_pairs(points: DataFrame, id_col: str, x: str, y: str, d_max: float, w: float = 0.15, dense: int = DENSE) -> DataFrame:
    """Unordered pairs of points closer than ``d_max``, and their weight w * (1 - d / d_max).

    Points are put in cells of that size and joined with those in their own and the eight cells
    around; there is no pair of all points. Where a cell has more than ``dense`` points, cells are
    split as their counts ask for, and parts of cells are joined that may hold a pair. Points with a
    null coordinate have no partner.
    """
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(id_col).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"), F.floor(F.col(x) / d_max).alias("cx"), F.floor(F.col(y) / d_max).alias("cy"))
    if p.groupBy("cx", "cy").count().where(F.col("count") > dense).head(1):
        near = _dense_candidates(p, d_max, dense)
    else:
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        q = p.select(F.col("a").alias("b"), F.col("ax").alias("bx"), F.col("ay").alias("by"), "cx", "cy", F.explode(around).alias("d")).select("b", "bx", "by", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
        near = p.join(q, ["cx", "cy"]).where("a < b")
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    close = near.withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") < d_max)
    return close.select("a", "b", "distance", (w * (1 - F.col("distance") / d_max)).alias("weight"))


def _dense_candidates(p: DataFrame, d_max: float, dense: int) -> DataFrame:
    """Pairs of points (a < b) in parts of cells that may hold near ones. A cell of more than ``dense`` points is a grid of parts with about so many each; a part that still has more, as where points coincide, is dealt to several by a hash."""
    cells = p.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).select("cx", "cy", F.least(F.ceil(F.sqrt(F.col("n") / dense)), F.lit(64)).cast("long").alias("side"))
    within = lambda v, c: F.greatest(F.lit(0), F.least(F.floor((F.col(v) / d_max - F.col(c)) * F.col("side")), F.col("side") - 1))
    split = p.join(cells, ["cx", "cy"]).withColumn("gx", within("ax", "cx")).withColumn("gy", within("ay", "cy"))
    part = ["cx", "cy", "side", "gx", "gy"]
    parts = split.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("ax", "ay") for f in (F.min, F.max)])
    parts = written(parts.withColumn("deals", F.ceil(F.col("n") / dense)).withColumn("part", F.xxhash64(*part)), "parts")
    placed = split.join(parts.select(*part, "part", "deals"), part).select("part", F.pmod(F.xxhash64("a", "ax", "ay"), F.col("deals")).alias("deal"), "a", "ax", "ay")
    placed = written(placed, "placed")
    pieces = parts.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
    side = lambda t: [F.col(c).alias(f"{t}{c}") for c in ("part", "deal", "ax_min", "ax_max", "ay_min", "ay_max")]
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    other = pieces.select(*side("r"), "cx", "cy", F.explode(around).alias("d")).select(*[f"r{c}" for c in ("part", "deal", "ax_min", "ax_max", "ay_min", "ay_max")], (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
    apart = lambda c: F.greatest(F.lit(0.0), F.col(f"l{c}_min") - F.col(f"r{c}_max"), F.col(f"r{c}_min") - F.col(f"l{c}_max"))
    # Of two pieces one order is enough; bounds are a little wide, as the distance is tested later.
    meet = pieces.select("cx", "cy", *side("l")).join(other, ["cx", "cy"]).where("(lpart, ldeal) <= (rpart, rdeal)").where(apart("ax") * apart("ax") + apart("ay") * apart("ay") <= d_max * d_max * (1 + 1e-9))
    meet = written(meet.select("lpart", "ldeal", "rpart", "rdeal").distinct(), "meet")
    left = placed.withColumnsRenamed({"part": "lpart", "deal": "ldeal"}).join(meet, ["lpart", "ldeal"])
    right = placed.withColumnsRenamed({"part": "rpart", "deal": "rdeal", "a": "b", "ax": "bx", "ay": "by"})
    right = right.join(meet, ["rpart", "rdeal"])
    both = left.join(right, ["lpart", "ldeal", "rpart", "rdeal"])
    same = (F.col("lpart") == F.col("rpart")) & (F.col("ldeal") == F.col("rdeal"))
    both = both.where(F.when(same, F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    turned = F.col("a") > F.col("b")
    pick = lambda yes, no, name: F.when(turned, F.col(yes)).otherwise(F.col(no)).alias(name)
    return both.select(*[pick(q, p, p) for p, q in (("a", "b"), ("ax", "bx"), ("ay", "by"))], *[pick(p, q, q) for p, q in (("a", "b"), ("ax", "bx"), ("ay", "by"))])


def _same(width: float) -> float:
    """How likely two points at the distance d_max fall into one step of ``width`` times d_max along a random direction."""
    tail = math.erfc(width / math.sqrt(2))
    return 1 - tail - math.sqrt(2 / math.pi) / width * (1 - math.exp(-width * width / 2))


def _steps(dim: int, d_max: float, n: int, width: float, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """Whole numbers: in which step each row of a matrix falls along each of ``n`` random directions."""
    r = np.random.default_rng(seed)
    along, shift = r.standard_normal((dim, n)) / (width * d_max), r.random(n)

    def steps(x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.clip(np.nan_to_num(np.floor(x @ along + shift)), -(2.0**62), 2.0**62).astype(np.int64)

    return steps


def _keyed(reps: DataFrame, dim: int, made: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Of each vector: c, and what ``made`` gives for a matrix of them: two numbers of 64 bits (s1, s2) and any number of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sketch, keys = made(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1], keys.ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), lists], ["c", "s1", "s2", "keys"])

    return reps.select("c", "v").mapInArrow(run, "c long, s1 long, s2 long, keys array<long>")


def _factors(shape: tuple[int, ...], seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(-(2**63), 2**63 - 1, shape, dtype=np.int64) | 1


def _projections(reps: DataFrame, n: int, dim: int, d_max: float, width: float, seed: int) -> int:
    """How many directions make a key, so that sorting all keys and comparing the points that share one take least together. One table counts the pairs that share a key."""
    steps, factors = _steps(dim, d_max, max(PROJECTIONS), width, seed), _factors((max(PROJECTIONS),), seed)

    def made(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((len(x), 2), dtype=np.int64), np.cumsum(steps(x) * factors, axis=1)[:, [k - 1 for k in PROJECTIONS]]

    sizes = _keyed(reps, dim, made).select(F.posexplode("keys").alias("k", "key")).groupBy("k", "key").count()
    pairs = {PROJECTIONS[r["k"]]: r["pairs"] for r in sizes.groupBy("k").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    return min(PROJECTIONS, key=lambda k: _same(width) ** -k * (20 * n + pairs.get(k, 0)))


def near_candidates(reps: DataFrame, dim: int, d_max: float, tables: int | None = None, projections: int | None = None, width: float = 4.0, seed: int = 1) -> DataFrame:
    """Pairs (c, e) of the vectors ``v`` with different numbers ``c``, once each, that may be closer than ``d_max``.

    Vectors that share a key are compared by sketches of 128 bits before anything else is done with
    them; a pair closer than ``d_max`` has too many different bits once in ten million times.
    """
    n = reps.count()
    projections = projections or _projections(reps, n, dim, d_max, width, seed)
    tables = tables or math.ceil(math.log(MISSED) / math.log1p(-(_same(width) ** projections)))
    steps, factors = _steps(dim, d_max, tables * projections, width, seed + 1), _factors((tables, projections), seed + 1)
    marks, table = _steps(dim, d_max, 128, 8.0, seed + 2), _factors((tables,), seed + 2)
    differ = 1 - _same(8.0)
    most = math.ceil(128 * differ + 6 * math.sqrt(128 * differ * (1 - differ)))

    def made(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.packbits((marks(x) & 1).astype(np.uint8), axis=1)
        return bits.view("<i8"), (steps(x).reshape(len(x), tables, projections) * factors).sum(axis=2) + table

    left = _keyed(reps, dim, made).select("c", "s1", "s2", F.explode("keys").alias("key"))
    right = left.select(F.col("c").alias("e"), F.col("s1").alias("t1"), F.col("s2").alias("t2"), "key")
    unlike = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2")))
    return left.join(right, "key").where((F.col("c") < F.col("e")) & (unlike <= most)).select("c", "e").distinct()


def near_pairs(points: DataFrame, id_col: str, vector_col: str, dim: int, d_max: float, w: float = 0.15, tables: int | None = None, projections: int | None = None, width: float = 4.0, seed: int = 1) -> DataFrame:
    """Unordered pairs of points in ``dim`` dimensions closer than ``d_max``, and their weight w * (1 - d / d_max): most of them, not all.

    Each of several tables gives points a key, by where they fall along random directions; points
    that share a key are compared. The more points there are, the more directions a key has
    (``projections``), so that few points share one that aren't near, and the more ``tables`` there
    are, so that of the pairs just within ``d_max`` one in 5,000 is missed, of nearer ones fewer.
    Points with equal vectors are compared once. All that is found is true. Vectors that are null, of
    another length, or hold a null or a number that isn't finite have no partner.
    """
    p = points.select(F.col(id_col).alias("a"), F.col(vector_col).cast("array<double>").alias("v"))
    p = p.where((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    placed = written(p.withColumn("c", F.xxhash64("v")), "placed")
    reps = written(placed.groupBy("c").agg(F.first("v").alias("v"), (F.count("a") > 1).alias("several")), "reps")
    met = near_candidates(reps, dim, d_max, tables, projections, width, seed)
    both = met.join(reps.select("c", "v"), "c").join(reps.select(F.col("c").alias("e"), F.col("v").alias("u")), "e")
    distance = F.sqrt(F.aggregate(F.zip_with("v", "u", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    apart = both.select("c", "e", distance.alias("distance")).where(F.col("distance") < d_max)
    close = apart.unionByName(reps.where("several").select("c", F.col("c").alias("e"), F.lit(0.0).alias("distance")).where(F.col("distance") < d_max))
    named = close.join(placed.select("c", "a"), "c").join(placed.select(F.col("c").alias("e"), F.col("a").alias("b")), "e")
    named = named.where(F.when(F.col("c") == F.col("e"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    return named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance", (w * (1 - F.col("distance") / d_max)).alias("weight"))


def near_point(points: DataFrame, id_col: str, x: str, y: str, at: tuple[float, float], d_max: float, w: float = 0.28) -> DataFrame:
    """Points closer than ``d_max`` to the point ``at``, their distance and weight w * (1 - d / d_max). Points with a null coordinate are never near. Bounds on each coordinate reach the scan where it is a column of the table."""
    dx, dy = F.col(x) - at[0], F.col(y) - at[1]
    box = F.col(x).between(at[0] - d_max, at[0] + d_max) & F.col(y).between(at[1] - d_max, at[1] + d_max)
    close = points.where(box).withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") < d_max)
    return close.select(id_col, "distance", (w * (1 - F.col("distance") / d_max)).alias("weight"))
