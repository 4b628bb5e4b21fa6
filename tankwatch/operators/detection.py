"""Noise thresholds, the window scan, plausibility, and overlap suppression."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tankwatch.functions.stats import large, mad_sigma
from tankwatch.operators.quality import first_of
from tankwatch.operators.segments import with_segment
from tankwatch.params import Detection, Pattern

EVENT_KEY = ["vehicle_id", "start_time", "end_time", "drop_gal"]


def by_state(df: DataFrame) -> DataFrame:
    """One row for each state that a row is in."""
    state = F.array_compact(F.array(F.when(F.col("stationary_on"), F.lit("stationary_on")), F.when(F.col("ign_off"), F.lit("ign_off"))))
    return df.withColumn("state", F.explode(state))


def noise_thresholds(df: DataFrame, p: Detection = Detection(), train_only: bool = False) -> DataFrame:
    """``vehicle_id, state, step_gal, cum_gal`` from the robust deviation of fuel steps, not below the floors."""
    rows = df.where("is_train") if train_only else df
    both = rows.select("vehicle_id").distinct().withColumn("state", F.explode(F.array(*[F.lit(s) for s in sorted(p.floors)])))
    sigma = F.coalesce("sigma", F.lit(0.0))
    floor = lambda k: F.element_at(F.create_map(*[x for s, f in sorted(p.floors.items()) for x in (F.lit(s), F.lit(float(f[k])))]), F.col("state"))
    return both.join(large(mad_sigma(by_state(rows), ["vehicle_id", "state"], "dfuel")), ["vehicle_id", "state"], "left").select(
        "vehicle_id", "state", F.greatest(p.noise_mult_step * sigma, floor(0)).alias("step_gal"), F.greatest(p.noise_mult_cum * sigma, floor(1)).alias("cum_gal")
    )


def noise_envelope(df: DataFrame) -> DataFrame:
    """How fuel steps spread by vehicle and state."""
    rows = by_state(df)
    q = F.percentile("dfuel", F.array(*[F.lit(x) for x in (0.01, 0.05, 0.95, 0.99)]))
    quantiles = rows.groupBy("vehicle_id", "state").agg(F.count("dfuel").alias("n_samples"), q.alias("q"))
    sigma = mad_sigma(rows, ["vehicle_id", "state"], "dfuel").select("vehicle_id", "state", "sigma")
    return quantiles.join(large(sigma), ["vehicle_id", "state"], "left").select("vehicle_id", "state", "n_samples", F.coalesce("sigma", F.lit(0.0)).alias("sigma_mad"), *[F.col("q")[k].alias(n) for k, n in enumerate(("q01", "q05", "q95", "q99"))])


def with_thresholds(df: DataFrame, thresholds: DataFrame, p: Detection = Detection()) -> DataFrame:
    """Looks up thresholds by vehicle and state; a vehicle without any gets the floors."""
    floor = lambda k: F.element_at(F.create_map(*[x for s, f in sorted(p.floors.items()) for x in (F.lit(s), F.lit(float(f[k])))]), F.col("state"))
    return df.join(large(thresholds), ["vehicle_id", "state"], "left").withColumns({"step_gal": F.coalesce("step_gal", floor(0)), "cum_gal": F.coalesce("cum_gal", floor(1))})


def pattern_table(spark: SparkSession, p: Detection = Detection()) -> DataFrame:
    """A few rows: the patterns, each with its state and its place in the list."""
    rows = [(k, x.name, x.state, float(x.min_minutes), None if x.max_minutes is None else float(x.max_minutes), x.min_points, float(x.min_median_dt_s), 2 if x.name.startswith("short") else 1) for k, x in enumerate(p.patterns)]
    return spark.createDataFrame(rows, "pattern_no int, pattern string, state string, min_minutes double, max_minutes double, min_points int, min_median_dt_s double, min_steps int")


def valid_duration(minutes: Column, x: Pattern) -> Column:
    ok = minutes >= x.min_minutes
    return ok if x.max_minutes is None else ok & (minutes <= x.max_minutes)


def valid_event(x: Pattern, step_gal: Column, cum_gal: Column) -> Column:
    """Whether an event row fits a pattern: its duration, and the tests of the pattern's state."""
    base = valid_duration(F.col("duration_min"), x)
    if x.state == "ign_off":
        return base & (F.col("drop_gal") >= cum_gal) & (F.col("n_points") >= x.min_points) & (F.col("median_dt_s") >= x.min_median_dt_s)
    return base & ((F.col("drop_gal") >= cum_gal) | (F.col("min_step_gal") >= step_gal))


def plausible(df: DataFrame, p: Detection = Detection()) -> DataFrame:
    return df.where((F.col("drop_gal") / F.greatest(F.col("duration_min"), F.lit(0.001)) <= p.max_rate) & (F.col("min_step_gal") <= p.max_step))


def tasks(df: DataFrame) -> int:
    """As many tasks as the session shuffles into: rows that are few but costly are then not merged into one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Starts of windows that one task tries; a longer stop is dealt out by blocks of starts.
BLOCK = 2048
_FOUND = "vehicle_id string, start_time timestamp, end_time timestamp, duration_min double, drop_gal double, min_step_gal double, pattern string, n_negative_steps int, seg_id long, pattern_no int, start_idx int, end_idx int"


def _stops(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows as one table for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in keys:
            edge |= np.asarray(pc.not_equal(batch.column(c)[1:], batch.column(c)[:-1]))
        begins = [0, *(np.flatnonzero(edge) + 1).tolist()]
        if held and any(held[-1].column(c)[0] != batch.column(c)[0] for c in keys):
            yield pa.Table.from_batches(held)
            held = []
        for begin, end in zip(begins, [*begins[1:], batch.num_rows], strict=True):
            held.append(batch.slice(begin, end - begin))
            if end < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _windows(stop: pa.Table, p: Detection, width: int = BLOCK) -> Iterator[dict[str, np.ndarray]]:
    """The windows of a stop that pass, start by start, for the starts of the table's block.

    Drops only add up, so that the first end at which a start can pass is known from running sums: earlier ones are not tried.
    """
    col = lambda c: stop.column(c).to_numpy()
    state, step_gal, cum_gal, first = stop.column("state")[0].as_py(), stop.column("step_gal")[0].as_py(), stop.column("cum_gal")[0].as_py(), int(stop.column("idx")[0].as_py())
    t, dt = stop.column("timestamp").cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_numpy(), col("dt_s").astype(float)
    drop = -col("drop").astype(float)
    some = ~np.isnan(drop)
    drop = np.where(some, drop, 0.0)
    total, count = np.r_[0.0, np.cumsum(drop)], np.r_[0, np.cumsum(some)]
    large = np.where(some & (drop >= step_gal), np.arange(len(t)), len(t))
    next_large = np.minimum.accumulate(large[::-1])[::-1]
    patterns = [(k, x, 2 if x.name.startswith("short") else 1) for k, x in enumerate(p.patterns) if x.state == state]
    if not patterns:
        return
    least, longest = min(x.min_minutes for _, x, _ in patterns), max(float("inf") if x.max_minutes is None else x.max_minutes for _, x, _ in patterns)
    has = ~np.isnan(dt)
    steps = np.r_[0, np.cumsum(has)]
    below = {m: np.r_[0, np.cumsum(has & (dt < m))] for m in {x.min_median_dt_s for _, x, _ in patterns}} if state == "ign_off" else {}
    block = int(stop.column("block")[0].as_py())
    starts = np.arange(block * width + 1 - first, min(len(t), (block + 1) * width + 1 - first))
    # a little less than needed, as sums of the window itself are rounded
    from_ = np.searchsorted(total[1:], total[starts] + cum_gal - 1e-6)
    if state != "ign_off":
        from_ = np.minimum(from_, next_large[starts])
    from_ = np.maximum(np.maximum(from_, starts + 1), np.searchsorted(t, t[starts] + int(least * 6e7)))
    upto = np.full(len(starts), len(t)) if longest == float("inf") else np.searchsorted(t, t[starts] + int(longest * 6e7), side="right")
    for i, low, high in zip(starts.tolist(), from_.tolist(), upto.tolist(), strict=True):
        if low >= high:
            continue
        j = np.arange(low, high)
        sums, biggest = np.round(total[j + 1] - total[i], 9), np.maximum.accumulate(drop[i:high])[low - i :]
        n, minutes = count[j + 1] - count[i], (t[j] - t[i]) / 6e7
        sound = (n > 0) & (sums / np.maximum(minutes, 0.001) <= p.max_rate) & (biggest <= p.max_step)
        for number, x, fewest in patterns:
            ok = sound & (minutes >= x.min_minutes) & (minutes <= (np.inf if x.max_minutes is None else x.max_minutes))
            if state == "ign_off":
                ok &= (sums >= cum_gal) & (j - i + 1 >= x.min_points)
                if ok.any():
                    ok &= _slow(dt, i, low, high, steps, below[x.min_median_dt_s], x.min_median_dt_s)
            else:
                ok &= ((sums >= cum_gal) | (biggest >= step_gal)) & (n >= fewest)
            k = np.flatnonzero(ok)
            if len(k):
                yield {"start_time": np.full(len(k), t[i]), "end_time": t[j[k]], "duration_min": minutes[k], "drop_gal": sums[k], "min_step_gal": biggest[k], "n_negative_steps": n[k], "pattern": np.full(len(k), number), "start_idx": np.full(len(k), i + first), "end_idx": j[k] + first}


def _slow(dt: np.ndarray, i: int, low: int, high: int, steps: np.ndarray, below: np.ndarray, least: float) -> np.ndarray:
    """Whether the median time step of the windows from ``i`` to ``low`` .. ``high`` - 1 reaches the limit, from counts of
    steps below it; in the even case the largest one below and the smallest one not below decide."""
    j = np.arange(low, high)
    n, few = steps[j + 1] - steps[i + 1], below[j + 1] - below[i + 1]
    out = 2 * few < n
    even = (2 * few == n) & (n > 0)
    if even.any():
        own = dt[i + 1 : high]
        top = np.fmax.accumulate(np.where(own < least, own, np.nan))[low - i - 1 :]
        bottom = np.fmin.accumulate(np.where(own >= least, own, np.nan))[low - i - 1 :]
        out = np.where(even, (top + bottom) / 2 >= least, out)
    return out


def scan(df: DataFrame, thresholds: DataFrame, p: Detection = Detection(), width: int = BLOCK) -> DataFrame:
    """All windows of a segment that look like a fuel drop.

    The rows of a segment meet in one task, in order, and are tried there start by start with running sums, so that rows are
    shuffled but pairs of rows never are. A long segment is dealt out by blocks of ``width`` starts, each with all rows from its
    first start on. Segments are first cut to those whose total drop or largest step can pass at all, which loses nothing.
    """
    rows = df.where(F.col("seg_id").isNotNull()).select("vehicle_id", F.col("seg_id").cast("long").alias("seg_id"), "timestamp", "dfuel", "dt_s", "ign_off")
    drop = F.when(F.col("dfuel") < p.noise_drop, F.col("dfuel"))
    stop = W.partitionBy("vehicle_id", "seg_id")
    placed = rows.withColumns({"idx": F.row_number().over(stop.orderBy("timestamp")), "drop": drop})
    # what a segment is as a whole comes from windows over the same order by vehicle: no second pass, no join of rows
    minutes = (F.unix_micros(F.max("timestamp").over(stop)) - F.unix_micros(F.min("timestamp").over(stop))) / 6e7
    state = F.when(F.avg(F.col("ign_off").cast("double")).over(stop) > 0.5, "ign_off").otherwise("stationary_on")
    known = placed.withColumns({"state": state, "_minutes": minutes, "_rows": F.count("*").over(stop), "_total": F.sum(-F.col("drop")).over(stop), "_largest": F.max(-F.col("drop")).over(stop)})
    able = (F.col("_total") + 1e-9 >= F.col("cum_gal")) | (F.col("_largest") >= F.col("step_gal"))
    lasting = known.where((F.col("_minutes") >= p.min_segment_min) & (F.col("_rows") >= 2) & (F.col("_largest") > 0))
    searched = with_thresholds(lasting, thresholds, p).where(able)
    # a row goes to its own block of starts and to those before
    last = F.floor((F.col("idx") - 1) / width).cast("int")
    dealt = searched.withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    names = pa.array([x.name for x in p.patterns])

    def out(held: list[tuple]) -> pa.RecordBatch:
        """What some starts found, of one stop or of several, as one batch."""
        found = [h[2] for h in held]
        sizes = [len(h["pattern"]) for h in found]
        c = {k: np.concatenate([h[k] for h in found]) for k in found[0]}
        of_stop = pa.array(np.repeat(np.arange(len(held)), sizes))
        time = lambda k: pa.array(c[k], pa.timestamp("us", "UTC"))
        whole = lambda k: pa.array(c[k].astype(np.int32))
        vehicle, segment = pa.array([h[0] for h in held], pa.string()).take(of_stop), pa.array([h[1] for h in held], pa.int64()).take(of_stop)
        return pa.RecordBatch.from_arrays(
            [vehicle, time("start_time"), time("end_time"), pa.array(c["duration_min"]), pa.array(c["drop_gal"]), pa.array(c["min_step_gal"]), names.take(pa.array(c["pattern"])), whole("n_negative_steps"), segment, whole("pattern"), whole("start_idx"), whole("end_idx")],
            names=[x.split()[0] for x in _FOUND.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for stop in _stops(batches, ["vehicle_id", "seg_id", "block"]):
            vehicle, segment = stop.column("vehicle_id")[0].as_py(), stop.column("seg_id")[0].as_py()
            for one in _windows(stop, p, width):
                held.append((vehicle, segment, one))
                size += len(one["pattern"])
                if size > 1 << 16:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    order = ["vehicle_id", "seg_id", "block", "idx"]
    return dealt.repartition(tasks(df), "vehicle_id", "seg_id", "block").sortWithinPartitions(*order).select(*order, "timestamp", "drop", "dt_s", "state", "step_gal", "cum_gal").mapInArrow(run, _FOUND)


ORDER = ["vehicle_id", "seg_id", "pattern_no", "start_idx", "end_idx"]


def distinct_events(events: DataFrame) -> DataFrame:
    """Equal vehicle, times and drop: the first in detection order stays."""
    return first_of(events, EVENT_KEY, [F.col(c) for c in ORDER])


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared over covered seconds of two intervals; 0 if nothing is covered."""
    a, b, c, d = (F.unix_micros(x) for x in (s1, e1, s2, e2))
    shared = F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))
    return F.coalesce(F.try_divide(shared, (b - a) + (d - c) - shared), F.lit(0.0))


class _Kept:
    """Intervals that stay, found by length and place: one overlaps only such as are like it in both."""

    def __init__(self, limit: float):
        self.limit, self.step = limit, max(math.log(1 / limit), 0.05)
        self.cells: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def clash(self, start: int, end: int) -> bool:
        """Whether an interval that stays covers this one up to the limit; if not, it stays as well."""
        length = end - start
        if not length:  # an instant shares nothing with anything
            return False
        size = int(math.log(length) / self.step)
        # lengths of a size differ by less than 1 / limit, and those that clash by no more than that
        for near in (size - 1, size, size + 1):
            width = math.exp((near + 2) * self.step)
            place = int(start / width)
            for k in (place - 1, place, place + 1):
                for s, e in self.cells.get((near, k), ()):
                    shared = min(end, e) - max(start, s)
                    if shared > 0 and shared >= self.limit * (length + e - s - shared):
                        return True
        width = math.exp((size + 2) * self.step)
        self.cells.setdefault((size, int(start / width)), []).append((start, end))
        return False


def suppress(events: DataFrame, p: Detection = Detection()) -> DataFrame:
    """Greedy suppression: by falling drop, an event goes if it overlaps one that stays.

    Segments do not overlap in time, so each is settled by itself. A task reads the windows of a stop in order, sorted by Spark, and
    remembers those that stay, never the others, however long the stop is. Ties go by pattern, then by the earlier start and end.
    With a limit of 0 the first one alone stays.
    """
    schema = events.schema
    time = lambda c: F.unix_micros(c).alias(f"_{c}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, None
        for batch in batches:
            stay = []
            vehicles, stops, starts, ends = (batch.column(c).to_pylist() for c in ("vehicle_id", "seg_id", "_start_time", "_end_time"))
            for k, (vehicle, stop, start, end) in enumerate(zip(vehicles, stops, starts, ends, strict=True)):
                fresh = (vehicle, stop) != now
                if fresh:
                    now, kept = (vehicle, stop), _Kept(p.iou) if p.iou > 0 else None
                if fresh and kept is None or kept is not None and not kept.clash(start, end):
                    stay.append(k)
            yield batch.take(pa.array(stay, pa.int64())).select(schema.names)

    order = [F.col("vehicle_id"), F.col("seg_id"), F.desc("drop_gal"), F.col("pattern_no"), F.col("start_idx"), F.col("end_idx")]
    return events.select("*", time("start_time"), time("end_time")).repartition(tasks(events), "vehicle_id", "seg_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def _stored(df: DataFrame) -> DataFrame:
    """A table in the session's checkpoint folder: rounds neither grow the plan nor depend on one executor."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='tankwatch-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def detect(df: DataFrame, p: Detection = Detection(), thresholds: DataFrame | None = None) -> DataFrame:
    """From derived telemetry to events that do not overlap."""
    placed = with_segment(df, p) if "seg_id" not in df.columns else df
    found = scan(placed, noise_thresholds(placed, p) if thresholds is None else thresholds, p)
    return suppress(distinct_events(found), p)
