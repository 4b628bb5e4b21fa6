"""Long stops, long runs, many values, and overlaps: what must not grow with the square of a group."""

import time
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tankwatch.functions import stats
from tankwatch.operators import detection, features, intervals, jobs, metrics, models, segments, signal, splits
from tankwatch.params import Detection
from tankwatch.plans import q_events
from tankwatch.plans.telemetry import SCALED, telemetry

BEGIN = pd.Timestamp("2024-01-01")


def pings(spark, levels, vehicle="v", minutes=1.0, ignition=False):
    rows = pd.DataFrame({"vehicle_id": vehicle, "timestamp": BEGIN + pd.to_timedelta(np.arange(len(levels)) * minutes, unit="min"), "total_fuel_gal": np.asarray(levels, dtype=float), "speed_kmh": 0.0, "ignition": ignition})
    return spark.createDataFrame(rows)


def test_a_stop_of_20_000_pings(spark):
    """One drop near the end of a quiet fortnight: every window that holds it, and only these are made."""
    levels = np.full(20_000, 50.0)
    levels[19_900:] -= 10.0
    t = segments.with_segment(signal.derive(pings(spark, levels)), Detection())
    none = detection.noise_thresholds(t)
    began = time.time()
    found = detection.scan(t, none).persist()
    # windows that begin at the first low ping or before it and end there or after it, as long as the pattern asks
    i, j = np.arange(19_901)[:, None], np.arange(19_900, 20_000)[None, :]
    assert found.count() == int((j - i >= 10).sum())
    assert found.agg(F.min("drop_gal"), F.max("drop_gal")).first() == (10.0, 10.0)
    kept = detection.suppress(detection.distinct_events(found)).toPandas()
    found.unpersist()
    assert len(kept) and time.time() - began < 120
    # no two of those that stay overlap by half or more
    s, e = kept["start_time"].astype("int64").to_numpy(), kept["end_time"].astype("int64").to_numpy()
    shared = np.maximum(0, np.minimum(e[:, None], e) - np.maximum(s[:, None], s))
    over = shared / ((e - s)[:, None] + (e - s) - shared)
    assert (over[~np.eye(len(s), dtype=bool)] < 0.5).all()


@pytest.mark.parametrize("width", [3, 64])
def test_blocks_of_starts_find_the_same(spark, sf, width):
    t = q_events.placed(spark, sf)
    thresholds = detection.noise_thresholds(t, SCALED)
    whole, parts = (detection.scan(t, thresholds, SCALED, w) for w in (1 << 20, width))
    assert whole.exceptAll(parts).isEmpty() and parts.exceptAll(whole).isEmpty() and not whole.isEmpty()


@pytest.mark.parametrize("limit", [0.0, 0.3, 0.5, 0.9, 1.0])
def test_suppression_against_a_loop(spark, limit):
    rng = np.random.default_rng(3)
    rows = [("ab"[k % 2], k % 3, int(a), int(a + rng.integers(1, 400)), float(rng.integers(0, 12))) for k, a in enumerate(rng.integers(0, 1500, 600))]
    df = spark.createDataFrame([(v, g, d, 0, a, b, "x", a, b) for v, g, a, b, d in rows], "vehicle_id string, seg_id long, drop_gal double, pattern_no int, start_idx int, end_idx int, pattern string, s long, e long").select("*", F.timestamp_seconds("s").alias("start_time"), F.timestamp_seconds("e").alias("end_time"))
    got = sorted((r.vehicle_id, r.seg_id, r.s, r.e, r.drop_gal) for r in detection.suppress(df, replace(Detection(), iou=limit)).collect())
    want = []
    for stop in sorted({r[:2] for r in rows}):
        kept = []
        for r in sorted((r for r in rows if r[:2] == stop), key=lambda r: (-r[4], r[2], r[3])):
            shared = [max(0, min(r[3], k[3]) - max(r[2], k[2])) for k in kept]
            if all(x < limit * (r[3] - r[2] + k[3] - k[2] - x) for x, k in zip(shared, kept)):
                kept.append(r)
        want += kept
    assert got == sorted(want)


def test_a_run_of_200_000_rows_is_interpolated(spark):
    levels = np.linspace(60, 40, 200_000)
    levels[np.arange(5, 200_000, 9)] = np.nan
    t = signal.states(pings(spark, levels).withColumn("total_fuel_gal", F.when(~F.isnan("total_fuel_gal"), F.col("total_fuel_gal"))))
    began = time.time()
    out = signal.interpolate(t).agg(F.count("total_fuel_gal").alias("n"), F.max(F.abs(F.col("total_fuel_gal") - (60 - 20 * (F.unix_timestamp("timestamp") - F.lit(int(BEGIN.timestamp()))) / 60 / 199_999))).alias("off")).first()
    assert out.n == 200_000 - np.isnan(levels[-1]) and out.off < 1e-6 and time.time() - began < 60


def test_quantiles_narrow_to_few_values(spark):
    rng = np.random.default_rng(1)
    n = 30_000
    rows = pd.DataFrame({"x": rng.normal(size=n), "y": rng.integers(0, 3, n).astype(float), "z": np.where(rng.random(n) < 0.9, 7.0, rng.random(n) * 1e6), "one": 2.0})
    df = spark.createDataFrame(rows).withColumns({"w": F.when(F.col("x") > 0, F.col("x")), "none": F.lit(None).cast("double")})
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    columns = ["x", "y", "z", "one", "w"]
    want = df.agg(*[F.percentile(c, F.array(*[F.lit(q) for q in shares])).alias(c) for c in columns]).first()
    for gather in (20, 500, 1 << 20):
        got = stats.quantiles(df, [*columns, "none"], shares, gather)
        assert all(got[c] == pytest.approx(list(want[c]), rel=1e-12) for c in columns) and got["none"] == [None] * len(shares)
    assert stats.quantiles(df.where("false"), ["x"], [0.5]) == {"x": [None]}


def test_leaks_make_no_pairs_without_overlap(spark):
    rng = np.random.default_rng(2)
    rows = [(f"v{k % 3}", int(a), int(a + rng.integers(0, 40)), bool(rng.random() < 0.6)) for k, a in enumerate(rng.integers(0, 4000, 300))]
    times = lambda df: df.select("vehicle_id", F.timestamp_seconds("s").alias("start_time"), F.timestamp_seconds("e").alias("end_time"), "is_train")
    got = sorted((r.vehicle_id, r.train_start.timestamp(), r.train_end.timestamp(), r.test_start.timestamp(), r.test_end.timestamp()) for r in splits.leaks(times(spark.createDataFrame(rows, "vehicle_id string, s long, e long, is_train boolean"))).collect())
    want = sorted((a[0], a[1], a[2], b[1], b[2]) for a in rows for b in rows if a[0] == b[0] and a[3] and not b[3] and a[1] <= b[2] and b[1] <= a[2])
    assert got == want and want
    many = spark.range(100_000).select(F.lit("v").alias("vehicle_id"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 5).alias("e"), (F.col("id") < 80_000).alias("is_train"))
    began = time.time()
    splits.check_no_leak(times(many))
    assert time.time() - began < 60


def test_bootstrap_is_within_monte_carlo_error_of_a_loop(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(3000) < 0.3).astype(int)
    score = np.clip(y * 0.3 + rng.random(3000) * 0.7, 0, 1)
    df = spark.createDataFrame(pd.DataFrame({"event_key": np.arange(3000), "y": y, "score": score})).repartition(3)
    got = {r.metric: r for r in metrics.bootstrap(df, metrics.rates(F.col("score") >= 0.5), 1000).collect()}
    hit, want = score >= 0.5, {"precision": [], "recall": [], "fpr": []}
    for _ in range(1000):
        k = rng.integers(0, 3000, 3000)
        tp, fp, fn, tn = ((hit[k] & (y[k] == 1)).sum(), (hit[k] & (y[k] == 0)).sum(), (~hit[k] & (y[k] == 1)).sum(), (~hit[k] & (y[k] == 0)).sum())
        for n, v in (("precision", tp / (tp + fp)), ("recall", tp / (tp + fn)), ("fpr", fp / (fp + tn))):
            want[n].append(v)
    for n, values in want.items():
        spread = np.std(values)
        assert abs(got[n]["mean"] - np.mean(values)) < 0.2 * spread
        for side, q in (("low", 2.5), ("high", 97.5)):
            assert abs(got[n][side] - np.percentile(values, q)) < 0.4 * spread
    again = {r.metric: r for r in metrics.bootstrap(df.repartition(2), metrics.rates(F.col("score") >= 0.5), 1000).collect()}
    assert all(again[n][c] == pytest.approx(got[n][c]) for n in got for c in ("mean", "low", "high"))


def test_folds_hold_both_classes(spark):
    rows = [(k, 1 if k < 5 else 0) for k in range(200)]
    got = models.stratified(spark.createDataFrame(rows, "event_key long, y int"), 5).groupBy("_fold", "y").count().toPandas()
    assert sorted(got[got.y == 1]["count"]) == [1] * 5 and sorted(got[got.y == 0]["count"]) == [39] * 5


def test_telemetry_in_any_batches_gives_the_batch_result(spark, sf, tmp_path):
    from tankwatch.streaming import streams

    t = telemetry(spark, sf).where("cast(vehicle_id as int) % 4 = 0").toPandas()
    known = segments.with_segment(signal.derive(spark.createDataFrame(t), SCALED), SCALED)
    noise = spark.createDataFrame(detection.noise_thresholds(known, SCALED).toPandas())
    columns = ["vehicle_id", "seg_id", "start_time", "end_time", "drop_gal", "pattern"]
    want = sorted(map(tuple, detection.suppress(detection.distinct_events(detection.scan(known, noise, SCALED)), SCALED).select(*columns).collect()))
    rng = np.random.default_rng(6)
    far = t.iloc[:1].assign(vehicle_id="~end", timestamp=t["timestamp"].max() + pd.Timedelta(days=3660))
    # rows of a batch may be out of order, by less than the watermark's two days; the last batch lets all segments close
    shown = (t["timestamp"] - t["timestamp"].min()).dt.total_seconds() / 86400 + rng.random(len(t)) * 1.5
    parts = [g for _, g in t.groupby(np.digitize(shown, [shown.quantile(0.3), shown.quantile(0.7)]))] + [far]
    src, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    score = lambda e, rows: e.withColumn("is_theft", (F.col("drop_gal") > 40).cast("int"))
    for part in parts:
        df = spark.createDataFrame(part.sample(frac=1, random_state=1))
        df.coalesce(1).write.mode("append").parquet(src)
        streams.detect_batches(spark.readStream.schema(df.schema).parquet(src), noise, score, out, state, SCALED, "2 days")
    got = sorted(map(tuple, spark.read.parquet(f"{out}/events").select(*columns).collect()))
    assert got == want and want
    sums = spark.read.parquet(f"{out}/batches").agg(F.sum("n_events"), F.sum("n_thefts")).first()
    assert sums[0] == len(want) and sums[1] == sum(r[4] > 40 for r in want)


def test_window_features_are_never_broadcast(spark):
    """Windows count as small by their file, however far they are spread; nothing that grows with events passes the driver."""
    t = spark.range(400).select((F.col("id") % 4).cast("string").alias("vehicle_id"), F.timestamp_seconds(F.col("id") * 600).alias("timestamp"), (100.0 - F.col("id") % 7).alias("total_fuel_gal"), F.lit(0.0).alias("speed_kmh"), F.lit(True).alias("ignition"), (4.0 + F.col("id") % 3 * 0.001).alias("latitude"), F.lit(-74.0).alias("longitude"), F.lit(600.0).alias("dt_s"), F.lit(-0.5).alias("dfuel"), (F.col("id") % 9 == 0).cast("int").alias("stationary_drain"))
    e = spark.range(20).select((F.col("id") % 4).cast("string").alias("vehicle_id"), F.timestamp_seconds(F.col("id") * 9000).alias("start_time"), F.timestamp_seconds(F.col("id") * 9000 + 7200).alias("end_time"), F.lit("p").alias("pattern"), F.lit(3.0).alias("drop_gal"), F.lit(1.0).alias("min_step_gal"), F.lit(2).alias("n_negative_steps"))
    rows = features.labels(features.FeatureBuilder(hours=96).base(splits.map_events(intervals.keyed(e), splits.rank_split(t)), t), t)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") > 0
    assert features.matrix(rows, ["vehicle_id"]).count() == 20


def test_hotspots_are_never_broadcast(spark, monkeypatch):
    """Spots, cells and centroids grow with the vehicles, and their files are small."""
    from tankwatch.operators import hotspots
    from tankwatch.params import Clustering

    plans, kept = [], hotspots._stored
    note = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(hotspots, "_stored", lambda df: kept(note(df)))
    rows = spark.range(400).select((F.col("id") % 4).cast("string").alias("vehicle_id"), F.col("id").alias("point_id"), (4.0 + F.col("id") % 7 * 0.0001).alias("latitude"), (-74.0 - F.col("id") % 5 * 0.003).alias("longitude"))
    centres, points = hotspots.fit_hotspots(rows, Clustering(eps_m=40.0, min_samples=4))
    events = points.select("vehicle_id", F.col("point_id").alias("event_key"), F.lit(3.0).alias("drop_gal"), F.lit(60.0).alias("duration_min"))
    placed = note(hotspots.event_clusters(note(points).withColumn("event_key", F.col("point_id")), events))
    note(hotspots.hotspot_statistics(placed, points))
    note(detection.noise_envelope(rows.select("vehicle_id", F.lit(0.5).alias("dfuel"), F.lit(True).alias("stationary_on"), F.lit(False).alias("ign_off"))))
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans) and sum("SortMergeJoin" in p for p in plans) > 5
    assert not centres.isEmpty() and placed.where("is_hotspot = 1").count() == 400


def test_a_stream_asks_its_state_a_few_times_for_a_vehicle(spark):
    """However many rows a batch brings, and over however many hours: each call is a message to the JVM."""
    from tankwatch.streaming import streams

    calls = []

    class State:
        def __init__(self):
            self.held = []

        def __getattr__(self, name):
            def call(*x):
                calls.append(name)
                if name in ("appendList", "put"):
                    self.held = [*(self.held if name == "appendList" else []), *x[0]]
                elif name == "clear":
                    self.held = []
                elif name == "update":
                    self.held = x[0]
                return self.held or None if name == "get" else bool(self.held)

            return call

    class Handle:
        def __getattr__(self, name):
            return lambda *x: State() if name.startswith("get") else calls.append(name)

    class Times:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    n = 400
    rows = pd.DataFrame({"timestamp": pd.to_datetime(np.arange(1, n + 1) * 3600, unit="s"), "total_fuel_gal": 90.0, "speed_kmh": 0.0, "ignition": True, "latitude": 4.0, "longitude": -74.0, "is_moving": False, "stationary_on": True, "ign_off": False, "stationary": True})
    own = streams._Segments(SCALED)
    own.init(Handle())
    assert not list(own.handleInputRows(("a",), iter([rows.iloc[::-1]]), Times(0)))
    out = pd.concat(own.handleExpiredTimer(("a",), Times((n + 100) * 3_600_000), None))
    assert out["timestamp"].tolist() == rows["timestamp"].tolist() and out["seg_id"].unique().tolist() == [1]
    assert len(calls) <= 20


def test_a_part_of_a_stream_is_not_one_tasks(spark, sf, monkeypatch):
    """A part arrives in as many files as it has tasks, and all of them make one batch."""
    from tankwatch.plans import q_jobs
    from tankwatch.streaming import streams

    whole, path, paths, seen = q_jobs.telemetry, q_jobs._path, {}, []
    monkeypatch.setattr(q_jobs, "telemetry", lambda spark, d: whole(spark, d).repartition(4, "event_id"))
    monkeypatch.setattr(q_jobs, "_path", lambda spark, name: paths.setdefault(name, path(spark, name)))

    def note(stream, *args):
        def batch(rows, number):
            seen.append((number, rows.count()))

        stream.writeStream.foreachBatch(batch).option("checkpointLocation", path(spark, "noted")).trigger(availableNow=True).start().awaitTermination()
        raise StopIteration

    monkeypatch.setattr(streams, "detect_batches", note)
    with pytest.raises(StopIteration):
        q_jobs.i11(spark, sf)
    first = spark.read.parquet(paths["in"])
    assert len(first.inputFiles()) > 1 and seen == [(0, first.count())]


def test_an_evaluation_is_not_made_anew_by_who_reads_it(spark):
    """The four tables of the evaluation job are stored, and an evaluation makes its curve once: plans stay small however they are read together."""
    rng = np.random.default_rng(7)
    scores = spark.createDataFrame([(k, m, ("long", "short")[k % 2], int(rng.random() < 0.4), float(rng.random())) for k in range(300) for m in "ab"], "event_key long, model string, pattern string, y int, score double")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan(models.evaluate(scores))
    e = jobs.evaluation_job(scores, n=5)
    for table in (e.best, e.calibration, e.per_pattern, e.top):
        assert table.count() and not any(x in plan(table) for x in ("Join", "Aggregate", "Window"))
    assert [r.score for r in e.top.collect()] == sorted((r.score for r in scores.where(F.col("model") == e.best.first().model).collect()), reverse=True)[:5]
