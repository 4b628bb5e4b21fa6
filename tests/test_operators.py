import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tankwatch.functions import parse
from tankwatch.functions.geo import haversine
from tankwatch.operators import detection, hotspots, metrics, models, quality, signal, splits
from tankwatch.params import Clustering, Detection
from tankwatch.plans import q_events, q_models
from tankwatch.sources import ingest

T0 = dt.datetime(2025, 1, 15, 8, 0)


def one(spark, c):
    return spark.range(1).select(c).first()[0]


@pytest.mark.parametrize("text,want", [("50 km/h", 50.0), ("60.5 km/h", 60.5), ("45.5", 45.5), ("invalid", None), (None, None)])
def test_speed(spark, text, want):
    assert one(spark, parse.speed(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text,want", [("on", True), ("Encendido", True), ("apagado", False), ("2", True), ("0", False), ("what", False), (None, False)])
def test_ignition(spark, text, want):
    assert one(spark, parse.ignition(F.lit(text).cast("string"))) is want


@pytest.mark.parametrize("text,want", [("40.7128, -74.0060", (40.7128, -74.006)), ("34.0522,-118.2437", (34.0522, -118.2437)), ("invalid", (None, None)), ("", (None, None)), (None, (None, None))])
def test_coordinates(spark, text, want):
    lat, lon = parse.coordinates(F.lit(text).cast("string"))
    assert tuple(spark.range(1).select(lat, lon).first()) == want


def test_pick_column():
    assert parse.pick_column(["Fecha", "Tanque Total"], ["total_fuel", "tanque total"]) == "Tanque Total"
    assert parse.pick_column(["left_fuel"], ["fuel"]) == "left_fuel"
    assert parse.pick_column(["day"], ["y"]) is None


def test_haversine_unit(spark):
    d = one(spark, haversine(F.lit(40.7128), F.lit(-74.006), F.lit(34.0522), F.lit(-118.2437)))
    assert 3930 < d < 3945
    with pytest.raises(ValueError):
        haversine(F.lit(0), F.lit(0), F.lit(0), F.lit(0), "miles")


def telemetry(spark, fuel, step=60, speed=None, ignition=True):
    speed = speed or [0.0] * len(fuel)
    rows = [("V1", T0 + dt.timedelta(seconds=step * k), f, s, ignition, 40.0, -74.0) for k, (f, s) in enumerate(zip(fuel, speed))]
    return spark.createDataFrame(rows, "vehicle_id string, timestamp timestamp, total_fuel_gal double, speed_kmh double, ignition boolean, latitude double, longitude double")


def test_rate_outlier_is_emptied(spark):
    got = signal.drop_rate_outliers(telemetry(spark, [100.0, 50.0, 49.0])).orderBy("timestamp").collect()
    assert [r.total_fuel_gal for r in got] == [100.0, None, 49.0]


def test_gap_is_filled_only_when_standing(spark):
    fuel = [100.0, None, None, 98.0, 97.5]
    still = signal.interpolate(signal.states(telemetry(spark, fuel))).orderBy("timestamp").collect()
    assert all(98 < r.total_fuel_gal < 100 for r in still[1:3])
    moving = signal.interpolate(signal.states(telemetry(spark, fuel, speed=[60.0] * 5))).orderBy("timestamp").collect()
    assert moving[1].total_fuel_gal is None


def test_missing_columns_are_an_error(spark):
    with pytest.raises(ValueError):
        quality.require(spark.range(1), ["vehicle_id"])
    with pytest.raises(ValueError):
        ingest.union([])
    with pytest.raises(ValueError):
        ingest.standardise(spark.createDataFrame([("1",)], "fuel string"))


def test_scan_finds_a_theft(spark):
    fuel = [100 - 0.1 * k for k in range(20)] + [98.0, 95.0, 92.0, 89.0, 86.0] + [86 - 0.1 * k for k in range(10)]
    t = signal.derive(telemetry(spark, fuel, step=120))
    got = detection.detect(t).collect()
    assert got and max(r.drop_gal for r in got) >= 10


def greedy(events, limit):
    kept = []
    for e in sorted(events, key=lambda r: (-r.drop_gal, r.vehicle_id, r.seg_id, r.pattern_no, r.start_idx, r.end_idx)):
        def iou(o):
            a, b = e.start_time.timestamp(), e.end_time.timestamp()
            c, d = o.start_time.timestamp(), o.end_time.timestamp()
            shared = max(0.0, min(b, d) - max(a, c))
            whole = (b - a) + (d - c) - shared
            return shared / whole if whole else 0.0
        if all(o.vehicle_id != e.vehicle_id or iou(o) < limit for o in kept):
            kept.append(e)
    return {(r.vehicle_id, r.start_time, r.end_time, r.pattern) for r in kept}


def test_suppression_equals_greedy(spark, sf):
    events = q_events.found(spark, sf)
    got = {(r.vehicle_id, r.start_time, r.end_time, r.pattern) for r in detection.suppress(events, q_events.SCALED).collect()}
    assert got == greedy(events.collect(), q_events.SCALED.iou)


def brute_dbscan(points, eps_km, least):
    import math

    def km(p, q):
        a = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 12742 * math.atan2(math.sqrt(a), math.sqrt(1 - a))

    near = {p[0]: [q[0] for q in points if km(p, q) <= eps_km] for p in points}
    core = {k for k, v in near.items() if len(v) >= least}
    label, n = {}, 0
    for k in sorted(core):
        if k not in label:
            wait = [k]
            label[k] = n
            while wait:
                for j in near[wait.pop()]:
                    if j in core and j not in label:
                        label[j] = n
                        wait.append(j)
            n += 1
    return {p[0]: label.get(p[0], min([label[j] for j in near[p[0]] if j in core], default=-1)) for p in points}


def test_dbscan_equals_brute_force(spark):
    rng = random.Random(3)
    points = [(k, 40 + rng.choice([0, 0.01, 0.02]) + rng.gauss(0, 0.0006), -74 + rng.choice([0, 0.01]) + rng.gauss(0, 0.0006)) for k in range(220)]
    df = spark.createDataFrame([("V", *p) for p in points], "vehicle_id string, point_id long, latitude double, longitude double")
    got = {r.point_id: r.cluster for r in hotspots.dbscan(df, Clustering(eps_m=60, min_samples=5)).collect()}
    assert got == brute_dbscan(points, 0.06, 5)


def test_threshold_guards(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1)], "score double, y int")
    assert metrics.threshold_at_fpr(df).count() == 0
    assert metrics.average_precision(df).first().pr_auc == 0.0
    assert metrics.threshold_nearest_fpr(df).first().threshold == 0.5


def test_calibration_bins(spark):
    df = spark.createDataFrame([(0.1, 0)] * 5 + [(0.9, 1)] * 5, "score double, y int")
    assert metrics.calibration_error(df, 2).first().ece < 0.2


def test_leak_is_an_error(spark):
    df = spark.createDataFrame([("V", T0, T0 + dt.timedelta(hours=2), True), ("V", T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=3), False)], "vehicle_id string, start_time timestamp, end_time timestamp, is_train boolean")
    with pytest.raises(ValueError):
        splits.check_no_leak(df)


def test_no_events_without_segments(spark):
    t = signal.derive(telemetry(spark, [50.0] * 30, speed=[60.0] * 30))
    assert detection.detect(t, Detection()).count() == 0


class _Asked(Exception):
    pass


@pytest.mark.parametrize("name", ["m3", "m4", "m6", "m7", "m11", "m29"])
def test_queries_fit_in_full_size(spark, monkeypatch, name):
    events = spark.createDataFrame([(k, "short", k % 2, True, 0.5) for k in range(60)], "event_key long, pattern string, y int, is_train boolean, drop_gal double")
    asked = {}

    def note(kind):
        def stop(*args, **kwargs):
            asked[kind] = (args, kwargs)
            raise _Asked
        return stop

    monkeypatch.setattr(q_models, "_set", lambda spark, d: events)
    monkeypatch.setattr(q_events, "scored", lambda spark, d: events)
    for module, kind in ((models, "train_all"), (models, "calibrate"), (models, "isolation_scores"), (metrics, "bootstrap")):
        monkeypatch.setattr(module, kind, note(kind))
    query = next(q for k, q in {**q_models.QUERIES, **q_events.QUERIES}.items() if k.split("_")[0] == name)
    with pytest.raises(_Asked):
        query(spark, "")
    (kind, (args, kwargs)), = asked.items()
    if kind == "train_all":
        assert args[4:6] == (5, False)
    elif kind == "calibrate":
        assert args[2] == 5
    elif kind == "isolation_scores":
        assert kwargs["trees"] == 200
    else:
        assert args[2] == 1000


def test_centroids_are_added_up_in_order(spark):
    """Large and small values, dealt out by their size: the mean is that of the sum in the order of time, to the last bit."""
    values = [1e16, 1.0, 3.0, -1e16, 1.0, None, 7.0, 1e16, 1.0, -1e16, 0.1]
    rows = spark.createDataFrame([("v", k % 1, k, x, None if x is None else x / 3) for k, x in enumerate(values)], "vehicle_id string, cluster_id int, event_id long, latitude double, longitude double")
    total = [0.0, 0.0]
    for x in values:
        if x is not None:
            total = [total[0] + x, total[1] + x / 3]
    for n, c in ((1, "event_id"), (4, "latitude"), (11, "longitude")):
        got = hotspots.ordered_centroids(rows.repartition(n, c), ["vehicle_id", "cluster_id"], ["event_id"]).first()
        assert (got.c_lat, got.c_lon) == (total[0] / 10, total[1] / 10)
    none = rows.where("latitude is null")
    assert hotspots.ordered_centroids(none, ["vehicle_id", "cluster_id"], ["event_id"]).first().c_lat is None
