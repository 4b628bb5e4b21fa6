"""Queries of segmentation, detection, joins, features, splits and event reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankwatch.operators import detection, features, hotspots, intervals, metrics, reports, segments, signal, splits
from tankwatch.params import Clustering
from tankwatch.plans.q_basic import DER, hav, r6
from tankwatch.plans.telemetry import SCALED, TEL, telemetry

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: r6(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return put


SEG = f"""{TEL}, {DER},
    pv AS (SELECT *, coalesce(lag(stationary) OVER w, false) AS ps, coalesce(lag(stationary_on) OVER w, false) AS pon, coalesce(lag(ign_off) OVER w, false) AS poff FROM der WINDOW w AS (PARTITION BY vehicle_id ORDER BY timestamp)),
    sf AS (SELECT *, CAST(stationary AND coalesce(NOT ps OR (pon AND dt_s > 86400) OR (poff AND dt_s > 172800) OR (ps AND ign_off <> poff), false) AS INT) AS st FROM pv),
    placed AS (SELECT *, CASE WHEN stationary THEN CAST(sum(st) OVER (PARTITION BY vehicle_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS seg_id FROM sf),
    segs AS (SELECT vehicle_id, seg_id, min(timestamp) AS start_time, max(timestamp) AS end_time, avg(CAST(ign_off AS INT)) > 0.5 AS is_ign_off, epoch_us(max(timestamp) - min(timestamp)) / 6e7 AS duration_min
        FROM placed WHERE seg_id IS NOT NULL GROUP BY vehicle_id, seg_id HAVING epoch_us(max(timestamp) - min(timestamp)) / 6e7 >= 60)"""
THR = """bs AS (SELECT vehicle_id, 'stationary_on' AS state, dfuel FROM placed WHERE stationary_on UNION ALL SELECT vehicle_id, 'ign_off', dfuel FROM placed WHERE ign_off),
    bm AS (SELECT vehicle_id, state, median(dfuel) AS med FROM bs WHERE dfuel IS NOT NULL GROUP BY vehicle_id, state),
    sg AS (SELECT vehicle_id, state, 1.4826 * median(abs(dfuel - med)) AS sigma FROM bs JOIN bm USING (vehicle_id, state) WHERE dfuel IS NOT NULL GROUP BY vehicle_id, state),
    thr AS (SELECT v.vehicle_id, s.state, greatest(0.5 * coalesce(sigma, 0), s.step) AS step_gal, greatest(0.5 * coalesce(sigma, 0), s.cum) AS cum_gal
        FROM (SELECT DISTINCT vehicle_id FROM placed) v CROSS JOIN (VALUES ('stationary_on', 0.5::DOUBLE, 1.0::DOUBLE), ('ign_off', 0.3::DOUBLE, 0.8::DOUBLE)) s(state, step, cum) LEFT JOIN sg ON sg.vehicle_id = v.vehicle_id AND sg.state = s.state)"""
EV = f"""{SEG}, {THR},
    idx AS (SELECT p.vehicle_id, p.seg_id, p.timestamp, p.dt_s, CASE WHEN dfuel < -0.10 THEN dfuel END AS d, row_number() OVER (PARTITION BY p.vehicle_id, p.seg_id ORDER BY p.timestamp) AS i FROM placed p WHERE p.seg_id IS NOT NULL),
    st AS (SELECT s.vehicle_id, s.seg_id, t.state, step_gal, cum_gal FROM segs s JOIN thr t ON t.vehicle_id = s.vehicle_id AND t.state = CASE WHEN is_ign_off THEN 'ign_off' ELSE 'stationary_on' END),
    win AS (SELECT a.vehicle_id, a.seg_id, st.state, a.i, b.i AS j, any_value(a.timestamp) AS start_time, any_value(b.timestamp) AS end_time, any_value(step_gal) AS step_gal, any_value(cum_gal) AS cum_gal,
            round(-sum(c.d), 9) AS drop_gal, -min(c.d) AS min_step_gal, count(c.d) AS n_negative_steps, median(c.dt_s) FILTER (c.i > a.i) AS median_step, any_value(epoch_us(b.timestamp - a.timestamp) / 6e7) AS duration_min
        FROM idx a JOIN st USING (vehicle_id, seg_id) JOIN idx b ON b.vehicle_id = a.vehicle_id AND b.seg_id = a.seg_id AND b.i > a.i JOIN idx c ON c.vehicle_id = a.vehicle_id AND c.seg_id = a.seg_id AND c.i BETWEEN a.i AND b.i
        GROUP BY a.vehicle_id, a.seg_id, st.state, a.i, b.i HAVING count(c.d) > 0),
    pat(pattern_no, pattern, pstate, lo, hi, pts, mdt, steps) AS (VALUES (0, 'short_stationary', 'stationary_on', 60, 1440, 0, 0, 2), (1, 'extended_stationary', 'stationary_on', 2880, NULL, 0, 0, 1), (2, 'postjourney', 'ign_off', 60, NULL, 2, 60, 1)),
    cand AS (SELECT *, i AS start_idx, j AS end_idx FROM win JOIN pat ON pstate = state WHERE duration_min >= lo AND (hi IS NULL OR duration_min <= hi)
        AND CASE WHEN state = 'ign_off' THEN drop_gal >= cum_gal AND j - i + 1 >= pts AND median_step >= mdt ELSE (drop_gal >= cum_gal OR min_step_gal >= step_gal) AND n_negative_steps >= steps END),
    ev AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, start_time, end_time, drop_gal ORDER BY seg_id, pattern_no, i, j) AS k FROM cand) WHERE k = 1)"""


def placed(spark, d) -> DataFrame:
    return segments.with_segment(signal.derive(telemetry(spark, d), SCALED), SCALED)


def candidates(spark, d) -> DataFrame:
    t = placed(spark, d)
    return detection.scan(t, detection.noise_thresholds(t, SCALED), SCALED)


def found(spark, d) -> DataFrame:
    """Events of all patterns before suppression, as a stored table that the queries below share in their plans."""
    return intervals.keyed(detection._stored(detection.distinct_events(candidates(spark, d))))


def points(events: DataFrame, t: DataFrame) -> DataFrame:
    return intervals.event_points(events, t, ["dt_s", "dfuel", "speed_kmh", "ignition", "latitude", "longitude", "total_fuel_gal", "stationary_drain"])


@query("d1_segments", f"WITH {SEG} SELECT vehicle_id, seg_id, start_time, end_time, is_ign_off, round(duration_min, 6) AS duration_min FROM segs")
def d1(spark, d):
    return segments.segments(placed(spark, d), SCALED)


@query("d2_thresholds", f"WITH {SEG}, {THR} SELECT vehicle_id, state, round(step_gal, 6) AS step_gal, round(cum_gal, 6) AS cum_gal FROM thr")
def d2(spark, d):
    return detection.noise_thresholds(placed(spark, d), SCALED)


@query("d3_threshold_lookup", f"""WITH {SEG}, {THR} SELECT vehicle_id, seg_id, round(coalesce(step_gal, f1), 6) AS step_gal, round(coalesce(cum_gal, f2), 6) AS cum_gal FROM (
    SELECT s.vehicle_id, seg_id, CASE WHEN is_ign_off THEN 'ign_off' ELSE 'stationary_on' END AS state, CASE WHEN is_ign_off THEN 0.3 ELSE 0.5 END AS f1, CASE WHEN is_ign_off THEN 0.8 ELSE 1.0 END AS f2 FROM segs s) x
    LEFT JOIN (SELECT * FROM thr WHERE CAST(vehicle_id AS INT) % 3 <> 0) USING (vehicle_id, state)""")
def d3(spark, d):
    t = placed(spark, d)
    seg = segments.segments(t, SCALED).withColumn("state", F.when(F.col("is_ign_off"), "ign_off").otherwise("stationary_on"))
    return detection.with_thresholds(seg, detection.noise_thresholds(t, SCALED).where(F.col("vehicle_id").cast("int") % 3 != 0), SCALED).select("vehicle_id", "seg_id", "step_gal", "cum_gal")


@query("d4_envelope", f"""WITH {SEG}, {THR} SELECT b.vehicle_id, b.state, count(dfuel) AS n_samples, round(coalesce(any_value(sigma), 0), 6) AS sigma_mad, round(quantile_cont(dfuel, 0.01), 6) AS q01, round(quantile_cont(dfuel, 0.05), 6) AS q05, round(quantile_cont(dfuel, 0.95), 6) AS q95, round(quantile_cont(dfuel, 0.99), 6) AS q99
    FROM bs b LEFT JOIN sg USING (vehicle_id, state) GROUP BY b.vehicle_id, b.state""")
def d4(spark, d):
    return detection.noise_envelope(placed(spark, d))


_EVENT = "vehicle_id, start_time, end_time, round(duration_min, 6) AS duration_min, round(drop_gal, 6) AS drop_gal, round(min_step_gal, 6) AS min_step_gal, pattern, n_negative_steps"
_COLS = ["vehicle_id", "start_time", "end_time", "duration_min", "drop_gal", "min_step_gal", "pattern", "n_negative_steps"]


@query("d5_scan", f"WITH {EV} SELECT {_EVENT} FROM cand")
def d5(spark, d):
    return candidates(spark, d).select(*_COLS)


@query("v12_distinct_events", f"WITH {EV} SELECT {_EVENT} FROM ev")
def v12(spark, d):
    return found(spark, d).select(*_COLS)


@query("v13_plausible", f"WITH {EV} SELECT {_EVENT} FROM ev WHERE drop_gal / greatest(duration_min, 0.001) <= 0.05 AND min_step_gal <= 60")
def v13(spark, d):
    from dataclasses import replace

    return detection.plausible(found(spark, d), replace(SCALED, max_rate=0.05, max_step=60)).select(*_COLS)


@query("v14_pattern_predicates", f"WITH {EV} SELECT vehicle_id, start_time, end_time, pattern FROM ev WHERE duration_min BETWEEN 60 AND 1440 AND (drop_gal >= 30 OR min_step_gal >= 20)")
def v14(spark, d):
    return found(spark, d).where(detection.valid_event(SCALED.patterns[0], F.lit(20.0), F.lit(30.0))).select("vehicle_id", "start_time", "end_time", "pattern")


@query("v15_patterns_by_state", f"WITH {SEG} SELECT vehicle_id, seg_id, pattern FROM segs JOIN (VALUES ('short_stationary', false), ('extended_stationary', false), ('postjourney', true)) p(pattern, off) ON off = is_ign_off")
def v15(spark, d):
    seg = segments.segments(placed(spark, d), SCALED).withColumn("state", F.when(F.col("is_ign_off"), "ign_off").otherwise("stationary_on"))
    return seg.join(F.broadcast(detection.pattern_table(spark, SCALED)), "state").select("vehicle_id", "seg_id", "pattern")


@query("d6_detect")
def d6(spark, d):
    return detection.detect(signal.derive(telemetry(spark, d), SCALED), SCALED).select(*_COLS)


@query("d8_suppress")
def d8(spark, d):
    return detection.suppress(found(spark, d), SCALED).select(*_COLS)


_IOU = "coalesce(greatest(0, epoch_us(least(a.end_time, b.end_time) - greatest(a.start_time, b.start_time))) / nullif(epoch_us(a.end_time - a.start_time) + epoch_us(b.end_time - b.start_time) - greatest(0, epoch_us(least(a.end_time, b.end_time) - greatest(a.start_time, b.start_time))), 0), 0)"


def _pairs(spark, d):
    e = found(spark, d).select("vehicle_id", "seg_id", "start_time", "end_time", "start_idx", "end_idx")
    a, b = e.alias("a"), e.alias("b")
    after = (F.col("a.start_idx") < F.col("b.start_idx")) | ((F.col("a.start_idx") == F.col("b.start_idx")) & (F.col("a.end_idx") < F.col("b.end_idx")))
    meet = (F.col("a.vehicle_id") == F.col("b.vehicle_id")) & (F.col("a.seg_id") == F.col("b.seg_id")) & after & (F.col("a.start_time") <= F.col("b.end_time")) & (F.col("b.start_time") <= F.col("a.end_time"))
    return a.join(b, meet).select("a.vehicle_id", F.col("a.start_time").alias("s1"), F.col("a.end_time").alias("e1"), F.col("b.start_time").alias("s2"), F.col("b.end_time").alias("e2"))


_MEET = f"WITH {EV} SELECT a.vehicle_id, a.start_time AS s1, a.end_time AS e1, b.start_time AS s2, b.end_time AS e2{{x}} FROM ev a JOIN ev b ON a.vehicle_id = b.vehicle_id AND a.seg_id = b.seg_id AND (a.i < b.i OR (a.i = b.i AND a.j < b.j)) AND a.start_time <= b.end_time AND b.start_time <= a.end_time"


@query("d7_iou", _MEET.format(x=f", round({_IOU}, 6) AS iou"))
def d7(spark, d):
    return _pairs(spark, d).withColumn("iou", detection.iou(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")))


@query("j8_overlaps", _MEET.format(x=""))
def j8(spark, d):
    return _pairs(spark, d)


_PTS = "JOIN der t ON t.vehicle_id = e.vehicle_id AND t.timestamp >= e.start_time AND t.timestamp <= e.end_time"
_G = "e.vehicle_id, e.start_time, e.end_time, e.pattern"


@query("j6_window_join", f"WITH {EV} SELECT {_G}, t.event_id FROM ev e {_PTS}")
def j6(spark, d):
    e = found(spark, d)
    return intervals.event_points(e, telemetry(spark, d), ["event_id"]).join(e.select("event_key", "start_time", "end_time", "pattern"), "event_key").select("vehicle_id", "start_time", "end_time", "pattern", "event_id")


@query("j7_lookback_join", f"WITH {EV} SELECT {_G}, t.event_id FROM ev e JOIN tel t ON t.vehicle_id = e.vehicle_id AND t.timestamp >= e.start_time - INTERVAL 48 HOUR AND t.timestamp < e.start_time")
def j7(spark, d):
    e = found(spark, d)
    return intervals.lookback_points(e, telemetry(spark, d), 48, ["event_id"]).join(e.select("event_key", "start_time", "end_time", "pattern"), "event_key").select("vehicle_id", "start_time", "end_time", "pattern", "event_id")


KEYS = ["vehicle_id", "start_time", "end_time", "pattern"]


@query("d9_labels", f"WITH {EV} SELECT {_G}, max(t.stationary_drain) AS y FROM ev e {_PTS} GROUP BY {_G}")
def d9(spark, d):
    return features.labels(found(spark, d), telemetry(spark, d)).select(*KEYS, "y")


@query("f1_statistics", f"""WITH {EV} SELECT {_G}, count(*) AS n_points, round(median(dt_s), 6) AS median_dt_s, any_value(e.n_negative_steps) AS n_negative_steps, round(-avg(CASE WHEN dfuel < -0.10 THEN dfuel END), 6) AS mean_step_neg,
    round(quantile_cont(abs(dfuel), 0.95), 6) AS p95_abs_dfuel, round(median(speed_kmh), 6) AS median_speed, round(avg(CAST(ignition AS INT)), 6) AS pct_ign_on FROM ev e {_PTS.replace('t.timestamp >=', 't.timestamp >=')} GROUP BY {_G}""".replace("median(dt_s)", "median(t.dt_s)"))
def f1(spark, d):
    e, t = found(spark, d), placed(spark, d)
    return features.statistics(e, points(e, t)).select(*KEYS, "n_points", "median_dt_s", "n_negative_steps", "mean_step_neg", "p95_abs_dfuel", "median_speed", "pct_ign_on")


@query("f2_durations", f"WITH {EV} SELECT {_G}, round(duration_min / 60, 6) AS duration_hours, round(ln(1 + duration_min), 6) AS log_duration FROM ev e")
def f2(spark, d):
    return features.durations(found(spark, d)).select(*KEYS, "duration_hours", "log_duration")


_MID = "make_timestamp((epoch_us(start_time) + epoch_us(end_time)) // 2)"
_HR = f"(hour({_MID}) + minute({_MID}) / 60)"


@query("f3_clock", f"""WITH {EV} SELECT {_G}, round(sin({_HR} * 2 * pi() / 24), 6) AS hour_sin, round(cos({_HR} * 2 * pi() / 24), 6) AS hour_cos, isodow({_MID}) - 1 AS weekday, CAST(isodow({_MID}) >= 6 AS INT) AS is_weekend,
    CAST(hour({_MID}) >= 22 OR hour({_MID}) <= 5 AS INT) AS is_night FROM ev e""")
def f3(spark, d):
    return features.clock(found(spark, d)).select(*KEYS, "hour_sin", "hour_cos", "weekday", "is_weekend", "is_night")


_SP = """round(coalesce(epoch_us(start_time - lag(start_time) OVER (PARTITION BY vehicle_id ORDER BY start_time, end_time, pattern)) / 3.6e9, -1), 6) AS time_since_last_event_hours,
    CAST(row_number() OVER (PARTITION BY vehicle_id, CAST(start_time AS DATE) ORDER BY start_time, end_time, pattern) = 1 AS INT) AS is_first_event_of_day"""


@query("f4_spacing", f"WITH {EV} SELECT {_G}, {_SP} FROM ev e")
def f4(spark, d):
    return features.spacing(found(spark, d)).select(*KEYS, "time_since_last_event_hours", "is_first_event_of_day")


@query("f5_temporal", f"WITH {EV} SELECT {_G}, round(ln(1 + duration_min), 6) AS log_duration, CAST(isodow({_MID}) >= 6 AS INT) AS is_weekend, {_SP} FROM ev e")
def f5(spark, d):
    return features.temporal(found(spark, d)).select(*KEYS, "log_duration", "is_weekend", "time_since_last_event_hours", "is_first_event_of_day")


@query("f6_location", f"""WITH {EV}, c AS (SELECT {_G}, median(latitude) AS lat_c, median(longitude) AS lon_c, coalesce(stddev_samp(latitude), 0) AS lat_std, coalesce(stddev_samp(longitude), 0) AS lon_std FROM ev e {_PTS} GROUP BY {_G})
    SELECT {_G}, round(any_value(lat_c), 6) AS lat_c, round(any_value(lon_c), 6) AS lon_c, round(any_value(lat_std), 6) AS lat_std, round(any_value(lon_std), 6) AS lon_std, round(max({hav('lat_c', 'lon_c', 'latitude', 'longitude')}), 6) AS coord_range_km FROM c e {_PTS} GROUP BY {_G}""")
def f6(spark, d):
    e, t = found(spark, d), placed(spark, d)
    return features.location(e, points(e, t)).select(*KEYS, "lat_c", "lon_c", "lat_std", "lon_std", "coord_range_km")


@query("f7_trip", f"""WITH {EV}, s AS (SELECT {_G}, {hav('lag(latitude) OVER w', 'lag(longitude) OVER w', 'latitude', 'longitude')} AS km FROM ev e {_PTS} WINDOW w AS (PARTITION BY {_G} ORDER BY t.timestamp))
    SELECT {_G}, round(coalesce(sum(km), 0), 6) AS km FROM s e GROUP BY {_G}""")
def f7(spark, d):
    e, t = found(spark, d), telemetry(spark, d)
    return intervals.trip_distance(intervals.event_points(e, t, ["latitude", "longitude"])).join(e, "event_key").select(*KEYS, "km")


_LB = "JOIN tel t ON t.vehicle_id = e.vehicle_id AND t.timestamp >= e.start_time - INTERVAL 96 HOUR AND t.timestamp < e.start_time"


@query("f10_pre_event", f"""WITH {EV}, p AS (SELECT {_G}, count(*) AS n, avg(speed_kmh) AS v, avg(CAST(speed_kmh > 5 AS INT)) AS m, arg_max(total_fuel_gal, t.timestamp) - arg_min(total_fuel_gal, t.timestamp) AS f FROM ev e {_LB} GROUP BY {_G})
    SELECT {_G}, CASE WHEN n >= 5 THEN round(v, 6) ELSE 0 END AS pre_event_avg_speed, CASE WHEN n >= 5 THEN round(m, 6) ELSE 0 END AS pre_event_moving_pct, CASE WHEN n >= 5 THEN round(f, 6) ELSE 0 END AS pre_event_fuel_change FROM ev e LEFT JOIN p USING (vehicle_id, start_time, end_time, pattern)""".replace("SELECT e.vehicle_id, e.start_time, e.end_time, e.pattern, CASE", "SELECT vehicle_id, start_time, end_time, pattern, CASE"))
def f10(spark, d):
    return features.pre_event(found(spark, d), telemetry(spark, d), 96).select(*KEYS, "pre_event_avg_speed", "pre_event_moving_pct", "pre_event_fuel_change")


@query("f11_variability", f"WITH {EV} SELECT {_G}, round(coalesce(stddev_samp(speed_kmh), 0), 6) AS speed_std, round(coalesce(max(speed_kmh), 0), 6) AS speed_max, round(coalesce(var_samp(speed_kmh), 0), 6) AS movement_variability FROM ev e {_PTS} GROUP BY {_G}")
def f11(spark, d):
    e, t = found(spark, d), placed(spark, d)
    return features.variability(e, points(e, t)).select(*KEYS, "speed_std", "speed_max", "movement_variability")


SPLIT = """ranked AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY timestamp) - 1 AS k, count(*) OVER (PARTITION BY vehicle_id) AS n FROM tel),
    cuts AS (SELECT vehicle_id, coalesce(max(CASE WHEN k = greatest(1, least(CAST(floor(n * 0.8::DOUBLE) AS BIGINT), n - 1)) THEN timestamp END), max(timestamp)) AS cut FROM ranked GROUP BY vehicle_id)"""
TRAIN = f"mapped AS (SELECT e.*, {_MID.replace('start_time', 'e.start_time').replace('end_time', 'e.end_time')} AS mid_time, coalesce({_MID.replace('start_time', 'e.start_time').replace('end_time', 'e.end_time')} <= cut, false) AS is_train FROM ev e LEFT JOIN cuts USING (vehicle_id))"


def mapped(spark, d) -> DataFrame:
    return splits.map_events(found(spark, d), splits.rank_split(telemetry(spark, d)))


@query("k1_rank_split", f"WITH {TEL}, {SPLIT} SELECT event_id, timestamp <= cut AS is_train FROM tel JOIN cuts USING (vehicle_id)")
def k1(spark, d):
    return splits.rank_split(telemetry(spark, d)).select("event_id", "is_train")


@query("k2_quantile_split", f"WITH {TEL}, q AS (SELECT vehicle_id, quantile_cont(CAST(epoch_us(timestamp) AS DOUBLE), 0.8) AS cut FROM tel GROUP BY vehicle_id) SELECT event_id, epoch_us(timestamp) <= cut AS is_train FROM tel JOIN q USING (vehicle_id)")
def k2(spark, d):
    return splits.quantile_split(telemetry(spark, d)).select("event_id", "is_train")


@query("k3_map_events", f"WITH {EV}, {SPLIT}, {TRAIN} SELECT {_G}, mid_time, is_train FROM mapped e")
def k3(spark, d):
    return mapped(spark, d).select(*KEYS, "mid_time", "is_train")


@query("k4_leaks", f"WITH {EV}, {SPLIT}, {TRAIN} SELECT a.vehicle_id, a.start_time AS train_start, a.end_time AS train_end, b.start_time AS test_start, b.end_time AS test_end FROM mapped a JOIN mapped b ON a.vehicle_id = b.vehicle_id AND a.is_train AND NOT b.is_train AND a.start_time <= b.end_time AND b.start_time <= a.end_time")
def k4(spark, d):
    return splits.leaks(mapped(spark, d))


@query("k5_leak_report", f"""WITH {EV}, {SPLIT}, {TRAIN}, r AS (SELECT vehicle_id, count(*) FILTER (is_train) AS n_train, count(*) FILTER (NOT is_train) AS n_test, max(end_time) FILTER (is_train) AS max_train_end, min(start_time) FILTER (NOT is_train) AS min_test_start FROM mapped GROUP BY vehicle_id)
    SELECT *, coalesce(max_train_end > min_test_start, false) AS has_overlap, round((epoch_us(min_test_start) - epoch_us(max_train_end)) / 3.6e9, 6) AS gap_hours FROM r""")
def k5(spark, d):
    return splits.leak_report(mapped(spark, d))


LAB = f"lab AS (SELECT {_G}, max(t.stationary_drain) AS y FROM ev e {_PTS} GROUP BY {_G})"


@query("k6_balance", f"""WITH {EV}, {SPLIT}, {TRAIN}, {LAB}, r AS (SELECT count(*) FILTER (is_train) AS n_train, count(*) FILTER (NOT is_train) AS n_test, count(*) FILTER (is_train AND y = 1) AS train_positives, count(*) FILTER (NOT is_train AND y = 1) AS test_positives FROM mapped JOIN lab USING (vehicle_id, start_time, end_time, pattern))
    SELECT *, round(coalesce(train_positives / nullif(n_train, 0), 0), 6) AS train_rate, round(coalesce(test_positives / nullif(n_test, 0), 0), 6) AS test_rate, train_positives >= 10 AND test_positives >= 5 AND coalesce(train_positives / nullif(n_train, 0), 0) >= 0.01 AND coalesce(test_positives / nullif(n_test, 0), 0) >= 0.01 AS balanced FROM r""")
def k6(spark, d):
    return splits.balance(features.labels(mapped(spark, d), telemetry(spark, d)))


@query("k8_test_side", f"WITH {EV}, {SPLIT}, {TRAIN} SELECT {_G} FROM mapped e WHERE NOT is_train")
def k8(spark, d):
    return mapped(spark, d).where("not is_train").select(*KEYS)


_NRM = ["drop_gal", "duration_min"]
NORM = "norms AS (SELECT vehicle_id, " + ", ".join(f"avg({c}) AS {c}_mean, CASE WHEN stddev_samp({c}) > 1e-9 THEN stddev_samp({c}) ELSE 1e-6 END AS {c}_std" for c in _NRM) + " FROM mapped WHERE is_train GROUP BY vehicle_id)"


@query("f12_norms", f"WITH {EV}, {SPLIT}, {TRAIN}, {NORM} SELECT vehicle_id, {', '.join(f'round({c}_{k}, 6) AS {c}_{k}' for c in _NRM for k in ('mean', 'std'))} FROM norms")
def f12(spark, d):
    return features.fit_norms(mapped(spark, d), _NRM)


@query("f13_zscores", f"WITH {EV}, {SPLIT}, {TRAIN}, {NORM} SELECT {_G}, {', '.join(f'round(coalesce(({c} - {c}_mean) / {c}_std, 0), 3) AS {c}_vehicle_zscore' for c in _NRM)} FROM mapped e LEFT JOIN norms USING (vehicle_id)")
def f13(spark, d):
    e = mapped(spark, d)
    out = features.zscores(e, features.fit_norms(e, _NRM), _NRM)
    return out.select(*KEYS, *[F.round(f"{c}_vehicle_zscore", 3).alias(f"{c}_vehicle_zscore") for c in _NRM])


_FUEL = "fuel AS (SELECT vehicle_id, avg(total_fuel_gal) AS avg_fuel, max(total_fuel_gal) AS max_fuel FROM tel GROUP BY vehicle_id)"


@query("f14_relative_drop", f"WITH {EV}, {_FUEL} SELECT {_G}, round(drop_gal / (avg_fuel + 1e-6), 6) AS drop_vs_avg, round(drop_gal / (max_fuel + 1e-6), 6) AS drop_vs_capacity FROM ev e JOIN fuel USING (vehicle_id)")
def f14(spark, d):
    return features.relative_drop(found(spark, d), telemetry(spark, d)).select(*KEYS, "drop_vs_avg", "drop_vs_capacity")


@query("j3_vehicle_fuel", f"WITH {TEL}, {_FUEL} SELECT vehicle_id, round(avg_fuel, 6) AS avg_fuel, round(max_fuel, 6) AS max_fuel FROM fuel")
def j3(spark, d):
    return features.vehicle_fuel(telemetry(spark, d))


@query("f17_rate", f"WITH {EV} SELECT {_G}, round(drop_gal / (duration_min + 1e-6), 6) AS rate_gpm FROM ev e")
def f17(spark, d):
    return features.with_rate(found(spark, d)).select(*KEYS, "rate_gpm")


@query("f15_feature_pipeline")
def f15(spark, d):
    e, t = mapped(spark, d), placed(spark, d)
    return features.FeatureBuilder(hours=96).fit(e, t).transform(e, t)


@query("f16_matrix")
def f16(spark, d):
    e, t = mapped(spark, d), placed(spark, d)
    return features.matrix(features.labels(features.FeatureBuilder(hours=96).base(e, t), t))


SMALL = Clustering(eps_m=40.0, min_samples=4)


def _points(spark, d):
    return hotspots.stationary_points(placed(spark, d))


@query("c1_dbscan")
def c1(spark, d):
    return hotspots.dbscan(_points(spark, d), SMALL)


@query("c2_fit_hotspots")
def c2(spark, d):
    return hotspots.fit_hotspots(_points(spark, d), SMALL)[1].select("vehicle_id", "timestamp", "cluster_id")


CEN = "cen AS (SELECT vehicle_id, CAST(event_id % 7 AS INT) AS cluster_id, avg(latitude) AS c_lat, avg(longitude) AS c_lon FROM tel GROUP BY ALL)"
_NEAR = hav("latitude", "longitude", "c_lat", "c_lon")


@query("j10_nearest_centroid", f"WITH {SEG}, {CEN}, n AS (SELECT p.event_id, cluster_id, {_NEAR} AS km FROM placed p JOIN cen USING (vehicle_id) WHERE stationary), b AS (SELECT event_id, arg_min(cluster_id, km) AS cluster_id FROM n WHERE km <= 0.02 GROUP BY event_id) SELECT event_id, coalesce(b.cluster_id, -1) AS cluster_id FROM placed LEFT JOIN b USING (event_id) WHERE stationary")
def j10(spark, d):
    c = hotspots.ordered_centroids(telemetry(spark, d).withColumn("cluster_id", (F.col("event_id") % 7).cast("int")), ["vehicle_id", "cluster_id"], ["timestamp", "event_id"])
    return hotspots.nearest(_points(spark, d), c, Clustering(eps_m=20.0)).select("event_id", "cluster_id")


def _clustered(spark, d):
    """Telemetry points with a cluster from a fixed rule, so that SQL can follow."""
    t = placed(spark, d).withColumn("cluster_id", F.when(F.col("event_id") % 4 == 3, -1).otherwise((F.col("event_id") % 4).cast("int")))
    e = found(spark, d)
    return hotspots.event_clusters(intervals.event_points(e, t, ["cluster_id"]), e), t


CLU = f"""pc AS (SELECT *, CASE WHEN event_id % 4 = 3 THEN -1 ELSE CAST(event_id % 4 AS INT) END AS cluster_id FROM der), cc AS (SELECT {_G}, cluster_id, count(*) AS c FROM ev e {_PTS.replace('der t', 'pc t')} GROUP BY ALL),
    clu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, start_time, end_time, pattern ORDER BY c DESC, cluster_id) AS k FROM cc) WHERE k = 1), evc AS (SELECT ev.*, clu.cluster_id, clu.c FROM ev JOIN clu USING (vehicle_id, start_time, end_time, pattern))"""


@query("c5_event_cluster", f"WITH {EV}, {CLU} SELECT {_G}, cluster_id, c AS cluster_points, CAST(cluster_id >= 0 AS INT) AS is_hotspot FROM evc e")
def c5(spark, d):
    return _clustered(spark, d)[0].select(*KEYS, "cluster_id", "cluster_points", "is_hotspot")


@query("c6_hotspot_statistics", f"""WITH {EV}, {CLU}, s AS (SELECT vehicle_id, cluster_id, count(*) AS n_events, round(sum(drop_gal), 6) AS total_fuel_drop, round(avg(drop_gal), 6) AS mean_fuel_drop, round(max(drop_gal), 6) AS max_fuel_drop, round(avg(duration_min), 6) AS mean_duration FROM evc WHERE cluster_id >= 0 GROUP BY ALL),
    w AS (SELECT vehicle_id, cluster_id, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM pc GROUP BY ALL) SELECT s.*, latitude, longitude FROM s LEFT JOIN w USING (vehicle_id, cluster_id)""")
def c6(spark, d):
    return hotspots.hotspot_statistics(*_clustered(spark, d))


@query("c7_top_clusters", f"WITH {EV}, {CLU} SELECT cluster_id, count(*) AS n_events, count(DISTINCT vehicle_id) AS n_vehicles, round(sum(drop_gal), 6) AS total_drop, round(avg(drop_gal), 6) AS mean_drop FROM evc WHERE cluster_id >= 0 GROUP BY cluster_id ORDER BY total_drop DESC, cluster_id LIMIT 5")
def c7(spark, d):
    return hotspots.top_clusters(_clustered(spark, d)[0]).drop("patterns")


@query("r1_event_summary", f"WITH {EV}, {LAB} SELECT vehicle_id, pattern, count(*) AS event_count, round(avg(drop_gal), 6) AS mean_drop_gal, round(max(drop_gal), 6) AS max_drop_gal, round(median(duration_min), 6) AS median_duration_min, 0 AS hotspot_events, CAST(sum(y) AS BIGINT) AS positive_labels FROM ev JOIN lab USING (vehicle_id, start_time, end_time, pattern) GROUP BY vehicle_id, pattern")
def r1(spark, d):
    return reports.event_summary(features.labels(found(spark, d), telemetry(spark, d)))


@query("j5_label_counts", f"WITH {EV}, {LAB} SELECT vehicle_id, pattern, CAST(sum(y) AS BIGINT) AS positive_labels FROM lab GROUP BY vehicle_id, pattern")
def j5(spark, d):
    return reports.event_summary(features.labels(found(spark, d), telemetry(spark, d))).select("vehicle_id", "pattern", "positive_labels")


@query("r2_top_drops", f"WITH {EV} SELECT {_EVENT} FROM ev ORDER BY drop_gal DESC, vehicle_id, start_time, end_time LIMIT 10")
def r2(spark, d):
    return reports.top(found(spark, d), "drop_gal", 10, ["vehicle_id", "start_time", "end_time"]).select(*_COLS)


@query("r3_pattern_distribution", f"WITH {EV} SELECT pattern, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM ev GROUP BY pattern")
def r3(spark, d):
    return reports.distribution(found(spark, d), "pattern")


@query("r4_shares", f"WITH {EV}, {SPLIT}, {TRAIN}, {LAB} SELECT count(*) AS n, count(*) FILTER (is_train) AS n_train, round(count(*) FILTER (is_train) * 100.0 / count(*), 6) AS pct_train, count(*) FILTER (y = 1) AS n_positive, round(count(*) FILTER (y = 1) * 100.0 / count(*), 6) AS pct_positive FROM mapped JOIN lab USING (vehicle_id, start_time, end_time, pattern)")
def r4(spark, d):
    return reports.shares(features.labels(mapped(spark, d), telemetry(spark, d)), {"train": F.col("is_train"), "positive": F.col("y") == 1})


_PP = ", ".join(f"round(median({c}), 6) AS median_{c}, round(avg({c}), 6) AS mean_{c}, round(stddev_samp({c}), 6) AS std_{c}" for c in ("duration_min", "drop_gal", "n_negative_steps"))


@query("r9_pattern_profile", f"WITH {EV} SELECT pattern, {_PP} FROM ev GROUP BY pattern")
def r9(spark, d):
    return reports.pattern_profile(found(spark, d))


def labelled(spark, d):
    return features.labels(found(spark, d), telemetry(spark, d))


EVL = f"{EV}, {LAB}, evl AS (SELECT ev.*, y FROM ev JOIN lab USING (vehicle_id, start_time, end_time, pattern))"


@query("r10_rate_by_pattern", f"WITH {EVL} SELECT pattern, CAST(sum(y) AS BIGINT) AS positives, count(*) AS n, round_even(avg(y), 3) AS rate FROM evl GROUP BY pattern")
def r10(spark, d):
    return reports.rate_by(labelled(spark, d), "pattern")


@query("r11_top_vehicles", f"WITH {EVL} SELECT vehicle_id, CAST(sum(y) AS BIGINT) AS positives FROM evl GROUP BY vehicle_id ORDER BY positives DESC, vehicle_id LIMIT 3")
def r11(spark, d):
    return reports.top(labelled(spark, d).groupBy("vehicle_id").agg(F.sum("y").alias("positives")), "positives", 3, ["vehicle_id"])


@query("r12_eda_summary", f"WITH {EVL} SELECT count(*) AS n_events, count(DISTINCT vehicle_id) AS n_vehicles, round(sum(drop_gal), 6) AS total_loss, round(avg(y), 6) AS rate FROM evl")
def r12(spark, d):
    return labelled(spark, d).agg(F.count("*").alias("n_events"), F.countDistinct("vehicle_id").alias("n_vehicles"), F.sum("drop_gal").alias("total_loss"), F.avg("y").alias("rate"))


_FEAT = ["drop_gal", "duration_min", "min_step_gal"]
_desc = " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM ev" for c in _FEAT)


@query("r13_describe", f"WITH {EV} {_desc}")
def r13(spark, d):
    from tankwatch.functions.stats import profile

    return profile(found(spark, d), _FEAT)


@query("r14_mann_whitney", f"""WITH {EVL}, g AS (SELECT drop_gal, CAST(sum(y) AS DOUBLE) AS n1, CAST(count(*) AS DOUBLE) AS t FROM evl GROUP BY drop_gal), k AS (SELECT *, sum(t) OVER (ORDER BY drop_gal ROWS UNBOUNDED PRECEDING) - (t - 1) / 2 AS r FROM g),
    s AS (SELECT sum(r * n1) AS r1, sum(n1) AS n1, sum(t) AS n, sum(t*t*t - t) AS ties FROM k), zz AS (SELECT abs(r1 - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))) / sqrt(2.0) AS x FROM s),
    zt AS (SELECT x, 1 / (1 + 0.3275911 * x) AS t FROM zz), pz AS (SELECT t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) AS pv FROM zt)
    SELECT round(r1 - n1 * (n1 + 1) / 2, 6) AS u, round((r1 - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z, n1, n - n1 AS n0, round(pv, 4) AS p FROM s, pz""")
def r14(spark, d):
    return reports.mann_whitney(labelled(spark, d), "drop_gal").withColumn("p", F.round("p", 4))


@query("r15_rate_by_hour", f"WITH {EVL}, h AS (SELECT y, {_HR} AS h FROM evl), m AS (SELECT min(h) AS a, max(h) AS b FROM h) SELECT greatest(0, CAST(ceil((h - a) / ((b - a) / 24)) AS INT) - 1) AS bin, count(*) AS n, round(avg(y), 6) AS rate FROM h, m GROUP BY bin")
def r15(spark, d):
    return reports.equal_bins(features.clock(labelled(spark, d)), "hour_of_day", 24, "y")


_NIGHT = f"(hour({_MID}) >= 22 OR hour({_MID}) <= 5)"


@query("r16_night_day", f"WITH {EVL} SELECT round(avg(y) FILTER ({_NIGHT}), 6) AS night_rate, round(avg(y) FILTER (NOT {_NIGHT}), 6) AS day_rate FROM evl")
def r16(spark, d):
    e = features.clock(labelled(spark, d))
    return e.agg(F.avg(F.when(F.col("is_night") == 1, F.col("y"))).alias("night_rate"), F.avg(F.when(F.col("is_night") == 0, F.col("y"))).alias("day_rate"))


_corr = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho FROM ev" for k, a in enumerate(_FEAT) for b in _FEAT[k + 1 :])


@query("r17_correlations", f"WITH {EV} {_corr}")
def r17(spark, d):
    return reports.correlations(found(spark, d), _FEAT)


_out = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(count(*) FILTER ({c} < a - 3 * (b - a) OR {c} > b + 3 * (b - a)) * 100.0 / count(*), 6) AS outlier_pct FROM ev, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM ev)" for c in _FEAT)


@query("r19_outliers", f"WITH {EV} {_out}")
def r19(spark, d):
    return reports.outlier_share(found(spark, d), _FEAT)


@query("r40_largest_drop", f"WITH {EV} SELECT {_EVENT} FROM ev ORDER BY drop_gal DESC, vehicle_id, start_time, end_time LIMIT 1")
def r40(spark, d):
    return reports.top(found(spark, d), "drop_gal", 1, ["vehicle_id", "start_time", "end_time"]).select(*_COLS)


#: A score and a label for each telemetry row, from its numbers; three models' scores for the comparisons.
SC = "sc AS (SELECT event_id, user_id % 5 AS grp, CAST((((event_id * 7919) % 1000) * 7 + CASE WHEN event_type = 'purchase' THEN 2000 ELSE 0 END) // 10 AS DOUBLE) / 1000 AS score, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events)"


def scored(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    y = (F.col("event_type") == "purchase").cast("int")
    return e.select("event_id", (F.col("user_id") % 5).alias("grp"), (F.floor((F.col("event_id") * 7919 % 1000 * 7 + y * 2000) / 10) / 1000.0).alias("score"), y.alias("y"))


def _cv(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"""cg AS (SELECT {sel}score, sum(y) AS p, count(*) - sum(y) AS n FROM sc GROUP BY ALL),
    cv AS (SELECT {sel}score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER ({part}) AS pos, sum(n) OVER ({part}) AS neg FROM cg WINDOW w AS ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    cr AS (SELECT *, tp / pos AS tpr, fp / neg AS fpr, tp / (tp + fp) AS precision FROM cv),
    co AS (SELECT * EXCLUDE (bf, bt) FROM (SELECT *, lead(fp) OVER w - 2 * fp + coalesce(lag(fp) OVER w, 0) AS bf, lead(tp) OVER w - 2 * tp + coalesce(lag(tp) OVER w, 0) AS bt FROM cr WINDOW w AS ({part} ORDER BY score DESC)) WHERE bf IS NULL OR bf <> 0 OR bt <> 0)"""


@query("m20_curve", f"WITH {SC}, {_cv('')} SELECT score, CAST(p AS BIGINT) AS p, CAST(n AS BIGINT) AS n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(precision, 6) AS precision FROM cr")
def m20(spark, d):
    return metrics.curve(scored(spark, d)).drop("next_p", "next_n")


@query("m16_average_precision", f"WITH {SC}, {_cv('grp')} SELECT grp, round(sum(precision * p / pos), 6) AS pr_auc FROM cr GROUP BY grp")
def m16(spark, d):
    return metrics.average_precision(scored(spark, d), ["grp"])


@query("m17_recall_at_fpr", f"WITH {SC}, {_cv('grp')} SELECT grp, round(tpr, 6) AS recall, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY tpr DESC, score DESC) AS k FROM cr WHERE fpr <= 0.05) WHERE k = 1")
def m17(spark, d):
    return metrics.recall_at_fpr(scored(spark, d), 0.05, ["grp"])


@query("m18_precision_at_recall", f"WITH {SC}, {_cv('grp')} SELECT grp, round(precision, 6) AS precision, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY precision DESC, score DESC) AS k FROM cr WHERE tpr >= 0.8) WHERE k = 1")
def m18(spark, d):
    return metrics.precision_at_recall(scored(spark, d), 0.8, ["grp"])


@query("m19_threshold_at_fpr", f"WITH {SC}, {_cv('grp')} SELECT grp, score AS threshold, round(tpr, 6) AS recall, round(precision, 6) AS precision, round(fpr, 6) AS fpr FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY tpr DESC, score DESC) AS k FROM co WHERE fp <= CASE WHEN neg < 20 THEN 1 ELSE floor(neg * 0.05) END) WHERE k = 1")
def m19(spark, d):
    return metrics.threshold_at_fpr(scored(spark, d), 0.05, by=["grp"])


@query("m12_threshold_nearest_fpr", f"WITH {SC}, {_cv('grp')} SELECT grp, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(fpr - 0.05), score DESC) AS k FROM co) WHERE k = 1")
def m12(spark, d):
    return metrics.threshold_nearest_fpr(scored(spark, d), 0.05, ["grp"])


@query("m21_areas", f"""WITH {SC}, {_cv('grp')}, l AS (SELECT *, coalesce(lag(fpr) OVER w, 0) AS x, coalesce(lag(tpr) OVER w, 0) AS z, coalesce(lag(precision) OVER w, 1) AS q FROM cr WINDOW w AS (PARTITION BY grp ORDER BY score DESC))
    SELECT grp, round(sum((fpr - x) * (tpr + z) / 2), 6) AS roc_auc, round(sum((tpr - z) * (precision + q) / 2), 6) AS pr_auc_trapezoid FROM l GROUP BY grp""")
def m21(spark, d):
    return metrics.areas(scored(spark, d), ["grp"])


REP = """rp AS (SELECT grp, count(*) FILTER (y = 1 AND score >= 0.5) AS tp, count(*) FILTER (y = 0 AND score >= 0.5) AS fp, count(*) FILTER (y = 0 AND score < 0.5) AS tn, count(*) FILTER (y = 1 AND score < 0.5) AS fn FROM sc GROUP BY grp),
    rr AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, (tp + tn) / (tp + tn + fp + fn) AS accuracy, fp / (fp + tn) AS fpr, tn / (fp + tn) AS specificity FROM rp)"""


@query("m22_report", f"WITH {SC}, {REP} SELECT grp, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(accuracy, 6) AS accuracy, round(fpr, 6) AS fpr, round(specificity, 6) AS specificity, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM rr")
def m22(spark, d):
    return metrics.report(scored(spark, d), F.col("score") >= 0.5, ["grp"])


BIN = "bn AS (SELECT grp, " + " + ".join(f"CAST(score >= {k}/10.0::DOUBLE AS INT)" for k in range(1, 10)) + " AS bin, count(*) AS n, avg(score) AS mean_p, avg(y) AS rate FROM sc GROUP BY ALL)"


@query("m26_calibration_bins", f"WITH {SC}, {BIN} SELECT grp, bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM bn")
def m26(spark, d):
    return metrics.calibration_bins(scored(spark, d), 10, ["grp"])


@query("m26_calibration_error", f"WITH {SC}, {BIN} SELECT grp, round(sum(abs(mean_p - rate) * n) / sum(n), 6) AS ece, round(max(abs(mean_p - rate)), 6) AS mce FROM bn GROUP BY grp")
def m26e(spark, d):
    return metrics.calibration_error(scored(spark, d), 10, ["grp"])


@query("m27_top_predictions", f"WITH {SC} SELECT event_id, score, y, CAST(score >= 0.5 AS INT) AS predicted_label FROM sc ORDER BY score DESC, event_id LIMIT 100")
def m27(spark, d):
    return reports.top(scored(spark, d), "score", 100, ["event_id"]).select("event_id", "score", "y", (F.col("score") >= 0.5).cast("int").alias("predicted_label"))


@query("m14_min_max", f"WITH {SC} SELECT event_id, round((score - (SELECT min(score) FROM sc)) / ((SELECT max(score) FROM sc) - (SELECT min(score) FROM sc)), 6) AS score FROM sc")
def m14(spark, d):
    return metrics.min_max(scored(spark, d)).select("event_id", "score")


@query("m29_bootstrap")
def m29(spark, d):
    """Precision, recall and false positive rate at 0.5, with intervals."""
    return metrics.bootstrap(scored(spark, d), metrics.rates(F.col("score") >= 0.5), 1000, key="event_id")


@query("m31_evaluate_at_threshold", f"WITH {SC}, {_cv('grp')} SELECT grp, round(a.pr_auc, 6) AS pr_auc, t.threshold FROM (SELECT grp, sum(precision * p / pos) AS pr_auc FROM cr GROUP BY grp) a JOIN (SELECT grp, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY tpr DESC, score DESC) AS k FROM co WHERE fp <= CASE WHEN neg < 20 THEN 1 ELSE floor(neg * 0.05) END) WHERE k = 1) t USING (grp)")
def m31(spark, d):
    s = scored(spark, d)
    return metrics.average_precision(s, ["grp"]).join(metrics.threshold_at_fpr(s, 0.05, by=["grp"]).select("grp", "threshold"), "grp")


@query("i5_risk_level", f"WITH {SC} SELECT event_id, CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level FROM sc")
def i5(spark, d):
    return scored(spark, d).select("event_id", reports.risk_level(F.col("score")).alias("risk_level"))


@query("r29_outcome", f"WITH {SC} SELECT event_id, CASE WHEN score >= 0.5 AND y = 1 THEN 'TP' WHEN score >= 0.5 THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM sc")
def r29(spark, d):
    return scored(spark, d).select("event_id", reports.outcome(F.col("score") >= 0.5, F.col("y")).alias("outcome"))


@query("r30_row_shares", f"WITH {SC}, p AS (SELECT y, CAST(score >= 0.5 AS INT) AS predicted FROM sc) SELECT y, predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM p GROUP BY y, predicted")
def r30(spark, d):
    return reports.row_shares(scored(spark, d).withColumn("predicted", (F.col("score") >= 0.5).cast("int")), "y", "predicted")


@query("r31_score_profile", f"WITH {SC} SELECT 'score' AS feature, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, min(score) AS min, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.75), 6) AS q75, max(score) AS max FROM sc")
def r31(spark, d):
    from tankwatch.functions.stats import profile

    return profile(scored(spark, d), ["score"])


@query("r32_top_alerts", f"WITH {SC} SELECT event_id, score FROM sc ORDER BY score DESC, event_id LIMIT 3")
def r32(spark, d):
    return reports.top(scored(spark, d), "score", 3, ["event_id"]).select("event_id", "score")


@query("r34_confidence_tier", f"WITH {SC} SELECT event_id, CASE WHEN score >= 0.5 + 0.2 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS tier FROM sc")
def r34(spark, d):
    return scored(spark, d).select("event_id", reports.confidence_tier(F.col("score"), 0.5).alias("tier"))


@query("r37_risk_distribution", f"WITH {SC}, l AS (SELECT CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level FROM sc) SELECT risk_level, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM l GROUP BY risk_level")
def r37(spark, d):
    return reports.distribution(scored(spark, d).select(reports.risk_level(F.col("score")).alias("risk_level")), "risk_level")


@query("r27_alerts_by_group", f"WITH {SC} SELECT grp, CAST(sum(CAST(score >= 0.5 AS INT)) AS BIGINT) AS alerts, count(*) AS n, round(avg(CAST(score >= 0.5 AS INT)), 6) AS rate FROM sc GROUP BY grp")
def r27(spark, d):
    a = (F.col("score") >= 0.5).cast("int")
    return scored(spark, d).groupBy("grp").agg(F.sum(a).alias("alerts"), F.count("*").alias("n"), F.avg(a).alias("rate"))


@query("r28_dataset_profile", f"WITH {SC} SELECT grp, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) AS prevalence FROM sc GROUP BY grp")
def r28(spark, d):
    s = scored(spark, d)
    return reports.distribution(s, "grp").join(s.groupBy("grp").agg(F.sum("y").alias("positives"), F.avg("y").alias("prevalence")), "grp")


@query("i9_prediction_summary", f"WITH {SC}, x AS (SELECT e.user_id, sc.score, e.value FROM sc JOIN events e USING (event_id)) SELECT user_id, count(*) AS n_events, count(*) FILTER (score >= 0.5) AS n_thefts, max(score) AS max_confidence, round(sum(value), 4) AS total_fuel_drop FROM x GROUP BY user_id")
def i9(spark, d):
    x = scored(spark, d).join(spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "value"), "event_id")
    return x.groupBy("user_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("score") >= 0.5).alias("n_thefts"), F.max("score").alias("max_confidence"), F.round(F.sum("value"), 4).alias("total_fuel_drop"))


@query("i6_pattern_threshold", f"WITH {SC}, t(grp, thr) AS (VALUES (0, 0.4), (1, 0.6)) SELECT event_id, CAST(score >= coalesce(thr, 0.5) AS INT) AS is_theft FROM sc LEFT JOIN t USING (grp)")
def i6(spark, d):
    t = spark.createDataFrame([(0, 0.4), (1, 0.6)], "grp long, thr double")
    return scored(spark, d).join(F.broadcast(t), "grp", "left").select("event_id", (F.col("score") >= F.coalesce("thr", F.lit(0.5))).cast("int").alias("is_theft"))


@query("j12_counts_lookup", f"WITH {SC}, c AS (SELECT grp, count(*) AS c FROM sc WHERE score >= 0.85 GROUP BY grp) SELECT DISTINCT sc.grp, coalesce(c, 0) AS c FROM sc LEFT JOIN c USING (grp)")
def j12(spark, d):
    s = scored(spark, d)
    return s.select("grp").distinct().join(s.where("score >= 0.85").groupBy("grp").agg(F.count("*").alias("c")), "grp", "left").withColumn("c", F.coalesce("c", F.lit(0)))
