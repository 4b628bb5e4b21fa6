"""Queries of sources, models, scoring and streams; fitted models have no SQL form and are tested in tests/test_models.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankwatch.operators import detection, features, hotspots, intervals, metrics, models, quality, reports, scoring, signal, splits
from tankwatch.params import Clustering
from tankwatch.plans.q_basic import DER, hav, r6, raw
from tankwatch.plans.q_events import CEN, EV, SC, SEG, SPLIT, found, labelled, mapped, placed, scored
from tankwatch.plans.telemetry import GAPS, SCALED, TEL, events, telemetry
from tankwatch.sources import ingest
from tankwatch.streaming import streams

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: r6(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return put


def _path(spark, name: str) -> str:
    return f"{detection.checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _csv(spark, d: str, encoding: str = "UTF-8") -> str:
    """Telemetry as a Spanish CSV, in the session's shared folder."""
    t = telemetry(spark, d)
    path = _path(spark, "raw")
    t.select(
        F.col("vehicle_id").alias("Vehiculo"), F.date_format("timestamp", "dd.MM.yyyy HH:mm:ss").alias("Tiempo"), F.concat(F.col("latitude").cast("string"), F.lit(", "), F.col("longitude").cast("string")).alias("Coordenadas"),
        F.concat(F.col("speed_kmh").cast("string"), F.lit(" km/h")).alias("Velocidad"), F.when(F.col("ignition"), "encendido").otherwise("apagado").alias("Ignición" if encoding == "UTF-8" else "Ignicion"), F.col("total_fuel_gal").cast("string").alias("Tanque Total"), F.col("event_id").cast("string").alias("ref"),
    ).write.option("encoding", encoding).csv(path, header=True)
    return path


_STD = "CAST(user_id AS VARCHAR) AS vehicle_id, date_trunc('second', ts) AS timestamp, event_type <> 'error' AS ignition, round(value, 6) AS total_fuel_gal"
_KEYS = ["vehicle_id", "timestamp", "ignition", "total_fuel_gal"]


@query("s1_csv_scan", "SELECT CAST(event_id AS VARCHAR) AS ref, CAST(user_id AS VARCHAR) AS vehicle FROM events")
def s1(spark, d):
    return ingest.read_csv(spark, _csv(spark, d)).select("ref", F.col("Vehiculo").alias("vehicle"))


@query("s2_encodings", "SELECT CAST(event_id AS VARCHAR) AS ref FROM events UNION ALL SELECT CAST(event_id AS VARCHAR) FROM events")
def s2(spark, d):
    return ingest.read_any_encoding(spark, [_csv(spark, d), _csv(spark, d, "ISO-8859-1")]).select("ref")


@query("p1_standardise", f"SELECT {_STD} FROM events")
def p1(spark, d):
    return ingest.standardise(ingest.read_csv(spark, _csv(spark, d))).select(*_KEYS)


@query("s4_load_many", f"SELECT {_STD} FROM events UNION ALL SELECT {_STD} FROM events")
def s4(spark, d):
    return ingest.load_many(spark, [_csv(spark, d), _csv(spark, d), _path(spark, "absent")]).select(*_KEYS)


@query("s9_partitioned_sink", f"WITH {TEL} SELECT event_id, vehicle_id FROM tel")
def s9(spark, d):
    path = _path(spark, "combined")
    ingest.save_table(telemetry(spark, d), path)
    return ingest.load_table(spark, path).select("event_id", F.col("vehicle_id").cast("string").alias("vehicle_id"))


@query("s13_load_one", "SELECT vehicle_id, count(*) AS n FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS vehicle_id, date_trunc('second', ts) AS t FROM events) GROUP BY vehicle_id")
def s13(spark, d):
    return ingest.load(spark, _csv(spark, d)).groupBy("vehicle_id").agg(F.count("*").alias("n"))


@query("j1_union", "SELECT event_id, CASE WHEN s = 1 THEN round(value, 6) END AS value FROM (SELECT *, 1 AS s FROM events UNION ALL SELECT *, 2 FROM events)")
def j1(spark, d):
    e = raw(spark, d)
    return ingest.union([e.select("event_id", "value"), e.select("event_id")]).select("event_id", "value")


@query("j4_cluster_centroids", f"WITH {TEL}, {CEN} SELECT event_id, round(c_lat, 6) AS c_lat, round(c_lon, 6) AS c_lon FROM tel LEFT JOIN cen ON cen.vehicle_id = tel.vehicle_id AND cen.cluster_id = event_id % 9")
def j4(spark, d):
    t = telemetry(spark, d)
    c = t.groupBy("vehicle_id", (F.col("event_id") % 7).alias("cluster_id")).agg(F.avg("latitude").alias("c_lat"), F.avg("longitude").alias("c_lon"))
    return t.withColumn("cluster_id", F.col("event_id") % 9).join(c, ["vehicle_id", "cluster_id"], "left").select("event_id", "c_lat", "c_lon")


@query("j9_train_test_overlap", f"WITH {EV}, {SPLIT}, m AS (SELECT e.*, make_timestamp((epoch_us(e.start_time) + epoch_us(e.end_time)) // 2) <= cut AS is_train FROM ev e JOIN cuts USING (vehicle_id)) SELECT count(*) > 0 AS leaks FROM m a JOIN m b ON a.vehicle_id = b.vehicle_id AND a.is_train AND NOT b.is_train AND a.start_time <= b.end_time AND b.start_time <= a.end_time")
def j9(spark, d):
    return splits.leaks(mapped(spark, d)).agg((F.count("*") > 0).alias("leaks"))


@query("j14_train_points", f"WITH {TEL}, {DER}, {SPLIT} SELECT event_id FROM der JOIN cuts USING (vehicle_id) WHERE stationary AND timestamp <= cut")
def j14(spark, d):
    return hotspots.stationary_points(splits.rank_split(signal.derive(telemetry(spark, d)))).where("is_train").select("event_id")


@query("v11_required_state", f"WITH {TEL} SELECT event_id FROM tel")
def v11(spark, d):
    return quality.require(signal.derive(telemetry(spark, d)), quality.DETECTION_COLUMNS).select("event_id")


@query("c3_transform_points")
def c3(spark, d):
    p = Clustering(eps_m=40.0, min_samples=4)
    pts = hotspots.stationary_points(splits.rank_split(placed(spark, d)))
    centres, _ = hotspots.fit_hotspots(pts, p)
    return hotspots.nearest(pts.where("not is_train"), centres, p).select("event_id", "cluster_id")


def _set(spark, d) -> DataFrame:
    """The whole feature matrix of events with label and side of the split, as a stored table."""
    t = placed(spark, d)
    e = splits.map_events(features.labels(found(spark, d), t), t if "is_train" in t.columns else splits.rank_split(telemetry(spark, d)), False)
    rows = features.FeatureBuilder(hours=96).base(e, t)
    return models.stored(features.matrix(rows, ["vehicle_id", "start_time", "end_time", "is_train"]))


NUM, BIN = list(features.NUMERIC), list(features.BINARY)


#: The reference's sizes: calibration folds, and trees of the isolation forest.
FOLDS, ISOLATION_TREES = 5, 200


def _trained(spark, d, names=("logistic",)):
    """All of the named models, and the set; without any event there is nothing to fit, and no model."""
    s = _set(spark, d)
    m = models.train_all(s.where("is_train"), NUM, BIN, ["pattern"], FOLDS, False, list(names))
    return (m if m.failures and s.isEmpty() else m.complete()), s


def _scores(spark, d, names=("logistic",)):
    m, s = _trained(spark, d, names)
    return models.stored(models.predict(m, s.where("not is_train")))


@query("m2_logistic")
def m2(spark, d):
    return _scores(spark, d)


@query("m3_random_forest")
def m3(spark, d):
    return _scores(spark, d, ("random_forest",))


@query("m4_boosted")
def m4(spark, d):
    return _scores(spark, d, ("boosted",))


@query("m6_isolation_forest")
def m6(spark, d):
    return models.isolation_scores(_set(spark, d), NUM, trees=ISOLATION_TREES)


@query("m8_temperature")
def m8(spark, d):
    s = scored(spark, d).withColumn("logit", F.log((F.col("score") + 1e-3) / (1 - F.col("score") + 1e-3)))
    t = models.temperature(s)
    return s.select("event_id", (1 / (1 + F.exp(-F.col("logit") / t))).alias("score"))


@query("m10_predict_all")
def m10(spark, d):
    return _scores(spark, d, ("logistic", "random_forest"))


@query("m11_pattern_models")
def m11(spark, d):
    """A result row for each pattern with a model of its own: its threshold, and a report there that adds up."""
    s = _set(spark, d)
    own = models.pattern_models(s.where("is_train"), NUM, BIN)
    results, _ = models.pattern_results(own, s.where("not is_train"))
    sides = s.groupBy("pattern").agg(F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_test"), F.sum(F.when(~F.col("is_train"), F.col("y")).otherwise(0)).cast("long").alias("positives"))
    whole = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return sides.join(results, "pattern").select("pattern", "n_train", "n_test", "positives", (F.col("threshold").between(0, 1) & F.col("pr_auc").between(0, 1)).alias("within"), ((whole == F.col("n_test")) & (F.col("tp") + F.col("fn") == F.col("positives"))).alias("adds_up"))


LONG = "lg AS (SELECT event_id, grp, y, model, CASE model WHEN 'a' THEN score WHEN 'b' THEN 1 - score ELSE CAST((event_id * 31) % 100 AS DOUBLE) / 100 END AS score FROM sc CROSS JOIN (VALUES ('a'), ('b'), ('c')) v(model))"


def long_scores(spark, d) -> DataFrame:
    s = scored(spark, d).withColumn("model", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    return s.withColumn("score", F.when(F.col("model") == "a", F.col("score")).when(F.col("model") == "b", 1 - F.col("score")).otherwise((F.col("event_id") * 31 % 100).cast("double") / 100))


for _how, _agg in (("mean", "avg(score)"), ("max", "max(score)"), ("median", "median(score)")):
    query(f"m13_blend_{_how}", f"WITH {SC}, {LONG} SELECT event_id, round({_agg}, 6) AS score FROM lg GROUP BY event_id")(lambda spark, d, how=_how: models.blend(long_scores(spark, d), how, key="event_id"))

query("m13_blend_weighted", f"WITH {SC}, {LONG} SELECT event_id, round(sum(score * w) / sum(w), 6) AS score FROM lg JOIN (VALUES ('a', 0.5), ('b', 0.3), ('c', 0.2)) v(model, w) USING (model) GROUP BY event_id")(lambda spark, d: models.blend(long_scores(spark, d), "weighted", {"a": 0.5, "b": 0.3, "c": 0.2}, "event_id"))

query("m13_blend_rank", f"""WITH {SC}, {LONG}, rk AS (SELECT event_id, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM lg), m AS (SELECT event_id, avg(r) AS s FROM rk GROUP BY event_id)
    SELECT event_id, round((s - (SELECT min(s) FROM m)) / ((SELECT max(s) FROM m) - (SELECT min(s) FROM m)), 6) AS score FROM m""")(lambda spark, d: models.blend(long_scores(spark, d), "rank", key="event_id"))

LCV = """g AS (SELECT model, score, sum(y) AS p, count(*) - sum(y) AS n FROM lg GROUP BY ALL), lcv AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY model) AS pos FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    ap AS (SELECT model, sum(tp / (tp + fp) * p / pos) AS pr_auc FROM lcv GROUP BY model)"""


@query("m24_quick_evaluate", f"WITH {SC}, {LONG}, {LCV} SELECT model, round(pr_auc, 6) AS pr_auc FROM ap")
def m24(spark, d):
    return metrics.average_precision(long_scores(spark, d), ["model"])


@query("r24_model_ranking", f"WITH {SC}, {LONG}, {LCV} SELECT model, row_number() OVER (ORDER BY pr_auc DESC, model) AS place FROM ap")
def r24(spark, d):
    ap = metrics.average_precision(long_scores(spark, d), ["model"])
    return ap.select("model", F.row_number().over(W.orderBy(F.desc("pr_auc"), "model")).alias("place"))  # one row for each model


@query("m28_model_report", f"WITH {SC}, {LONG}, {LCV} SELECT model, round(pr_auc, 6) AS pr_auc FROM ap ORDER BY pr_auc DESC, model LIMIT 1")
def m28(spark, d):
    return reports.top(metrics.average_precision(long_scores(spark, d), ["model"]), "pr_auc", 1, ["model"])


_GM = "gm AS (SELECT grp, model, avg(score) AS s FROM lg GROUP BY grp, model)"


@query("r22_pivot", f"WITH {SC}, {LONG} SELECT grp, round(avg(score) FILTER (model = 'a'), 6) AS a, round(avg(score) FILTER (model = 'b'), 6) AS b, round(avg(score) FILTER (model = 'c'), 6) AS c FROM lg GROUP BY grp")
def r22(spark, d):
    return long_scores(spark, d).groupBy("grp").pivot("model", ["a", "b", "c"]).avg("score")


@query("r23_best_by_group", f"WITH {SC}, {LONG}, {_GM} SELECT grp, model FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(s, 9) DESC, model) AS k FROM gm) WHERE k = 1")
def r23(spark, d):
    return reports.best_by(long_scores(spark, d).groupBy("grp", "model").agg(F.round(F.avg("score"), 9).alias("s")), ["grp"], "s", ["model"]).select("grp", "model")


@query("r25_difficulty", f"WITH {SC}, {LONG} SELECT grp, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS rate FROM lg GROUP BY grp")
def r25(spark, d):
    return long_scores(spark, d).groupBy("grp").agg(F.avg("score").alias("mean_score"), F.avg("y").alias("rate"))


@query("r26_well_calibrated", f"WITH {SC}, {LONG}, b AS (SELECT model, " + " + ".join(f"CAST(score >= {k}/10.0::DOUBLE AS INT)" for k in range(1, 10)) + " AS bin, count(*) AS n, abs(avg(score) - avg(y)) AS gap FROM lg GROUP BY ALL) SELECT model FROM b GROUP BY model HAVING sum(gap * n) / sum(n) < 0.3")
def r26(spark, d):
    return metrics.calibration_error(long_scores(spark, d), 10, ["model"]).where("ece < 0.3").select("model")


@query("r33_improvement", f"WITH {SC}, {LONG}, m AS (SELECT model AS metric, avg(score) AS value, avg(y) AS base FROM lg GROUP BY model) SELECT metric, round((CASE WHEN metric = 'b' THEN -1 ELSE 1 END) * (value - base) / base * 100, 4) AS improvement_pct FROM m")
def r33(spark, d):
    s = long_scores(spark, d)
    cur, base = (s.groupBy(F.col("model").alias("metric")).agg(F.avg(c).alias("value")) for c in ("score", "y"))
    return reports.improvement(cur, base, ["b"]).select("metric", F.round("improvement_pct", 4).alias("improvement_pct"))


@query("r20_cumulative", f"WITH {SC}, {LONG}, v AS (SELECT model, avg(score) AS s FROM lg GROUP BY model) SELECT model, round(sum(s) OVER (ORDER BY s DESC, model ROWS UNBOUNDED PRECEDING) / sum(s) OVER (), 6) AS cumulative FROM v")
def r20(spark, d):
    return reports.cumulative(long_scores(spark, d).groupBy("model").agg(F.avg("score").alias("s")), "model", "s").select("model", "cumulative")


@query("r35_validation_export", f"WITH {SC} SELECT event_id, score AS prob, score >= 0.5 AS alert, y AS ground_truth FROM sc")
def r35(spark, d):
    return scored(spark, d).select("event_id", F.col("score").alias("prob"), (F.col("score") >= 0.5).alias("alert"), F.col("y").alias("ground_truth"))


@query("r38_batch_totals", f"WITH {SC} SELECT grp AS source, count(*) AS n_events, count(*) FILTER (score >= 0.5) AS n_thefts FROM sc GROUP BY grp")
def r38(spark, d):
    return scored(spark, d).groupBy(F.col("grp").alias("source")).agg(F.count("*").alias("n_events"), F.count_if(F.col("score") >= 0.5).alias("n_thefts"))


@query("r21_feature_families", f"""WITH {EV}, f(feature, family) AS (VALUES {", ".join(f"('{c}', 'numeric')" for c in features.NUMERIC)}, {", ".join(f"('{c}', 'binary')" for c in features.BINARY)}),
    h(feature, n) AS (SELECT 'drop_gal', count(drop_gal) FROM ev UNION ALL SELECT 'duration_min', count(duration_min) FROM ev UNION ALL SELECT 'min_step_gal', count(min_step_gal) FROM ev UNION ALL SELECT 'n_negative_steps', count(n_negative_steps) FROM ev)
    SELECT family, count(*) AS n_features, count(n) AS n_present FROM f LEFT JOIN h USING (feature) GROUP BY family""")
def r21(spark, d):
    fam = spark.createDataFrame([(c, "numeric") for c in features.NUMERIC] + [(c, "binary") for c in features.BINARY], "feature string, family string")
    have = reports.unpivoted(found(spark, d).agg(*[F.count(c).alias(c) for c in ("drop_gal", "duration_min", "min_step_gal", "n_negative_steps")]), "feature", "n")
    return fam.join(F.broadcast(have), "feature", "left").groupBy("family").agg(F.count("*").alias("n_features"), F.count("n").alias("n_present"))


@query("m15_importance")
def m15(spark, d):
    m, _ = _trained(spark, d, ("boosted",))
    return models.importance(m["boosted"])


@query("r41_contributions")
def r41(spark, d):
    m, s = _trained(spark, d, ("boosted",))
    one = s.orderBy(F.desc("drop_gal"), "event_key").limit(1).select(*[F.col(c).cast("double").alias(c) for c in NUM])
    return models.importance(m["boosted"]).join(reports.unpivoted(one, "feature", "value"), "feature").orderBy(F.desc("importance"), "feature").limit(10)


@query("m23_evaluate")
def m23(spark, d):
    return models.evaluate(_scores(spark, d, ("logistic", "boosted")))


@query("m25_per_pattern")
def m25(spark, d):
    return models.per_pattern(_scores(spark, d))


@query("i8_score_events")
def i8(spark, d):
    m, s = _trained(spark, d, ("boosted",))
    path = _path(spark, "model")
    models.save(m["boosted"], path)
    return scoring.score_events(models.load(path), s.where("not is_train").drop("is_train", "y"), [*NUM, *BIN, "pattern"]).select("event_key", "score", "is_theft", "risk_level", "explanation")


@query("i7_explanations", f"""WITH {EV}, x AS (SELECT *, least(drop_gal / 100, 0.99) AS score, CAST(drop_gal > 30 AS INT) AS is_theft, drop_gal / (duration_min + 1e-6) AS rate_gpm, n_negative_steps % 2 AS is_hotspot FROM ev)
    SELECT vehicle_id, start_time, end_time, pattern, array_to_string(list_filter([
        CASE WHEN is_theft = 1 THEN CASE WHEN score > 0.8 THEN 'high' WHEN score > 0.6 THEN 'moderate' ELSE 'low' END || printf(' confidence theft (%.1f%%)', score * 100) ELSE printf('Low theft probability (%.1f%%)', score * 100) END,
        CASE WHEN drop_gal > 10 THEN printf('Large fuel drop: %.1f gallons', drop_gal) WHEN drop_gal > 5 THEN printf('Moderate fuel drop: %.1f gallons', drop_gal) END,
        CASE WHEN duration_min < 10 THEN printf('Short duration: %.1f minutes', duration_min) WHEN duration_min > 30 THEN printf('Extended duration: %.1f minutes', duration_min) END,
        CASE WHEN rate_gpm > 0.5 THEN printf('Fast drain rate: %.2f gal/min', rate_gpm) END,
        CASE WHEN is_hotspot = 1 THEN 'Occurred at known hotspot location' END, 'Pattern: ' || pattern], lambda r: r IS NOT NULL), '; ') AS reasons FROM x""")
def i7(spark, d):
    e = features.with_rate(found(spark, d)).withColumns({"score": F.least(F.col("drop_gal") / 100, F.lit(0.99)), "is_theft": (F.col("drop_gal") > 30).cast("int"), "is_hotspot": F.col("n_negative_steps") % 2})
    return e.select("vehicle_id", "start_time", "end_time", "pattern", F.array_join(scoring.explanations(e), "; ").alias("reasons"))


#: Rows that arrive long after their time, and up to when the first part of a stream goes.
LATE, CUT = "event_id % 50 = 0 AND ts < (SELECT max(ts) - INTERVAL 10 DAY FROM events)", "(SELECT max(ts) - INTERVAL 2 DAY FROM events)"


def _streamed(spark, parts: list[DataFrame], build) -> DataFrame:
    """A stream that is stopped and goes on from its checkpoint after each part has arrived; its rows so far."""
    src, out, state = _path(spark, "in"), _path(spark, "out"), _path(spark, "state")
    for part in parts:
        part.write.mode("append").parquet(src)
        made = build(spark.readStream.schema(part.schema).parquet(src))
        with streams.state_store(spark):
            made.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


def _timed(spark, d, rows: DataFrame, late: bool = False) -> list[DataFrame]:
    """``rows`` with their last two days in a second part, which may bring old rows as well, and at the end a row of
    no vehicle far ahead, with which the watermark passes all others."""
    end = rows.agg(F.max("timestamp").alias("_end"))
    marked = rows.join(F.broadcast(end)).withColumn("_late", (F.col("event_id") % 50 == 0) & (F.col("timestamp") < F.col("_end") - F.expr("interval 10 days")) if late else F.lit(False))
    first = (F.col("timestamp") <= F.col("_end") - F.expr("interval 2 days")) & ~F.col("_late")
    last = rows.agg(*[(F.max(c) + F.expr("interval 3660 days") if c == "timestamp" else F.lit("~end") if c == "vehicle_id" else F.first(c)).alias(c) for c in rows.columns])
    return [marked.where(first).drop("_end", "_late"), marked.where(~first).drop("_end", "_late"), last.withColumn("stationary", F.lit(True)) if "stationary" in rows.columns else last]


@query("x4_hourly_loss", f"WITH {TEL}, {DER} SELECT vehicle_id, date_trunc('hour', timestamp) AS start, round(sum(CASE WHEN dfuel < 0 THEN -dfuel ELSE 0 END), 6) AS lost_gal, count(*) AS n FROM der GROUP BY ALL")
def x4(spark, d):
    rows = signal.derive(telemetry(spark, d)).select("event_id", "vehicle_id", "timestamp", "dfuel")
    return _streamed(spark, _timed(spark, d, rows), streams.hourly_loss)


@query("x5_quality_monitor", f"""WITH {GAPS}, w AS (SELECT make_timestamp((epoch_us(timestamp) // 900000000 - k) * 900000000) AS start, total_fuel_gal, speed_kmh FROM gaps, generate_series(0, 3) g(k))
    SELECT start, count(*) AS n, round(avg(CAST(total_fuel_gal IS NULL AS DOUBLE)), 6) AS missing_fuel, round(avg(CAST(speed_kmh IS NULL AS DOUBLE)), 6) AS missing_speed FROM w GROUP BY start""")
def x5(spark, d):
    rows = telemetry(spark, d, gaps=True).select("event_id", "vehicle_id", "timestamp", "total_fuel_gal", "speed_kmh")
    return _streamed(spark, _timed(spark, d, rows), streams.quality_monitor)


@query("x3_sessions", f"""WITH {TEL}, {DER}, g AS (SELECT vehicle_id, timestamp, timestamp + CASE WHEN ign_off THEN INTERVAL 2880 MINUTE ELSE INTERVAL 1440 MINUTE END AS until FROM der WHERE stationary),
    b AS (SELECT *, CAST(timestamp > max(until) OVER (PARTITION BY vehicle_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INT) AS fresh FROM g),
    s AS (SELECT *, sum(coalesce(fresh, 1)) OVER (PARTITION BY vehicle_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS session FROM b)
    SELECT vehicle_id, min(timestamp) AS start, count(*) AS n_rows FROM s GROUP BY vehicle_id, session""")
def x3(spark, d):
    rows = signal.derive(telemetry(spark, d), SCALED).select("event_id", "vehicle_id", "timestamp", "stationary", "ign_off")
    return _streamed(spark, _timed(spark, d, rows), lambda df: streams.sessions(df, SCALED))


@query("x1_stateful_segments", f"WITH {SEG.replace(' FROM events)', f' FROM events WHERE NOT ({LATE}))', 1)} SELECT vehicle_id, seg_id, start_time, end_time, is_ign_off FROM segs")
def x1(spark, d):
    """A stream in three parts; the second brings every fiftieth row long after its time, which the watermark drops."""
    closed = _streamed(spark, _timed(spark, d, telemetry(spark, d), late=True), lambda df: streams.closed_segments(df, SCALED))
    return streams.stateful_segments(closed, SCALED).select("vehicle_id", "seg_id", "start_time", "end_time", "is_ign_off")


_SPOILT = "event_id % 101 = 0 OR event_id % 103 = 0 OR event_id % 107 = 0"
_LINE = "CAST(event_id AS VARCHAR) || ',' || CAST(user_id AS VARCHAR) || ',' || event_type"


@query("s3_tolerant_scan", f"""SELECT true AS good, {_LINE} AS line, CAST(1 AS BIGINT) AS n FROM events WHERE NOT ({_SPOILT})
    UNION ALL SELECT false, CASE WHEN event_id % 101 = 0 THEN 'short,' || CAST(user_id AS VARCHAR) WHEN event_id % 103 = 0 THEN {_LINE} || ',more' ELSE CAST(event_id AS VARCHAR) || ',"' || CAST(user_id AS VARCHAR) || ',' || event_type END AS line, count(*) FROM events WHERE {_SPOILT} GROUP BY line""")
def s3(spark, d):
    """Lines with a field too few, one too many, or an open quote go to quarantine; the others are read."""
    path, e = _path(spark, "spoilt"), events(spark, d)
    plain = F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type")
    line = F.when(F.col("event_id") % 101 == 0, F.concat(F.lit("short,"), F.col("user_id").cast("string"))).when(F.col("event_id") % 103 == 0, F.concat(plain, F.lit(",more"))).when(F.col("event_id") % 107 == 0, F.concat(F.col("event_id").cast("string"), F.lit(',"'), F.col("user_id").cast("string"), F.lit(","), F.col("event_type"))).otherwise(plain)
    head = F.lit("ref,vehicle,kind").alias("value")
    e.select(line.alias("value"), F.spark_partition_id().alias("part")).groupBy("part").agg(F.concat_ws("\n", F.array(head), F.collect_list("value")).alias("value")).select("value").write.text(path)
    good, bad = ingest.read_tolerant(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in ("ref", "vehicle", "kind")]))
    return good.select(F.lit(True).alias("good"), F.concat_ws(",", "ref", "vehicle", "kind").alias("line"), F.lit(1).cast("long").alias("n")).union(bad.groupBy("line").agg(F.sum("n").alias("n")).select(F.lit(False), "line", "n"))


@query("s5_glob", "SELECT CAST(event_id AS VARCHAR) AS ref FROM events")
def s5(spark, d):
    return ingest.read_csv(spark, f"{_csv(spark, d)}/part-*.csv").select("ref")


@query("s8_load_events", f"WITH {EV} SELECT vehicle_id, date_trunc('second', start_time) AS start_time, date_trunc('second', end_time) AS end_time, pattern FROM ev")
def s8(spark, d):
    path = _path(spark, "events")
    found(spark, d).select("vehicle_id", "start_time", "end_time", "pattern").write.option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path, header=True)
    return ingest.load_events(spark, path)


@query("j13_split_mapping", f"WITH {EV}, {SPLIT} SELECT e.vehicle_id, e.start_time, e.end_time, e.pattern, make_timestamp((epoch_us(e.start_time) + epoch_us(e.end_time)) // 2) <= cut AS is_train FROM ev e JOIN cuts USING (vehicle_id)")
def j13(spark, d):
    return mapped(spark, d).select("vehicle_id", "start_time", "end_time", "pattern", "is_train")


@query("k7_stratified_split", f"WITH {TEL}, q AS (SELECT vehicle_id, quantile_cont(CAST(epoch_us(timestamp) AS DOUBLE), 0.8) AS cut FROM tel GROUP BY vehicle_id) SELECT event_id, epoch_us(timestamp) <= cut AS is_train FROM tel JOIN q USING (vehicle_id)")
def k7(spark, d):
    """Without a rule of its own: the quantile split."""
    return splits.quantile_split(telemetry(spark, d)).select("event_id", "is_train")


@query("m5_boosted_deep")
def m5(spark, d):
    return _scores(spark, d, ("boosted_deep",))


@query("m7_isotonic")
def m7(spark, d):
    s = _set(spark, d)
    train = s.where("is_train")
    model = models.calibrate(train, [*models.preprocessing(NUM, BIN, ["pattern"]), models.logistic(train.count())], FOLDS, "isotonic")
    return models.predict({"logistic": model}, s.where("not is_train"))


@query("i1_score_telemetry")
def i1(spark, d):
    m, s = _trained(spark, d, ("boosted",))
    norms = models.stored(features.fit_norms(s.where("is_train")))
    return scoring.score_telemetry(m["boosted"], telemetry(spark, d), norms, [*NUM, *BIN, "pattern"], SCALED).select("vehicle_id", "start_time", "end_time", "pattern", "score", "is_theft", "risk_level")


@query("i10_micro_batches", f"WITH {SC} SELECT event_id, CAST(score >= 0.5 AS INT) AS is_theft, CAST((SELECT count(*) FROM sc) AS BIGINT) AS n_events, CAST((SELECT count(*) FROM sc WHERE score >= 0.5) AS BIGINT) AS n_thefts FROM sc")
def i10(spark, d):
    """Every scored row, with the totals of the batches' summaries."""
    src, out = _path(spark, "in"), _path(spark, "out")
    rows = scored(spark, d)
    rows.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    streams.run_batches(stream, lambda df, batch: scoring.decide(df.withColumn("pattern", F.lit("short_stationary"))), out, _path(spark, "state"))
    sums = spark.read.parquet(f"{out}/batches").agg(F.sum("n_events").alias("n_events"), F.sum("n_thefts").alias("n_thefts"))
    return spark.read.parquet(f"{out}/events").select("event_id", "is_theft").join(F.broadcast(sums))


@query("x2_late_data", f"""WITH w AS (SELECT make_timestamp((epoch_us(max(ts)) // 1000 - 7200000) * 1000) AS mark FROM events WHERE ts <= {CUT} AND NOT ({LATE}))
    SELECT DISTINCT CAST(user_id AS VARCHAR) AS vehicle_id, ts AS timestamp FROM events, w WHERE (ts <= {CUT} AND NOT ({LATE})) OR ts > mark""")
def x2(spark, d):
    """Every row comes twice; the second part brings every fiftieth row long after its time, which the watermark drops."""
    rows = telemetry(spark, d).select("event_id", "vehicle_id", "timestamp")
    one, two, last = _timed(spark, d, rows, late=True)
    out = _streamed(spark, [one.union(one), two.union(two)], streams.deduplicated)
    return out.select("vehicle_id", "timestamp")
