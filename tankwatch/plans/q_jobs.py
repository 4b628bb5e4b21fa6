"""Queries of jobs, of scoring with stored artefacts, and of operators that other queries hold inside, with DuckDB SQL
where SQL can express them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tankwatch.functions import parse
from tankwatch.functions.stats import large
from tankwatch.operators import detection, features, hotspots, jobs, metrics, models, quality, scoring, segments, signal, splits
from tankwatch.plans import q_basic, q_events, q_models
from tankwatch.plans.q_basic import hav, r6
from tankwatch.plans.q_events import EV, KEYS, LAB, SC, SEG, SMALL, SPLIT, THR, TRAIN, _cv, found, mapped, placed, scored
from tankwatch.plans.q_models import BIN, NUM, _csv, _path
from tankwatch.plans.telemetry import GAPS, SCALED, TEL, _sql, telemetry
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


@query("s7_reload", f"WITH {TEL} SELECT event_id, vehicle_id, date_trunc('second', timestamp) AS timestamp FROM tel")
def s7(spark, d):
    """Stored with the time as text, read back as UTC."""
    path = _path(spark, "combined")
    ingest.save_table(telemetry(spark, d).select("event_id", "vehicle_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp")), path, None)
    return ingest.load_combined(spark, path)


@query("p2_pick_column", "SELECT CAST(event_id AS VARCHAR) AS ref, CAST(user_id AS VARCHAR) AS vehicle, CAST(event_id % 130 AS VARCHAR) AS speed, event_id % 2 = 0 AS on_left, CAST(NULL AS VARCHAR) AS nothing FROM events")
def p2(spark, d):
    """Exact names go before contained ones, and a candidate's place before a column's."""
    e = spark.read.parquet(f"{d}/events.parquet")
    t = e.select(F.col("event_id").cast("string").alias("ref"), F.col("user_id").cast("string").alias(" Vehiculo "), (F.col("event_id") % 7).cast("string").alias("speed limit"), (F.col("event_id") % 130).cast("string").alias("Velocidad (km/h)"), (F.col("event_id") % 2 == 0).alias("LEFT_FUEL"), F.lit("x").alias("day"))
    pick = lambda names: parse.pick_column(t.columns, names)
    col = lambda c: F.col(f"`{c}`") if c else F.lit(None).cast("string")
    return t.select("ref", col(pick(["unit", "vehiculo"])).alias("vehicle"), col(pick(["velocidad", "speed"])).alias("speed"), col(pick(["total_fuel", "fuel"])).alias("on_left"), col(pick(["y"])).alias("nothing"))


_ASKED = ["vehicle_id", "speed", "total_fuel_gal", "odometer", "latitude"]


@query("p3_required", f"WITH {GAPS} " + " UNION ALL ".join(f"SELECT '{c}' AS asked, 'missing columns: {c}' AS error, CAST(0 AS BIGINT) AS n" if c in ("speed", "odometer") else f"SELECT '{c}', CAST(NULL AS VARCHAR), count({c}) FROM gaps" for c in sorted(_ASKED, key=lambda c: c not in ("speed", "odometer"))))
def p3(spark, d):
    """Columns that are there with their values, and the error for those that are not."""
    t, parts = telemetry(spark, d, gaps=True), []
    for c in _ASKED:
        try:
            parts.append(quality.require(t, [c]).agg(F.lit(c).alias("asked"), F.lit(None).cast("string").alias("error"), F.count(c).alias("n")))
        except ValueError as e:
            parts.append(t.agg(F.lit(c).alias("asked"), F.lit(str(e)).alias("error"), F.lit(0).cast("long").alias("n")))
    return ingest.union(parts)


_CELLS = f"""a AS (SELECT event_id AS a, vehicle_id, latitude AS la, longitude AS lo FROM tel WHERE event_id % 10 = 0), b AS (SELECT event_id AS b, vehicle_id, latitude AS lb, longitude AS lp FROM tel WHERE event_id % 10 = 5)
    SELECT a, b, round({hav('la', 'lo', 'lb', 'lp')}, 6) AS km FROM a JOIN b ON a.vehicle_id = b.vehicle_id"""


@query("j11_pairwise", f"WITH {TEL}, {_CELLS} AND {hav('la', 'lo', 'lb', 'lp')} <= 0.05")
def j11(spark, d):
    """All pairs of two sets of points of a vehicle that lie within 50 m, with their distance."""
    t = telemetry(spark, d)
    one, two = t.where("event_id % 10 = 0").withColumnRenamed("event_id", "a"), t.where("event_id % 10 = 5").withColumnRenamed("event_id", "b")
    return hotspots.pairwise(one, two, 0.05, ["vehicle_id"]).select("a", "b", "km")


_SPOTS = f"""pts AS (SELECT vehicle_id, event_id, timestamp, epoch_us(timestamp) AS point_id, latitude, longitude FROM placed WHERE stationary AND latitude IS NOT NULL AND longitude IS NOT NULL)"""


def _dbscan(rows: str) -> str:
    near = hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")
    return f"""sp AS (SELECT vehicle_id, latitude, longitude, min(point_id) AS spot, count(*) AS w FROM {rows} GROUP BY ALL),
    nb AS (SELECT a.vehicle_id, a.spot AS a, b.spot AS b, b.w FROM sp a JOIN sp b ON a.vehicle_id = b.vehicle_id WHERE {near} <= {SMALL.eps_m / 1000}),
    core AS (SELECT vehicle_id, a AS spot FROM nb GROUP BY ALL HAVING sum(w) >= {SMALL.min_samples}),
    ce AS (SELECT nb.vehicle_id, nb.a, nb.b FROM nb JOIN core c ON c.vehicle_id = nb.vehicle_id AND c.spot = nb.a JOIN core e ON e.vehicle_id = nb.vehicle_id AND e.spot = nb.b),
    reach(vehicle_id, node, other) AS (SELECT vehicle_id, spot, spot FROM core UNION SELECT r.vehicle_id, r.node, ce.b FROM reach r JOIN ce ON ce.vehicle_id = r.vehicle_id AND ce.a = r.other),
    fst AS (SELECT vehicle_id, node, min(other) AS f FROM reach GROUP BY ALL),
    num AS (SELECT vehicle_id, f, row_number() OVER (PARTITION BY vehicle_id ORDER BY f) - 1 AS cluster FROM (SELECT DISTINCT vehicle_id, f FROM fst)),
    cl AS (SELECT fst.vehicle_id, node AS spot, cluster FROM fst JOIN num USING (vehicle_id, f)),
    bo AS (SELECT nb.vehicle_id, nb.a AS spot, min(cluster) AS cluster FROM nb JOIN cl ON cl.vehicle_id = nb.vehicle_id AND cl.spot = nb.b WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.vehicle_id = nb.vehicle_id AND c.spot = nb.a) GROUP BY ALL),
    lb AS (SELECT sp.vehicle_id, latitude, longitude, coalesce(cl.cluster, bo.cluster, -1) AS cluster FROM sp LEFT JOIN cl ON cl.vehicle_id = sp.vehicle_id AND cl.spot = sp.spot LEFT JOIN bo ON bo.vehicle_id = sp.vehicle_id AND bo.spot = sp.spot),
    cen AS (SELECT vehicle_id, lb.cluster AS cluster_id, avg(latitude) AS c_lat, avg(longitude) AS c_lon FROM {rows} JOIN lb USING (vehicle_id, latitude, longitude) WHERE lb.cluster >= 0 GROUP BY ALL)"""


def _nearest(rows: str) -> str:
    km = hav("latitude", "longitude", "c_lat", "c_lon")
    return f"""nk AS (SELECT event_id, cluster_id, {km} AS km FROM {rows} JOIN cen USING (vehicle_id)), nr AS (SELECT event_id, arg_min(cluster_id, km) AS cluster_id FROM nk WHERE km <= {SMALL.eps_m / 1000} GROUP BY event_id)"""


_SEGR = "RECURSIVE " + SEG
SQL["c1_dbscan"] = f"WITH {_SEGR}, {_SPOTS}, {_dbscan('pts')} SELECT p.vehicle_id, point_id, CAST(cluster AS INT) AS cluster FROM pts p JOIN lb USING (vehicle_id, latitude, longitude)"
SQL["c2_fit_hotspots"] = f"WITH {_SEGR}, {_SPOTS}, {_dbscan('pts')}, {_nearest('pts')} SELECT vehicle_id, timestamp, coalesce(cluster_id, -1) AS cluster_id FROM pts LEFT JOIN nr USING (event_id)"
_SIDES = "tr AS (SELECT pts.* FROM pts JOIN cuts USING (vehicle_id) WHERE timestamp <= cut), te AS (SELECT pts.* FROM pts JOIN cuts USING (vehicle_id) WHERE timestamp > cut)"
SQL["c3_transform_points"] = f"WITH {_SEGR}, {_SPOTS}, {SPLIT}, {_SIDES}, {_dbscan('tr')}, {_nearest('te')} SELECT event_id, coalesce(cluster_id, -1) AS cluster_id FROM te LEFT JOIN nr USING (event_id)"


@query("c4_extract_and_cluster", f"WITH {_SEGR}, {_SPOTS}, {SPLIT}, {_SIDES}, {_dbscan('tr')}, {_nearest('pts')} SELECT event_id, coalesce(cluster_id, -1) AS cluster_id FROM pts LEFT JOIN nr USING (event_id)")
def c4(spark, d):
    return hotspots.extract_and_cluster(splits.rank_split(placed(spark, d)), SMALL)[1].select("event_id", "cluster_id")


_OVER = "(greatest(0, least(e.t, x.t) - greatest(e.s, x.s)) / nullif((e.t - e.s) + (x.t - x.s) - greatest(0, least(e.t, x.t) - greatest(e.s, x.s)), 0) >= 0.5)"


def _kept(events: str) -> str:
    """Greedy suppression: one step for each event of a segment, with the list of those that stay."""
    return f"""rk AS (SELECT *, epoch_us(start_time) AS s, epoch_us(end_time) AS t, row_number() OVER (PARTITION BY vehicle_id, seg_id ORDER BY drop_gal DESC, pattern_no, start_idx, end_idx) AS place FROM {events}),
    gr(vehicle_id, seg_id, k, kept) AS (
        SELECT DISTINCT vehicle_id, seg_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(s BIGINT, t BIGINT, place BIGINT)[]) FROM rk
        UNION ALL SELECT g.vehicle_id, g.seg_id, e.place, CASE WHEN len(list_filter(g.kept, lambda x: coalesce({_OVER}, false))) = 0 THEN list_append(g.kept, struct_pack(s := e.s, t := e.t, place := e.place)) ELSE g.kept END
        FROM gr g JOIN rk e ON e.vehicle_id = g.vehicle_id AND e.seg_id = g.seg_id AND e.place = g.k + 1),
    ls AS (SELECT vehicle_id, seg_id, arg_max(kept, k) AS kept FROM gr GROUP BY ALL),
    pl AS (SELECT vehicle_id, seg_id, unnest(kept).place AS place FROM ls),
    nms AS (SELECT rk.* FROM rk JOIN pl USING (vehicle_id, seg_id, place))"""


_EVENT = "vehicle_id, start_time, end_time, round(duration_min, 6) AS duration_min, round(drop_gal, 6) AS drop_gal, round(min_step_gal, 6) AS min_step_gal, pattern, n_negative_steps"
SQL["d6_detect"] = SQL["d8_suppress"] = f"WITH RECURSIVE {EV}, {_kept('ev')} SELECT {_EVENT} FROM nms"

_STRICT = EV.replace("0.5 * coalesce(sigma, 0)", "2.0 * coalesce(sigma, 0)")


@query("i3_detect_stored_thresholds", f"WITH RECURSIVE {_STRICT}, {_kept('ev')} SELECT {_EVENT} FROM nms")
def i3(spark, d):
    """With thresholds that a stricter run has stored, in place of those of the rows at hand."""
    from dataclasses import replace

    path, t = _path(spark, "noise"), placed(spark, d)
    ingest.save_table(detection.noise_thresholds(t, replace(SCALED, noise_mult_step=2.0, noise_mult_cum=2.0)), path, None)
    return scoring.detected(t, SCALED, spark.read.parquet(path)).select(*KEYS[:3], "duration_min", "drop_gal", "min_step_gal", "pattern", "n_negative_steps")


_IN_TIME = EV.replace(" FROM events)", f" FROM events WHERE NOT ({q_models.LATE}))", 1)


@query("i11_stream_driver", f"WITH RECURSIVE {_IN_TIME}, {_kept('ev')} SELECT {_EVENT}, CAST(least(drop_gal / 100, 0.99) >= 0.5 AS INT) AS is_theft FROM nms")
def i11(spark, d):
    """Telemetry as a stream, one part after another, each a batch: events of the segments that have closed, scored batch by batch.

    The second part brings every fiftieth row long after its time; what the watermark drops takes no part.
    """
    first, second, last = q_models._timed(spark, d, telemetry(spark, d), late=True)
    middle = first.agg(F.percentile_approx("timestamp", 0.5, 100).alias("_middle"))
    halves = first.join(F.broadcast(middle))
    parts = [halves.where("timestamp <= _middle").drop("_middle"), halves.where("timestamp > _middle").drop("_middle"), second, last]
    src, out, state, noise = (_path(spark, n) for n in ("in", "out", "state", "noise"))
    known = ingest.union([first, second.where(F.col("timestamp") > F.lit(first.agg(F.max("timestamp")).first()[0]))])
    ingest.save_table(detection.noise_thresholds(segments.with_segment(signal.derive(known, SCALED), SCALED), SCALED), noise, None)
    score = lambda e, rows: scoring.decide(e.withColumn("score", F.least(F.col("drop_gal") / 100, F.lit(0.99))))
    for part in parts:
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(part.schema).parquet(src)
        streams.detect_batches(stream, spark.read.parquet(noise), score, out, state, SCALED)
    return spark.read.parquet(f"{out}/events").select(*KEYS[:3], "duration_min", "drop_gal", "min_step_gal", "pattern", "n_negative_steps", "is_theft")


#: Thresholds from training rows, then all rows of the events.
_TRAINED = EV.replace("FROM placed WHERE stationary_on", "FROM placed JOIN cuts USING (vehicle_id) WHERE stationary_on AND timestamp <= cut").replace("FROM placed WHERE ign_off", "FROM placed JOIN cuts USING (vehicle_id) WHERE ign_off AND timestamp <= cut").replace("pv AS (", f"{SPLIT}, pv AS (", 1)
_MIDT = "make_timestamp((epoch_us(e.start_time) + epoch_us(e.end_time)) // 2)"
_ON = "t.vehicle_id = e.vehicle_id AND t.timestamp >= e.start_time AND t.timestamp <= e.end_time"

SQL["d10_detection_job"] = f"""WITH RECURSIVE {_TRAINED}, {_SPOTS}, {_SIDES.split(', te AS')[0]}, {_dbscan('tr')}, {_nearest('pts')}, pc AS (SELECT pts.*, coalesce(nr.cluster_id, -1) AS cluster_id FROM pts LEFT JOIN nr USING (event_id)), {_kept('ev')},
    k AS (SELECT e.vehicle_id, e.start_time, e.end_time, e.pattern, t.cluster_id, count(*) AS c FROM nms e JOIN pc t ON {_ON} GROUP BY ALL),
    kb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, start_time, end_time, pattern ORDER BY c DESC, cluster_id) AS o FROM k) WHERE o = 1),
    ly AS (SELECT e.vehicle_id, e.start_time, e.end_time, e.pattern, max(t.stationary_drain) AS y FROM nms e JOIN der t ON {_ON} GROUP BY ALL)
    SELECT e.vehicle_id, e.start_time, e.end_time, e.pattern, round(e.drop_gal, 6) AS drop_gal, coalesce(kb.cluster_id, -1) AS cluster_id, coalesce(kb.c, 0) AS cluster_points, CAST(coalesce(kb.cluster_id, -1) >= 0 AS INT) AS is_hotspot, coalesce({_MIDT} <= cut, false) AS is_train, ly.y,
        round(ln(1 + e.duration_min), 6) AS log_duration, CAST(isodow({_MIDT}) >= 6 AS INT) AS is_weekend
    FROM nms e LEFT JOIN kb USING (vehicle_id, start_time, end_time, pattern) LEFT JOIN ly USING (vehicle_id, start_time, end_time, pattern) LEFT JOIN cuts ON cuts.vehicle_id = e.vehicle_id"""


@query("d10_detection_job", SQL["d10_detection_job"])
def d10(spark, d):
    e = jobs.detection_job(signal.derive(telemetry(spark, d), SCALED), _path(spark, "job"), SCALED, SMALL)
    return e.select(*KEYS, "drop_gal", "cluster_id", "cluster_points", "is_hotspot", "is_train", "y", "log_duration", "is_weekend")


@query("m1_preprocessing", f"WITH {EV} SELECT vehicle_id, start_time, end_time, pattern, round(drop_gal / stddev_samp(drop_gal) OVER (), 5) AS drop_scaled, round(duration_min / stddev_samp(duration_min) OVER (), 5) AS duration_scaled, CAST(n_negative_steps % 2 AS DOUBLE) AS flag, CAST(1 AS DOUBLE) AS one_hot FROM ev")
def m1(spark, d):
    """Scaled without centring; the flag passes through; one place of the pattern's is set."""
    e = found(spark, d).withColumn("flag", F.col("n_negative_steps") % 2)
    out = Pipeline(stages=models.preprocessing(["drop_gal", "duration_min"], ["flag"], ["pattern"])).fit(e).transform(e).withColumn("x", vector_to_array("features"))
    return out.select(*KEYS, F.round(F.col("x")[0], 5).alias("drop_scaled"), F.round(F.col("x")[1], 5).alias("duration_scaled"), F.col("x")[2].alias("flag"), F.aggregate(F.slice("x", 4, 9), F.lit(0.0), lambda a, v: a + v).alias("one_hot"))


@query("m9_tolerant_training", f"WITH {EV} SELECT vehicle_id, start_time, end_time, pattern, 'logistic' AS fitted, 'broken' AS failed FROM ev")
def m9(spark, d):
    """A model that cannot be fitted does not stop the others; the failure is told by name."""
    from pyspark.ml.classification import LogisticRegression

    s = q_models._set(spark, d)
    m = models.train_all(s, NUM, BIN, ["pattern"], q_models.FOLDS, False, ["logistic"], {"broken": LogisticRegression(labelCol="absent")})
    keys = s.select("event_key", *KEYS)
    return models.predict(m, s).drop("pattern").join(large(keys), "event_key").select(*KEYS, F.col("model").alias("fitted"), F.lit(",".join(sorted(m.failures))).alias("failed"))


_ONE = "sc AS (SELECT event_id, grp, score, CASE WHEN grp = 3 THEN 1 WHEN grp = 4 THEN 0 ELSE y END AS y FROM sc0)"


@query("m30_guards", f"WITH {SC.replace('sc AS', 'sc0 AS', 1)}, {_ONE}, {_cv('grp')} SELECT grp, round(CASE WHEN any_value(pos) > 0 AND any_value(neg) > 0 THEN sum(precision * p / nullif(pos, 0)) ELSE 0 END, 6) AS pr_auc, any_value(pos) > 0 AND any_value(neg) > 0 AS has_threshold FROM cr GROUP BY grp")
def m30(spark, d):
    """Groups of one class: no average precision, no threshold at a false positive rate."""
    s = scored(spark, d).withColumn("y", F.when(F.col("grp") == 3, 1).when(F.col("grp") == 4, 0).otherwise(F.col("y")))
    t = metrics.threshold_at_fpr(s, by=["grp"]).select("grp", F.lit(True).alias("has_threshold"))
    return metrics.average_precision(s, ["grp"]).join(t, "grp", "left").withColumn("has_threshold", F.coalesce("has_threshold", F.lit(False)))


@query("i2_standardise_if_needed", "SELECT CAST(user_id AS VARCHAR) AS vehicle_id, date_trunc('second', ts) AS timestamp, round(value, 6) AS total_fuel_gal FROM events UNION ALL SELECT CAST(user_id AS VARCHAR), date_trunc('second', ts), round(value, 6) FROM events")
def i2(spark, d):
    """A raw table is standardised, a standard one stays as it is."""
    keep = ["vehicle_id", "timestamp", "total_fuel_gal"]
    own = telemetry(spark, d)
    assert scoring.ensure_standard(own) is own
    return ingest.union([scoring.ensure_standard(ingest.read_csv(spark, _csv(spark, d))).select(*keep), own.select("vehicle_id", F.date_trunc("second", "timestamp").alias("timestamp"), "total_fuel_gal")])


@query("i14_required_features", f"WITH {EV} SELECT name, CAST(place AS INT) AS place, CAST((SELECT count(*) FROM ev) AS BIGINT) AS n_filled FROM (VALUES {', '.join(f'({k}, {chr(39)}{c}{chr(39)})' for k, c in enumerate(sorted([*NUM, 'pattern', *BIN])))}) v(place, name)")
def i14(spark, d):
    """The list that a fitted pipeline names itself, each with the events that have a value of it once it is filled."""
    s = q_models._set(spark, d)
    names = sorted(scoring.required_features(Pipeline(stages=models.preprocessing(NUM, BIN, ["pattern"])).fit(s)))
    filled = scoring.fill_features(s, names).agg(*[F.count(c).alias(c) for c in names])
    return filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(k).alias("place"), F.col(c).alias("n_filled")) for k, c in enumerate(names)])).alias("r")).select("r.*")


@query("v17_compatible", f"WITH {EV} SELECT vehicle_id, start_time, end_time, pattern, CASE WHEN drop_gal > 40 THEN 'missing features: drop_gal, is_night' ELSE '' END AS error FROM ev")
def v17(spark, d):
    """Events with a large drop are offered without two columns that the model reads."""
    s = q_models._set(spark, d)
    model = Pipeline(stages=models.preprocessing(NUM, BIN, ["pattern"])).fit(s)

    def error(df):
        try:
            models.compatible(model, df)
            return ""
        except ValueError as e:
            return str(e)

    big, rest = s.where("drop_gal > 40"), s.where("drop_gal <= 40")
    return big.select(*KEYS, F.lit(error(big.drop("drop_gal", "is_night"))).alias("error")).union(rest.select(*KEYS, F.lit(error(rest)).alias("error")))


def _artefacts(spark, d, conditioned=None) -> scoring.Artefacts:
    """A model fitted on training events, with the training's norms, noise (of ``conditioned`` rows if there are any) and the
    thresholds of its own scores by pattern, stored and loaded."""
    s = q_models._set(spark, d)
    train = s.where("is_train")
    model = Pipeline(stages=[*models.preprocessing(NUM, BIN, ["pattern"]), models.logistic(s.count())]).fit(models.balanced(train))
    t, path = placed(spark, d) if conditioned is None else conditioned, _path(spark, "artefacts")
    thresholds = metrics.threshold_nearest_fpr(models.predict({"logistic": model}, train), 0.05, ["pattern"])
    scoring.Artefacts(model, features.fit_norms(train), detection.noise_thresholds(t, SCALED), thresholds).save(path)
    return scoring.Artefacts.load(spark, path, hours=96)


@query("s11_model_round_trip", f"WITH {EV} SELECT vehicle_id, start_time, end_time, pattern, true AS same, true AS within FROM ev")
def s11(spark, d):
    """Scores of a calibrated model before it was stored and after it was loaded."""
    s, path = q_models._set(spark, d), _path(spark, "calibrated")
    model = models.calibrate(s, [*models.preprocessing(NUM, BIN, ["pattern"]), models.logistic(s.count())], q_models.FOLDS)
    models.save(model, path)
    before, after = (m.transform(s).select("event_key", F.col("score").alias(n)) for m, n in ((model, "b"), (models.load(path), "a")))
    return s.select("event_key", *KEYS).join(large(before), "event_key").join(large(after), "event_key").select(*KEYS, (F.abs(F.col("a") - F.col("b")) < 1e-9).alias("same"), F.col("a").between(0, 1).alias("within"))


@query("i12_load_artefacts", f"WITH {SEG}, {THR} SELECT vehicle_id, state, round(step_gal, 6) AS step_gal, round(cum_gal, 6) AS cum_gal, true AS thresholds_hold FROM thr")
def i12(spark, d):
    """The noise table, and whether the pattern thresholds are those that the loaded model's own scores give."""
    a = _artefacts(spark, d)
    again = metrics.threshold_nearest_fpr(models.predict({"logistic": a.model}, q_models._set(spark, d).where("is_train")), 0.05, ["pattern"]).withColumnRenamed("threshold", "again")
    hold = a.thresholds.join(again, "pattern", "full").agg(F.bool_and(F.coalesce(F.abs(F.col("threshold") - F.col("again")) < 1e-9, F.lit(False))).alias("thresholds_hold"))
    return a.noise.join(F.broadcast(hold))


def _conditioned(time: str) -> str:
    """SQL of the conditioning, over one row for each vehicle and time, with its rows by these instead of by an id."""
    return q_basic.SQL["t10_preprocess"].replace(GAPS, _once(time)).replace("SELECT event_id, round(total_fuel_gal, 6)", "SELECT vehicle_id, timestamp, round(total_fuel_gal, 6)")


def _once(time: str) -> str:
    rows = _sql(False).replace("ts AS timestamp", f"{time} AS timestamp", 1)
    return f"""every AS ({rows}), gaps AS (SELECT * EXCLUDE _n FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, timestamp ORDER BY total_fuel_gal DESC NULLS LAST, speed_kmh NULLS LAST, latitude NULLS LAST, longitude NULLS LAST) AS _n FROM every) WHERE _n = 1)"""


#: Events of telemetry that a CSV of whole seconds holds, conditioned first.
_FROM_FILES = EV.replace(TEL, f"""{_once("date_trunc('second', ts)")}, {q_basic.RATE}, {q_basic.MAD.format(src='rated')}, {q_basic.FILL.format(src='robust').replace('st AS (', 'st0 AS (', 1).replace('FROM st)', 'FROM st0)', 1)},
    tel AS (SELECT vehicle_id, timestamp, total_fuel_gal, speed_kmh, ignition, latitude, longitude, stationary_drain, event_id FROM filled)""")


@query("i13_preprocess_at_scoring", _conditioned("date_trunc('second', ts)"))
def i13(spark, d):
    """Raw rows through the training's own conditioning."""
    return scoring.prepared(ingest.read_csv(spark, _csv(spark, d)), SCALED).select("vehicle_id", "timestamp", "total_fuel_gal", "dfuel", "fuel_med5")


@query("j2_combine", _conditioned("ts"))
def j2(spark, d):
    """Two sources with the same rows, one of which lacks values and a column: numbers win over missing ones, then all is conditioned."""
    parts = [telemetry(spark, d), telemetry(spark, d, gaps=True).drop("stationary_drain")]
    return ingest.combine(parts, F.lit("2100-01-01").cast("timestamp"), SCALED).select("vehicle_id", "timestamp", "total_fuel_gal", "dfuel", "fuel_med5")


@query("s10_report_sink", q_basic.SQL["v9_report"])
def s10(spark, d):
    """The whole quality report, from the JSON that it was stored as."""
    path, report = _path(spark, "report"), quality.quality_report(q_basic.twice(spark, d))
    ingest.save_report(report, path)
    return spark.read.schema(report.schema).option("timestampFormat", ingest.MICROSECONDS).json(path)


@query("i4_fill_features", f"WITH {EV} SELECT vehicle_id, start_time, end_time, CASE WHEN n_negative_steps % 2 = 0 THEN 0.0 ELSE round(drop_gal, 6) END AS drop_gal, CASE WHEN n_negative_steps % 3 = 0 THEN 'unknown' ELSE pattern END AS pattern, 0.0 AS absent, round(duration_min, 6) AS duration_min FROM ev")
def i4(spark, d):
    """Nulls among numbers and words, and a column that is not there, are filled; what has a value keeps it."""
    e = found(spark, d).withColumns({"drop_gal": F.when(F.col("n_negative_steps") % 2 != 0, F.col("drop_gal")), "pattern": F.when(F.col("n_negative_steps") % 3 != 0, F.col("pattern"))})
    return scoring.fill_features(e, ["drop_gal", "absent", "pattern", "duration_min"]).select(*KEYS[:3], "drop_gal", "pattern", "absent", "duration_min")


#: Test and training events by pattern, and the patterns that get a model of their own.
_SIDED = f"{EV}, {SPLIT}, {TRAIN}, {LAB}, sided AS (SELECT m.*, y FROM mapped m JOIN lab USING (vehicle_id, start_time, end_time, pattern)), own AS (SELECT pattern FROM sided WHERE is_train GROUP BY pattern HAVING count(*) >= 30 AND sum(y) >= 5)"
_NAMES = ["logistic", "random_forest", "boosted"]
_EACH = ", ".join(f"('{n}')" for n in _NAMES)


def _job(spark, d, out: str) -> jobs.Trained:
    return jobs.training_job(q_models._set(spark, d), out, NUM, BIN, _NAMES, q_models.FOLDS)


@query("m32_training_job", f"""WITH {_SIDED} SELECT v.model, pattern, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, true AS within, true AS threshold_holds FROM sided, (VALUES {_EACH}) v(model) WHERE NOT is_train GROUP BY ALL
    UNION ALL SELECT 'own', pattern, count(*), CAST(sum(y) AS BIGINT), true, true FROM sided JOIN own USING (pattern) WHERE NOT is_train GROUP BY pattern""")
def m32(spark, d):
    """What the job has stored: test rows by model and pattern, scores of 0 to 1, and thresholds that these give again."""
    out = _path(spark, "trained")
    _job(spark, d, out).models.complete()
    scores, own = spark.read.parquet(f"{out}/scores"), spark.read.parquet(f"{out}/pattern_scores")
    best = spark.read.parquet(f"{out}/evaluation").orderBy(F.desc("pr_auc"), "model").select("model").limit(1)
    again = lambda rows: metrics.threshold_nearest_fpr(rows, 0.05, ["pattern"]).withColumnRenamed("threshold", "again")
    hold = lambda stored, rows: stored.join(again(rows), "pattern").select("pattern", (F.abs(F.col("threshold") - F.col("again")) < 1e-9).alias("threshold_holds"))
    sums = lambda rows: rows.groupBy("model", "pattern").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"), F.min(F.col("score").between(0, 1)).alias("within"))
    globals_ = sums(scores).join(hold(spark.read.parquet(f"{out}/pattern_thresholds"), scores.join(best, "model", "left_semi")), "pattern")
    return globals_.unionByName(sums(own.withColumn("model", F.lit("own"))).join(hold(spark.read.parquet(f"{out}/pattern_results").select("pattern", "threshold"), own), "pattern")).select("model", "pattern", "n", "positives", "within", "threshold_holds")


SQL["m11_pattern_models"] = f"WITH {_SIDED} SELECT pattern, count(*) FILTER (is_train) AS n_train, count(*) FILTER (NOT is_train) AS n_test, CAST(coalesce(sum(y) FILTER (NOT is_train), 0) AS BIGINT) AS positives, true AS within, true AS adds_up FROM sided JOIN own USING (pattern) GROUP BY pattern"


@query("m33_evaluation_job", f"""WITH {EV}, {SPLIT}, {TRAIN}, {LAB}, sided AS (SELECT m.*, y FROM mapped m JOIN lab USING (vehicle_id, start_time, end_time, pattern) WHERE NOT is_train), p AS (SELECT pattern, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM sided GROUP BY pattern HAVING count(*) >= 10 AND count(DISTINCT y) = 2)
    SELECT 'pattern' AS part, pattern AS name, n, positives, true AS holds FROM p UNION ALL SELECT 'best', 'model', count(*), CAST(sum(y) AS BIGINT), true FROM sided
    UNION ALL SELECT 'calibration', 'ece', count(*), CAST(sum(y) AS BIGINT), true FROM sided UNION ALL SELECT 'top', 'scores', least(100, count(*)), CAST(0 AS BIGINT), true FROM sided""")
def m33(spark, d):
    """The job's four tables: each pattern's report, the best model's, its calibration, and its highest scores."""
    scores = q_models._scores(spark, d, ("logistic", "boosted"))
    e = jobs.evaluation_job(scores)
    whole = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    row = lambda df, part, name, n, positives, holds: df.agg(F.lit(part).alias("part"), F.lit(name).alias("name"), n.cast("long").alias("n"), positives.cast("long").alias("positives"), F.bool_and(holds).alias("holds"))
    own = scores.join(F.broadcast(e.best.select("model")), "model", "left_semi")
    best_ap = metrics.average_precision(scores, ["model"]).agg(F.max("pr_auc")).first()[0]
    each = own.agg(F.count("*").alias("_n"), F.sum("y").alias("_p"))
    bins = metrics.calibration_bins(own, 10).withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))
    ece = bins.agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("_e"))
    per = e.per_pattern.select(F.lit("pattern").alias("part"), F.col("pattern").alias("name"), whole.alias("n"), (F.col("tp") + F.col("fn")).alias("positives"), F.col("pr_auc").between(0, 1).alias("holds"))
    best = row(e.best, "best", "model", F.max(whole), F.max(F.col("tp") + F.col("fn")), F.abs(F.col("pr_auc") - best_ap) < 1e-9)
    calibration = row(e.calibration.join(F.broadcast(ece)).join(F.broadcast(each)), "calibration", "ece", F.max("_n"), F.max("_p"), F.abs(F.col("ece") - F.col("_e")) < 1e-9)
    least = e.top.agg(F.min("score").alias("_least"), F.count("*").alias("_k"))
    above = own.join(F.broadcast(least)).agg(F.count_if(F.col("score") > F.col("_least")).alias("_above"), F.max("_k").alias("_k"))
    highest = row(above, "top", "scores", F.max("_k"), F.lit(0), F.col("_above") <= F.col("_k"))
    return ingest.union([per, best, calibration, highest])


@query("s12_batch_inference", f"""WITH RECURSIVE {_FROM_FILES}, {_kept('ev')} SELECT v.s AS source, vehicle_id, start_time, end_time, pattern, round(drop_gal, 6) AS drop_gal, CAST(NULL AS VARCHAR) AS error FROM nms, (VALUES ('one'), ('two')) v(s)
    UNION ALL SELECT 'bad', NULL, NULL, NULL, NULL, NULL, 'no timestamp column' UNION ALL SELECT 'absent', NULL, NULL, NULL, NULL, NULL, 'not found'""")
def s12(spark, d):
    """Two sources, each scored by itself; one without a time column and one that is not there have no events."""
    base, path = _path(spark, "files"), _csv(spark, d)
    raw = spark.read.csv(path, header=True)
    for name in ("one", "two"):
        raw.write.csv(f"{base}/{name}", header=True)
    raw.select("ref").write.csv(f"{base}/bad", header=True)
    events, failed = jobs.score_files(spark, [f"{base}/{n}" for n in ("one", "two", "bad", "absent")], _artefacts(spark, d, scoring.prepared(ingest.read_csv(spark, path), SCALED)), SCALED, _path(spark, "scored"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("vehicle_id", "string"), ("start_time", "timestamp"), ("end_time", "timestamp"), ("pattern", "string"), ("drop_gal", "double"))]
    return events.select("source", *KEYS, "drop_gal", F.lit(None).cast("string").alias("error")).union(failed.select("source", *none, "error"))


def _part(sql: str) -> str:
    rest = sql.removeprefix(f"WITH {EV}").strip()
    return f"WITH {rest[1:]}" if rest.startswith(",") else rest


_MATRIX = {"f1_statistics": ["n_points", "median_dt_s", "mean_step_neg", "p95_abs_dfuel", "median_speed", "pct_ign_on"], "f2_durations": ["duration_hours", "log_duration"], "f3_clock": ["hour_sin", "hour_cos", "weekday", "is_weekend", "is_night"], "f4_spacing": ["time_since_last_event_hours", "is_first_event_of_day"], "f6_location": ["lat_std", "lon_std", "coord_range_km"], "f10_pre_event": ["pre_event_avg_speed", "pre_event_moving_pct", "pre_event_fuel_change"], "f11_variability": ["speed_std", "speed_max", "movement_variability"]}
_K = "vehicle_id, start_time, end_time, pattern"
_STEPS = hav("lag(latitude) OVER w", "lag(longitude) OVER w", "latitude", "longitude")
_WHOLE = ", ".join(f"m{k} AS ({_part(q_events.SQL[name])})" for k, name in enumerate(_MATRIX)) + f""",
    wt AS (SELECT e.vehicle_id, e.start_time, e.end_time, e.pattern, {_STEPS} AS km FROM ev e JOIN der t ON t.vehicle_id = e.vehicle_id AND t.timestamp >= e.start_time AND t.timestamp <= e.end_time WINDOW w AS (PARTITION BY e.vehicle_id, e.start_time, e.end_time, e.pattern ORDER BY t.timestamp)),
    wk AS (SELECT {_K}, round(coalesce(sum(km), 0), 6) AS window_trip_km FROM wt GROUP BY {_K}),
    pt AS (SELECT e.vehicle_id, e.start_time, e.end_time, e.pattern, {_STEPS} AS km FROM ev e JOIN tel t ON t.vehicle_id = e.vehicle_id AND t.timestamp >= e.start_time - INTERVAL 96 HOUR AND t.timestamp < e.start_time WINDOW w AS (PARTITION BY e.vehicle_id, e.start_time, e.end_time, e.pattern ORDER BY t.timestamp)),
    pk AS (SELECT {_K}, CASE WHEN count(*) >= 5 THEN round(coalesce(sum(km), 0), 6) ELSE 0 END AS pre_event_distance_km FROM pt GROUP BY {_K}), {LAB},
    mx AS (SELECT {_K}, round(drop_gal, 6) AS drop_gal, round(duration_min, 6) AS duration_min, round(min_step_gal, 6) AS min_step_gal, ev.n_negative_steps, round(drop_gal / (duration_min + 1e-6), 6) AS rate_gpm, {", ".join(f"m{k}.{c}" for k, cols in enumerate(_MATRIX.values()) for c in cols)}, window_trip_km, coalesce(pre_event_distance_km, 0) AS pre_event_distance_km, lab.y
        FROM ev {" ".join(f"JOIN m{k} USING ({_K})" for k in range(len(_MATRIX)))} JOIN wk USING ({_K}) LEFT JOIN pk USING ({_K}) JOIN lab USING ({_K}))"""


@query("f16_matrix", f"WITH {EV}, {_WHOLE} SELECT * FROM mx")
def f16(spark, d):
    e, t = found(spark, d), placed(spark, d)
    rows = features.labels(features.FeatureBuilder(hours=96).base(e, t), t)
    whole = features.matrix(rows, KEYS)
    return whole.select(*[c for c in whole.columns if c not in ("event_key", *KEYS)], *KEYS)


_Z = ["drop_gal", "duration_min", "n_negative_steps", "rate_gpm"]


@query("f15_feature_pipeline", f"""WITH {EV}, {_WHOLE}, {SPLIT}, side AS (SELECT mx.* REPLACE (e.drop_gal AS drop_gal, e.duration_min AS duration_min, e.drop_gal / (e.duration_min + 1e-6) AS rate_gpm), coalesce({_MIDT} <= cut, false) AS is_train FROM mx JOIN ev e USING ({_K}) LEFT JOIN cuts USING (vehicle_id)),
    nm AS (SELECT vehicle_id, {", ".join(f"avg({c}) AS {c}_m, CASE WHEN stddev_samp({c}) > 1e-9 THEN stddev_samp({c}) ELSE 1e-6 END AS {c}_s" for c in _Z)} FROM side WHERE is_train GROUP BY vehicle_id),
    fu AS (SELECT vehicle_id, avg(total_fuel_gal) AS a, max(total_fuel_gal) AS b FROM der GROUP BY vehicle_id)
    SELECT {_K}, {", ".join(f"round(coalesce(({c} - {c}_m) / {c}_s, 0), 2) AS {c}_vehicle_zscore" for c in _Z)}, round(drop_gal / (a + 1e-6), 5) AS drop_vs_avg, round(drop_gal / (b + 1e-6), 5) AS drop_vs_capacity, coord_range_km, pre_event_avg_speed, movement_variability
    FROM side LEFT JOIN nm USING (vehicle_id) LEFT JOIN fu USING (vehicle_id)""")
def f15(spark, d):
    """Where a vehicle's training events have no spread, a millionth stands for it, so that scores may be large."""
    e, t = mapped(spark, d), placed(spark, d)
    out = features.FeatureBuilder(hours=96).fit(e, t).transform(e, t)
    return out.select(*KEYS, *[F.round(f"{c}_vehicle_zscore", 2).alias(f"{c}_vehicle_zscore") for c in _Z], F.round("drop_vs_avg", 5).alias("drop_vs_avg"), F.round("drop_vs_capacity", 5).alias("drop_vs_capacity"), "coord_range_km", "pre_event_avg_speed", "movement_variability")
