"""Queries of parsing, validation and signal operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankwatch.functions import geo, parse, stats
from tankwatch.operators import quality, reports, signal
from tankwatch.plans.telemetry import GAPS, SCALED, TEL, events, telemetry

QUERIES: dict = {}
SQL: dict = {}


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six digits, so that the order of a sum does not show."""
    return df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: r6(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return put


def text_of(c: Column) -> Column:
    return c.cast("string")


#: Texts as sources write them, from the numbers of an event.
RAW = """raw AS (SELECT event_id,
    CASE WHEN event_id % 11 = 0 THEN 'invalid' WHEN event_id % 7 = 0 THEN NULL ELSE CAST(user_id % 90 AS VARCHAR) || '.5, -' || CAST(event_id % 180 AS VARCHAR) || '.25, x' END AS coords,
    CASE WHEN event_id % 9 = 0 THEN 'n/a' WHEN event_id % 2 = 0 THEN CAST(event_id % 130 AS VARCHAR) || ' km/h' ELSE CAST(event_id % 130 AS VARCHAR) || '.5' END AS speed,
    CASE event_id % 8 WHEN 0 THEN 'ON' WHEN 1 THEN 'off' WHEN 2 THEN 'Encendido' WHEN 3 THEN 'apagado ' WHEN 4 THEN '2' WHEN 5 THEN '0.0' WHEN 6 THEN 'what' END AS ign,
    CASE event_id % 5 WHEN 0 THEN '1' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'sí' WHEN 3 THEN 'no' END AS lab,
    CASE WHEN event_id % 6 = 0 THEN 'empty' ELSE CAST(event_id % 50 AS VARCHAR) || '.25' END AS tank_left,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 40 AS VARCHAR) END AS tank_right,
    CASE event_id % 3 WHEN 0 THEN 'V' || CAST(user_id AS VARCHAR) || '_2025 Jun.csv' WHEN 1 THEN 'unit' || CAST(user_id AS VARCHAR) || '-a.csv' ELSE '(old) ' || CAST(user_id AS VARCHAR) || '.csv' END AS file,
    value, ts, user_id FROM events)"""


def raw(spark, sf_dir: str) -> DataFrame:
    e, u, v = F.col("event_id"), F.col("user_id").cast("string"), F.col("event_id").cast("string")
    pick = lambda n, values: F.get(F.array(*[F.lit(x) for x in values]), (e % n).cast("int"))
    return events(spark, sf_dir).select(
        "event_id",
        F.when(e % 11 == 0, "invalid").when(e % 7 == 0, None).otherwise(F.concat((F.col("user_id") % 90).cast("string"), F.lit(".5, -"), (e % 180).cast("string"), F.lit(".25, x"))).alias("coords"),
        F.when(e % 9 == 0, "n/a").when(e % 2 == 0, F.concat((e % 130).cast("string"), F.lit(" km/h"))).otherwise(F.concat((e % 130).cast("string"), F.lit(".5"))).alias("speed"),
        pick(8, ["ON", "off", "Encendido", "apagado ", "2", "0.0", "what", None]).alias("ign"),
        pick(5, ["1", "TRUE", "sí", "no", None]).alias("lab"),
        F.when(e % 6 == 0, "empty").otherwise(F.concat((e % 50).cast("string"), F.lit(".25"))).alias("tank_left"),
        F.when(e % 4 != 0, (e % 40).cast("string")).alias("tank_right"),
        F.when(e % 3 == 0, F.concat(F.lit("V"), u, F.lit("_2025 Jun.csv"))).when(e % 3 == 1, F.concat(F.lit("unit"), u, F.lit("-a.csv"))).otherwise(F.concat(F.lit("(old) "), u, F.lit(".csv"))).alias("file"),
        "value", "ts", "user_id", v.alias("_v"),
    ).drop("_v")


@query("p4_coordinates", f"""WITH {RAW}, s AS (SELECT event_id, try_cast(trim(split_part(coords, ',', 1)) AS DOUBLE) AS a, try_cast(trim(split_part(coords, ',', 2)) AS DOUBLE) AS b FROM raw)
    SELECT event_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round(a, 6) END AS latitude, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round(b, 6) END AS longitude FROM s""")
def p4(spark, d):
    lat, lon = parse.coordinates(F.col("coords"))
    return raw(spark, d).select("event_id", lat.alias("latitude"), lon.alias("longitude"))


@query("p5_speed", f"WITH {RAW} SELECT event_id, try_cast(nullif(regexp_extract(speed, '([-+]?[0-9]*\\.?[0-9]+)', 1), '') AS DOUBLE) AS speed_kmh FROM raw")
def p5(spark, d):
    return raw(spark, d).select("event_id", parse.speed(F.col("speed")).alias("speed_kmh"))


@query("p6_ignition", f"""WITH {RAW}, w AS (SELECT event_id, CASE event_id % 10 WHEN 1 THEN 'y' WHEN 3 THEN 's' WHEN 5 THEN 'YES' WHEN 7 THEN 'n' WHEN 9 THEN 'Sí' ELSE ign END AS ign FROM raw)
    SELECT event_id, coalesce(CASE WHEN lower(trim(ign)) IN ('1', 'true', 'on', 'encendido', 'si', 'sí', 'yes') THEN true
    WHEN lower(trim(ign)) IN ('0', 'false', 'off', 'apagado', 'no') THEN false ELSE try_cast(trim(ign) AS DOUBLE) > 0 END, false) AS ignition FROM w""")
def p6(spark, d):
    e = F.col("event_id") % 10
    word = F.when(e == 1, "y").when(e == 3, "s").when(e == 5, "YES").when(e == 7, "n").when(e == 9, "Sí").otherwise(F.col("ign"))
    return raw(spark, d).select("event_id", parse.ignition(word).alias("ignition"))


@query("p7_timestamp", "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE date_trunc('second', ts) END AS timestamp FROM events")
def p7(spark, d):
    e, t = F.col("event_id"), F.col("ts").cast("timestamp")
    text = F.when(e % 13 == 0, "someday").when(e % 3 == 0, F.date_format(t, "dd.MM.yyyy HH:mm:ss")).when(e % 3 == 1, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(t, "dd/MM/yyyy HH:mm:ss"))
    return events(spark, d).select("event_id", parse.timestamp(text).alias("timestamp"))


@query("p8_label", f"WITH {RAW} SELECT event_id, CASE WHEN lower(trim(lab)) IN ('1','true','yes','si','sí') THEN 1 ELSE 0 END AS label FROM raw")
def p8(spark, d):
    return raw(spark, d).select("event_id", parse.label(F.col("lab")).alias("label"))


@query("p9_tanks", f"WITH {RAW} SELECT event_id, coalesce(try_cast(tank_left AS DOUBLE), 0) + coalesce(try_cast(tank_right AS DOUBLE), 0) AS total_fuel_gal FROM raw")
def p9(spark, d):
    return raw(spark, d).select("event_id", parse.tanks(F.col("tank_left"), F.col("tank_right")).alias("total_fuel_gal"))


@query("p10_utc", "SELECT event_id, date_trunc('second', ts) AS timestamp FROM events")
def p10(spark, d):
    t = F.col("ts").cast("timestamp")
    zoned = F.concat(F.date_format(t + F.expr("interval 5 hours"), "yyyy-MM-dd HH:mm:ss"), F.lit("+05:00"))
    return events(spark, d).select("event_id", parse.utc(F.when(F.col("event_id") % 2 == 0, zoned).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss"))).alias("timestamp"))


@query("p11_time_profile", """SELECT count(*) AS n, count(t) AS n_valid, count(*) - count(t) AS n_null, min(t) AS first, max(t) AS last FROM (
    SELECT CASE WHEN event_id % 13 = 0 THEN NULL ELSE date_trunc('second', ts) END AS t FROM events)""")
def p11(spark, d):
    text = F.when(F.col("event_id") % 13 == 0, "someday").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    return events(spark, d).select(text.alias("t")).agg(*parse.time_profile(F.col("t")))


@query("p12_unique_names", "SELECT event_id AS a, user_id AS a__dup1, value AS b FROM events")
def p12(spark, d):
    return parse.unique_names(events(spark, d).select(F.col("event_id").alias("a"), F.col("user_id").alias("a"), F.round("value", 6).alias("b")))


@query("p13_column_kinds", "SELECT * FROM (VALUES ('vehicle_id','categorical'),('total_fuel_gal','numeric'),('speed_kmh','numeric'),('ignition','binary'),('stationary_drain','binary')) t(\"column\", kind)")
def p13(spark, d):
    return parse.column_kinds(telemetry(spark, d).select("vehicle_id", "total_fuel_gal", "speed_kmh", "ignition", "stationary_drain"))


@query("s6_vehicle_from_name", f"""WITH {RAW}, b AS (SELECT event_id, regexp_replace(file, '\\.[^.]*$', '') AS base FROM raw), f AS (SELECT *, regexp_split_to_array(base, '[_\\s\\-.]')[1] AS head FROM b)
    SELECT event_id, CASE WHEN regexp_full_match(head, '[A-Za-z0-9]+') THEN head ELSE replace(base, ' ', '_') END AS vehicle_id FROM f""")
def s6(spark, d):
    return raw(spark, d).select("event_id", parse.vehicle_from_name(F.col("file")).alias("vehicle_id"))


TWICE = "twice AS (SELECT * FROM gaps UNION ALL SELECT * REPLACE (total_fuel_gal + 1 AS total_fuel_gal) FROM gaps WHERE event_id % 10 = 0)"


def twice(spark, d):
    g = telemetry(spark, d, gaps=True)
    return g.union(g.where("event_id % 10 = 0").withColumn("total_fuel_gal", F.col("total_fuel_gal") + 1))


_first = "SELECT vehicle_id, timestamp, round(total_fuel_gal, 6) AS total_fuel_gal, round(speed_kmh, 6) AS speed_kmh FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, timestamp ORDER BY total_fuel_gal DESC NULLS {n}, speed_kmh NULLS LAST, latitude NULLS LAST, longitude NULLS LAST) AS k FROM twice) WHERE k = 1"


@query("v1_clean", f"WITH {GAPS}, {TWICE} {_first.format(n='LAST')}")
def v1(spark, d):
    return quality.clean(twice(spark, d)).select("vehicle_id", "timestamp", "total_fuel_gal", "speed_kmh")


@query("v2_dedup_sources", f"WITH {GAPS}, {TWICE} {_first.format(n='LAST')}")
def v2(spark, d):
    return quality.dedup_sources(twice(spark, d)).select("vehicle_id", "timestamp", "total_fuel_gal", "speed_kmh")


@query("v3_duplicates", f"WITH {GAPS}, {TWICE}, c AS (SELECT count(*) AS c FROM twice GROUP BY vehicle_id, timestamp) SELECT CAST(sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS BIGINT) AS n_in_groups, CAST(sum(c - 1) AS BIGINT) AS n_removed FROM c")
def v3(spark, d):
    return quality.duplicate_counts(twice(spark, d))


def _far(spark, d):
    return telemetry(spark, d, gaps=True).withColumn("latitude", F.when(F.col("event_id") % 29 == 0, 200.0).otherwise(F.col("latitude")))


FAR = "far AS (SELECT * REPLACE (CASE WHEN event_id % 29 = 0 THEN 200.0 ELSE latitude END AS latitude) FROM gaps)"


@query("v4_valid_coordinates", f"WITH {GAPS}, {FAR} SELECT event_id, CASE WHEN latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 THEN round(latitude, 6) END AS latitude, CASE WHEN latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 THEN round(longitude, 6) END AS longitude FROM far")
def v4(spark, d):
    return quality.valid_coordinates(_far(spark, d)).select("event_id", "latitude", "longitude")


@query("v5_valid_times", f"WITH {TEL} SELECT event_id, timestamp FROM tel WHERE timestamp <= TIMESTAMP '2024-01-15 00:00:00'")
def v5(spark, d):
    return quality.valid_times(telemetry(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id", "timestamp")


_GAP = "g AS (SELECT vehicle_id, epoch_us(timestamp - lag(timestamp) OVER (PARTITION BY vehicle_id ORDER BY timestamp)) / 3.6e9 AS gap FROM tel)"


@query("v6_gaps", f"WITH {TEL}, {_GAP} SELECT vehicle_id, count(*) AS n_gaps, round_even(max(gap), 2) AS max_gap_hours, round_even(avg(gap), 2) AS mean_gap_hours FROM g WHERE gap > 6 GROUP BY vehicle_id")
def v6(spark, d):
    return quality.gap_report(telemetry(spark, d), 6.0)


@query("v7_missing", f"""WITH {GAPS}, m AS (SELECT count(*) - count(total_fuel_gal) AS total_fuel_gal, count(*) - count(speed_kmh) AS speed_kmh, count(*) - count(latitude) AS latitude, count(*) - count(longitude) AS longitude FROM gaps)
    SELECT "column", n_missing FROM (UNPIVOT m ON total_fuel_gal, speed_kmh, latitude, longitude INTO NAME "column" VALUE n_missing) WHERE n_missing > 0""")
def v7(spark, d):
    return quality.missing_values(telemetry(spark, d, gaps=True))


_RANGE = ["total_fuel_gal", "speed_kmh", "latitude"]
_ranges = " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM gaps" for c in _RANGE)


@query("v8_ranges", f"WITH {GAPS} {_ranges}")
def v8(spark, d):
    return stats.profile(telemetry(spark, d, gaps=True), _RANGE)


@query("v9_report", f"""WITH {GAPS}, {TWICE}, c AS (SELECT *, count(*) OVER (PARTITION BY vehicle_id, timestamp) AS c FROM twice)
    SELECT count(*) AS n_rows, 9 AS n_columns, count(DISTINCT vehicle_id) AS n_vehicles, min(timestamp) AS first, max(timestamp) AS last, count(*) - count(total_fuel_gal) AS missing_fuel, count(*) FILTER (c > 1) AS n_duplicates,
    round(min(total_fuel_gal), 6) AS min_fuel, round(max(total_fuel_gal), 6) AS max_fuel, count(latitude) AS valid_coordinates, round(count(latitude) * 100.0 / count(*), 6) AS valid_coordinates_pct FROM c""")
def v9(spark, d):
    return quality.quality_report(twice(spark, d))


@query("v10_validated", f"""WITH {GAPS}, {TWICE}, k AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id, timestamp ORDER BY total_fuel_gal DESC NULLS LAST, speed_kmh NULLS LAST, latitude NULLS LAST, longitude NULLS LAST) AS k FROM twice)
    SELECT vehicle_id, count(*) AS n, count(latitude) AS n_coordinates FROM k WHERE k = 1 AND timestamp <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY vehicle_id""")
def v10(spark, d):
    return quality.validated(twice(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp")).groupBy("vehicle_id").agg(F.count("*").alias("n"), F.count("latitude").alias("n_coordinates"))


DER = """lagged AS (SELECT *, epoch_us(timestamp - lag(timestamp) OVER w) / 1e6 AS dt_s, total_fuel_gal - lag(total_fuel_gal) OVER w AS dfuel FROM tel WINDOW w AS (PARTITION BY vehicle_id ORDER BY timestamp)),
    der AS (SELECT *, coalesce(speed_kmh, 0) > 3 AS moving, ignition AND coalesce(speed_kmh, 0) > 3 AS is_moving, ignition AND NOT coalesce(speed_kmh, 0) > 3 AS stationary_on, NOT ignition AS ign_off,
        (ignition AND NOT coalesce(speed_kmh, 0) > 3) OR NOT ignition AS stationary FROM lagged)"""


@query("t1_lags", f"WITH {TEL}, {DER} SELECT event_id, round(dt_s, 6) AS dt_s, round(dfuel, 6) AS dfuel FROM der")
def t1(spark, d):
    return signal.lag_differences(telemetry(spark, d)).select("event_id", "dt_s", "dfuel")


@query("t2_states", f"WITH {TEL}, {DER} SELECT event_id, moving, is_moving, stationary_on, ign_off, stationary FROM der")
def t2(spark, d):
    return signal.states(telemetry(spark, d)).select("event_id", "moving", "is_moving", "stationary_on", "ign_off", "stationary")


@query("t3_derive", f"WITH {TEL}, {DER} SELECT event_id, round(dt_s, 6) AS dt_s, round(dfuel, 6) AS dfuel, stationary FROM der")
def t3(spark, d):
    return signal.derive(telemetry(spark, d)).select("event_id", "dt_s", "dfuel", "stationary")


RATE = """rated AS (SELECT * REPLACE (CASE WHEN NOT coalesce(rate < -0.5 OR rate > 0.5, false) THEN total_fuel_gal END AS total_fuel_gal) FROM (
    SELECT *, (total_fuel_gal - lag(total_fuel_gal) OVER w) / (epoch_us(timestamp - lag(timestamp) OVER w) / 6e7 + 1e-6) AS rate FROM gaps WINDOW w AS (PARTITION BY vehicle_id ORDER BY timestamp)))"""
MAD = """mid AS (SELECT vehicle_id, count(total_fuel_gal) AS n, median(total_fuel_gal) AS med FROM {src} GROUP BY vehicle_id),
    spread AS (SELECT s.vehicle_id, 1.4826 * median(abs(total_fuel_gal - med)) AS sigma FROM {src} s JOIN mid USING (vehicle_id) GROUP BY s.vehicle_id),
    robust AS (SELECT s.* REPLACE (CASE WHEN NOT coalesce(n > 10 AND abs(total_fuel_gal - med) > 3.0 * sigma, false) THEN total_fuel_gal END AS total_fuel_gal) FROM {src} s JOIN mid USING (vehicle_id) LEFT JOIN spread USING (vehicle_id))"""


@query("t4_rate_outliers", f"WITH {GAPS}, {RATE} SELECT event_id, round(total_fuel_gal, 6) AS total_fuel_gal FROM rated")
def t4(spark, d):
    return signal.drop_rate_outliers(telemetry(spark, d, gaps=True), SCALED).select("event_id", "total_fuel_gal")


@query("t5_mad_outliers", f"WITH {GAPS}, {MAD.format(src='gaps')} SELECT event_id, round(total_fuel_gal, 6) AS total_fuel_gal FROM robust")
def t5(spark, d):
    return signal.drop_mad_outliers(telemetry(spark, d, gaps=True), SCALED).select("event_id", "total_fuel_gal")


FILL = """st AS (SELECT *, (ignition AND NOT coalesce(speed_kmh, 0) > 3) OR NOT ignition AS stationary FROM {src}),
    ch AS (SELECT *, coalesce(CAST(stationary <> lag(stationary) OVER (PARTITION BY vehicle_id ORDER BY timestamp) AS INT), 1) AS c FROM st),
    rn AS (SELECT *, sum(c) OVER (PARTITION BY vehicle_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS run FROM ch),
    ix AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id, run ORDER BY timestamp) AS i FROM rn),
    nb AS (SELECT *, last_value(total_fuel_gal IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN total_fuel_gal IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0,
        first_value(total_fuel_gal IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN total_fuel_gal IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1 FROM ix
        WINDOW b AS (PARTITION BY vehicle_id, run ORDER BY timestamp ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY vehicle_id, run ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    filled AS (SELECT * REPLACE (coalesce(total_fuel_gal, CASE WHEN stationary AND i - i0 <= 2 THEN v0 + (v1 - v0) * (i - i0) / (i1 - i0) END) AS total_fuel_gal) FROM nb)"""


@query("t6_interpolate", f"WITH {GAPS}, {FILL.format(src='gaps')} SELECT event_id, round(total_fuel_gal, 6) AS total_fuel_gal FROM filled")
def t6(spark, d):
    return signal.interpolate(signal.states(telemetry(spark, d, gaps=True)), SCALED).select("event_id", "total_fuel_gal")


@query("t7_rate", f"WITH {TEL}, {DER} SELECT event_id, round(CASE WHEN dt_s <> 0 THEN dfuel / (dt_s / 60) END, 6) AS rate_gpm FROM der")
def t7(spark, d):
    return signal.fuel_rate(signal.lag_differences(telemetry(spark, d))).select("event_id", "rate_gpm")


_MED = "median(total_fuel_gal) OVER (PARTITION BY vehicle_id ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query("t8_rolling_median", f"WITH {GAPS} SELECT event_id, round({_MED}, 6) AS fuel_med5 FROM gaps")
def t8(spark, d):
    return signal.rolling_median(telemetry(spark, d, gaps=True)).select("event_id", "fuel_med5")


@query("t9_utc", f"WITH {TEL} SELECT event_id, timestamp FROM tel")
def t9(spark, d):
    return signal.as_utc(telemetry(spark, d).withColumn("timestamp", F.col("timestamp").cast("string"))).select("event_id", "timestamp")


@query("t10_preprocess", f"WITH {GAPS}, {RATE}, {MAD.format(src='rated')}, {FILL.format(src='robust')} SELECT event_id, round(total_fuel_gal, 6) AS total_fuel_gal, round(total_fuel_gal - lag(total_fuel_gal) OVER (PARTITION BY vehicle_id ORDER BY timestamp), 6) AS dfuel, round({_MED}, 6) AS fuel_med5 FROM filled")
def t10(spark, d):
    return signal.preprocess(telemetry(spark, d, gaps=True), SCALED).select("event_id", "total_fuel_gal", "dfuel", "fuel_med5")


@query("t11_align", f"WITH {TEL} SELECT event_id, vehicle_id, timestamp FROM tel")
def t11(spark, d):
    return signal.aligned(telemetry(spark, d)).select("event_id", "vehicle_id", "timestamp")


@query("t12_robust_sigma", f"""WITH {GAPS}, mid AS (SELECT vehicle_id, count(total_fuel_gal) AS n, median(total_fuel_gal) AS med FROM gaps WHERE total_fuel_gal IS NOT NULL GROUP BY vehicle_id)
    SELECT g.vehicle_id, any_value(n) AS n, round(any_value(med), 6) AS med, round(1.4826 * median(abs(total_fuel_gal - med)), 6) AS sigma FROM gaps g JOIN mid USING (vehicle_id) WHERE total_fuel_gal IS NOT NULL GROUP BY g.vehicle_id""")
def t12(spark, d):
    return stats.mad_sigma(telemetry(spark, d, gaps=True), ["vehicle_id"], "total_fuel_gal")


def hav(a: str, b: str, c: str, e: str) -> str:
    x = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({e}) - radians({b})) / 2), 2))"
    return f"(12742.0 * atan2(sqrt({x}), sqrt(greatest(0.0, 1 - {x}))))"


@query("f8_haversine", f"WITH {TEL} SELECT event_id, round({hav('latitude', 'longitude', '4.05::DOUBLE', '-74.05::DOUBLE')}, 6) AS km FROM tel")
def f8(spark, d):
    return telemetry(spark, d).select("event_id", geo.haversine(F.col("latitude"), F.col("longitude"), F.lit(4.05), F.lit(-74.05)).alias("km"))


_P = hav("latitude", "longitude", "4.0::DOUBLE", "-74.0::DOUBLE"), hav("latitude", "longitude", "4.09::DOUBLE", "-74.2::DOUBLE"), hav("4.0::DOUBLE", "-74.0::DOUBLE", "4.09::DOUBLE", "-74.2::DOUBLE")


@query("f9_chord", f"WITH {TEL}, s AS (SELECT event_id, {_P[0]} AS b, {_P[1]} AS c, {_P[2]} AS a FROM tel) SELECT event_id, round(2 * sqrt(greatest(0.0, ((a+b+c)/2) * ((a+b+c)/2 - a) * ((a+b+c)/2 - b) * ((a+b+c)/2 - c))) / a, 4) AS km FROM s")
def f9(spark, d):
    return telemetry(spark, d).select("event_id", F.round(geo.chord_distance(F.col("latitude"), F.col("longitude"), (F.lit(4.0), F.lit(-74.0)), (F.lit(4.09), F.lit(-74.2))), 4).alias("km"))


@query("v16_radius", f"WITH {TEL} SELECT event_id FROM tel WHERE {hav('latitude', 'longitude', '4.05::DOUBLE', '-74.05::DOUBLE')} <= 3.0")
def v16(spark, d):
    return telemetry(spark, d).where(geo.within_radius(F.col("latitude"), F.col("longitude"), F.lit(4.05), F.lit(-74.05), 3.0)).select("event_id")


@query("r5_vehicle_statistics", f"WITH {GAPS} SELECT vehicle_id, count(total_fuel_gal) AS n, round_even(min(total_fuel_gal), 2) AS min_fuel, round_even(max(total_fuel_gal), 2) AS max_fuel, round_even(avg(total_fuel_gal), 2) AS mean_fuel FROM gaps GROUP BY vehicle_id")
def r5(spark, d):
    return reports.vehicle_statistics(telemetry(spark, d, gaps=True))


_ST = ", ".join(f"count(*) FILTER ({c}) AS n_{n}, round(count(*) FILTER ({c}) * 100.0 / count(*), 6) AS pct_{n}" for n, c in (("moving", "is_moving"), ("stationary_on", "stationary_on"), ("ign_off", "ign_off")))


@query("r6_state_distribution", f"WITH {TEL}, {DER} SELECT vehicle_id, count(*) AS n, {_ST} FROM der GROUP BY vehicle_id")
def r6_states(spark, d):
    return reports.state_distribution(signal.states(telemetry(spark, d)), ["vehicle_id"])


@query("r7_label_rate", f"WITH {TEL} SELECT count(*) AS n, count(*) FILTER (stationary_drain = 1) AS n_label, round(count(*) FILTER (stationary_drain = 1) * 100.0 / count(*), 6) AS pct_label FROM tel")
def r7(spark, d):
    return reports.shares(telemetry(spark, d), {"label": F.col("stationary_drain") == 1})


@query("r8_coverage", f"WITH {TEL} SELECT vehicle_id, round(epoch_us(max(timestamp) - min(timestamp)) / 8.64e10, 6) AS span_days FROM tel GROUP BY vehicle_id")
def r8(spark, d):
    return reports.coverage(telemetry(spark, d))


@query("r39_table_profile", f"WITH {TEL} SELECT count(*) AS n_rows, 9 AS n_columns, count(DISTINCT vehicle_id) AS n_vehicles, min(timestamp) AS first, max(timestamp) AS last FROM tel")
def r39(spark, d):
    return reports.table_profile(telemetry(spark, d))


@query("r36_fleet_artefact", f"""WITH {TEL}, {DER} SELECT count(*) AS n_rows, count(DISTINCT vehicle_id) AS n_vehicles, round(epoch_us(max(timestamp) - min(timestamp)) / 8.64e10, 6) AS span_days, round(avg(total_fuel_gal), 6) AS mean_fuel,
    round(count(*) FILTER (stationary) * 100.0 / count(*), 6) AS stationary_pct, round(count(total_fuel_gal) * 100.0 / count(*), 6) AS completeness_pct, count(*) FILTER (dfuel <= -50) AS large_drops FROM der""")
def r36(spark, d):
    t = signal.derive(telemetry(spark, d))
    n = F.count("*")
    return t.agg(n.alias("n_rows"), F.countDistinct("vehicle_id").alias("n_vehicles"), ((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 8.64e10).alias("span_days"), F.avg("total_fuel_gal").alias("mean_fuel"), (F.count_if("stationary") * 100.0 / n).alias("stationary_pct"), (F.count("total_fuel_gal") * 100.0 / n).alias("completeness_pct"), F.count_if(F.col("dfuel") <= -50).alias("large_drops"))


@query("r18_missing_share", f"WITH {GAPS}, m AS (SELECT round((count(*) - count(total_fuel_gal)) * 100.0 / count(*), 6) AS total_fuel_gal, round((count(*) - count(speed_kmh)) * 100.0 / count(*), 6) AS speed_kmh FROM gaps) SELECT feature, missing_pct FROM (UNPIVOT m ON total_fuel_gal, speed_kmh INTO NAME feature VALUE missing_pct)")
def r18(spark, d):
    return quality.missing_share(telemetry(spark, d, gaps=True), ["total_fuel_gal", "speed_kmh"])
