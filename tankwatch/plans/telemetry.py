"""The driver's ``events`` as vehicle telemetry, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tankwatch.params import Detection, Pattern

#: The same operators on pings that are hours apart and noisy.
SCALED = Detection(
    gap_on_min=1440, gap_off_min=2880, min_segment_min=60, max_drain_rate=0.5, max_fill_rate=0.5, mad_k=3.0, max_gap_points=2,
    noise_mult_step=0.5, noise_mult_cum=0.5, max_rate=1e9, max_step=1e9,
    patterns=(Pattern("short_stationary", "stationary_on", 60, 1440), Pattern("extended_stationary", "stationary_on", 2880), Pattern("postjourney", "ign_off", 60, None, 2, 60.0)),
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def telemetry(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """With ``gaps``, every 17th fuel value, 19th speed and 23rd pair of coordinates is missing."""
    k = F.get_json_object("props", "$.k").cast("int")
    missing = lambda n, c: F.when(F.col("event_id") % n != 0, c) if gaps else c
    return events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("vehicle_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        missing(17, F.col("value")).alias("total_fuel_gal"),
        missing(19, F.when(k < 50, 0.0).otherwise(k.cast("double"))).alias("speed_kmh"),
        (F.col("event_type") != "error").alias("ignition"),
        missing(23, 4.0 + (F.col("user_id") % 10) * 0.01 + (F.col("event_id") % 7) * 0.0001).alias("latitude"),
        missing(23, -74.0 - (F.col("user_id") % 10) * 0.01 - (F.col("event_id") % 5) * 0.0001).alias("longitude"),
        (F.col("event_type") == "purchase").cast("int").alias("stationary_drain"),
        "event_id",
    )


def _sql(gaps: bool) -> str:
    m = (lambda n, c: f"CASE WHEN event_id % {n} <> 0 THEN {c} END") if gaps else (lambda n, c: c)
    return f"""SELECT CAST(user_id AS VARCHAR) AS vehicle_id, ts AS timestamp, {m(17, 'value')} AS total_fuel_gal,
        {m(19, 'CASE WHEN k < 50 THEN 0.0 ELSE CAST(k AS DOUBLE) END')} AS speed_kmh, event_type <> 'error' AS ignition,
        {m(23, '4.0::DOUBLE + (user_id % 10) * 0.01::DOUBLE + (event_id % 7) * 0.0001::DOUBLE')} AS latitude,
        {m(23, '-74.0::DOUBLE - (user_id % 10) * 0.01::DOUBLE - (event_id % 5) * 0.0001::DOUBLE')} AS longitude,
        CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS stationary_drain, event_id
        FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)"""


TEL = f"tel AS ({_sql(False)})"
GAPS = f"gaps AS ({_sql(True)})"
