"""Joins of event windows with telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tankwatch.functions.geo import haversine
from tankwatch.functions.stats import large

#: Width of the time buckets that turn a range condition into an equality, in seconds.
BUCKET = 6 * 3600


def _bucket(t: Column, width: int) -> Column:
    return F.floor(F.unix_micros(t) / (width * 1_000_000)).cast("long")


def window_join(events: DataFrame, telemetry: DataFrame, start: Column, end: Column, columns: list[str], closed: bool = True, width: int = BUCKET) -> DataFrame:
    """Telemetry rows inside each event's window, with the event's ``event_key``.

    Events are spread over the time buckets that they touch and meet rows of the same vehicle and bucket; a row lies in
    one bucket, so no pair arises twice. ``closed`` includes the end.
    """
    wins = events.select("event_key", "vehicle_id", start.alias("_s"), end.alias("_e"))
    spread = wins.withColumn("_b", F.explode(F.sequence(_bucket(F.col("_s"), width), _bucket(F.col("_e"), width))))
    rows = telemetry.select("vehicle_id", "timestamp", *[c for c in columns if c not in ("vehicle_id", "timestamp")]).withColumn("_b", _bucket(F.col("timestamp"), width))
    inside = (F.col("timestamp") >= F.col("_s")) & ((F.col("timestamp") <= F.col("_e")) if closed else (F.col("timestamp") < F.col("_e")))
    return large(spread).join(large(rows), ["vehicle_id", "_b"]).where(inside).drop("_b", "_s", "_e")


def keyed(events: DataFrame) -> DataFrame:
    """A key for each event from what tells events apart."""
    return events.withColumn("event_key", F.xxhash64("vehicle_id", "start_time", "end_time", "pattern"))


def event_points(events: DataFrame, telemetry: DataFrame, columns: list[str]) -> DataFrame:
    """The closed window join that all window features share."""
    return window_join(events, telemetry, F.col("start_time"), F.col("end_time"), columns)


def lookback_points(events: DataFrame, telemetry: DataFrame, hours: float, columns: list[str]) -> DataFrame:
    """Rows in the hours before an event, its start left out."""
    begin = F.timestamp_micros(F.unix_micros("start_time") - int(hours * 3_600_000_000))
    return window_join(events, telemetry, begin, F.col("start_time"), columns, closed=False)


def with_steps(points: DataFrame) -> DataFrame:
    """Adds ``_placed``, whether a point has coordinates, and ``_km``, its way from the event's placed point before it."""
    w = W.partitionBy("event_key", "_placed").orderBy("timestamp")
    marked = points.withColumn("_placed", F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    step = haversine(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    return marked.withColumn("_km", F.when(F.col("_placed"), step))


def trip() -> Column:
    """The aggregate of ``with_steps``: the way over consecutive placed points."""
    return F.coalesce(F.sum("_km"), F.lit(0.0))


def trip_distance(points: DataFrame) -> DataFrame:
    """``event_key, km`` over consecutive points that have coordinates."""
    return with_steps(points).where("_placed").groupBy("event_key").agg(trip().alias("km"))
