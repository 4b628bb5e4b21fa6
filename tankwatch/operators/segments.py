"""Stationary segments: sessions of standing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tankwatch.operators.signal import by_time
from tankwatch.params import Detection


def with_segment(df: DataFrame, p: Detection = Detection()) -> DataFrame:
    """Adds ``seg_id``, counted by vehicle, to standing rows; null elsewhere.

    A segment begins at a standing row after one that moved, after too long a gap, or where the engine's state flips.
    """
    prev = lambda c: F.coalesce(F.lag(c).over(by_time()), F.lit(False))
    flagged = df.withColumns({"_ps": prev("stationary"), "_pon": prev("stationary_on"), "_poff": prev("ign_off")})
    wide = (F.col("_pon") & (F.col("dt_s") > p.gap_on_min * 60)) | (F.col("_poff") & (F.col("dt_s") > p.gap_off_min * 60))
    flip = F.col("_ps") & (F.col("ign_off") != F.col("_poff"))
    start = F.col("stationary") & F.coalesce(~F.col("_ps") | wide | flip, F.lit(False))
    counted = flagged.withColumn("_start", start.cast("long")).withColumn("_k", F.sum("_start").over(by_time().rowsBetween(W.unboundedPreceding, 0)))
    return counted.withColumn("seg_id", F.when(F.col("stationary"), F.col("_k"))).drop("_ps", "_pon", "_poff", "_start", "_k")


def segments(df: DataFrame, p: Detection = Detection()) -> DataFrame:
    """``vehicle_id, seg_id, start_time, end_time, is_ign_off, duration_min`` of segments that last long enough."""
    rows = (df if "seg_id" in df.columns else with_segment(df, p)).where(F.col("seg_id").isNotNull())
    out = rows.groupBy("vehicle_id", "seg_id").agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), (F.avg(F.col("ign_off").cast("double")) > 0.5).alias("is_ign_off"))
    return out.withColumn("duration_min", (F.unix_micros("end_time") - F.unix_micros("start_time")) / 6e7).where(F.col("duration_min") >= p.min_segment_min)
