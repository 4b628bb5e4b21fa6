"""Conditioning of the fuel signal; all windows share one partitioning by vehicle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tankwatch.functions.stats import mad_sigma
from tankwatch.operators.quality import clean, elapsed, require
from tankwatch.params import Detection

def by_time():
    return W.partitionBy("vehicle_id").orderBy("timestamp")


def lag_differences(df: DataFrame) -> DataFrame:
    return df.withColumns({"dt_s": elapsed(F.lag("timestamp").over(by_time()), F.col("timestamp")), "dfuel": F.col("total_fuel_gal") - F.lag("total_fuel_gal").over(by_time())})


def states(df: DataFrame, p: Detection = Detection()) -> DataFrame:
    """Moving, standing with the engine on, engine off; a missing speed counts as none."""
    moving, on = F.coalesce("speed_kmh", F.lit(0.0)) > p.speed_stationary, F.col("ignition")
    out = df.withColumns({"moving": moving, "is_moving": F.coalesce(on & moving, F.lit(False)), "stationary_on": F.coalesce(~moving & on, F.lit(False)), "ign_off": F.coalesce(~on, F.lit(False))})
    return out.withColumn("stationary", F.col("stationary_on") | F.col("ign_off"))


def derive(df: DataFrame, p: Detection = Detection()) -> DataFrame:
    return states(lag_differences(require(df, ["vehicle_id", "timestamp", "total_fuel_gal", "speed_kmh", "ignition"])), p)


def drop_rate_outliers(df: DataFrame, p: Detection = Detection()) -> DataFrame:
    """Fuel that fell or rose faster than a tank allows is missing."""
    dt = elapsed(F.lag("timestamp").over(by_time()), F.col("timestamp"))
    rate = (F.col("total_fuel_gal") - F.lag("total_fuel_gal").over(by_time())) / (dt / 60 + 1e-6)
    bad = F.coalesce((rate < -p.max_drain_rate) | (rate > p.max_fill_rate), F.lit(False))
    return df.withColumn("_bad", bad).withColumn("total_fuel_gal", F.when(~F.col("_bad"), F.col("total_fuel_gal"))).drop("_bad")


def drop_mad_outliers(df: DataFrame, p: Detection = Detection()) -> DataFrame:
    """Per vehicle with more than 10 values: what lies further than k robust deviations from the median."""
    stats = mad_sigma(df, ["vehicle_id"], "total_fuel_gal")
    far = F.coalesce((F.col("n") > 10) & (F.abs(F.col("total_fuel_gal") - F.col("med")) > p.mad_k * F.col("sigma")), F.lit(False))
    return df.join(stats, "vehicle_id", "left").withColumn("total_fuel_gal", F.when(~far, F.col("total_fuel_gal"))).select(*df.columns)


def interpolate(df: DataFrame, p: Detection = Detection()) -> DataFrame:
    """Inside runs of standing rows, the first few missing values of an inner gap, linear by row."""
    change = F.coalesce((F.col("stationary") != F.lag("stationary").over(by_time())).cast("int"), F.lit(1))
    runs = df.withColumn("_c", change).withColumn("_run", F.sum("_c").over(by_time().rowsBetween(W.unboundedPreceding, 0)))
    w = W.partitionBy("vehicle_id", "_run").orderBy("timestamp")
    # what comes next is what came last in falling order: a frame that ends with the run would be summed anew for each row
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("vehicle_id", "_run").orderBy(F.desc("_i")).rowsBetween(W.unboundedPreceding, 0)
    fuel = F.col("total_fuel_gal")
    placed = runs.withColumn("_i", F.row_number().over(w)).withColumn("_at", F.when(fuel.isNotNull(), F.col("_i")))
    placed = placed.withColumns({"_v0": F.last(fuel, True).over(back), "_i0": F.last("_at", True).over(back), "_v1": F.last(fuel, True).over(ahead), "_i1": F.last("_at", True).over(ahead)})
    fill = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_i") - F.col("_i0")) / F.nullif(F.col("_i1") - F.col("_i0"), F.lit(0))
    use = F.col("stationary") & fuel.isNull() & (F.col("_i") - F.col("_i0") <= p.max_gap_points)
    return placed.withColumn("total_fuel_gal", F.coalesce(fuel, F.when(use, fill))).select(*df.columns)


def fuel_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("rate_gpm", F.try_divide(F.col("dfuel"), F.col("dt_s") / 60))


def rolling_median(df: DataFrame, window: int = 5) -> DataFrame:
    half = window // 2
    return df.withColumn("fuel_med5", F.expr(f"percentile(total_fuel_gal, 0.5) OVER (PARTITION BY vehicle_id ORDER BY timestamp ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"))


def aligned(df: DataFrame) -> DataFrame:
    return df.repartition("vehicle_id").sortWithinPartitions("vehicle_id", "timestamp")


def as_utc(df: DataFrame, col: str = "timestamp") -> DataFrame:
    """Times are UTC in a session whose zone is UTC; text is read as such."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def preprocess(df: DataFrame, p: Detection = Detection()) -> DataFrame:
    """All steps in order; the fuel difference is taken again after the signal is cleaned."""
    out = df.transform(as_utc).transform(clean).transform(lambda d: derive(d, p)).transform(lambda d: drop_rate_outliers(d, p)).transform(lambda d: drop_mad_outliers(d, p)).transform(lambda d: interpolate(d, p))
    out = out.withColumn("dfuel", F.col("total_fuel_gal") - F.lag("total_fuel_gal").over(by_time()))
    return out.transform(fuel_rate).transform(rolling_median)

