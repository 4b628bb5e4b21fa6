"""Validation, deduplication and profiles of telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tankwatch.functions.stats import unpivoted

KEY = ["vehicle_id", "timestamp"]
REQUIRED = ["vehicle_id", "timestamp", "total_fuel_gal"]
DETECTION_COLUMNS = ["vehicle_id", "timestamp", "total_fuel_gal", "dt_s", "dfuel", "moving", "stationary_on", "ign_off", "stationary"]


def require(df: DataFrame, columns: list[str] = REQUIRED) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def _ties(df: DataFrame) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in ("speed_kmh", "latitude", "longitude") if c in df.columns]


def clean(df: DataFrame) -> DataFrame:
    """Rows with a time, one for each vehicle and time: the one with the most fuel, then by its other values."""
    return first_of(df.where(F.col("timestamp").isNotNull()), KEY, [F.col("total_fuel_gal").desc_nulls_last(), *_ties(df)])


def dedup_sources(df: DataFrame, null_wins: bool = False) -> DataFrame:
    """One row for each vehicle and time over all sources, with the largest fuel value (or a missing one)."""
    fuel = F.col("total_fuel_gal")
    return first_of(df, KEY, [fuel.desc_nulls_first() if null_wins else fuel.desc_nulls_last(), *_ties(df)])


def duplicate_counts(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """How many rows share their key with another, and how many would go."""
    each = df.groupBy(*keys).agg(F.count("*").alias("c"))
    return each.agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("n_in_groups"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_removed"))


def valid_coordinates(df: DataFrame) -> DataFrame:
    ok = F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(False))
    return df.withColumns({"latitude": F.when(ok, F.col("latitude")), "longitude": F.when(ok, F.col("longitude"))})


def valid_times(df: DataFrame, as_of: Column) -> DataFrame:
    return df.where(F.col("timestamp").isNotNull() & (F.col("timestamp") <= as_of))


def elapsed(before: Column, after: Column) -> Column:
    """Seconds from one time to another; whole microseconds are subtracted, so nothing is lost to rounding."""
    return (F.unix_micros(after) - F.unix_micros(before)) / 1e6


def gap_report(df: DataFrame, max_hours: float = 1.0) -> DataFrame:
    """Gaps above the limit by vehicle: how many, the longest and the mean, in hours rounded half to even."""
    gap = elapsed(F.lag("timestamp").over(W.partitionBy("vehicle_id").orderBy("timestamp")), F.col("timestamp")) / 3600
    wide = df.select("vehicle_id", gap.alias("gap")).where(F.col("gap") > max_hours)
    return wide.groupBy("vehicle_id").agg(F.count("*").alias("n_gaps"), F.bround(F.max("gap"), 2).alias("max_gap_hours"), F.bround(F.avg("gap"), 2).alias("mean_gap_hours"))


def missing_values(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return unpivoted(row, "column", "n_missing").where("n_missing > 0")


def missing_share(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*[(F.count_if(F.col(c).isNull()) * 100.0 / F.count("*")).alias(c) for c in columns])
    return unpivoted(row, "feature", "missing_pct")


def quality_report(df: DataFrame) -> DataFrame:
    """One row: sizes, span, missing values, duplicates and coordinates."""
    copies = df.withColumn("_c", F.count("*").over(W.partitionBy(*KEY)))
    ok = F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(False))
    return copies.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.countDistinct("vehicle_id").alias("n_vehicles"),
        F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"),
        F.count_if(F.col("total_fuel_gal").isNull()).alias("missing_fuel"),
        F.count_if(F.col("_c") > 1).alias("n_duplicates"),
        F.min("total_fuel_gal").alias("min_fuel"),
        F.max("total_fuel_gal").alias("max_fuel"),
        F.count_if(ok).alias("valid_coordinates"),
        (F.count_if(ok) * 100.0 / F.count("*")).alias("valid_coordinates_pct"),
    )


def validated(df: DataFrame, as_of: Column) -> DataFrame:
    """Duplicates go, then rows without a credible time, then impossible coordinates are emptied."""
    return df.transform(clean).transform(lambda d: valid_times(d, as_of)).transform(valid_coordinates)
