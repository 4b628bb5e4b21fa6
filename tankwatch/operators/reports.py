"""Summaries of telemetry, events and predictions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tankwatch.functions.stats import median, quantiles, running_sums, unpivoted


def pct(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0))


def event_summary(events: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)) if c in events.columns else F.lit(0)
    out = events.groupBy("vehicle_id", "pattern").agg(F.count("*").alias("event_count"), F.avg("drop_gal").alias("mean_drop_gal"), F.max("drop_gal").alias("max_drop_gal"), median("duration_min").alias("median_duration_min"), zero("is_hotspot").alias("hotspot_events"), zero("y").alias("positive_labels"))
    return out.orderBy("vehicle_id", F.desc("event_count"), "pattern")


def top(df: DataFrame, by: str, n: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), *ties).limit(n)


def distribution(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))


def shares(events: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row with the count and the share of each condition."""
    return events.agg(F.count("*").alias("n"), *[x for k, c in flags.items() for x in (F.count_if(c).alias(f"n_{k}"), pct(F.count_if(c), F.count("*")).alias(f"pct_{k}"))])


def vehicle_statistics(df: DataFrame) -> DataFrame:
    f = "total_fuel_gal"
    return df.groupBy("vehicle_id").agg(F.count(f).alias("n"), F.bround(F.min(f), 2).alias("min_fuel"), F.bround(F.max(f), 2).alias("max_fuel"), F.bround(F.avg(f), 2).alias("mean_fuel"))


def state_distribution(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    n = F.count("*")
    flags = {"moving": F.col("is_moving"), "stationary_on": F.col("stationary_on"), "ign_off": F.col("ign_off")}
    return df.groupBy(*(by or [])).agg(n.alias("n"), *[x for k, c in flags.items() for x in (F.count_if(c).alias(f"n_{k}"), pct(F.count_if(c), n).alias(f"pct_{k}"))])


def coverage(df: DataFrame) -> DataFrame:
    return df.groupBy("vehicle_id").agg(((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 8.64e10).alias("span_days"))


def pattern_profile(events: DataFrame) -> DataFrame:
    return events.groupBy("pattern").agg(*[x for c in ("duration_min", "drop_gal", "n_negative_steps") for x in (median(c).alias(f"median_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"))])


def rate_by(events: DataFrame, col: str) -> DataFrame:
    return events.groupBy(col).agg(F.sum("y").alias("positives"), F.count("*").alias("n"), F.bround(F.avg("y"), 3).alias("rate"))


def mann_whitney(df: DataFrame, col: str, label: str = "y") -> DataFrame:
    """U of the positives, its z by normal approximation with ties, and the two-sided p."""
    rows = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.sum(label).cast("double").alias("n1"), F.count("*").cast("double").alias("t"))
    ranked = running_sums(rows, col, [], {"upto": "t"}).withColumn("r", F.col("upto") - (F.col("t") - 1) / 2)
    s = ranked.agg(F.sum(F.col("r") * F.col("n1")).alias("r1"), F.sum("n1").alias("n1"), F.sum("t").alias("n"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    s = s.withColumn("n0", F.col("n") - F.col("n1")).withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    sigma = F.sqrt(F.col("n1") * F.col("n0") / 12 * (F.col("n") + 1 - F.try_divide("ties", F.col("n") * (F.col("n") - 1))))
    out = s.select("u", F.try_divide(F.col("u") - F.col("n1") * F.col("n0") / 2, sigma).alias("z"), "n1", "n0")

    def with_p(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(p=[None if pd.isna(z) else two_sided_p(z) for z in rows["z"]])

    return out.mapInPandas(with_p, "u double, z double, n1 double, n0 double, p double")  # one row


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def equal_bins(df: DataFrame, col: str, bins: int, value: str) -> DataFrame:
    """Mean of ``value`` in equal bins over the observed range, closed on the right, the first one on both sides."""
    ends = df.agg(F.min(col).alias("_a"), F.max(col).alias("_b"))
    wide = df.join(F.broadcast(ends)).withColumn("bin", F.greatest(F.lit(0), F.ceil((F.col(col) - F.col("_a")) / ((F.col("_b") - F.col("_a")) / bins)).cast("int") - 1))
    return wide.groupBy("bin").agg(F.count("*").alias("n"), F.avg(value).alias("rate"))


def correlations(df: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """Pearson correlation of each pair, in one pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs])).alias("r")).select("r.*")
    return out.where(F.abs("rho") > least) if least else out


def outlier_share(df: DataFrame, columns: list[str], k: float = 3.0) -> DataFrame:
    """Share of rows beyond k interquartile ranges from the quartiles."""
    known = quantiles(df, columns, [0.25, 0.75])
    fence = {c: (a - k * (b - a), b + k * (b - a)) for c, (a, b) in known.items() if a is not None}
    out = lambda c: (F.col(c) < fence[c][0]) | (F.col(c) > fence[c][1]) if c in fence else F.lit(False)
    row = df.agg(*[pct(F.count_if(out(c)), F.count("*")).alias(c) for c in columns])
    return unpivoted(row, "feature", "outlier_pct")


def cumulative(df: DataFrame, name: str, value: str) -> DataFrame:
    """Running share by falling value; the table is one of features, not of data rows."""
    down = W.orderBy(F.desc(value), name).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum(value).over(down) / F.sum(value).over(W.partitionBy()))


def best_by(df: DataFrame, by: list[str], value: str, ties: list[str]) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.desc_nulls_last(value), *ties)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def outcome(predicted: Column, y: Column) -> Column:
    return F.when(predicted & (y == 1), "TP").when(predicted, "FP").when(y == 1, "FN").otherwise("TN")


def row_shares(df: DataFrame, row: str, col: str) -> DataFrame:
    each = df.groupBy(row, col).agg(F.count("*").alias("n"))
    return each.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(row)))


def confidence_tier(score: Column, threshold: Column | float) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(score >= t + 0.2, "high").when(score >= t, "medium").otherwise("low")


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.85, "critical").when(score >= 0.6, "high").when(score >= 0.3, "medium").otherwise("low")


def improvement(current: DataFrame, base: DataFrame, lower_is_better: list[str]) -> DataFrame:
    """Change over a baseline in per cent, positive where better; both are (metric, value)."""
    both = current.join(base.withColumnRenamed("value", "base"), "metric")
    sign = F.when(F.col("metric").isin(*lower_is_better), -1.0).otherwise(1.0)
    return both.withColumn("improvement_pct", F.try_divide(sign * (F.col("value") - F.col("base")), "base") * 100)


def table_profile(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.countDistinct("vehicle_id").alias("n_vehicles"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
