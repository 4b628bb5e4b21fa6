"""Temporal splits and checks against leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tankwatch.functions.stats import large


def rank_split(df: DataFrame, ratio: float = 0.8) -> DataFrame:
    """``is_train``: up to the time of the vehicle's row int(n * ratio), kept between 1 and n - 1."""
    w = W.partitionBy("vehicle_id").orderBy("timestamp")
    placed = df.withColumns({"_k": F.row_number().over(w) - 1, "_n": F.count("*").over(W.partitionBy("vehicle_id"))})
    at = F.greatest(F.lit(1), F.least((F.col("_n") * ratio).cast("long"), F.col("_n") - 1))
    cut = F.max(F.when(F.col("_k") == at, F.col("timestamp"))).over(W.partitionBy("vehicle_id"))
    return placed.withColumn("_at", at).withColumn("_cut", F.coalesce(cut, F.max("timestamp").over(W.partitionBy("vehicle_id")))).withColumn("is_train", F.col("timestamp") <= F.col("_cut")).drop("_k", "_n", "_at", "_cut")


def quantile_split(df: DataFrame, ratio: float = 0.8) -> DataFrame:
    if not 0 < ratio < 1:
        raise ValueError("the ratio must lie between 0 and 1")
    cut = df.groupBy("vehicle_id").agg(F.percentile(F.unix_micros("timestamp"), F.lit(ratio)).alias("_cut"))
    return df.join(large(cut), "vehicle_id").withColumn("is_train", F.unix_micros("timestamp") <= F.col("_cut")).drop("_cut")


def map_events(events: DataFrame, split: DataFrame, keep_mid: bool = True) -> DataFrame:
    """An event is in training if its middle is not after its vehicle's last training row."""
    cut = split.where("is_train").groupBy("vehicle_id").agg(F.max("timestamp").alias("_cut"))
    mid = F.timestamp_micros(((F.unix_micros("start_time") + F.unix_micros("end_time")) / 2).cast("long"))
    out = events.withColumn("mid_time", mid).join(large(cut), "vehicle_id", "left").withColumn("is_train", F.coalesce(F.col("mid_time") <= F.col("_cut"), F.lit(False))).drop("_cut")
    return out if keep_mid else out.drop("mid_time")


def leaks(events: DataFrame) -> DataFrame:
    """Training events that overlap a test event of their vehicle, with that event.

    A sweep over a vehicle's events by start finds those that overlap any event of the other side at all, by the latest end
    before and the earliest start after, and cuts them where nothing overlaps: only these meet, and only within a cut.
    """
    rows = events.where("start_time is not null and end_time is not null and is_train is not null").select("vehicle_id", "start_time", "end_time", "is_train")
    order = ["start_time", "end_time", "is_train"]
    before = W.partitionBy("vehicle_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("vehicle_id").orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)
    side = lambda c, train: F.when(F.col("is_train") == train, F.col(c))
    latest, first = {t: F.max(side("end_time", t)).over(before) for t in (True, False)}, {t: F.min(side("start_time", t)).over(behind) for t in (True, False)}
    other = lambda at: F.when(F.col("is_train"), at[False]).otherwise(at[True])
    apart = F.coalesce(F.col("start_time") > F.max("end_time").over(before), F.lit(False)).cast("long")
    meets = F.coalesce(other(latest) >= F.col("start_time"), F.lit(False)) | F.coalesce(other(first) <= F.col("end_time"), F.lit(False))
    swept = rows.withColumns({"_meets": meets, "_apart": apart})
    met = swept.withColumn("_cut", F.sum("_apart").over(W.partitionBy("vehicle_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).where("_meets")
    a, b = met.where("is_train").alias("a"), met.where("not is_train").alias("b")
    meet = (F.col("a.vehicle_id") == F.col("b.vehicle_id")) & (F.col("a._cut") == F.col("b._cut")) & (F.col("a.start_time") <= F.col("b.end_time")) & (F.col("b.start_time") <= F.col("a.end_time"))
    return large(a).join(large(b), meet).select("a.vehicle_id", F.col("a.start_time").alias("train_start"), F.col("a.end_time").alias("train_end"), F.col("b.start_time").alias("test_start"), F.col("b.end_time").alias("test_end"))


def check_no_leak(events: DataFrame) -> None:
    if not leaks(events).isEmpty():
        raise ValueError("training and test events overlap")


def leak_report(events: DataFrame) -> DataFrame:
    train = F.col("is_train")
    out = events.groupBy("vehicle_id").agg(F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"), F.max(F.when(train, F.col("end_time"))).alias("max_train_end"), F.min(F.when(~train, F.col("start_time"))).alias("min_test_start"))
    gap = (F.unix_micros("min_test_start") - F.unix_micros("max_train_end")) / 3.6e9
    return out.withColumns({"has_overlap": F.coalesce(F.col("max_train_end") > F.col("min_test_start"), F.lit(False)), "gap_hours": gap})


def balance(events: DataFrame, min_train: int = 10, min_test: int = 5) -> DataFrame:
    """Positives on both sides, their rates, and whether they suffice."""
    pos, train = F.coalesce(F.col("y"), F.lit(0)) == 1, F.col("is_train")
    row = events.agg(F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"), F.count_if(train & pos).alias("train_positives"), F.count_if(~train & pos).alias("test_positives"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return row.withColumns({"train_rate": rate("train_positives", "n_train"), "test_rate": rate("test_positives", "n_test")}).withColumn("balanced", (F.col("train_positives") >= min_train) & (F.col("test_positives") >= min_test) & (F.col("train_rate") >= 0.01) & (F.col("test_rate") >= 0.01))


def require_both_sides(rows: DataFrame) -> DataFrame:
    """Training and test rows, or it is an error."""
    n = rows.agg(F.count_if("is_train").alias("a"), F.count_if(~F.col("is_train")).alias("b")).first()
    if not n.a or not n.b:
        raise ValueError("one side of the split is empty")
    return rows
