"""Classification metrics as relational operators over ``(score, y)`` rows, by group where wanted."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankwatch.functions.stats import running_sums


def curve(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for each distinct score: true and false positives if it were the threshold.

    ``next_p`` and ``next_n`` are the positives and negatives of the next lower score.
    """
    by = by or []
    each = df.groupBy(*by, "score").agg(F.sum(F.col("y").cast("long")).alias("p"), F.sum((1 - F.col("y")).cast("long")).alias("n"))
    whole = each.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    c, t = running_sums(each, "score", by, {"tp": "p", "fp": "n"}, ["p", "n"], falling=True).alias("c"), whole.alias("t")
    same = F.lit(True)
    for k in by:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}"))
    out = (c.join(t, same) if by else c.crossJoin(t)).select("c.*", "t.pos", "t.neg")
    return out.select(*by, "score", "p", "n", "tp", "fp", "pos", "neg", F.coalesce(F.try_divide("tp", "pos"), F.lit(0.0)).alias("tpr"), F.coalesce(F.try_divide("fp", "neg"), F.lit(0.0)).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), "next_p", "next_n")


def average_precision(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Step-wise: precision weighted by the gain in recall; 0 with one class only."""
    return average_precision_of(curve(df, by), by)


def average_precision_of(c: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The same from a curve."""
    return c.groupBy(*(by or [])).agg(F.when((F.max("pos") > 0) & (F.max("neg") > 0), F.sum(F.col("precision") * F.col("p") / F.greatest("pos", F.lit(1)))).otherwise(0.0).alias("pr_auc"))


def areas(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Trapezoids under the ROC curve and under precision over recall (which begins at precision 1)."""
    by = by or []
    rate = lambda a, b, none=0.0: F.coalesce(F.try_divide(a, b), F.lit(none))
    tp, fp = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")  # at the next higher score
    c = curve(df, by).withColumns({"x": rate(fp, F.col("neg")), "z": rate(tp, F.col("pos")), "q": rate(tp, tp + fp, 1.0)})
    return c.groupBy(*by).agg(F.sum((F.col("fpr") - F.col("x")) * (F.col("tpr") + F.col("z")) / 2).alias("roc_auc"), F.sum((F.col("tpr") - F.col("z")) * (F.col("precision") + F.col("q")) / 2).alias("pr_auc_trapezoid"))


def _best(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The row with the largest values in ``order``, by partial maxima."""
    best = df.groupBy(*by).agg(F.max_by(F.struct(*[c for c in df.columns if c not in by]), F.struct(*order)).alias("_r"))
    return best.where("_r is not null").select(*by, "_r.*")


def corners(c: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The curve without points on a straight line between their neighbours; both ends stay."""
    return c.where("next_p is null or next_n <> n or next_p <> p")


def recall_at_fpr(df: DataFrame, limit: float = 0.05, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return _best(curve(df, by).where(F.col("fpr") <= limit), by, [F.col("tpr"), F.col("score")]).select(*by, F.col("tpr").alias("recall"), F.col("score").alias("threshold"))


def precision_at_recall(df: DataFrame, limit: float = 0.8, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return _best(curve(df, by).where(F.col("tpr") >= limit), by, [F.col("precision"), F.col("score")]).select(*by, "precision", F.col("score").alias("threshold"))


def threshold_at_fpr(df: DataFrame, limit: float = 0.05, least_negatives: int = 20, by: list[str] | None = None) -> DataFrame:
    """The highest corner with the best recall among those within the allowed false positives.

    Allowed are floor(limit * negatives), or one if there are few negatives. Groups of one class have no row.
    """
    return threshold_at_fpr_of(curve(df, by), limit, least_negatives, by)


def threshold_at_fpr_of(c: DataFrame, limit: float = 0.05, least_negatives: int = 20, by: list[str] | None = None) -> DataFrame:
    """The same from a curve."""
    by = by or []
    allowed = F.when(F.col("neg") < least_negatives, F.lit(1)).otherwise(F.floor(F.col("neg") * limit))
    within = corners(c.where("pos > 0 and neg > 0"), by).where(F.col("fp") <= allowed)
    return _best(within, by, [F.col("tpr"), F.col("score")]).select(*by, F.col("score").alias("threshold"), F.col("tpr").alias("recall"), "precision", "fpr")


def threshold_nearest_fpr(df: DataFrame, target: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """The corner whose false positive rate is nearest the target; 0.5 for one class."""
    by = by or []
    near = _best(corners(curve(df, by), by), by, [-F.abs(F.col("fpr") - target), F.col("score")])
    return near.select(*by, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("score")).otherwise(0.5).alias("threshold"))


def report(df: DataFrame, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """Counts and rates for a yes or no prediction."""
    y, hit = F.col("y") == 1, predicted
    row = df.groupBy(*(by or [])).agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(~y & ~hit).alias("tn"), F.count_if(y & ~hit).alias("fn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = row.withColumns({"precision": rate(F.col("tp"), F.col("tp") + F.col("fp")), "recall": rate(F.col("tp"), F.col("tp") + F.col("fn")), "accuracy": rate(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), "fpr": rate(F.col("fp"), F.col("fp") + F.col("tn")), "specificity": rate(F.col("tn"), F.col("fp") + F.col("tn"))})
    return out.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def calibration_bins(df: DataFrame, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins closed on the left, the last one on both sides."""
    edges = [k / bins for k in range(1, bins)]
    place = sum((F.col("score") >= e).cast("int") for e in edges) if edges else F.lit(0)
    return df.withColumn("bin", place).groupBy(*(by or []), "bin").agg(F.count("*").alias("n"), F.avg("score").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))


def calibration_error(df: DataFrame, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    b = calibration_bins(df, bins, by)
    gap = F.abs(F.col("mean_p") - F.col("rate"))
    return b.groupBy(*(by or [])).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def min_max(df: DataFrame, col: str = "score") -> DataFrame:
    """Scores stretched to 0..1; 0 if all are alike."""
    ends = df.agg(F.min(col).alias("_a"), F.max(col).alias("_b"))
    return df.join(F.broadcast(ends)).withColumn(col, F.coalesce(F.try_divide(F.col(col) - F.col("_a"), F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0))), F.lit(0.0))).drop("_a", "_b")


def rates(predicted: Column) -> dict[str, tuple[Column, Column]]:
    """Precision, recall and false positive rate of a yes or no prediction, as what is summed above and below the line."""
    y = F.col("y") == 1
    return {"precision": (predicted & y, predicted), "recall": (predicted & y, y), "fpr": (predicted & ~y, ~y)}


def bootstrap(df: DataFrame, metric: Column | dict[str, tuple[Column, Column]], replicates: int = 100, seed: int = 0, key: str = "event_key") -> DataFrame:
    """Poisson bootstrap: each replicate weighs each row by a Poisson(1) draw, which follows from its key, the replicate and the seed.

    Ratios of sums, given by name with what is summed above and below, have a row each: ``metric, mean, low, high`` with 95 %
    intervals. A task draws the weights of a few rows for all replicates at once and adds them up: rows are read once and never copied, and
    a task sends one row for each replicate. A replicate whose lower sum is 0 leaves out the ratio. Any other weighted aggregate
    over ``w`` gives ``mean, low, high``; its rows are copied for each replicate.
    """
    if isinstance(metric, Column):
        per = _copied(df, metric, replicates, seed, key)
        q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
        return per.agg(F.avg("value").alias("mean"), q[0].alias("low"), q[1].alias("high"))
    parts = [F.coalesce(c.cast("double"), F.lit(0.0)) for pair in metric.values() for c in pair]
    rows, n = df.select(F.xxhash64(F.col(key), F.lit(seed)).alias("hash"), F.array(*parts).alias("parts")), len(parts)
    steps, term, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, salts = np.zeros((replicates, n)), np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            hashes, values = batch.column("hash").to_numpy().view(np.uint64), batch.column("parts").flatten().to_numpy().reshape(-1, n)
            for at in range(0, len(hashes), 1024):
                h = hashes[at : at + 1024, None] + salts
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                sums += np.searchsorted(steps, (h >> np.uint64(11)) / float(1 << 53), side="right").T @ values[at : at + 1024]
        yield pa.RecordBatch.from_pydict({"replicate": pa.array(np.arange(replicates)), **{f"s{k}": pa.array(sums[:, k]) for k in range(n)}})

    per = rows.mapInArrow(run, "replicate long, " + ", ".join(f"s{k} double" for k in range(len(parts)))).groupBy("replicate").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(len(parts))])
    long = per.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.try_divide(f"s{2 * k}", f"s{2 * k + 1}").alias("value")) for k, n in enumerate(metric)])).alias("r")).select("r.*")
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), q[0].alias("low"), q[1].alias("high"))


def _copied(df: DataFrame, metric: Column, replicates: int, seed: int, key: str) -> DataFrame:
    u = F.pmod(F.xxhash64(F.col(key), F.col("replicate"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    tail, cum, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(8):
        cum += term
        term /= k + 1
        tail = tail + (u >= cum).cast("int")
    spread = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", tail)
    return spread.groupBy("replicate").agg(metric.alias("value"))
