"""Robust statistics as aggregates over groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges into which a group's distinct values are cut for running sums.
RANGES = 64


def median(c) -> Column:
    return F.percentile(c, F.lit(0.5))


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: rows meet by sorted shuffles, and it is never broadcast through the driver."""
    return df.hint("merge")


def no_nan(c: Column) -> Column:
    """NaN is null from ingestion on: Spark would order it above all numbers."""
    return F.when(~F.isnan(c), c)


def mad_sigma(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """``keys, n, med, sigma``: 1.4826 times the median distance from the median; null values do not count."""
    some = df.where(F.col(col).isNotNull())
    mid = some.groupBy(*keys).agg(median(col).alias("med"), F.count("*").alias("n"))
    spread = some.join(large(mid), keys).groupBy(*keys).agg((median(F.abs(F.col(col) - F.col("med"))) * 1.4826).alias("sigma"))
    return mid.join(large(spread), keys).select(*keys, "n", "med", "sigma")


#: Values that one aggregate gathers for a quantile; wider ranges are narrowed first. Accuracy of the guesses.
GATHER, ACCURACY = 20_000, 10_000


@dataclass
class _Search:
    """The values of a column from ``low`` to ``high``, of which ``below`` are less than these and ``upto`` are not more."""

    column: str
    rank: int
    part: float
    upto: int
    below: int = 0
    low: float | None = None
    high: float | None = None

    @property
    def size(self) -> int:
        return self.upto - self.below

    def within(self) -> Column:
        x = F.col(self.column).cast("double")
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (x >= self.low)
        if self.high is not None:
            ok = ok & (x <= self.high)
        return F.when(ok, x)

    def guesses(self) -> Column:
        pad = self.size * 2 // ACCURACY + 2
        share = lambda r: min(max((r - self.below) / self.size, 0.0), 1.0)
        return F.percentile_approx(self.within(), F.array(F.lit(share(self.rank - pad)), F.lit(share(self.rank + 2 + pad))), F.lit(ACCURACY))

    def narrow(self, low: float, high: float, below: int, upto: int) -> bool:
        """Take what keeps both wanted ranks inside; whether this was of use."""
        before = self.size
        if self.below < below <= self.rank or self.low is None and below <= self.rank:
            self.low, self.below = low, below
        if self.rank + 1 < upto < self.upto or self.high is None and self.rank + 1 < upto:
            self.high, self.upto = high, upto
        return self.size < before or self.low == self.high


def quantiles(df: DataFrame, columns: list[str], shares: list[float], gather: int = GATHER) -> dict[str, list[float | None]]:
    """Exact quantiles of columns over a whole table, as ``percentile`` gives them, by distributed selection.

    A sketch guesses a range around each wanted rank, a count tells which ranks the range really holds, and so on until few
    values are left or all are one; these alone are gathered. So no task and no buffer holds the distinct values of a column. Each round
    is two aggregates over the table for all columns; three are enough for 10 ** 11 rows. Null values do not count; without any the
    quantiles are null. Results do not depend on how good the guesses are.
    """
    counts = df.agg(*[F.count(F.col(c).cast("double")).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    found: dict[tuple[str, float], float | None] = {}
    open_: dict[tuple[str, float], _Search] = {}
    for k, c in enumerate(columns):
        for q in shares:
            at = q * (counts[k] - 1)
            if counts[k]:
                open_[c, q] = _Search(c, min(int(at), counts[k] - 1), at - int(at), counts[k])
            else:
                found[c, q] = None
    wide = {k: s for k, s in open_.items() if s.size > gather}
    while wide:
        keys = list(wide)
        row = df.agg(*[wide[k].guesses().alias(f"g{i}") for i, k in enumerate(keys)]).first()
        x = lambda k: F.col(k[0]).cast("double")
        seen = df.agg(*[c for i, k in enumerate(keys) for c in (F.count_if(x(k) < row[i][0]).alias(f"b{i}"), F.count_if(x(k) <= row[i][1]).alias(f"u{i}"))]).first()
        useful = {k: wide[k].narrow(row[i][0], row[i][1], seen[2 * i], seen[2 * i + 1]) for i, k in enumerate(keys)}
        wide = {k: s for k, s in wide.items() if useful[k] and s.size > gather and s.low != s.high}
    for k, s in open_.items():
        if s.low is not None and s.low == s.high:
            found[k] = s.low
    left = [k for k in open_ if k not in found]
    if left:
        ranges = {(open_[k].column, open_[k].low, open_[k].high): open_[k] for k in left}
        names = {r: f"v{i}" for i, r in enumerate(ranges)}
        values = df.agg(*[F.sort_array(F.collect_list(s.within())).alias(names[r]) for r, s in ranges.items()])
        pick = []
        for i, k in enumerate(left):
            s = open_[k]
            v = F.col(names[s.column, s.low, s.high])
            pick += [F.get(v, F.lit(s.rank - s.below)).alias(f"a{i}"), F.get(v, F.lit(s.rank - s.below + 1)).alias(f"b{i}")]
        got = values.select(*pick).first()
        for i, k in enumerate(left):
            a, b, part = got[2 * i], got[2 * i + 1], open_[k].part
            found[k] = a if not part or b is None else (1 - part) * a + part * b
    return {c: [found[c, q] for q in shares] for c in columns}


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column with count, mean, sample deviation, extremes and exact quartiles."""
    shares = [0.25, 0.5, 0.75]
    known, aggs = quantiles(df, columns, shares), []
    for c in columns:
        q = [F.lit(v).cast("double").alias(n) for v, n in zip(known[c], ("q25", "q50", "q75"), strict=True)]
        aggs.append(F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"), *q, F.max(F.col(c).cast("double")).alias("max")).alias(c))
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("r")).select("r.*")


def unpivoted(row: DataFrame, name: str, value: str) -> DataFrame:
    """A one-row table of aggregates as (name, value) rows."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias(value)) for c in row.columns])).alias("r")).select("r.*")


def ranged(values: DataFrame, col: str, by: list[str], ranges: int = RANGES) -> DataFrame:
    """Adds ``_range``, which rises with ``col`` within each group: about as many rows in each, equal values in one.

    Null values come first. A window over a range stands for one over the group, which one task would have to sort.
    """
    edges = values.groupBy(*by).agg(F.percentile_approx(col, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(20 * ranges)).alias("_edges"))
    place = F.when(F.col(col).isNull(), -1).otherwise(F.size(F.filter("_edges", lambda e: e < F.col(col))))
    if not by:
        return values.crossJoin(edges).withColumn("_range", place).drop("_edges")  # one row of edges
    v, e = values.alias("v"), edges.alias("e")
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"v.{c}").eqNullSafe(F.col(f"e.{c}"))
    return v.join(e, same).select("v.*", place.alias("_range"))


def running_sums(values: DataFrame, col: str, by: list[str], sums: dict[str, str], following: list[str] | None = None, falling: bool = False) -> DataFrame:
    """Adds running sums (new name: column) in the order of ``col``, whose values are distinct within a group, the own
    row included; ``following`` adds ``next_<column>`` of the row after it.

    Sums run within ranges, and begin with the totals of the ranges before: a row for each range.
    """
    rows = ranged(values, col, by)
    order = F.desc(col) if falling else F.asc(col)
    place = -F.col("_range") if falling else F.col("_range")
    first = F.max_by if falling else F.min_by
    nexts = following or []
    totals = rows.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()], *[first(c, F.coalesce(F.col(col).cast("double"), F.lit(float("-inf")))).alias(f"_f_{c}") for c in nexts])
    before = W.partitionBy(*by).orderBy(place)
    offsets = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{k}").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_o_{k}") for k in sums], *[F.lead(f"_f_{c}").over(before).alias(f"_n_{c}") for c in nexts])
    within = W.partitionBy(*by, "_range").orderBy(order)
    own = rows.withColumns({k: F.sum(c).over(within.rowsBetween(W.unboundedPreceding, 0)) for k, c in sums.items()} | {f"next_{c}": F.lead(c).over(within) for c in nexts})
    v, o = own.alias("v"), offsets.alias("o")
    same = F.col("v._range") == F.col("o._range")
    for c in by:
        same = same & F.col(f"v.{c}").eqNullSafe(F.col(f"o.{c}"))
    kept = [c for c in own.columns if c not in ("_range", *sums, *[f"next_{c}" for c in nexts])]
    return v.join(o, same).select(*[F.col(f"v.{c}") for c in kept], *[(F.col(f"v.{k}") + F.col(f"o._o_{k}")).alias(k) for k in sums], *[F.coalesce(F.col(f"v.next_{c}"), F.col(f"o._n_{c}")).alias(f"next_{c}") for c in nexts])
