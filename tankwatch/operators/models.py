"""Classifiers with MLlib: preprocessing, calibration by folds, ensembles and evaluation tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankwatch.functions.stats import running_sums
from tankwatch.operators import metrics
from tankwatch.operators.detection import _stored


def preprocessing(numeric: list[str], binary: list[str], categorical: list[str]) -> list:
    """Median for missing numbers, scaling without centring, one-hot for words with a place for unknown ones."""
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}_i" for c in numeric]), VectorAssembler(inputCols=[f"{c}_i" for c in numeric], outputCol="numbers"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=False)]
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"{c}_k" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_k" for c in categorical], outputCols=[f"{c}_o" for c in categorical], handleInvalid="keep")]
    return [*stages, VectorAssembler(inputCols=["scaled", *binary, *[f"{c}_o" for c in categorical]], outputCol="features", handleInvalid="keep")]


def logistic(rows: int, c: float = 0.1) -> LogisticRegression:
    return LogisticRegression(labelCol="y", weightCol="weight", regParam=1.0 / (c * max(rows, 1)), maxIter=50)


def forest(trees: int = 200, depth: int = 10, leaf: int = 10, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed)


def boosted(rounds: int = 100, depth: int = 5, step: float = 0.1, share: float = 0.8, weighted: bool = True, seed: int = 42) -> GBTClassifier:
    m = GBTClassifier(labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=share, seed=seed)
    return m.setWeightCol("weight") if weighted else m


def balanced(df: DataFrame, positive_only: bool = False) -> DataFrame:
    """Weights that give both classes the same total (or positives negatives / positives)."""
    n, pos = df.agg(F.count("*"), F.sum("y")).first()
    pos = pos or 0
    a, b = (1.0, (n - pos) / max(pos, 1)) if positive_only else (n / max(2 * (n - pos), 1), n / max(2 * pos, 1))
    return df.withColumn("weight", F.when(F.col("y") == 1, b).otherwise(a))


@dataclass
class Platt:
    """A logistic map of a model's score."""

    slope: float
    shift: float

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_p", 1 / (1 + F.exp(-(F.col("_s") * self.slope + self.shift))))

    def save(self, path: str) -> None:
        _session().createDataFrame([(self.slope, self.shift)], "slope double, shift double").coalesce(1).write.mode("overwrite").json(path)

    @staticmethod
    def load(path: str) -> Platt:
        row = _session().read.json(path).first()
        return Platt(row.slope, row.shift)


@dataclass
class Isotonic:
    """A rising step map of a model's score."""

    model: IsotonicRegressionModel

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> Isotonic:
        return Isotonic(IsotonicRegressionModel.load(path))


@dataclass
class Plain:
    """The score as it is, for want of a fold to calibrate on."""

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_p", F.col("_s"))

    def save(self, path: str) -> None:
        pass

    @staticmethod
    def load(path: str) -> Plain:
        return Plain()


_LINKS = {c.__name__: c for c in (Platt, Isotonic, Plain)}


@dataclass
class Calibrated:
    """The mean of models that were each fitted without one fold and calibrated on it."""

    models: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for k, (base, link) in enumerate(self.models):
            keep = out.columns
            out = base.transform(out).withColumn("_s", vector_to_array("probability")[1])
            out = link(out).select(*keep, F.col("_p").alias(f"_p{k}"))
        total = sum(F.col(f"_p{k}") for k in range(len(self.models)))
        return out.withColumn("score", total / len(self.models)).drop(*[f"_p{k}" for k in range(len(self.models))])


def stratified(df: DataFrame, folds: int = 5, key: str = "event_key", label: str = "y") -> DataFrame:
    """Adds ``_fold``: the rows of each class go round the folds in the order of their keys' hashes.

    So each fold has a row of each class that has ``folds`` rows. Ranks are counted within ranges of the hash, so that no task
    sorts a class.
    """
    ranked = running_sums(df.withColumns({"_hash": F.xxhash64(key), "_one": F.lit(1)}), "_hash", [label], {"_rank": "_one"})
    return ranked.withColumn("_fold", F.pmod("_rank", F.lit(folds)).cast("int")).select(*df.columns, "_fold")


def calibrate(df: DataFrame, stages: list, folds: int = 5, method: str = "sigmoid", key: str = "event_key") -> Calibrated:
    """Each fold's scores are mapped to rates by Platt's or isotonic regression; folds are stratified."""
    dealt = _stored(stratified(df, folds, key))
    out = Calibrated()
    for k in range(folds):
        fit, rest = dealt.where(F.col("_fold") != k), dealt.where(F.col("_fold") == k)
        if rest.select("y").distinct().count() < 2 or fit.select("y").distinct().count() < 2:
            continue
        base = Pipeline(stages=stages).fit(balanced(fit))
        held = base.transform(rest).select(vector_to_array("probability")[1].alias("_s"), F.col("y").cast("double").alias("y"))
        if method == "isotonic":
            m = IsotonicRegression(featuresCol="_s", labelCol="y", predictionCol="_p").fit(held)
            out.models.append((base, Isotonic(m)))
        else:
            m = LogisticRegression(labelCol="y", featuresCol="_f").fit(VectorAssembler(inputCols=["_s"], outputCol="_f").transform(held))
            out.models.append((base, Platt(float(m.coefficients[0]), float(m.intercept))))
    if not out.models:
        out.models = [(Pipeline(stages=stages).fit(balanced(df)), Plain())]
    return out


def temperature(df: DataFrame, logit: str = "logit", least: float = 0.05, most: float = 10.0, steps: int = 40, rounds: int = 3) -> float:
    """The divisor of the logits with the least negative log likelihood.

    Each round is one aggregate over a grid of divisors, finer around the best of the round before.
    """
    low, high = least, most
    best = 1.0
    for _ in range(rounds):
        grid = [low * (high / low) ** (k / steps) for k in range(steps + 1)]
        loss = lambda t: F.avg(F.when(F.col("y") == 1, F.log1p(F.exp(-F.col(logit) / t))).otherwise(F.log1p(F.exp(F.col(logit) / t))))
        row = df.agg(*[loss(t).alias(f"t{k}") for k, t in enumerate(grid)]).first()
        if row[0] is None:
            return best
        at = min(range(len(grid)), key=lambda k: row[k])
        best, low, high = grid[at], grid[max(at - 1, 0)], grid[min(at + 1, steps)]
    return best


def isolation_scores(df: DataFrame, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 0, key: str = "event_key") -> DataFrame:
    """Isolation forest: one task grows a tree from its own bounded sample; rows score by mean path length, 0 to 1."""
    filled = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    n = max(filled.count(), 1)
    rate = min(1.0, 2.0 * sample / n)
    chance = F.pmod(F.xxhash64(F.col(key), F.col("tree"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    dealt = filled.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(chance < rate)

    def grow(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key_[0])])
        x = pdf[columns].to_numpy()
        x = x[rng.permutation(len(x))[:sample]]
        nodes: list[tuple] = []

        def split(rows: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append(None)
            wide = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) else []
            if len(rows) <= 1 or depth >= np.ceil(np.log2(max(sample, 2))) or not len(wide):
                nodes[me] = (-1, 0.0, depth + _mean_path(len(rows)), -1, -1)
                return me
            c = int(rng.choice(wide))
            cut = rng.uniform(rows[:, c].min(), rows[:, c].max())
            left, right = split(rows[rows[:, c] < cut], depth + 1), split(rows[rows[:, c] >= cut], depth + 1)
            nodes[me] = (c, cut, 0.0, left, right)
            return me

        split(x, 0)
        return pd.DataFrame([(int(key_[0]), k, *node) for k, node in enumerate(nodes)], columns=["tree", "node", "col", "cut", "path", "left", "right"])

    grown = dealt.groupBy("tree").applyInPandas(grow, "tree int, node int, col int, cut double, path double, left int, right int").toPandas()  # trees * 2 * sample rows at most
    forest_ = df.sparkSession.sparkContext.broadcast([t.sort_values("node")[["col", "cut", "path", "left", "right"]].to_numpy() for _, t in grown.groupby("tree")])

    def path(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, total = pdf[columns].to_numpy(), np.zeros(len(pdf))
            for t in forest_.value:
                at = np.zeros(len(x), dtype=int)
                while (open_ := np.flatnonzero(t[at, 0] >= 0)).size:
                    node = t[at[open_]]
                    go = x[open_, node[:, 0].astype(int)] < node[:, 1]
                    at[open_] = np.where(go, node[:, 3], node[:, 4]).astype(int)
                total += t[at, 2]
            yield pd.DataFrame({key: pdf[key], "score": 2 ** (-total / max(len(forest_.value), 1) / _mean_path(sample))})

    return metrics.min_max(filled.mapInPandas(path, f"{key} long, score double"))


def _mean_path(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def presets(rows: int, quick: bool = False) -> dict:
    small = {"trees": 20} if quick else {}
    fast = {"rounds": 10} if quick else {}
    return {"logistic": logistic(rows), "random_forest": forest(**small), "boosted": boosted(**fast), "boosted_deep": boosted(**(fast or {"rounds": 154}), depth=6, weighted=False)}


class Models(dict):
    """Fitted models by name, and ``failures``: why others were not fitted."""

    def __init__(self, *args):
        super().__init__(*args)
        self.failures: dict[str, str] = {}

    def complete(self) -> Models:
        """These, if none is missing; else it is an error that tells why."""
        if self.failures:
            raise ValueError("not fitted: " + "; ".join(f"{k} ({why})" for k, why in self.failures.items()))
        return self


def train_all(df: DataFrame, numeric: list[str], binary: list[str], categorical: list[str], folds: int = 5, quick: bool = False, names: list[str] | None = None, more: dict | None = None) -> Models:
    """Calibrated linear and forest models and plain boosted ones, and ``more`` plain ones.

    A model whose parameters or columns don't fit the data is left out, and ``failures`` tells why; rows of one class fit none. Who
    wants them all asks for ``complete``. A job that fails is no such case: it is an error.
    """
    pre, out = preprocessing(numeric, binary, categorical), Models()
    seen = df.agg(F.count("*").alias("n"), F.countDistinct("y").alias("k")).first()
    for name, m in {**presets(seen.n, quick), **(more or {})}.items():
        if names and name not in names and name not in (more or {}):
            continue
        if seen.k < 2:
            out.failures[name] = "one class only"
            continue
        try:
            out[name] = calibrate(df, [*pre, m], folds) if name in ("logistic", "random_forest") else Pipeline(stages=[*pre, m]).fit(balanced(df, positive_only=True))
        except (IllegalArgumentException, AnalysisException) as e:
            out.failures[name] = f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"
    return out


def predict(models: dict, df: DataFrame, key: str = "event_key") -> DataFrame:
    """Long table ``event_key, model, score, y, pattern``."""
    keep = [c for c in (key, "y", "pattern") if c in df.columns]
    if not models:
        return df.select(*keep, F.lit("").alias("model"), F.lit(0.0).alias("score")).where("false")
    parts = [(m.transform(df) if isinstance(m, Calibrated) else m.transform(df).withColumn("score", vector_to_array("probability")[1])).select(*keep, F.lit(name).alias("model"), "score") for name, m in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def evaluate(scores: DataFrame, fpr: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """A row for each model: average precision, the threshold at the wanted rate, and the report there; best first.

    The curve is made once and stored, so that what reads it has a small plan.
    """
    by = by or ["model"]
    c = _stored(metrics.curve(scores, by))
    t = metrics.threshold_at_fpr_of(c, fpr, by=by).select(*by, "threshold")
    ap = metrics.average_precision_of(c, by)
    hit = scores.join(t, by, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    rep = metrics.report(hit, F.col("score") >= F.col("threshold"), by)
    return ap.join(rep, by).join(t, by, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5))).orderBy(F.desc("pr_auc"), *by)


def per_pattern(scores: DataFrame, fallback: float = 0.5, fpr: float = 0.05, least: int = 10) -> DataFrame:
    """The same by pattern, for patterns with enough rows of both classes."""
    ok = scores.groupBy("pattern").agg(F.count("*").alias("n"), F.countDistinct("y").alias("k")).where((F.col("n") >= least) & (F.col("k") == 2)).select("pattern")
    return evaluate(_stored(scores.join(ok, "pattern", "left_semi")), fpr, ["pattern"])


def pattern_models(df: DataFrame, numeric: list[str], binary: list[str], least: int = 30, positives: int = 5, quick: bool = False, folds: int = 5) -> dict:
    """A model for each pattern with enough rows and positives; others are skipped. One that has enough and can't be fitted is an error."""
    sizes = df.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()  # a row for each pattern
    return {r.pattern: train_all(df.where(F.col("pattern") == r.pattern), numeric, binary, [], folds, quick, ["logistic"]).complete()["logistic"] for r in sizes if r.n >= least and (r.p or 0) >= positives}


def pattern_results(own: dict, test: DataFrame, fpr: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """A result row for each pattern's own model over its test rows: average precision, the report at its threshold, which is the one
    nearest the wanted false positive rate; and the scores."""
    parts = [predict({k: m}, test.where(F.col("pattern") == k)) for k, m in own.items()]
    scores = predict({}, test)
    for part in parts:
        scores = scores.unionByName(part)
    scores = _stored(scores)
    t = metrics.threshold_nearest_fpr(scores, fpr, ["pattern"])
    hit = scores.join(t, "pattern")
    rows = metrics.average_precision(scores, ["pattern"]).join(metrics.report(hit, F.col("score") >= F.col("threshold"), ["pattern"]), "pattern").join(t, "pattern")
    return rows, scores


def blend(scores: DataFrame, how: str = "mean", weights: dict[str, float] | None = None, key: str = "event_key") -> DataFrame:
    """One score from all models: mean, weighted, max, median, or mean of ranks."""
    if how == "weighted":
        w = F.coalesce(F.element_at(F.create_map(*[x for k, v in (weights or {}).items() for x in (F.lit(k), F.lit(float(v)))]), F.col("model")), F.lit(0.0)) if weights else F.lit(1.0)
        return scores.groupBy(key).agg((F.sum(F.col("score") * w) / F.sum(w)).alias("score"))
    if how == "rank":
        each = scores.groupBy("model", "score").agg(F.count("*").alias("t"))
        ranks = running_sums(each, "score", ["model"], {"upto": "t"}).select("model", "score", (F.col("upto") - (F.col("t") - 1) / 2).alias("r"))
        return metrics.min_max(scores.join(ranks, ["model", "score"]).groupBy(key).agg(F.avg("r").alias("score")))
    agg = {"mean": F.avg("score"), "max": F.max("score"), "median": F.percentile("score", F.lit(0.5))}[how]
    return scores.groupBy(key).agg(agg.alias("score"))


def importance(model: PipelineModel | Calibrated) -> DataFrame:
    """``feature, importance``, largest first; the mean over a calibrated model's parts."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    bases = [b for b, _ in model.models] if isinstance(model, Calibrated) else [model]
    rows: dict[str, list[float]] = {}
    for base in bases:
        last = base.stages[-1]
        values = np.abs(last.coefficients.toArray()) if hasattr(last, "coefficients") else last.featureImportances.toArray()
        for k, v in enumerate(values):
            rows.setdefault(_names(base, len(values))[k], []).append(float(v))
    return spark.createDataFrame([(k, float(np.mean(v))) for k, v in rows.items()], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _names(base: PipelineModel, n: int) -> list[str]:
    out: list[str] = []
    parts = [s for s in base.stages if isinstance(s, VectorAssembler)]
    for c in parts[-1].getInputCols():
        if c == "scaled":
            out += [x.removesuffix("_i") for x in parts[0].getInputCols()]
        elif c.endswith("_o"):
            labels = next(s for s in base.stages if hasattr(s, "labelsArray")).labelsArray[0]
            out += [f"{c.removesuffix('_o')}={v}" for v in labels]
        else:
            out.append(c)
    return out + [f"f{k}" for k in range(len(out), n)]


def required_features(model: PipelineModel | Calibrated) -> list[str]:
    """The columns that a fitted model reads, in its own order."""
    base = model.models[0][0] if isinstance(model, Calibrated) else model

    def columns(kind: str) -> list[str]:
        out: list[str] = []
        for s in base.stages:
            for name in (f"{kind}Col", f"{kind}Cols"):
                if s.hasParam(name) and s.isDefined(s.getParam(name)):
                    found = s.getOrDefault(name)
                    out += found if isinstance(found, list) else [found]
        return out

    made = set(columns("output"))
    return [c for c in dict.fromkeys(columns("input")) if c not in made]


def missing_features(model: PipelineModel | Calibrated, df: DataFrame) -> list[str]:
    return [c for c in required_features(model) if c not in df.columns]


def compatible(model: PipelineModel | Calibrated, df: DataFrame) -> DataFrame:
    """``df``, if it lacks nothing that the model reads; else it is an error."""
    lacking = missing_features(model, df)
    if lacking:
        raise ValueError(f"missing features: {', '.join(lacking)}")
    return df


def save(model: PipelineModel | Calibrated, path: str) -> None:
    """A plain pipeline as such; a calibrated one as its pipelines and the map of each one's scores."""
    if not isinstance(model, Calibrated):
        model.write().overwrite().save(path)
        return
    for k, (base, link) in enumerate(model.models):
        base.write().overwrite().save(f"{path}/base{k}")
        link.save(f"{path}/link{k}")
    spark = _session()
    spark.createDataFrame([(k, type(link).__name__) for k, (_, link) in enumerate(model.models)], "part int, kind string").coalesce(1).write.mode("overwrite").json(f"{path}/parts")


def load(path: str) -> PipelineModel | Calibrated:
    spark = _session()
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/parts")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return PipelineModel.load(path)
    kinds = {r.part: r.kind for r in spark.read.json(f"{path}/parts").collect()}  # one row for each fold
    return Calibrated([(PipelineModel.load(f"{path}/base{k}"), _LINKS[kinds[k]].load(f"{path}/link{k}")) for k in sorted(kinds)])


def save_all(models: dict, path: str) -> None:
    for name, m in models.items():
        save(m, f"{path}/{name}")


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def stored(df: DataFrame) -> DataFrame:
    return _stored(df)
