"""Classifier evaluation in aggregates, and dimension reduction and classifiers on pyspark.ml."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut

KERNEL = "dims int, n int, gamma double, seed int"


def confusion(predictions: DataFrame, truth: str = "truth", pred: str = "pred", keys=()) -> DataFrame:
    """(keys, tp0, tp1, fp0, fp1)."""
    t, p = F.col(truth), F.col(pred)
    return predictions.groupBy(*keys).agg(*[F.count_if((p == c) & (t == c if good else t != c)).alias(f"{'t' if good else 'f'}p{c}") for good in (True, False) for c in (0, 1)])


def macro(counts: DataFrame, keys=()) -> DataFrame:
    """(keys, precision, recall, f1, accuracy): unweighted means over both classes; null where a class is never predicted or never true."""
    tp, fp = [F.col("tp0"), F.col("tp1")], [F.col("fp0"), F.col("fp1")]
    precision = [F.try_divide(tp[c], tp[c] + fp[c]) for c in (0, 1)]
    recall = [F.try_divide(tp[c], tp[c] + fp[1 - c]) for c in (0, 1)]
    f1 = [F.try_divide(2 * p * r, p + r) for p, r in zip(precision, recall)]
    mean = lambda x: (x[0] + x[1]) / 2
    return counts.select(*keys, mean(precision).alias("precision"), mean(recall).alias("recall"), mean(f1).alias("f1"), F.try_divide(tp[0] + tp[1], tp[0] + tp[1] + fp[0] + fp[1]).alias("accuracy"))


def roc_points(scored: DataFrame, label: str = "truth", score: str = "score", keys=(), tasks: int | None = None) -> DataFrame:
    """(keys, score, tp, fp, tpr, fpr): one point per distinct score, from the highest down.

    Scores are counted first; the running sums go over ranges of scores in parallel, each range adding the totals of those above,
    one row a range, so no task sees all scores.
    """
    keys = list(keys)
    counts = scored.groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.sum(1 - F.col(label).cast("long")).alias("_n"))
    args = [x for x in (tasks,) if x]
    ranged = cut(counts.repartitionByRange(*args, F.col(score).desc()).withColumn("_part", F.spark_partition_id()))
    part = ranged.groupBy(*keys, "_part").agg(F.sum("_p").alias("_pp"), F.sum("_n").alias("_pn"))
    above = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    part = part.select(*keys, "_part", *[F.coalesce(F.sum(a).over(above), F.lit(0)).alias(f"{a}_above") for a in ("_pp", "_pn")], F.sum("_pp").over(whole).alias("_all_p"), F.sum("_pn").over(whole).alias("_all_n"))
    inner = Window.partitionBy(*keys, "_part").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(part, [*keys, "_part"])
    return joined.select(*keys, score, (F.sum("_p").over(inner) + F.col("_pp_above")).alias("tp"), (F.sum("_n").over(inner) + F.col("_pn_above")).alias("fp"), "_all_p", "_all_n").select(*keys, score, "tp", "fp", F.try_divide("tp", "_all_p").alias("tpr"), F.try_divide("fp", "_all_n").alias("fpr"))


def roc_auc(scored: DataFrame, label: str = "truth", score: str = "score", keys=()) -> DataFrame:
    """(keys, auc): the trapezoid under roc_points: each distinct score's negatives times the positives above it and half those at it."""
    keys = list(keys)
    points = roc_points(scored, label, score, keys)
    own = scored.groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.sum(1 - F.col(label).cast("long")).alias("_n"))
    joined = points.join(own, [*keys, score])
    area = F.sum(F.col("_n") * (F.col("tp") - F.col("_p") / 2))
    return joined.groupBy(*keys).agg(F.try_divide(area, F.sum("_p") * F.sum("_n")).alias("auc"))


def as_vector(column: str = "desc") -> Column:
    return array_to_vector(F.col(column).cast("array<double>"))


def pca(k: int = 1024, features: str = "features", out: str = "reduced") -> Pipeline:
    """Centred, then projected on the first k principal components."""
    return Pipeline(stages=[StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_centred"), PCA(k=k, inputCol="_centred", outputCol=out)])


def random_fourier(column: str, dims: int, n: int = 512, gamma: float = 1.0, seed: int = 0) -> Column:
    """Array of n features whose inner products approximate the radial kernel exp(-gamma |a - b|^2)."""
    import random

    draw = random.Random(seed)
    spread = math.sqrt(2 * gamma)
    parts = []
    for _ in range(n):
        w, b = [draw.gauss(0, spread) for _ in range(dims)], draw.uniform(0, 2 * math.pi)
        dot = F.aggregate(F.zip_with(F.col(column), F.array(*map(F.lit, w)), lambda x, y: x * y), F.lit(0.0), lambda s, e: s + e)
        parts.append(F.lit(math.sqrt(2 / n)) * F.cos(dot + b))
    return F.array(*parts)


@functools.lru_cache(2)
def _drawn(dims: int, n: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.normal(0, math.sqrt(2 * gamma), (dims, n)), draw.uniform(0, 2 * math.pi, n)


def radial(column: str, dims: int, n: int, gamma: float, seed: int = 0) -> Column:
    """random_fourier of a vector column of many dimensions: a product of matrices per Arrow batch; each worker draws the weights itself."""

    @F.pandas_udf("array<double>")
    def features(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return batch
        w, b = _drawn(dims, n, gamma, seed)
        return pd.Series(list(math.sqrt(2 / n) * np.cos(np.stack(batch.to_list()) @ w + b)))

    return array_to_vector(features(vector_to_array(F.col(column))))


def scaled_gamma(rows: DataFrame, column: str) -> tuple[int, float, int]:
    """Dimensions, 1 / (dimensions * variance of all components), and number of rows; gamma is 1 without variance."""
    n, mean, var = rows.select(Summarizer.metrics("count", "mean", "variance").summary(F.col(column)).alias("s")).select("s.count", "s.mean", "s.variance").first()
    whole = float(np.mean(var.toArray()) * (n - 1) / n + np.var(mean.toArray())) if n > 1 else 0.0
    return len(mean), 1 / (len(mean) * whole) if whole > 0 else 1.0, n


def svm(features: str = "reduced", label: str = "label", reg: float = 0.01, iterations: int = 50, standardise: bool = True) -> LinearSVC:
    """A linear margin; for a radial kernel give it features of radial or random_fourier."""
    return LinearSVC(featuresCol=features, labelCol=label, regParam=reg, maxIter=iterations, standardization=standardise, rawPredictionCol="margin")


def platt(margins: DataFrame, label: str = "label") -> tuple[Pipeline, DataFrame]:
    """A logistic curve over the margin as probability of class 1, and the data it is fitted on."""
    data = margins.withColumn("_m", vector_to_array("margin")[1])
    return Pipeline(stages=[VectorAssembler(inputCols=["_m"], outputCol="_mv"), LogisticRegression(featuresCol="_mv", labelCol=label, predictionCol="_pl", rawPredictionCol="_rl", probabilityCol="_prob")]), data


class Classifier:
    """Reduction, margin and probability, saved and loaded as pyspark.ml models. ``kernel`` has the dimensions, number, gamma and seed of the random features that approximate a radial kernel; their number is 0 for a linear margin."""

    def __init__(self, reduce: PipelineModel, margin, curve: PipelineModel, kernel: tuple[int, int, float, int] = (0, 0, 1.0, 0)):
        self.reduce, self.margin, self.curve, self.kernel = reduce, margin, curve, kernel

    @staticmethod
    def fit(train: DataFrame, k: int, label: str = "label", *, kernel: int = 512, gamma: float | None = None, cost: float = 1.0, seed: int = 0, **how) -> Classifier:
        """With ``kernel`` random features (0: a linear margin) and, unless given, gamma by the variance of the reduced vectors; ``cost`` is the weight of the margin's errors."""
        reduced = pca(k).fit(train)
        projected = reduced.transform(train)
        chosen = (0, 0, 1.0, 0)
        if kernel:
            dims, scaled, n = scaled_gamma(projected, "reduced")
            chosen = dims, kernel, scaled if gamma is None else gamma, seed
            how = {"reg": 1 / (cost * n), "standardise": False} | how
        # the solver makes many passes over these rows
        projected = Classifier._mapped(projected, chosen).select(label, "reduced").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            margin = svm(label=label, **how).fit(projected)
            curve, data = platt(margin.transform(projected), label)
            return Classifier(reduced, margin, curve.fit(data), chosen)
        finally:
            projected.unpersist()

    @staticmethod
    def _mapped(projected: DataFrame, kernel: tuple[int, int, float, int]) -> DataFrame:
        return projected.withColumn("reduced", radial("reduced", *kernel)) if kernel[1] else projected

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with pred (by margin) and score (probability of class 1)."""
        m = self.margin.transform(self._mapped(self.reduce.transform(rows), self.kernel)).withColumn("_m", vector_to_array("margin")[1])
        out = self.curve.transform(m)
        return out.withColumns({"pred": F.col("prediction").cast("int"), "score": vector_to_array("_prob")[1]}).select(*rows.columns, "pred", "score")

    def save(self, path: str) -> None:
        for name in ("reduce", "margin", "curve"):
            getattr(self, name).write().overwrite().save(f"{path}/{name}")
        SparkSession.active().createDataFrame([self.kernel], KERNEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/kernel")

    @staticmethod
    def load(path: str) -> Classifier:
        from pyspark.ml.classification import LinearSVCModel

        kernel = tuple(SparkSession.active().read.schema(KERNEL).parquet(f"{path}/kernel").first())
        return Classifier(PipelineModel.load(f"{path}/reduce"), LinearSVCModel.load(f"{path}/margin"), PipelineModel.load(f"{path}/curve"), kernel)


def covariance(rows: DataFrame, column: str = "desc") -> DataFrame:
    """(i, j, cov), i <= j: sample covariances of a vector's components by one aggregation of products."""
    spread = rows.select(F.col(column).cast("array<double>").alias("v")).select("v", F.posexplode("v").alias("i", "a"))
    pairs = spread.select("i", "a", F.posexplode("v").alias("j", "b")).where("i <= j")
    return pairs.groupBy("i", "j").agg(F.covar_samp("a", "b").alias("cov"))
