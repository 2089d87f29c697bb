"""Tabular layer: statistics per image, comparisons of pairs, and mismatch counts against golden tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as P


def statistics(values: DataFrame, keys=("image_id",), value: str = "gap") -> DataFrame:
    """(keys, n, mean, var, std, cv): population moments and the coefficient of variation."""
    return values.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"), F.stddev_pop(value).alias("std"), F.try_divide(F.stddev_pop(value), F.avg(value)).alias("cv"))


def distinct_images(pairs: DataFrame, a: str = "img1_path", b: str = "img2_path", out: str = "path") -> DataFrame:
    """Each image that a table of pairs names, once."""
    return pairs.select(F.col(a).alias(out)).union(pairs.select(F.col(b).alias(out))).distinct()


def all_pairs(images: DataFrame, name: str = "name") -> DataFrame:
    """(img1_path, img2_path): all ordered pairs of different images. The result itself is quadratic: meant for a set of images to compare, not for a corpus."""
    return images.select(F.col(name).alias("img1_path")).join(images.select(F.col(name).alias("img2_path")), F.col("img1_path") != F.col("img2_path"))


def verdicts(pairs: DataFrame, stats: DataFrame, name: str = "image_id", spacing: str = "cv", angle: str = "var", a: str = "img1_path", b: str = "img2_path") -> DataFrame:
    """(a, b, output_distance, output_angle): 1 if the first image is more regular, else 2."""
    side = lambda key, n: stats.select(F.col(name).alias(key), F.col(spacing).alias(f"_s{n}"), F.col(angle).alias(f"_a{n}"))
    joined = pairs.join(side(a, 1), a).join(side(b, 2), b)
    verdict = lambda x, y: P.verdict(F.coalesce(F.col(x).cast("double"), F.lit(float("nan"))), F.coalesce(F.col(y).cast("double"), F.lit(float("nan"))))
    return joined.select(a, b, verdict("_s1", "_s2").alias("output_distance"), verdict("_a1", "_a2").alias("output_angle"))


def count_score(golden: DataFrame, predicted: DataFrame, name: str = "image_name", count: str = "number of sutures", order: str | None = None) -> DataFrame:
    """(mismatches): golden counts that the prediction of that name misses; of several the first, by ``order`` or else in the order in which the table is read."""
    place = F.col(order) if order else F.monotonically_increasing_id()
    first = predicted.select(name, count, place.alias("_o")).groupBy(name).agg(F.min_by(count, "_o").alias("_p"))
    return golden.join(first, name, "left").agg(F.count_if(~F.col(count).eqNullSafe(F.col("_p"))).alias("mismatches"))


def positional_score(golden: DataFrame, predicted: DataFrame, row: str = "row") -> DataFrame:
    """(distance, angle, total): verdicts that differ between rows of the same number, whatever images they name; golden rows without one count."""
    return pair_score(golden, predicted, (row,))


def pair_score(golden: DataFrame, predicted: DataFrame, keys=("img1_path", "img2_path")) -> DataFrame:
    """(distance, angle, total): verdicts that differ."""
    p = predicted.select(*keys, F.col("output_distance").alias("_d"), F.col("output_angle").alias("_a"))
    joined = golden.join(p, list(keys), "left")
    d, a = F.count_if(~F.col("output_distance").eqNullSafe(F.col("_d"))), F.count_if(~F.col("output_angle").eqNullSafe(F.col("_a")))
    return joined.agg(d.alias("distance"), a.alias("angle"), (d + a).alias("total"))
