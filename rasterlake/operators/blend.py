"""Compositing of registered layers: brightness cascade, average and alpha blending, and seams.

Layers are rows (panorama keys..., seq, y, x, value[s], covered or weight); all but the seam are aggregates and windows. A seam
depends on the row above and on all earlier layers, so it is one grouped call a panorama.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: fixed value: the cost of pixels that only one side covers
UNCOVERED = 65537.0


def crop(layers: DataFrame, height: int, width: int, margin: int = 2) -> DataFrame:
    inside = layers.where((F.col("y") >= margin) & (F.col("x") >= margin) & (F.col("y") < height - margin) & (F.col("x") < width - margin))
    return inside.withColumns({"y": F.col("y") - margin, "x": F.col("x") - margin})


def overlap(coverage: DataFrame, keys=()) -> DataFrame:
    """(keys, seq, y, x) covered both by layer seq and the next."""
    both = [*keys, "seq", "y", "x"]
    here = coverage.select(*both)
    return here.join(here.withColumn("seq", F.col("seq") - 1), both)


def boundary_means(layers: DataFrame, values=("v",), keys=()) -> DataFrame:
    """(keys, seq, n, mean): over the leftmost and rightmost common pixel of each row, their number and the mean of layer seq less the next over all values."""
    keys = list(keys)
    covered = layers.where("covered")
    ends = overlap(covered, keys).groupBy(*keys, "seq", "y").agg(F.array_distinct(F.array(F.min("x"), F.max("x"))).alias("e")).withColumn("x", F.explode("e")).drop("e")
    at = [*keys, "seq", "y", "x"]
    after = layers.select(*keys, (F.col("seq") - 1).alias("seq"), "y", "x", *[F.col(v).alias(f"_{v}") for v in values])
    joined = ends.join(layers.select(*at, *values), at).join(after, at)
    gap = sum(F.col(v) - F.col(f"_{v}") for v in values) / len(values)
    return joined.groupBy(*keys, "seq").agg(F.count("*").alias("n"), F.avg(gap).alias("mean"))


def cascade(means: DataFrame, sizes: DataFrame, share: float = 0.2, keys=()) -> DataFrame:
    """(keys, seq, shift): what is added to each layer. A layer with more than share * rows boundary pixels takes its neighbour's shift and the mean between them; else it starts anew from 0. ``sizes`` has keys, seq and rows (of one layer's raster) for all layers."""
    keys = list(keys)
    step = sizes.join(means.withColumn("seq", F.col("seq") + 1), [*keys, "seq"], "left")
    ok = F.coalesce(F.col("n") > share * F.col("rows"), F.lit(False))
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    step = step.withColumn("_ok", ok).withColumn("_i", F.sum((~F.col("_ok")).cast("int")).over(order))
    inner = Window.partitionBy(*keys, "_i").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return step.select(*keys, "seq", F.sum(F.when(F.col("_ok"), F.col("mean")).otherwise(0.0)).over(inner).alias("shift"))


def equalise(layers: DataFrame, values=("v",), share: float = 0.2, keys=()) -> DataFrame:
    """Layers with their shift added everywhere, covered or not."""
    keys = list(keys)
    sizes = layers.groupBy(*keys, "seq").agg((F.max("y") + 1).alias("rows"))
    shifts = cascade(boundary_means(layers, values, keys), sizes, share, keys)
    return layers.join(shifts, [*keys, "seq"]).withColumns({v: F.col(v) + F.col("shift") for v in values}).drop("shift")


def average(layers: DataFrame, values=("v",), keys=()) -> DataFrame:
    """(keys, y, x, values): sum of all layers over the number that cover; where none does the sum."""
    n = F.greatest(F.lit(1), F.sum(F.col("covered").cast("int")))
    return layers.groupBy(*keys, "y", "x").agg(*[(F.sum(v) / n).alias(v) for v in values])


def alpha(layers: DataFrame, values=("v",), keys=(), weight: str = "w") -> DataFrame:
    """(keys, y, x, values): mean by weight; 0 without any."""
    return layers.groupBy(*keys, "y", "x").agg(*[F.coalesce(F.try_divide(F.sum(F.col(v) * F.col(weight)), F.sum(weight)), F.lit(0.0)).alias(v) for v in values])


def seam(cost: np.ndarray) -> np.ndarray:
    """The column of the seam in each row: costs are added up from below, the walk starts at the top row's rightmost least and goes on by the least of the current row's neighbourhood; at the left edge the neighbourhood has two columns and the offset counts from its first."""
    total = cost.astype(float)
    edge = np.array([np.inf])
    for y in range(len(total) - 2, -1, -1):
        below = np.concatenate((edge, total[y + 1], edge))
        total[y] += np.minimum(np.minimum(below[:-2], below[1:-1]), below[2:])
    width = total.shape[1]
    out = np.empty(len(total), np.int64)
    out[0] = width - 1 - total[0, ::-1].argmin()
    for y in range(1, len(total)):
        at = out[y - 1]
        out[y] = np.clip(at + total[y - 1, max(0, at - 1) : at + 2].argmin() - 1, 0, width - 1)
    return out


def composite(layers: list[np.ndarray], covers: list[np.ndarray]) -> np.ndarray:
    """Layers laid left to right: from the seam on, at most from the last covered column, the next one shows."""
    image, cover = layers[0].copy(), covers[0].copy()
    for layer, own in zip(layers[1:], covers[1:]):
        if not own.any():
            continue
        cost = np.where(cover & own, (np.abs(image - layer) ** 2).sum(-1), UNCOVERED)
        last = np.where(cover.any(1), cover.shape[1] - 1 - cover[:, ::-1].argmax(1), 0)
        new = np.arange(cover.shape[1]) >= np.minimum(last, seam(cost))[:, None]
        image[new] = layer[new]
        cover |= own
    return image


def seam_composite(layers: DataFrame, height: int, width: int, values=("v",), keys=("panorama",)) -> DataFrame:
    """(keys, y, x, values) of each panorama, by seams in order of seq."""
    keys, values = list(keys), list(values)
    schema = layers.select(*keys).schema.add("y", "integer").add("x", "integer")
    for v in values:
        schema = schema.add(v, "double")

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        planes, covers = [], []
        for _, p in pdf.groupby("seq"):
            plane, cover = np.zeros((height, width, len(values))), np.zeros((height, width), bool)
            y, x = p["y"].to_numpy(int), p["x"].to_numpy(int)
            plane[y, x] = p[values].to_numpy(float)
            cover[y, x] = p["covered"].to_numpy(bool)
            planes.append(plane)
            covers.append(cover)
        image = composite(planes, covers)
        y, x = np.divmod(np.arange(height * width), width)
        same = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame({**same, "y": y.astype(np.int32), "x": x.astype(np.int32), **{v: image[..., i].ravel() for i, v in enumerate(values)}})

    return layers.select(*keys, "seq", "y", "x", *values, "covered").groupBy(*keys).applyInPandas(each, schema)


def blend(layers: DataFrame, height: int, width: int, mode: str = "g", margin: int = 2, values=("v",), keys=("panorama",)) -> DataFrame:
    """Cropped, equalised and put together: mode "g" or "gp" by seams, "s" average, "a" by weight."""
    inner = equalise(crop(layers, height, width, margin), values, keys=keys)
    if mode in ("g", "gp"):
        return seam_composite(inner, height - 2 * margin, width - 2 * margin, values, keys)
    if mode == "s":
        return average(inner, values, keys)
    if mode == "a":
        return alpha(inner, values, keys)
    raise ValueError("mode must be g, gp, s or a")
