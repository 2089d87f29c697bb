"""Connected components of foreground pixels, their centroids, spacing, and merging of close ones.

Images are the unit of parallelism: a component never leaves its image. ``label`` numbers each image's components in one
grouped Arrow call on run-length rows, not pixels, so a group holds the runs of one image; ``label_distributed`` is for images
whose runs exceed a task, by label propagation over run adjacency with checkpoints in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .lineage import cut


def runs(mask: DataFrame, keys=("image_id",)) -> DataFrame:
    """(keys, y, x0, x1): maximal horizontal runs of foreground pixels."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    islands = mask.select(*keys, "y", "x").distinct().withColumn("_k", F.col("x") - F.row_number().over(row))
    return islands.groupBy(*keys, "y", "_k").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_k")


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def number_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Component numbers 1..K of runs sorted by (y, x0), touching at sides or corners.

    A run begins a provisional label if no run of the row above touches its first pixel; a later pixel of the run begins none,
    having a foreground pixel before it. Components are numbered by their largest provisional label, which is the order of the
    last such beginnings.
    """
    n = len(y)
    parent = np.arange(n)
    first = {int(v): int(k) for v, k in zip(*np.unique(y, return_index=True))}
    ends = {int(v): int(k) for v, k in zip(np.unique(y), np.searchsorted(y, np.unique(y), "right"))}
    begins = np.zeros(n, bool)
    for row, a in first.items():
        b = ends[row]
        if row - 1 not in first:
            begins[a:b] = True
            continue
        c, d = first[row - 1], ends[row - 1]
        low = c + np.searchsorted(x1[c:d], x0[a:b] - 1, "left")
        high = c + np.searchsorted(x0[c:d], x1[a:b] + 1, "right")
        touch = c + np.searchsorted(x0[c:d], x0[a:b] + 1, "right")
        begins[a:b] = touch <= low
        for i, lo, hi in zip(range(a, b), low.tolist(), high.tolist()):
            for j in range(lo, hi):
                p, q = _find(parent, i), _find(parent, j)
                parent[max(p, q)] = min(p, q)
    root = np.array([_find(parent, i) for i in range(n)], np.int64)
    latest = np.full(n, -1)
    np.maximum.at(latest, root[begins], np.flatnonzero(begins))
    roots = np.unique(root)
    rank = np.empty(n, np.int64)
    rank[roots[np.argsort(latest[roots], kind="stable")]] = np.arange(1, len(roots) + 1)
    return rank[root]


def label(mask: DataFrame, keys=("image_id",)) -> DataFrame:
    """(keys, y, x, label): 8-connected components of the mask's pixels, numbered 1..K in each image."""
    found = runs(mask, keys)

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "ascending"), ("x0", "ascending")])
        y, x0, x1 = (table[c].to_numpy() for c in ("y", "x0", "x1"))
        return table.append_column("label", pa.array(number_runs(y, x0, x1).astype(np.int32)))

    numbered = found.groupBy(*keys).applyInArrow(each, StructType([*found.schema.fields, StructField("label", IntegerType())]))
    return numbered.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def label_distributed(mask: DataFrame, keys=("image_id",)) -> DataFrame:
    """The same by propagation: runs that touch pass on their least number until nothing changes."""
    keys = list(keys)
    r = cut(runs(mask, keys).withColumn("id", F.struct("y", "x0")))
    up = r.select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("id").alias("other"))
    touch = r.join(up, [*keys, "y"]).where("a <= x1 + 1 and b >= x0 - 1")
    begins = r.join(touch.where("a <= x0 + 1 and b >= x0 - 1").select(*keys, "id").distinct().withColumn("_t", F.lit(1)), [*keys, "id"], "left").select(*keys, "id", F.when(F.col("_t").isNull(), F.col("id")).alias("begin"))
    edges = touch.select(*keys, "id", "other")
    edges = cut(edges.union(edges.select(*keys, F.col("other").alias("id"), F.col("id").alias("other"))))
    found = cut(r.select(*keys, "id", F.col("id").alias("root")))
    while True:
        near = edges.join(found.select(*keys, F.col("id").alias("other"), "root"), [*keys, "other"]).groupBy(*keys, "id").agg(F.min("root").alias("m"))
        step = found.join(near, [*keys, "id"], "left").select(*keys, "id", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        jump = found.select(*keys, F.col("id").alias("root"), F.col("root").alias("to"))
        step = cut(step.join(jump, [*keys, "root"], "left").select(*keys, "id", F.least("root", "to").alias("root"), "was"))
        if not step.where("root != was").limit(1).count():
            break
        found = step.drop("was")
    last = step.join(begins, [*keys, "id"]).groupBy(*keys, "root").agg(F.max("begin").alias("latest"))
    rank = last.withColumn("label", F.row_number().over(Window.partitionBy(*keys).orderBy("latest"))).drop("latest")
    return r.join(step.drop("was").join(rank, [*keys, "root"]), [*keys, "id"]).select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def split(pixels: DataFrame, labelled: DataFrame, keys=("image_id",)) -> DataFrame:
    """Pixels with their component; in images without any, all pixels are component 1."""
    keys = list(keys)
    some = labelled.select(*keys).distinct().withColumn("_some", F.lit(1))
    joined = pixels.join(labelled, [*keys, "y", "x"], "left").join(some, keys, "left")
    return joined.withColumn("label", F.when(F.col("_some").isNull(), 1).otherwise(F.col("label"))).where(F.col("label").isNotNull()).drop("_some")


def corner_counts(labelled: DataFrame, corners: DataFrame, keys=("image_id",)) -> DataFrame:
    """(keys, label, corners): how many connected groups of corner pixels each component has."""
    keys = list(keys)
    inside = labelled.join(corners.select(*keys, "y", "x").distinct(), [*keys, "y", "x"]).withColumnRenamed("label", "component")
    groups = label(inside, (*keys, "component")).groupBy(*keys, "component").agg(F.max("label").alias("corners")).withColumnRenamed("component", "label")
    return labelled.select(*keys, "label").distinct().join(groups, [*keys, "label"], "left").withColumn("corners", F.coalesce("corners", F.lit(0)))


def centroids(labelled: DataFrame, keys=("image_id",)) -> DataFrame:
    """(keys, label, cy, cx): mean place of each component, cut to integers."""
    return labelled.groupBy(*keys, "label").agg(F.avg("y").cast("int").alias("cy"), F.avg("x").cast("int").alias("cx"))


def spacing(found: DataFrame, keys=("image_id",), angle: str | None = None) -> DataFrame:
    """found with ``gap`` to the component before in label order (null for the first); with ``angle`` its part along that direction."""
    order = Window.partitionBy(*keys).orderBy("label")
    dy, dx = F.col("cy") - F.lag("cy").over(order), F.col("cx") - F.lag("cx").over(order)
    gap = F.sqrt((dy * dy + dx * dx).cast("double"))
    if angle:
        gap = F.abs(gap * F.cos(F.atan2(dy.cast("double"), dx.cast("double")) - F.radians(angle)))
    return found.withColumn("gap", gap)


def islands(gaps: DataFrame, divisor: float, keys=("image_id",), out: str = "island") -> DataFrame:
    """Numbers chains of components whose gaps are below the image's mean gap over ``divisor``."""
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
    far = F.col("gap").isNull() | (F.col("gap") >= F.avg("gap").over(whole) / divisor)
    return gaps.withColumn("_far", far.cast("int")).withColumn(out, F.sum("_far").over(order).cast("int")).drop("_far")


def merge_close(labelled: DataFrame, angles: DataFrame, divisors=(3, 2.5, 2), keys=("image_id",)) -> DataFrame:
    """Pixels relabelled after merging close components, round by round; centroids are taken anew from pixels."""
    for d in divisors:
        gaps = spacing(centroids(labelled, keys).join(angles, list(keys)), keys, "angle")
        labelled = labelled.join(islands(gaps, d, keys).select(*keys, "label", "island"), [*keys, "label"]).drop("label").withColumnRenamed("island", "label")
    return labelled


def component_angles(labelled: DataFrame, gradients: DataFrame, keys=("image_id",), mag: str = "mag", theta: str = "theta") -> DataFrame:
    """(keys, label, angle): weighted direction of each component's gradient less 90; without weight the image's mean direction."""
    keys = list(keys)
    t = F.pmod(theta, F.lit(180.0))
    whole = gradients.groupBy(*keys).agg(F.avg(t).alias("_mean"))
    inside = labelled.join(gradients.select(*keys, "y", "x", F.col(mag).alias("_m"), t.alias("_t")), [*keys, "y", "x"], "left")
    sums = inside.groupBy(*keys, "label").agg(F.sum("_m").alias("_w"), F.sum(F.col("_m") * F.col("_t")).alias("_wt"))
    angle = F.when(F.coalesce("_w", F.lit(0.0)) == 0, F.col("_mean")).otherwise(F.try_divide("_wt", "_w")) - 90
    return sums.join(whole, keys).select(*keys, "label", angle.alias("angle"))
