"""Line finding: votes guided by the gradient, a cut per image, and drawing between the end points.

A pixel votes for 2 * precision directions only, so the explode is bounded; votes are counted with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixel as P


def weighted_angle(weight: Column, theta: Column) -> Column:
    """Mean direction modulo 180 weighted; without any weight the plain mean. An aggregate."""
    t = F.pmod(theta, F.lit(180.0))
    return F.when(F.sum(weight) == 0, F.avg(t)).otherwise(F.try_divide(F.sum(weight * t), F.sum(weight)))


def normal_angle(gradients: DataFrame, keys=("image_id",), mag: str = "mag", theta: str = "theta") -> DataFrame:
    """(keys, angle): about the normal of most edges."""
    return gradients.groupBy(*keys).agg(weighted_angle(F.col(mag), F.col(theta)).alias("angle"))


def votes(mask: DataFrame, keys=("image_id",), n: int = 90, precision: Column | int = 3, near: Column | None = None, within: float = 20, size: tuple[str, str] = ("h", "w")) -> DataFrame:
    """(keys, r, t, x, y) of each vote of foreground pixels with gx, gy.

    Directions are those from ``precision`` below the pixel's own to one less than that above. With ``near`` only directions
    within so many degrees of it vote. Negative distances wrap by the image's diagonal, as directions do by n.
    """
    step = 180 / n
    precision = precision if isinstance(precision, Column) else F.lit(precision)
    own = P.theta_class(F.col("gx"), F.col("gy"), n)
    v = mask.withColumn("_t", F.explode(F.sequence(own - precision, own + precision - 1)))
    degrees = F.col("_t") * step
    if near is not None:
        v = v.where(P.angle_gap(degrees, near) <= within)
    r, diagonal = P.radius(F.col("x"), F.col("y"), degrees), P.trunc(F.hypot(F.col(size[0]), F.col(size[1])))
    return v.select(*keys, F.when(r < 0, r + diagonal).otherwise(r).alias("r"), F.pmod("_t", F.lit(n)).alias("t"), "x", "y")


def lines(cast: DataFrame, keys=("image_id",), share: float = 0.3) -> DataFrame:
    """(keys, r, t, n, first, last): cells with at least ``share`` of the image's fullest, and their extreme points (x, y)."""
    point = F.struct("x", "y")
    cells = cast.groupBy(*keys, "r", "t").agg(F.count("*").alias("n"), F.min(point).alias("first"), F.max(point).alias("last"))
    least = F.greatest(F.lit(1.0), share * F.max("n").over(Window.partitionBy(*keys)))
    return cells.withColumn("_least", least).where("n >= _least").drop("_least")


def on_line(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Array of (x, y) from one point to the other, both included; steps along the longer axis, in closed form."""
    steep = F.abs(y1 - y0) > F.abs(x1 - x0)
    a0, b0, a1, b1 = (F.when(steep, p).otherwise(q) for p, q in ((y0, x0), (x0, y0), (y1, x1), (x1, y1)))
    back = a0 > a1
    a0, a1, b0, b1 = (F.when(back, p).otherwise(q) for p, q in ((a1, a0), (a0, a1), (b1, b0), (b0, b1)))
    da, db = a1 - a0, F.abs(b1 - b0)
    up = F.when(b0 < b1, 1).otherwise(-1)
    k = lambda a: (a - a0).cast("double")
    rise = lambda a: F.when(da == 0, 0).otherwise(F.greatest(F.lit(0), F.ceil((k(a) * db - F.floor(da / 2)) / F.when(da == 0, 1).otherwise(da)).cast("int")))
    at = lambda a: F.struct(F.when(steep, b0 + up * rise(a)).otherwise(a).cast("int").alias("x"), F.when(steep, a).otherwise(b0 + up * rise(a)).cast("int").alias("y"))
    return F.transform(F.sequence(a0, a1), at)


def draw(found: DataFrame, keys=("image_id",)) -> DataFrame:
    """Distinct pixels (keys, y, x) of all lines."""
    p, q = F.col("first"), F.col("last")
    return found.select(*keys, F.explode(on_line(p["x"], p["y"], q["x"], q["y"])).alias("p")).select(*keys, "p.y", "p.x").distinct()
