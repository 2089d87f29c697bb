"""Neighbourhood operators on rasters held as pixel rows (keys..., y, x, value).

On a dense grid every stencil is lag and lead over rows and columns. Windows partitioned by the image's keys and y, or x, are
met by one hash partitioning on the keys, so ``by_image`` up front leaves sorts but no further exchange, however many stencils
are chained. Images too large for a task are cut in tiles first: put the tile in ``keys`` and overlap tiles by the radius.
Sparse rasters and large kernels use the join form, ``convolve_sparse``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixel as P

Kernel = list[list[float]]


def by_image(pixels: DataFrame, *keys: str) -> DataFrame:
    """Partitioned by image, once."""
    return pixels.repartition(*keys)


def _moved(value: Column, step: int, window) -> Column:
    """The value ``step`` places earlier (later, if negative), 0 beyond the edge."""
    if step == 0:
        return value
    return F.coalesce((F.lag(value, step) if step > 0 else F.lead(value, -step)).over(window), F.lit(0.0))


def _along(keys, fixed: str, moving: str):
    return Window.partitionBy(*keys, fixed).orderBy(moving)


def taps(row: list[float], value: Column, window, centre: int) -> Column:
    """Convolution of one line with one row of a kernel."""
    terms = [F.lit(float(w)) * _moved(value, k - centre, window) for k, w in enumerate(row) if w]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def convolve(pixels: DataFrame, kernel: Kernel, keys=("image_id",), value: str = "v", out: str = "v") -> DataFrame:
    """True convolution (the kernel turned by 180 degrees), zeros beyond the edge, same size; the centre is (k - 1) // 2."""
    cy, cx = (len(kernel) - 1) // 2, (len(kernel[0]) - 1) // 2
    across, down = _along(keys, "y", "x"), _along(keys, "x", "y")
    if _rank_one(kernel):
        pivot = max(range(len(kernel)), key=lambda k: abs(kernel[k][cx]))
        row, column = kernel[pivot], [line[cx] / kernel[pivot][cx] for line in kernel]
        step = pixels.withColumn("_t0", taps(row, F.col(value), across, cx))
        return step.withColumn(out, taps(column, F.col("_t0"), down, cy)).drop("_t0")
    step = pixels.withColumns({f"_t{k}": taps(row, F.col(value), across, cx) for k, row in enumerate(kernel)})
    parts = [_moved(F.col(f"_t{k}"), k - cy, down) for k in range(len(kernel))]
    return step.withColumn(out, sum(parts[1:], parts[0])).drop(*(f"_t{k}" for k in range(len(kernel))))


def _rank_one(kernel: Kernel) -> bool:
    """Whether two one-dimensional passes do."""
    cx = (len(kernel[0]) - 1) // 2
    pivot = max(kernel, key=lambda line: abs(line[cx]))
    return pivot[cx] != 0 and all(abs(a * pivot[cx] - line[cx] * b) <= 1e-15 * (1 + abs(a)) for line in kernel for a, b in zip(line, pivot))


def convolve_sparse(pixels: DataFrame, kernel: Kernel, keys=("image_id",), value: str = "v", full: bool = False) -> DataFrame:
    """The same by join with the kernel's taps: for sparse rasters (missing pixels are 0). ``full`` keeps what falls beyond the edges; else results stay where a pixel row exists."""
    cells = [f"struct({a} as a, {b} as b, {float(w)!r}D as w)" for a, line in enumerate(kernel) for b, w in enumerate(line) if w]
    cy, cx = (0, 0) if full else ((len(kernel) - 1) // 2, (len(kernel[0]) - 1) // 2)
    spread = pixels.withColumn("t", F.explode(F.expr(f"array({', '.join(cells)})")))
    out = spread.groupBy(*keys, (F.col("y") + F.col("t.a") - cy).alias("y"), (F.col("x") + F.col("t.b") - cx).alias("x")).agg(F.sum(F.col(value) * F.col("t.w")).alias(value))
    return out if full else out.join(pixels.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")


def gaussian_kernel(n: int, sigma: float = 1.0) -> Kernel:
    c = (n - 1) // 2
    g = [[math.exp(-((i - c) ** 2 + (j - c) ** 2) / (2 * sigma * sigma)) for j in range(n)] for i in range(n)]
    total = sum(map(sum, g))
    return [[v / total for v in line] for line in g]


def full_convolution(a: Kernel, b: Kernel) -> Kernel:
    out = [[0.0] * (len(a[0]) + len(b[0]) - 1) for _ in range(len(a) + len(b) - 1)]
    for i, line in enumerate(a):
        for j, v in enumerate(line):
            for k, other in enumerate(b):
                for m, w in enumerate(other):
                    out[i + k][j + m] += v * w
    return out


#: fixed values: the 3x3 Laplacian
LAPLACE: Kernel = [[0, -1, 0], [-1, 4, -1], [0, -1, 0]]


def log_kernel(n: int = 5, sigma: float = 1.0) -> Kernel:
    """Laplacian of Gaussian of size n x n."""
    return full_convolution(LAPLACE, gaussian_kernel(n - 2, sigma))


def smooth(pixels: DataFrame, n: int = 5, sigma: float = 1.0, **how) -> DataFrame:
    return convolve(pixels, gaussian_kernel(n, sigma), **how)


def sobel(pixels: DataFrame, keys=("image_id",), value: str = "v") -> DataFrame:
    """With gx = weighted v(x-1) - v(x+1) and gy = weighted v(y+1) - v(y-1), weights 1, 2, 1 across; zeros beyond the edge."""
    across, down = _along(keys, "y", "x"), _along(keys, "x", "y")
    v = F.col(value)
    step = pixels.withColumns({"_d": _moved(v, 1, across) - _moved(v, -1, across), "_s": _moved(v, 1, across) + 2 * v + _moved(v, -1, across)})
    d, s = F.col("_d"), F.col("_s")
    return step.withColumns({"gx": _moved(d, 1, down) + 2 * d + _moved(d, -1, down), "gy": _moved(s, -1, down) - _moved(s, 1, down)}).drop("_d", "_s")


def gradient(pixels: DataFrame, keys=("image_id",), value: str = "v") -> DataFrame:
    """sobel with magnitude ``mag`` and direction ``theta`` in degrees."""
    g = sobel(pixels, keys, value)
    return g.withColumns({"mag": P.magnitude(F.col("gx"), F.col("gy")), "theta": P.direction_degrees(F.col("gx"), F.col("gy"))})


def reflected(pixels: DataFrame, steps: range, axis: str, keys, value: str, size: str) -> dict[int, Column]:
    """Values ``step`` places on along an axis, mirrored at the edge without repeating it."""
    other = "x" if axis == "y" else "y"
    line = F.array_sort(F.collect_list(F.struct(axis, value)).over(Window.partitionBy(*keys, other)))
    n = F.col(size)
    place = lambda k: F.when(F.col(axis) + k < 0, -(F.col(axis) + k)).when(F.col(axis) + k >= n, 2 * (n - 1) - F.col(axis) - k).otherwise(F.col(axis) + k)
    return {k: F.get(line, F.least(n - 1, F.greatest(F.lit(0), place(k))))[value] for k in steps}


def blur_reflected(pixels: DataFrame, keys=("image_id",), value: str = "v", height: str = "h", width: str = "w") -> DataFrame:
    """Smoothing by 1, 4, 6, 4, 1 over 16 both ways, edges mirrored, rounded to whole values."""
    weights = dict(zip(range(-2, 3), (1, 4, 6, 4, 1)))
    mean = lambda at: sum(F.lit(w / 16.0) * at[k] for k, w in weights.items())
    step = pixels.withColumn("_b", mean(reflected(pixels, range(-2, 3), "x", keys, value, width)))
    return step.withColumn(value, F.round(mean(reflected(step, range(-2, 3), "y", keys, "_b", height)))).drop("_b")


def sobel_reflected(pixels: DataFrame, keys=("image_id",), value: str = "v", height: str = "h", width: str = "w") -> DataFrame:
    """gx = weighted v(x+1) - v(x-1), gy = weighted v(y+1) - v(y-1), edges mirrored."""
    at = reflected(pixels, range(-1, 2), "x", keys, value, width)
    step = pixels.withColumns({"_d": at[1] - at[-1], "_s": at[-1] + 2 * at[0] + at[1]})
    d, s = reflected(step, range(-1, 2), "y", keys, "_d", height), reflected(step, range(-1, 2), "y", keys, "_s", height)
    return step.withColumns({"gx": d[-1] + 2 * d[0] + d[1], "gy": s[1] - s[-1]}).drop("_d", "_s")


def suppress(gradients: DataFrame, keys=("image_id",), mag: str = "mag", theta: str = "theta", out: str = "v", strict: bool = True) -> DataFrame:
    """Non-maximum suppression across the edge, 0 on the border.

    With strict, magnitudes are compared with the neighbours' direction classes, as the line pipeline was calibrated; else with
    the neighbours' magnitudes.
    """
    across, down = _along(keys, "y", "x"), _along(keys, "x", "y")
    g = gradients.withColumn("_c", P.direction_class(F.col(theta)).cast("double"))
    c = F.col("_c") if strict else F.col(mag)
    g = g.withColumns({"_l": F.lag(c).over(across), "_r": F.lead(c).over(across)})
    at = lambda name, step: (F.lag(name) if step > 0 else F.lead(name)).over(down)
    g = g.withColumns({"_n": at(c, 1), "_s": at(c, -1), "_nl": at("_l", 1), "_nr": at("_r", 1), "_sl": at("_l", -1), "_sr": at("_r", -1)})
    pairs = [("_l", "_r"), ("_nr", "_sl"), ("_n", "_s"), ("_nl", "_sr")]
    rival = F.lit(None)
    for k, (a, b) in reversed(list(enumerate(pairs))):
        rival = F.when(F.col("_c") == k, F.greatest(a, b)).otherwise(rival)
    inner = F.col("_nl").isNotNull() & F.col("_sr").isNotNull() & F.col("_nr").isNotNull() & F.col("_sl").isNotNull()
    return g.withColumn(out, F.when(inner & (F.col(mag) > rival), F.col(mag)).otherwise(F.lit(0.0))).drop("_c", "_l", "_r", "_n", "_s", "_nl", "_nr", "_sl", "_sr")


def is_local_maximum(keys=("image_id",), value: str = "r", scale: str = "scale") -> Column:
    """Whether a value is the greatest of its three along scale, y and x each; edges have fewer."""
    line = lambda axis: F.max(value).over(Window.partitionBy(*keys, *[a for a in (scale, "y", "x") if a != axis]).orderBy(axis).rowsBetween(-1, 1))
    return (F.col(value) == line(scale)) & (F.col(value) == line("y")) & (F.col(value) == line("x"))


def dilate(pixels: DataFrame, size: int = 2, keys=("image_id",), value: str = "v") -> DataFrame:
    """The greatest value over a square of ``size`` pixels; an even square reaches further back, so shapes grow to larger y and x."""
    back, ahead = size - 1 - (size - 1) // 2, (size - 1) // 2
    top = lambda w: F.max(value).over(w.rowsBetween(-back, ahead))
    return pixels.withColumn(value, top(_along(keys, "y", "x"))).withColumn(value, top(_along(keys, "x", "y")))


def halve(pixels: DataFrame) -> DataFrame:
    """Even rows and columns only."""
    return pixels.where((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0)).withColumns({"y": (F.col("y") / 2).cast("int"), "x": (F.col("x") / 2).cast("int")})


def bounding_crop(pixels: DataFrame, foreground: Column, margin: int = 10, keys=("image_id",)) -> DataFrame:
    """Without a border of ``margin``, the foreground's box grown by ``margin`` and held inside, its last row and column left out; y and x from 0. Images without foreground have no rows."""
    size = pixels.groupBy(*keys).agg((F.max("y") + 1 - 2 * margin).alias("_h"), (F.max("x") + 1 - 2 * margin).alias("_w"))
    inner = pixels.join(size, list(keys)).withColumns({"y": F.col("y") - margin, "x": F.col("x") - margin}).where("y >= 0 and x >= 0 and y < _h and x < _w")
    box = inner.where(foreground).groupBy(*keys).agg(*[f.alias(n) for f, n in ((F.greatest(F.lit(0), F.min("y") - margin), "_y0"), (F.greatest(F.lit(0), F.min("x") - margin), "_x0"), (F.max("y") + margin, "_y1"), (F.max("x") + margin, "_x1"))])
    kept = inner.join(box, list(keys)).where("y >= _y0 and x >= _x0 and y < least(_y1, _h - 1) and x < least(_x1, _w - 1)")
    return kept.withColumns({"y": F.col("y") - F.col("_y0"), "x": F.col("x") - F.col("_x0")}).drop("_h", "_w", "_y0", "_x0", "_y1", "_x1")
