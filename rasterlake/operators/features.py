"""Keypoints and descriptors: scale-space corners with a threshold per block, patch histograms, and cell-and-block histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixel as P
from . import stencil


def corner_response(pixels: DataFrame, keys=("image_id",), channel: str | None = None, window: int = 5, k: float = 0.04, scales: int = 3, factor: float = 1.5) -> DataFrame:
    """(keys, scale, y, x, r): structure-matrix response after Laplacian-of-Gaussian smoothing at several scales, channels summed."""
    inner = [*keys, channel] if channel else list(keys)
    g = stencil.sobel(pixels, inner)
    gx, gy = F.col("gx"), F.col("gy")
    out = None
    for s in range(scales):
        kernel = stencil.log_kernel(window, factor**s)
        m = g.withColumns({"_xx": gx * gx, "_yy": gy * gy, "_xy": gx * gy})
        for c in ("_xx", "_yy", "_xy"):
            m = stencil.convolve(m, kernel, inner, c, c)
        r = P.harris(F.col("_xx"), F.col("_yy"), F.col("_xy"), k)
        m = m.select(*inner, F.lit(s).alias("scale"), "y", "x", r.alias("r"))
        m = m.groupBy(*keys, "scale", "y", "x").agg(F.sum("r").alias("r")) if channel else m
        out = m if out is None else out.unionByName(m)
    return out


def rungs(top: float = 1e8, least: float = 1e6, divisor: float = 1.1) -> list[float]:
    """Thresholds from ``top`` down by repeated division, as long as they are at least ``least``."""
    out = [top]
    while out[-1] / divisor >= least:
        out.append(out[-1] / divisor)
    return out


def first_rung(r: Column, ladder: list[float]) -> Column:
    """The number of the highest threshold that r exceeds; null if none."""
    return F.array_position(F.transform(F.array(*map(F.lit, ladder)), lambda t: r > t), True) - 1


def adaptive(candidates: DataFrame, block: list[Column], ladder: list[float], enough: int = 2000, keys=("image_id",), value: str = "r") -> DataFrame:
    """(keys, y, x) of candidates above their block's threshold: the highest that leaves more than ``enough`` places, else the last.

    Each place enters once, at the first threshold that one of its scales exceeds; blocks then need a running count of at most
    len(ladder) rows.
    """
    named = candidates.withColumns({f"_b{k}": b for k, b in enumerate(block)})
    names = [f"_b{k}" for k in range(len(block))]
    place = named.groupBy(*keys, *names, "y", "x").agg(F.max(value).alias("_r")).withColumn("_k", first_rung(F.col("_r"), ladder)).where(F.col("_k") < len(ladder)).where(F.col("_k") >= 0)
    steps = place.groupBy(*keys, *names, "_k").agg(F.count("*").alias("_n"))
    running = F.sum("_n").over(Window.partitionBy(*keys, *names).orderBy("_k"))
    chosen = steps.withColumn("_n", running).groupBy(*keys, *names).agg(F.coalesce(F.min(F.when(F.col("_n") > enough, F.col("_k"))), F.lit(len(ladder) - 1)).alias("_c"))
    return place.join(chosen, [*keys, *names]).where(F.col("_k") <= F.col("_c")).select(*keys, "y", "x")


def detect(pixels: DataFrame, sizes: DataFrame, keys=("image_id",), channel: str | None = None, enough: int = 2000, edge: int = 5, blocks: tuple[int, int] = (2, 1), top: float = 1e8, least: float = 1e6, **how) -> DataFrame:
    """(keys, kp_id, y, x): local maxima of the corner response over scale, y and x, thresholded per block, without an edge frame. ``sizes`` has keys, h and w."""
    r = corner_response(pixels, keys, channel, **how)
    ladder = rungs(top, least)
    peaks = r.withColumn("_peak", stencil.is_local_maximum(keys)).where(F.col("_peak") & (F.col("r") > ladder[-1])).join(sizes, list(keys))
    bh, bw = F.floor(F.col("h") / blocks[0]), F.floor(F.col("w") / blocks[1])
    kept = adaptive(peaks, [F.floor(F.col("y") / bh), F.floor(F.col("x") / bw)], ladder, enough, keys)
    kept = kept.join(sizes, list(keys)).where((F.col("y") >= edge) & (F.col("x") >= edge) & (F.col("y") < F.col("h") - edge) & (F.col("x") < F.col("w") - edge))
    return kept.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("y", "x")) - 1).alias("kp_id"), "y", "x")


def harris(pixels: DataFrame, keys=("image_id",), window: int = 3, k: float = 0.06, t: float = 1e9, sigma: float = 1.0) -> DataFrame:
    """(keys, y, x, r): places whose response after Gaussian smoothing exceeds t."""
    g = stencil.sobel(pixels, keys)
    gx, gy = F.col("gx"), F.col("gy")
    m = g.withColumns({"_xx": gx * gx, "_yy": gy * gy, "_xy": gx * gy})
    for c in ("_xx", "_yy", "_xy"):
        m = stencil.smooth(m, window, sigma, keys=keys, value=c, out=c)
    return m.select(*keys, "y", "x", P.harris(F.col("_xx"), F.col("_yy"), F.col("_xy"), k).alias("r")).where(F.col("r") > t)


def detector(pixels: DataFrame, sizes: DataFrame, mode: str = "l", low_resolution: int = 0, keys=("image_id",), **how) -> DataFrame:
    """(keys, y, x): corners by mode "h" (one scale) or "l" (scale space), on images halved ``low_resolution`` times, at the places of the whole image."""
    if mode not in ("h", "l"):
        raise ValueError("mode must be h or l")
    half = lambda c: F.ceil(F.col(c) / 2).cast("int").alias(c)
    for _ in range(low_resolution):
        pixels, sizes = stencil.halve(pixels), sizes.select(*keys, half("h"), half("w"))
    found = harris(pixels, keys, **how) if mode == "h" else detect(pixels, sizes, keys, **how)
    return found.select(*keys, (F.col("y") * (1 << low_resolution)).alias("y"), (F.col("x") * (1 << low_resolution)).alias("x"))


def stroke_corners(pixels: DataFrame, keys=("image_id",), window: int = 5, k: float = 0.04, t: float = 4e10) -> DataFrame:
    """(keys, y, x, r): corners of strokes, with that pipeline's window and threshold."""
    return harris(pixels, keys, window, k, t)


def overlay_keypoints(pixels: DataFrame, keypoints: DataFrame, keys=("image_id",), value: str = "v", thickness: int = 11) -> DataFrame:
    """pixels with those near a keypoint set to the far end of the contrast: dark ones to 256, bright ones to 0, 128 as it is."""
    marks = keypoints.select(*keys, "y", "x").distinct().withColumn("_k", F.lit(1))
    near = stencil.dilate(pixels.join(marks, [*keys, "y", "x"], "left").withColumn("_k", F.coalesce("_k", F.lit(0))), (thickness + 1) // 2, keys, "_k")
    v = F.col(value)
    return near.withColumn(value, F.when(F.col("_k") > 0, 128 - 128 * F.signum(v - 128)).otherwise(v)).drop("_k")


def overlay_centroids(pixels: DataFrame, found: DataFrame, keys=("image_id",), value: str = "v") -> DataFrame:
    """pixels at a third of their value, with 255 in the square of three about each centroid (cy, cx)."""
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    marks = found.withColumn("_a", near).withColumn("_b", near).select(*keys, (F.col("cy") + F.col("_a")).alias("y"), (F.col("cx") + F.col("_b")).alias("x")).distinct().withColumn("_k", F.lit(1))
    joined = pixels.join(marks, [*keys, "y", "x"], "left")
    return joined.withColumn(value, F.when(F.col("_k").isNotNull(), 255.0).otherwise(F.col(value) / 3)).drop("_k")


def cell_histogram(patch: DataFrame, by: list[str], position: list[str], mag: str = "mag", bins: str = "bin", mode: str = "last") -> DataFrame:
    """(by, bin, h): per cell and bin the magnitude of the last pixel, as calibrated, or with mode "sum" the sum."""
    h = F.max_by(mag, F.struct(*position)) if mode == "last" else F.sum(mag)
    return patch.groupBy(*by, bins).agg(h.alias("h"))


def describe(gradients: DataFrame, keypoints: DataFrame, keys=("image_id",), mode: str = "last", cap: float = 0.2) -> DataFrame:
    """(keys, kp_id, y, x, desc): 16 cells of 4 x 4 pixels about each keypoint, 8 directions each, normalised.

    ``gradients`` has keys, y, x, gx, gy. Keypoints fan out to their 256 pixels for an equi-join; nearer than 8 to the top or left
    edge the descriptor is all zeros, at the bottom and right what is missing counts nothing.
    """
    keys = list(keys)
    square = keypoints.withColumns({"_i": F.explode(F.sequence(F.lit(0), F.lit(15)))}).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(15))))
    square = square.where("y >= 8 and x >= 8").select(*keys, "kp_id", "_i", "_j", (F.col("y") + F.col("_i") - 8).alias("y"), (F.col("x") + F.col("_j") - 8).alias("x"))
    gx, gy = F.col("gx"), F.col("gy")
    g = gradients.select(*keys, "y", "x", F.sqrt(gx * gx + gy * gy).alias("mag"), P.orientation_class(F.atan2(gy, gx)).alias("bin"))
    patch = square.join(g, [*keys, "y", "x"]).withColumn("cell", F.floor(F.col("_i") / 4) * 4 + F.floor(F.col("_j") / 4))
    cells = cell_histogram(patch, [*keys, "kp_id", "cell"], ["_i", "_j"], mode=mode)
    dense = cells.groupBy(*keys, "kp_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("cell") * 8 + F.col("bin")).cast("int").alias("k"), "h"))).alias("_m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0)))
    return keypoints.join(dense, [*keys, "kp_id"], "left").withColumn("desc", F.coalesce(P.normalise(values, cap), F.array_repeat(F.lit(0.0), 128))).drop("_m")


def hog_cells(gradients: DataFrame, keys=("image_id",), cell: int = 8, bins: int = 9, mag: str = "mag", direction: str = "dir") -> DataFrame:
    """(keys, cy, cx, bin, h): sums of magnitude by cell and unsigned direction; the last bin takes pi itself."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(direction) / (F.pi() / bins)).cast("int"))
    return gradients.groupBy(*keys, F.floor(F.col("y") / cell).cast("int").alias("cy"), F.floor(F.col("x") / cell).cast("int").alias("cx"), b.alias("bin")).agg(F.sum(mag).alias("h"))


def hog_blocks(cells: DataFrame, grid: tuple[int, int], keys=("image_id",), bins: int = 9) -> DataFrame:
    """(keys, cy, cx, norm): root mean square of each block of 2 x 2 cells, 1 where that is 0; the last row and column of blocks are left out."""
    square = cells.groupBy(*keys, "cy", "cx").agg((F.sum(F.col("h") * F.col("h")) / bins).alias("q"))
    shift = F.explode(F.expr("array(struct(0 as a, 0 as b), struct(0 as a, 1 as b), struct(1 as a, 0 as b), struct(1 as a, 1 as b))"))
    spread = square.withColumn("s", shift).select(*keys, (F.col("cy") - F.col("s.a")).alias("cy"), (F.col("cx") - F.col("s.b")).alias("cx"), "q")
    norm = spread.where((F.col("cy") >= 0) & (F.col("cx") >= 0) & (F.col("cy") < grid[0] - 2) & (F.col("cx") < grid[1] - 2)).groupBy(*keys, "cy", "cx").agg(F.sqrt(F.sum("q") / 4).alias("norm"))
    return norm.withColumn("norm", F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")))


def hog(pixels: DataFrame, keys=("image_id",), height: int = 128, width: int = 64, cell: int = 8, bins: int = 9, dtype: str = "float") -> DataFrame:
    """(keys, desc): the descriptor of gray crops of fixed size, blurred, by blocks of 2 x 2 cells in reading order."""
    keys = list(keys)
    sized = stencil.by_image(pixels, *keys).withColumns({"h": F.lit(height), "w": F.lit(width)})
    g = stencil.sobel_reflected(stencil.blur_reflected(sized, keys), keys)
    gx, gy = F.col("gx"), F.col("gy")
    g = g.withColumns({"mag": F.sqrt(gx * gx + gy * gy), "dir": P.direction_unsigned(gx, gy)})
    rows, columns = height // cell, width // cell
    cells = hog_cells(g, keys, cell, bins)
    norms = hog_blocks(cells, (rows, columns), keys, bins)
    place = F.explode(F.expr("array(struct(0 as a, 0 as b), struct(0 as a, 1 as b), struct(1 as a, 0 as b), struct(1 as a, 1 as b))"))
    blocks = norms.withColumn("s", place).select(*keys, F.col("cy").alias("by"), F.col("cx").alias("bx"), "s", "norm", (F.col("cy") + F.col("s.a")).alias("cy"), (F.col("cx") + F.col("s.b")).alias("cx"))
    spot = (((F.col("by") * (columns - 2) + F.col("bx")) * 4 + F.col("s.a") * 2 + F.col("s.b")) * bins + F.col("bin")).cast("int")
    values = blocks.join(cells, [*keys, "cy", "cx"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(spot.alias("k"), (F.col("h") / F.col("norm")).alias("v")))).alias("_m"))
    size = (rows - 2) * (columns - 2) * 4 * bins
    return values.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0)).cast(dtype)).alias("desc"))
