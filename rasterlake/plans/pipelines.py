"""The end-to-end questions: line statistics, pair verdicts, panorama, and classifier evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel as P
from ..operators import blend, components, features, geometry, hough, learn, match, score, stencil
from ..operators.lineage import cut

KEYS = ("image_id",)


def edge_image(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, v): gray, smoothing, contrast, threshold, then edges by gradient, suppression and double threshold."""
    gray = stencil.by_image(pixels, *KEYS).select(*KEYS, "y", "x", P.gray(F.col("c0"), F.col("c1"), F.col("c2")).alias("v"))
    smooth = stencil.smooth(gray, 5).withColumn("v", P.threshold(P.contrast_clip(F.col("v"), 200), 50))
    edges = stencil.suppress(stencil.gradient(smooth))
    edges = edges.withColumn("v", P.max_normalise(F.col("v"), *KEYS)).withColumn("v", P.limit(P.double_threshold(F.col("v"), 50, 200)))
    return edges.select(*KEYS, "y", "x", "v")


def _thick(edges: DataFrame, params: DataFrame) -> DataFrame:
    """Foreground grown by each image's thickness (1, 2 or 3), as 0 or 255."""
    v = edges.withColumn("v", P.binary(F.col("v")))
    made = [stencil.dilate(v, n).withColumn("_n", F.lit(n)) for n in (1, 2, 3)]
    per = [m.join(params.where(F.col("thickness") == n).select(*KEYS), list(KEYS), "left_semi") for n, m in zip((1, 2, 3), made)]
    return per[0].unionByName(per[1]).unionByName(per[2]).withColumn("v", F.col("v") * 255).drop("_n")


def _cycle(edges: DataFrame, params: DataFrame):
    """One pass over all images: gradients, angles, merged components."""
    thick = stencil.by_image(_thick(edges, params), *KEYS)
    size = thick.groupBy(*KEYS).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    g = cut(stencil.gradient(thick))
    angles = cut(hough.normal_angle(g))
    mask = g.where(P.binary(F.col("v")) == 1).join(size, list(KEYS)).join(angles, list(KEYS)).join(params, list(KEYS))
    found = hough.draw(hough.lines(hough.votes(mask, precision=F.col("precision"), near=F.col("angle"))))
    merged = cut(components.merge_close(components.label(found), angles))
    return g, size, angles, merged


def line_statistics(pixels: DataFrame, sizes: DataFrame, part: int = 1) -> DataFrame:
    """(image_id, n, spacing_mean, spacing_var, spacing_cv, angle_mean, angle_var) of the strokes of each image.

    ``pixels`` has image_id, y, x, c0, c1, c2; ``sizes`` has image_id and h. The first pass over all images sets each one's
    thickness and precision for the second; both are plans over all images. Part 1 measures spacing between centroids by the
    image's height, part 2 along the normal and by the cropped height, with directions scaled by the mean spacing.
    """
    edges = cut(stencil.bounding_crop(edge_image(pixels), P.binary(F.col("v")) == 1).select(*KEYS, "y", "x", "v"))
    params = edges.select(*KEYS).distinct().withColumns({"thickness": F.lit(1), "precision": F.lit(3)})
    for last in (False, True):
        g, size, angles, merged = _cycle(edges, params)
        centres = components.centroids(merged)
        if not last:
            gap = components.spacing(centres.join(angles, list(KEYS)), angle="angle").groupBy(*KEYS).agg(F.avg("gap").alias("m"))
            joined = params.select(*KEYS).join(gap, list(KEYS), "left")
            thickness = F.when(F.col("m") >= 50, 3).when(F.col("m") >= 25, 2).otherwise(1)
            params = cut(joined.select(*KEYS, thickness.alias("thickness"), F.when(F.col("m") >= 25, 3).otherwise(2).alias("precision")))
    along = None if part == 1 else "angle"
    height = sizes.select(*KEYS, "h") if part == 1 else size.select(*KEYS, "h")
    gaps = components.spacing(centres.join(angles, list(KEYS)), angle=along).join(height, list(KEYS)).withColumn("gap", F.col("gap") / F.col("h"))
    spread = score.statistics(gaps)
    if part == 2:
        scaled = spread.select(*KEYS, F.col("mean").alias("_m"))
        g = g.join(scaled, list(KEYS)).withColumn("theta", P.direction_degrees(F.col("gx"), F.try_divide(F.col("gy"), F.col("_m")))).drop("_m")
    edge_only = g.withColumn("mag", F.when(P.binary(F.col("v")) == 1, F.col("mag")).otherwise(0.0))
    turned = components.component_angles(merged, edge_only)
    angle_stats = turned.groupBy(*KEYS).agg(F.count("*").alias("strokes"), F.avg("angle").alias("angle_mean"), F.var_pop("angle").alias("angle_var"))
    return angle_stats.join(spread, list(KEYS), "left").select(*KEYS, F.col("strokes").alias("n"), F.col("mean").alias("spacing_mean"), F.col("var").alias("spacing_var"), F.col("cv").alias("spacing_cv"), "angle_mean", "angle_var")


def statistics_table(stats: DataFrame) -> DataFrame:
    """line_statistics under the column names of the result file."""
    names = {"image_id": "image_name", "n": "number of sutures", "spacing_mean": "mean inter suture spacing", "spacing_var": "variance of inter suture spacing", "angle_mean": "mean suture angle wrt x-axis", "angle_var": "variance of suture angle wrt x-axis"}
    return stats.select(*[F.col(a).alias(b) for a, b in names.items()])


def pair_verdicts(pairs: DataFrame, pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Which image of each pair is more regular, by spacing and by angle."""
    return score.verdicts(pairs, line_statistics(pixels, sizes, part=2), "image_id", "spacing_cv", "angle_var")


def described(pixels: DataFrame, sizes: DataFrame, keys=("panorama", "seq"), **how) -> DataFrame:
    """Keypoints with descriptors of every image: contrast, colour smoothing, corners over scales, patch histograms."""
    keys = list(keys)
    long = stencil.by_image(pixels, *keys).select(*keys, "y", "x", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), P.contrast_trunc(F.col(f"c{c}")).cast("double").alias("v")) for c in range(3)])).alias("p")).select(*keys, "y", "x", "p.c", "p.v")
    long = cut(stencil.smooth(long, 5, keys=[*keys, "c"]))
    points = features.detect(long, sizes, keys, "c", **how)
    gray = long.groupBy(*keys, "y", "x").pivot("c", [0, 1, 2]).agg(F.first("v")).select(*keys, "y", "x", P.gray(F.col("0"), F.col("1"), F.col("2")).alias("v"))
    return features.describe(stencil.sobel(gray, keys), points, keys)


def register(points: DataFrame, ratio: float = 0.7, mutual: bool = False, seed: int = 0, **how) -> DataFrame:
    """(panorama, pair_id, h, inliers, rmse, within): homographies from each image's next onto it."""
    left, right = match.neighbours(cut(points))
    keys = ("panorama", "pair_id")
    found = match.mutual_matches(left, right, ratio, keys) if mutual else match.ratio_matches(match.nearest_two(left, right, keys), ratio, keys)
    return geometry.ransac(match.coordinates(found, left, right, keys), keys, seed=seed, **how)


def panorama(pixels: DataFrame, sizes: DataFrame, mode: str = "g", margin: int = 2, seed: int = 0, enough: int = 2000, **how) -> DataFrame:
    """(panorama, y, x, c0, c1, c2): each panorama's images, equal in size, registered, warped on the middle one's plane and blended.

    ``pixels`` has panorama, seq, y, x, c0..c2; ``sizes`` has panorama, seq, h and w. Each panorama's homographies are folded in a
    task and have a canvas of their own size; panoramas of one canvas size are blended in one job.
    """
    steps = cut(register(described(pixels, sizes, enough=enough), seed=seed, **how).select("panorama", "pair_id", "h"))
    models = cut(geometry.compound_models(steps, sizes).withColumn("seq", F.col("seq").cast(pixels.schema["seq"].dataType)))
    warped = None
    for c in ("c0", "c1", "c2"):
        one = geometry.warp_backward(pixels, models, ("ch", "cw"), ("panorama", "seq"), c).drop("w")
        warped = one if warped is None else warped.join(one, ["panorama", "seq", "y", "x"])
    size = models.select("panorama", "ch", "cw").distinct()
    warped = cut(warped.withColumn("covered", F.lit(True)).join(size, "panorama"))
    out = None
    for r in size.select("ch", "cw").distinct().orderBy("ch", "cw").collect():  # as many rows as there are shapes
        same = warped.where((F.col("ch") == r["ch"]) & (F.col("cw") == r["cw"])).drop("ch", "cw")
        one = blend.blend(same, r["ch"], r["cw"], mode=mode, margin=margin, values=("c0", "c1", "c2"), keys=("panorama",))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no panorama has two images that could be registered")
    return out


def classify(train: DataFrame, valid: DataFrame, k: int = 1024, height: int = 128, width: int = 64, **how) -> tuple[DataFrame, DataFrame]:
    """Metrics (split, precision, recall, f1, accuracy, auc) and scored rows, from gray crops (image_id, label, y, x, v)."""
    sets = []
    for name, rows in (("train", train), ("valid", valid)):
        labels = rows.select("image_id", "label").distinct()
        sets.append(cut(features.hog(rows.select("image_id", "y", "x", "v"), height=height, width=width).join(labels, "image_id").select("image_id", "label", learn.as_vector().alias("features"))))
    model = learn.Classifier.fit(sets[0], k, **how)
    scored = cut(model.predict(sets[0]).withColumn("split", F.lit("train")).unionByName(model.predict(sets[1]).withColumn("split", F.lit("valid"))).select("split", "image_id", F.col("label").alias("truth"), "pred", "score"))
    metrics = learn.macro(learn.confusion(scored, keys=("split",)), ("split",)).join(learn.roc_auc(scored, keys=("split",)), "split")
    return metrics, scored
