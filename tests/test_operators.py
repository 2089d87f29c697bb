"""Operators against numpy versions written from their definitions, and known answers."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.functions import pixel as P
from rasterlake.operators import blend, components, features, geometry, hough, learn, match, score, stencil
from rasterlake.sources import images


def rows_of(spark, plane, image="a", names=("image_id", "y", "x", "v")):
    h, w = plane.shape
    return spark.createDataFrame([(image, y, x, float(plane[y, x])) for y in range(h) for x in range(w)], "image_id string, y int, x int, v double").toDF(*names)


def plane_of(df, shape, value="v"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.y, r.x] = r[value]
    return out


def convolved(a, k):
    c = (len(k) - 1) // 2
    out = np.zeros(a.shape)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            for i in range(len(k)):
                for j in range(len(k)):
                    if 0 <= y - i + c < a.shape[0] and 0 <= x - j + c < a.shape[1]:
                        out[y, x] += k[i][j] * a[y - i + c, x - j + c]
    return out


def sobel(a):
    p = np.pad(a, 1)
    d, s = p[:, :-2] - p[:, 2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return d[:-2] + 2 * d[1:-1] + d[2:], s[2:] - s[:-2]


@pytest.fixture(scope="module")
def noise():
    return np.round(np.random.default_rng(0).uniform(0, 255, (13, 17)))


@pytest.mark.parametrize("kernel", [[[1, 2, 0], [0, -1, 3], [1, 0, -2]], stencil.gaussian_kernel(5, 1.3), stencil.log_kernel(5, 1.5), [[1, 2], [3, 4]]])
def test_convolution(spark, noise, kernel):
    pixels = rows_of(spark, noise)
    want = convolved(noise, kernel)
    assert np.allclose(plane_of(stencil.convolve(pixels, kernel), noise.shape), want)
    assert np.allclose(plane_of(stencil.convolve_sparse(pixels, kernel), noise.shape), want)


def test_gradients_and_suppression(spark, noise):
    gx, gy = sobel(noise)
    g = stencil.gradient(rows_of(spark, noise))
    assert np.allclose(plane_of(g, noise.shape, "gx"), gx) and np.allclose(plane_of(g, noise.shape, "gy"), gy)
    mag, c = np.hypot(gx, gy), np.rint(np.degrees(np.arctan2(gy, gx)) / 45).astype(int) % 4
    offset = {0: (0, 1), 1: (-1, 1), 2: (-1, 0), 3: (-1, -1)}
    for strict, field in ((True, c), (False, mag)):
        want = np.zeros(noise.shape)
        for y in range(1, 12):
            for x in range(1, 16):
                dy, dx = offset[c[y, x]]
                want[y, x] = mag[y, x] * (mag[y, x] > max(field[y + dy, x + dx], field[y - dy, x - dx]))
        assert np.allclose(plane_of(stencil.suppress(g, strict=strict), noise.shape), want)


def test_reflected_filters(spark, noise):
    sized = rows_of(spark, noise).withColumns({"h": F.lit(13), "w": F.lit(17)})
    k = np.array([1, 4, 6, 4, 1]) / 16
    p = np.pad(noise, 2, mode="reflect")
    across = sum(k[i] * p[:, i : i + 17] for i in range(5))
    want = sum(k[i] * across[i : i + 13] for i in range(5))
    assert np.abs(plane_of(stencil.blur_reflected(sized), noise.shape) - want).max() <= 0.5 + 1e-9
    p = np.pad(noise, 1, mode="reflect")
    d, s = p[:, 2:] - p[:, :-2], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    g = stencil.sobel_reflected(sized)
    assert np.allclose(plane_of(g, noise.shape, "gx"), d[:-2] + 2 * d[1:-1] + d[2:]) and np.allclose(plane_of(g, noise.shape, "gy"), s[2:] - s[:-2])


def test_dilation_grows_to_larger_places(spark):
    a = np.zeros((6, 6))
    a[2, 3] = 1
    assert plane_of(stencil.dilate(rows_of(spark, a), 2), a.shape)[2:4, 3:5].sum() == 4
    assert plane_of(stencil.dilate(rows_of(spark, a), 3), a.shape)[1:4, 2:5].sum() == 9


def test_crop(spark):
    a = np.zeros((60, 50))
    a[25:28, 20:31] = 255
    got = stencil.bounding_crop(rows_of(spark, a), P.binary(F.col("v")) == 1)
    assert (got.agg(F.max("y")).first()[0] + 1, got.agg(F.max("x")).first()[0] + 1) == (22, 29)
    assert plane_of(got, (22, 29)).sum() == a.sum()
    assert stencil.bounding_crop(rows_of(spark, a * 0), P.binary(F.col("v")) == 1).count() == 0


def flood(mask):
    """Components by flood fill, numbered by the last pixel without a foreground neighbour before it."""
    todo, found = set(map(tuple, np.argwhere(mask))), []
    while todo:
        stack, part = [todo.pop()], []
        while stack:
            y, x = stack.pop()
            part.append((y, x))
            for n in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if n in todo:
                    todo.remove(n)
                    stack.append(n)
        begin = [p for p in part if not any((p[0] + i, p[1] + j) in set(part) for i, j in ((0, -1), (-1, -1), (-1, 0), (-1, 1)))]
        found.append((max(begin), part))
    return {p: k + 1 for k, (_, part) in enumerate(sorted(found)) for p in part}


def test_components(spark):
    r = np.random.default_rng(3)
    masks = {f"m{k}": r.uniform(size=(14, 15)) < 0.25 + 0.06 * k for k in range(6)}
    u = np.zeros((9, 9), bool)
    u[1:8, 1] = u[1:8, 7] = u[7, 1:8] = u[3:6, 4] = True
    masks["u"] = u
    rows = spark.createDataFrame([(k, int(y), int(x)) for k, m in masks.items() for y, x in np.argwhere(m)], "image_id string, y int, x int")
    want = sorted((k, y, x, n) for k, m in masks.items() for (y, x), n in flood(m).items())
    for f in (components.label, components.label_distributed):
        assert sorted((r.image_id, r.y, r.x, r.label) for r in f(rows).collect()) == want


def test_split_falls_back_to_the_whole_image(spark):
    pixels = rows_of(spark, np.ones((2, 2)), "a").union(rows_of(spark, np.ones((2, 2)), "b"))
    labelled = spark.createDataFrame([("a", 0, 1, 2)], "image_id string, y int, x int, label int")
    got = components.split(pixels, labelled).groupBy("image_id", "label").count().collect()
    assert sorted(map(tuple, got)) == [("a", 2, 1), ("b", 1, 4)]


def walk(x0, y0, x1, y1):
    """The classic error-term line."""
    steep = abs(y1 - y0) > abs(x1 - x0)
    if steep:
        x0, y0, x1, y1 = y0, x0, y1, x1
    if x0 > x1:
        x0, x1, y0, y1 = x1, x0, y1, y0
    left, y, out = (x1 - x0) // 2, y0, []
    for x in range(x0, x1 + 1):
        out.append((y, x) if steep else (x, y))
        left -= abs(y1 - y0)
        if left < 0:
            y += 1 if y0 < y1 else -1
            left += x1 - x0
    return out


def test_lines(spark):
    r = random.Random(2)
    ends = [tuple(r.randint(0, 20) for _ in range(4)) for _ in range(300)] + [(3, 3, 3, 3)]
    got = spark.createDataFrame([(k, *e) for k, e in enumerate(ends)], "k int, a int, b int, c int, d int").select("k", hough.on_line(*map(F.col, "abcd")).alias("p")).collect()
    assert all([(p.x, p.y) for p in g.p] == walk(*ends[g.k]) for g in got)


def test_descriptor(spark):
    a = np.random.default_rng(5).uniform(0, 255, (40, 40))
    gx, gy = sobel(a)
    mag, bins = np.hypot(gx, gy), (4 * np.arctan2(gy, gx) / np.pi).astype(int) % 8
    points = spark.createDataFrame([("a", 0, 20, 21), ("a", 1, 6, 20)], "image_id string, kp_id int, y int, x int")
    for mode in ("last", "sum"):
        got = {r.kp_id: np.array(r.desc) for r in features.describe(stencil.sobel(rows_of(spark, a)), points, mode=mode).collect()}
        want = np.zeros(128)
        for i in range(16):
            for j in range(16):
                k = (i // 4 * 4 + j // 4) * 8 + bins[12 + i, 13 + j]
                want[k] = mag[12 + i, 13 + j] if mode == "last" else want[k] + mag[12 + i, 13 + j]
        want = np.minimum(want / np.linalg.norm(want), 0.2)
        assert np.allclose(got[0], want / np.linalg.norm(want)) and not got[1].any()


def test_hog(spark):
    stripes = {k: np.array([[255.0 * (((y * math.sin(t) + x * math.cos(t)) % 8) < 4) for x in range(64)] for y in range(128)]) for k, t in (("0", 0.0), ("90", math.pi / 2))}
    df = rows_of(spark, stripes["0"], "0").union(rows_of(spark, stripes["90"], "90"))
    got = {r.image_id: np.array(r.desc) for r in features.hog(df).collect()}
    assert {len(v) for v in got.values()} == {3024}
    assert got["0"].reshape(-1, 9).sum(0).argmax() in (0, 8) and got["90"].reshape(-1, 9).sum(0).argmax() == 4


def test_adaptive_threshold(spark):
    ladder = features.rungs(100.0, 10.0)
    r = np.random.default_rng(1)
    values = r.uniform(5, 120, 400)
    rows = spark.createDataFrame([("a", k // 20, k % 20, float(v)) for k, v in enumerate(values)], "image_id string, y int, x int, r double")
    for enough in (10, 150, 1000):
        level = next((t for t in ladder if (values > t).sum() > enough), ladder[-1])
        assert features.adaptive(rows, [F.lit(0)], ladder, enough).count() == (values > level).sum()


def test_matching(spark):
    r = np.random.default_rng(8)
    a, b = r.uniform(size=(30, 6)), r.uniform(size=(25, 6))
    b[:10] = a[:10] + 0.01
    frame = lambda m: spark.createDataFrame([(0, k, [float(x) for x in v]) for k, v in enumerate(m)], "pair_id int, kp_id int, desc array<double>")
    d = np.abs(a[:, None] - b[None]).sum(2)
    got = match.nearest_two(frame(a), frame(b)).collect()
    assert {(x.a, x.rank): x.b for x in got} == {(i, k + 1): int(j) for i in range(30) for k, j in enumerate(d[i].argsort()[:2])}
    one = {(x.a, x.b) for x in match.ratio_matches(match.nearest_two(frame(a), frame(b))).collect()}
    both = {(x.a, x.b) for x in match.mutual_matches(frame(a), frame(b)).collect()}
    assert {(k, k) for k in range(10)} <= both <= one
    assert match.ratio_matches(match.nearest_two(frame(a), frame(b[:1]))).count() == 0


H = np.array([[1.02, 0.03, 4], [-0.02, 0.98, 7], [1e-5, 2e-5, 1]])


def matched(spark, outliers=0, n=60):
    r = np.random.default_rng(6)
    p2 = r.uniform(0, 200, (n, 2))
    p = np.c_[p2, np.ones(n)] @ H.T
    p1 = p[:, :2] / p[:, 2:]
    p1[:outliers] += r.uniform(30, 90, (outliers, 2))
    return spark.createDataFrame([(0, *map(float, (*a, *b))) for a, b in zip(p1, p2)], "pair_id int, y1 double, x1 double, y2 double, x2 double")


def test_fits(spark):
    m = matched(spark)
    for mode in "sm":
        assert np.allclose(np.array(geometry.fit(m, mode=mode).first().h).reshape(3, 3), H, atol=1e-4)
    affine = np.array(geometry.fit(m, mode="c").first().h)
    assert np.allclose(affine, geometry.affine_from_sums(geometry.affine_sums(m)).first().h, atol=1e-6)
    found = geometry.ransac(matched(spark, 20), tries=60).first()
    assert found.inliers >= 40 and found.rmse < 0.01 and np.allclose(np.array(found.h).reshape(3, 3), H, atol=1e-3)
    inv = np.array(spark.range(1).select(geometry.inverse(F.array(*[F.lit(float(v)) for v in H.ravel()])).alias("h")).first().h).reshape(3, 3)
    assert np.allclose(inv, np.linalg.inv(H) / np.linalg.inv(H)[2, 2])


def test_compound():
    shift = np.eye(3)
    shift[1, 2] = 5
    chain = geometry.compound([shift, shift], 10, 3)
    assert [h[1, 2] for h in chain] == [5, 10, 15]


def test_backward_warp_of_a_shift(spark, noise):
    models = spark.createDataFrame([("a", [1.0, 0.0, 2.0, 0.0, 1.0, 3.0, 0.0, 0.0, 1.0], 13, 17)], "image_id string, h array<double>, sh int, sw int")
    got = geometry.warp_backward(rows_of(spark, noise), models, (20, 30))
    assert got.count() == 12 * 16 and np.allclose(plane_of(got, (20, 30))[2:14, 3:19], noise[:12, :16])


def test_resize_to_same_size(spark, noise):
    sizes = spark.createDataFrame([("a", 13, 17)], "image_id string, h int, w int")
    assert np.allclose(plane_of(geometry.resize(rows_of(spark, noise), sizes, 13, 17), noise.shape), noise)


def test_seam_composite(spark):
    h, w = 6, 12
    r = np.random.default_rng(7)
    one, two = r.uniform(0, 255, (2, h, w, 1))
    covers = np.zeros((2, h, w), bool)
    covers[0, :, :8], covers[1, :, 4:] = True, True
    two[:, 6] = one[:, 6]
    image = blend.composite([one, two], [covers[0], covers[1]])
    assert (image[:, :4] == one[:, :4]).all() and (image[:, 8:] == two[:, 8:]).all()
    rows = [(0, k, y, x, float(v[y, x, 0]), bool(covers[k, y, x])) for k, v in enumerate((one, two)) for y in range(h) for x in range(w)]
    got = blend.seam_composite(spark.createDataFrame(rows, "panorama int, seq int, y int, x int, v double, covered boolean"), h, w)
    assert np.allclose(plane_of(got, (h, w)), image[..., 0])


def test_brightness_of_ramps(spark):
    rows = [(0, k, y, x + 5 * k, 10.0 * x + 50 * k + (5 * k) * 10, True) for k in range(3) for y in range(10) for x in range(8)]
    layers = spark.createDataFrame(rows, "panorama int, seq int, y int, x int, v double, covered boolean")
    even = blend.equalise(layers, keys=("panorama",))
    assert {r.seq: r.s for r in even.join(layers.withColumnRenamed("v", "u"), ["panorama", "seq", "y", "x"]).groupBy("seq").agg(F.round(F.avg(F.col("v") - F.col("u")), 6).alias("s")).collect()} == {0: 0.0, 1: -50.0, 2: -100.0}


def test_evaluation(spark):
    r = np.random.default_rng(9)
    truth, s = r.integers(0, 2, 300), np.round(r.uniform(0, 1, 300), 2)
    scored = spark.createDataFrame([(int(t), float(v), int(v > 0.5)) for t, v in zip(truth, s)], "truth int, score double, pred int")
    wins = (s[truth == 1][:, None] > s[truth == 0]).mean() + (s[truth == 1][:, None] == s[truth == 0]).mean() / 2
    assert abs(learn.roc_auc(scored).first().auc - wins) < 1e-12
    assert abs(learn.roc_auc(scored.withColumn("score", -F.col("score"))).first().auc - (1 - wins)) < 1e-12
    last = learn.roc_points(scored, tasks=7).orderBy("score").first()
    assert (last.tpr, last.fpr) == (1.0, 1.0)
    never = learn.macro(learn.confusion(scored.withColumn("pred", F.lit(0)))).first()
    assert never.precision is None and never.accuracy is not None


def test_classifier_is_saved_and_loaded(spark, tmp_path):
    r = np.random.default_rng(10)
    rows = [(int(k), int(k % 2), [float(x) for x in r.normal(3 * (k % 2), 1, 6)]) for k in range(80)]
    df = spark.createDataFrame(rows, "image_id int, label int, desc array<double>").withColumn("features", learn.as_vector())
    model = learn.Classifier.fit(df, 3, kernel=0)
    found = model.predict(df)
    assert found.where("label = pred").count() >= 76 and found.where("(score > 0.5) <> (pred = 1)").count() <= 8
    curved = df.withColumn("features", learn.array_to_vector(learn.random_fourier("desc", 6, 64, 0.1)))
    assert learn.Classifier.fit(curved, 16, kernel=0).predict(curved).where("label = pred").count() >= 76


def test_classifier_with_radial_kernel(spark, tmp_path):
    """Rings, which no linear margin parts; gamma by the variance; features whose products are the kernel."""
    r = np.random.default_rng(6)
    angle, radius = r.uniform(0, 2 * np.pi, 200), np.repeat([1.0, 3.0], 100) + r.normal(0, 0.2, 200)
    points = np.stack([radius * np.cos(angle), radius * np.sin(angle)], 1)
    df = spark.createDataFrame([(k, k // 100, p.tolist()) for k, p in enumerate(points)], "image_id int, label int, desc array<double>").withColumn("features", learn.as_vector())
    dims, gamma, n = learn.scaled_gamma(df, "features")
    assert (dims, n) == (2, 200) and np.isclose(gamma, 1 / (2 * points.var()))
    mapped = np.stack([f.toArray() for f, in df.orderBy("image_id").select(learn.radial("features", dims, 4096, gamma)).collect()])
    exact = np.exp(-gamma * ((points[:, None] - points) ** 2).sum(2))
    assert np.abs(mapped @ mapped.T - exact).max() < 0.12
    model = learn.Classifier.fit(df, 2)
    found = model.predict(df)
    assert found.columns == [*df.columns, "pred", "score"] and found.where("label = pred").count() >= 195
    assert found.where("(score > 0.5) <> (pred = 1)").count() <= 4
    assert learn.Classifier.fit(df, 2, kernel=0).predict(df).where("label = pred").count() <= 150
    model.save(str(tmp_path / "m"))
    assert learn.Classifier.load(str(tmp_path / "m")).predict(df).select("pred").collect() == found.select("pred").collect()
    same = spark.createDataFrame([(k, k % 2, [1.0, 1.0]) for k in range(6)], "image_id int, label int, desc array<double>").withColumn("features", learn.as_vector())
    assert learn.scaled_gamma(same, "features") == (2, 1.0, 6)



# fixed values: the recorded golden counts of img1 to img10
GOLDEN = dict(enumerate((9, 5, 9, 10, 10, 13, 8, 17, 16, 14), 1))
# fixed values: pairs of images with golden and predicted verdicts, distance and angle
VERDICTS = """
1 2 11 11, 1 4 22 11, 1 6 22 11, 1 8 12 12, 1 10 21 11, 3 4 12 12, 3 6 11 11, 3 8 22 12, 3 10 21 21, 5 6 11 12, 5 8 22 12, 5 10 21 21,
7 8 21 22, 7 10 21 21, 9 10 21 21, 2 4 22 22, 2 6 22 22, 2 8 22 22, 2 10 22 21, 4 6 21 11, 4 8 12 12, 4 10 21 21, 6 8 22 22, 6 10 21 21
"""


def test_count_score(spark):
    golden = spark.createDataFrame([(f"img{k}.png", n) for k, n in GOLDEN.items()], images.COUNTS)
    predicted = spark.createDataFrame([(f"img{k}.png", {6: 12, 8: 15}.get(k, n)) for k, n in GOLDEN.items()], images.COUNTS)
    assert score.count_score(golden, predicted).first().mismatches == 2
    assert score.count_score(golden, predicted.where("image_name <> 'img1.png'")).first().mismatches == 3


def test_pair_score(spark):
    rows = [x.split() for x in VERDICTS.replace("\n", " ").split(",")]
    table = lambda k: spark.createDataFrame([(f"data/img{a}.png", f"data/img{b}.png", int(v[k][0]), int(v[k][1])) for a, b, *v in rows], images.VERDICTS)
    assert len(rows) == 24 and tuple(score.pair_score(table(0), table(1)).first()) == (6, 5, 11)


def test_pairs(spark):
    names = spark.createDataFrame([(f"img{k}",) for k in range(1, 11)], "name string")
    pairs = score.all_pairs(names)
    assert pairs.count() == 90 and score.distinct_images(pairs).count() == 10
    stats = spark.createDataFrame([(f"img{k}", float(k) if k < 9 else float("nan"), 1.0) for k in range(1, 11)], "image_id string, cv double, var double")
    got = {(r.img1_path, r.img2_path): (r.output_distance, r.output_angle) for r in score.verdicts(pairs, stats).collect()}
    assert got["img1", "img2"] == (1, 2) and got["img2", "img1"] == (2, 2) and got["img1", "img9"] == (2, 2) and got["img9", "img10"] == (2, 2)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"img1_path,img2_path,output_distance,output_angle\r\nimg1,img2,1,2\r\nimg2,img3,2,2\r\n")
    verdicts = images.read_csv(spark, str(tmp_path / "a.csv"), images.VERDICTS)
    assert [tuple(r) for r in verdicts.collect()] == [("img1", "img2", 1, 2), ("img2", "img3", 2, 2)]
    assert tuple(score.pair_score(verdicts, verdicts.withColumn("output_angle", F.lit(1))).first()) == (0, 2, 2)
    images.write_csv(verdicts, str(tmp_path / "out"))
    assert images.read_csv(spark, str(tmp_path / "out"), images.VERDICTS).count() == 2


def test_frames(spark):
    frames = spark.createDataFrame([("v", k) for k in range(21)] + [("s", k) for k in range(3)], "video_id string, seq int")
    got = images.sample_frames(frames).groupBy("video_id").agg(F.sort_array(F.collect_list("seq")).alias("s")).collect()
    assert {r.video_id: r.s for r in got} == {"v": [0, 4, 8, 12, 16, 20], "s": [0, 0, 0, 1, 1, 2]}


def test_regions(spark, noise):
    marks = spark.createDataFrame([("a", 0, x, y, 100, 50) for x, y in ((0.1, 0.2), (0.3, 0.6), (0.2, 0.4))], "image_id string, hand int, lx double, ly double, w int, h int")
    assert tuple(images.landmark_boxes(marks).first())[2:] == (10, 10, 21, 21)
    rois = spark.createDataFrame([("a", 0, 2, 3, 4, 5)], "image_id string, roi int, x int, y int, w int, h int")
    got = plane_of(images.crop_regions(rows_of(spark, noise), rois), (4, 5))
    assert (got == noise[2:6, 3:8]).all()
    assert (plane_of(images.crop_regions(rows_of(spark, noise), rois, swapped=False), (5, 4)) == noise[3:8, 2:6]).all()
    assert images.crop_regions(rows_of(spark, noise * 0), rois).count() == 0


def test_images_round_trip(spark, tmp_path, noise):
    from rasterlake.sources.images import png

    for k, scale in (("img1", 1.0), ("img10", 0.5), ("img2", 0.2)):
        (tmp_path / f"{k}.png").write_bytes(png(np.stack([noise * scale, noise * 0, noise], -1)))
    found = images.read_images(spark, str(tmp_path))
    assert [r.image_id for r in images.numbered(found).orderBy("seq").collect()] == ["img1.png", "img10.png", "img2.png"]
    one = images.pixels(found.where("image_id = 'img1.png'"))
    assert (plane_of(one, noise.shape, "c2") == noise).all() and (plane_of(one, noise.shape, "c0") == noise).all() and plane_of(one, noise.shape, "c1").sum() == 0
    named = images.named_images(spark, spark.createDataFrame([("x/img2.png",), ("x/img2.png",), ("x/none.png",)], "path string"), folder=str(tmp_path))
    assert named.count() == 1
    packed = images.encode_png(one, found.select("image_id", "h", "w"), values=("c2", "c1", "c0")).first()
    assert bytes(packed.png) == (tmp_path / "img1.png").read_bytes()
    made = []
    table = lambda: made.append(1) or one
    for _ in range(2):
        assert images.cached(spark, str(tmp_path / "cache"), table).count() == noise.size
    assert made == [1]


def test_pixel_functions(spark):
    v = [-20.0, 0.0, 50.0, 127.5, 128.0, 200.0, 300.0]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    c = F.col("v")
    got = [list(col) for col in zip(*df.select(P.binary(c), P.double_threshold(c, 50, 200), P.contrast_trunc(c, 50), P.limit(c)).collect())]
    f = 259 * 305 / (255 * 209)
    assert got == [[0, 0, 0, 0, 1, 1, 1], [0, 0, 50, 127.5, 128, 200, 255], [int(min(256, max(0, f * (x - 128) + 128))) for x in v], [min(255, max(0, x)) for x in v]]
    y, x = P.project(F.lit(1.0), F.lit(2.0), F.array(*[F.lit(float(k)) for k in (1, 0, 0, 0, 1, 0, 0, 0, 0)]))
    assert tuple(df.select(y, x).first()) == (0.0, 0.0)
    assert [r[0] for r in df.select(P.orientation_class(F.lit(-math.pi / 5) + c * 0)).distinct().collect()] == [0]


def test_detector_on_halved_images(spark, noise):
    pixels = rows_of(spark, noise).cache()
    sizes = spark.createDataFrame([("a", *noise.shape)], "image_id string, h int, w int")
    whole = features.detector(pixels, sizes, "h", t=1e6).collect()
    assert {(r.y, r.x) for r in whole} == {(r.y, r.x) for r in features.harris(pixels, t=1e6).collect()}
    small = {(r.y * 2, r.x * 2) for r in features.harris(stencil.halve(pixels), t=1e6).collect()}
    assert {(r.y, r.x) for r in features.detector(pixels, sizes, "h", 1, t=1e6).collect()} == small
    with pytest.raises(ValueError):
        features.detector(pixels, sizes, "x")


def test_stacked_fits_equal_single_ones():
    r = np.random.default_rng(4)
    rows = r.uniform(0, 100, (7, 6, 4))
    for mode in ("s", "c"):
        for many, one in zip(geometry.solve_many(rows, mode), (geometry.solve(x, mode) for x in rows)):
            assert np.allclose(many, one, rtol=1e-5, atol=1e-7)


def test_each_warp_has_its_own_canvas(spark):
    plane = np.arange(12.0).reshape(3, 4) + 1
    pixels = rows_of(spark, plane, "a").unionByName(rows_of(spark, plane, "b"))
    steps = spark.createDataFrame([("a", 0, np.eye(3).ravel().tolist()), ("b", 0, np.eye(3).ravel().tolist()), ("b", 1, np.eye(3).ravel().tolist()), ("b", 2, np.eye(3).ravel().tolist())], "panorama string, pair_id int, h array<double>")
    sizes = spark.createDataFrame([("a", 3, 4), ("b", 3, 4)], "panorama string, h int, w int")
    models = geometry.compound_models(steps, sizes).cache()
    assert {(r.panorama, r.cw) for r in models.collect()} == {("a", 8), ("b", 16)}
    want = geometry.compound([np.eye(3)] * 3, 4, 4)
    assert all(np.allclose(np.array(r.h).reshape(3, 3), want[r.seq]) for r in models.collect() if r.panorama == "b")
    first = models.where("seq = 0").withColumnRenamed("panorama", "image_id")
    got = geometry.warp_backward(pixels, first, ("ch", "cw")).groupBy("image_id").agg(F.max("x")).collect()
    assert len(got) == 2


def test_count_score_takes_the_first_by_order(spark):
    golden = spark.createDataFrame([("a", 1)], "image_name string, `number of sutures` int")
    several = spark.createDataFrame([("a", 2, 5), ("a", 1, 3), ("a", 4, 9)], "image_name string, `number of sutures` int, place int").repartition(3)
    assert score.count_score(golden, several, order="place").first().mismatches == 0
    assert score.count_score(golden, several.where("place <> 3"), order="place").first().mismatches == 1


def test_region_dataset(spark, noise):
    pixels = rows_of(spark, noise)
    h, w = noise.shape
    sizes = spark.createDataFrame([("a", h, w)], "image_id string, h int, w int")
    rois = spark.createDataFrame([("a", 0, 1, 2, 3, 4)], "image_id string, roi int, x int, y int, w int, h int")
    (found,) = images.region_dataset(pixels, sizes, rois, scale=1.0, height=4, width=3, swapped=False).collect()
    assert found.png == images.png(noise[:, ::-1][2:6, 1:4])


def test_corners_and_overlays(spark):
    plane = np.full((8, 8), 100.0)
    labelled = rows_of(spark, plane).where("y < 3").select("image_id", "y", "x", F.lit(1).alias("label")).unionByName(rows_of(spark, plane).where("y > 4").select("image_id", "y", "x", F.lit(2).alias("label")))
    corners = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 1, 5), ("a", 4, 4)], "image_id string, y int, x int")
    assert {(r.label, r.corners) for r in components.corner_counts(labelled, corners).collect()} == {(1, 2), (2, 0)}
    shown = plane_of(features.overlay_keypoints(rows_of(spark, plane), corners.where("y = 4"), thickness=1), (8, 8))
    assert shown[4, 4] == 256 and (shown == 100).sum() == 63
    marked = plane_of(features.overlay_centroids(rows_of(spark, plane), spark.createDataFrame([("a", 0, 3)], "image_id string, cy int, cx int")), (8, 8))
    assert (marked == 255).sum() == 6 and np.isclose(marked[7, 7], 100 / 3)


def joins(df) -> set[str]:
    return set(re.findall(r"\w+Join", df._jdf.queryExecution().executedPlan().toString()))


TILTED = [0.9, 0.1, 2.0, -0.1, 1.1, 1.0, 0.002, 0.0, 1.0]


def warped(spark, noise, weight):
    models = spark.createDataFrame([("a", TILTED, 13, 17)], "image_id string, h array<double>, sh int, sw int")
    df = geometry.warp_backward(rows_of(spark, noise), models, (16, 22), weight=weight)
    inv = np.linalg.inv(np.array(TILTED).reshape(3, 3))
    want = {}
    for y in range(16):
        for x in range(22):
            sy, sx, s = inv @ (y, x, 1)
            sy, sx = sy / s, sx / s
            if 0 <= sy < 12 and 0 <= sx < 16:
                a, b, fy, fx = int(sy), int(sx), sy % 1, sx % 1
                v = (noise[a, b] * (1 - fx) + noise[a, b + 1] * fx) * (1 - fy) + (noise[a + 1, b] * (1 - fx) + noise[a + 1, b + 1] * fx) * fy
                want[y, x] = (v, min(sy, sx, 13 - sy, 17 - sx) if weight == "l" else 1.0)
    return df, want


def test_weights_of_a_warp_need_no_broadcast(spark, noise):
    df, want = warped(spark, noise, "l")
    got = {(r.y, r.x): (r.v, r.w) for r in df.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert joins(df) == {"ShuffledHashJoin"}


def test_bilinear_warp_needs_no_broadcast(spark, noise):
    df, want = warped(spark, noise, "b")
    got = {(r.y, r.x): (r.v, r.w) for r in df.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert joins(df) == {"ShuffledHashJoin"}


def test_resize_needs_no_broadcast(spark, noise):
    sizes = spark.createDataFrame([("a", 13, 17)], "image_id string, h int, w int")
    df = geometry.resize(rows_of(spark, noise), sizes, 5, 40)
    held = lambda n, k: np.clip((np.arange(k) + 0.5) * n / k - 0.5, 0, n - 1)
    along = np.stack([np.interp(held(17, 40), np.arange(17), row) for row in noise])
    want = np.stack([np.interp(held(13, 5), np.arange(13), column) for column in along.T], 1)
    assert df.count() == 200 and np.allclose(plane_of(df, (5, 40)), want)
    assert joins(df) == {"ShuffledHashJoin"}


def matched_cells(spark, monkeypatch, which):
    r = np.random.default_rng(9)
    a, b = r.normal(size=(70, 64)), r.normal(size=(50, 64))
    b[:20] = a[:20] + r.normal(size=(20, 64)) * 0.01
    b[20:23] = a[0]
    monkeypatch.setattr(match, "CELL", 16)
    frame = lambda m: spark.createDataFrame([(0, k, [float(x) for x in v]) for k, v in enumerate(m)], "pair_id int, kp_id int, desc array<double>")
    assert match._cells(frame(a), frame(b), ["pair_id"], "kp_id", "desc").select("i", "j").distinct().count() == 5 * 4  # no task has a whole pair
    return which(frame(a), frame(b)).collect(), np.abs(a[:, None] - b).sum(2)


def test_nearest_two_of_cells(spark, monkeypatch):
    got, d = matched_cells(spark, monkeypatch, match.nearest_two)
    assert {(x.a, x.rank): (x.b, x.d) for x in got} == {(i, k + 1): (j, d[i, j]) for i in range(70) for k, j in enumerate(d[i].argsort(kind="stable")[:2])}


def test_search_of_one_pair_makes_no_rows():
    r = np.random.default_rng(5)
    rows = r.uniform(0, 50, (60, 4))
    rows[:, 2], rows[:, 3] = 0.9 * rows[:, 0] + 0.1 * rows[:, 1] + 3, 1.1 * rows[:, 1] - 0.1 * rows[:, 0] + 2
    rows[:12, 2] += 50
    h, inliers, rmse, within = geometry.search(rows, 100, 6, 2, 2, 1, 0.5, "s", 0)
    assert inliers == 48 and rmse < 1e-6 and within == 2 and np.allclose(geometry.distances(rows[12:], np.reshape(h, (1, 3, 3))), 0, atol=1e-6)


def test_mutual_matches_of_cells(spark, monkeypatch):
    got, d = matched_cells(spark, monkeypatch, lambda a, b: match.mutual_matches(a, b, 0.9))
    two = [np.sort(x, 1)[:, :2] for x in (d, d.T)]
    want = {(i, int(j)): d[i, j] for i, j in enumerate(d.argmin(1)) if d[:, j].argmin() == i and two[0][i, 1] > 0 and two[0][i, 0] <= 0.9 * two[0][i, 1] and two[1][j, 0] <= 0.9 * two[1][j, 1]}
    assert len(want) >= 15 and {(x.a, x.b): x.d for x in got} == want


def test_cells_are_dealt_over_many_tasks(spark):
    side = spark.range(40).select(F.lit(0).alias("pair_id"), F.col("id").alias("kp_id"), F.array(F.col("id").cast("double")).alias("desc"))
    plan = match.mutual_matches(side, side)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(pair_id#\d+, i#\d+, j#\d+, (\d+)\)", plan)
    assert dealt and all(int(n) >= match.TASKS >= 64 for n in dealt)  # not the session's 4, which get unlike numbers of cells


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (7, 64), (64, 33)])
def test_places_of_the_few_that_are_true(shape):
    r = np.random.default_rng(1)
    for share in (0, 0.02, 0.5, 1):
        mask = r.random(shape) < share
        assert [x.tolist() for x in match._where(mask)] == [x.tolist() for x in np.nonzero(mask)]


@pytest.mark.parametrize("n", [3, 64, 300])
def test_rough_distances_into_arrays_that_are_kept(n):
    r = np.random.default_rng(2)
    a, b = r.normal(size=(150, n)), r.normal(size=(200, n))
    left, right, off = match.rounded(a, b)
    kept = []
    for k in (0, 64, 128):  # the last block has fewer rows
        d = match.rough(left[:, k : k + 64], right, kept)
        assert np.shares_memory(d, kept[0]) and (d == match.rough(left[:, k : k + 64], right)).all()
    two = match.cell_nearest(a, b, np.arange(150), np.arange(200), True)
    d = np.abs(a[:, None] - b).sum(2)
    assert sorted(zip(*(x.tolist() for x in two[0][:2]))) == sorted((i, int(j)) for i in range(150) for j in d[i].argsort()[:2])
    assert sorted(zip(*(x.tolist() for x in two[1][:2]))) == sorted((int(i), j) for j in range(200) for i in d[:, j].argsort()[:2])


def test_ratio_matches_of_cells(spark, monkeypatch):
    got, d = matched_cells(spark, monkeypatch, lambda a, b: match.ratio_matches(match.nearest_two(a, b), 0.9))
    near = np.sort(d, 1)
    assert {(x.a, x.b) for x in got} == {(i, int(d[i].argmin())) for i in range(70) if near[i, 1] > 0 and near[i, 0] < 0.9 * near[i, 1]}


@pytest.mark.parametrize("weight", ["b", "l"])
def test_warp_of_one_model_compiles(spark, weight):
    pixels = spark.range(64).select(F.lit(0).alias("image_id"), F.floor(F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"), F.col("id").cast("double").alias("v"))
    models = spark.range(1).select(F.lit(0).alias("image_id"), F.array(*map(F.lit, (0.9, 0.1, 1.0, -0.1, 1.1, 2.0, 0.0, 0.0, 1.0))).alias("h"), F.lit(8).alias("sh"), F.lit(8).alias("sw"))
    spark.conf.set("spark.sql.codegen.fallback", "false")  # code too long for Java is an error then, not run uncompiled
    try:
        got = {(p.y, p.x): p.v for p in geometry.warp_backward(pixels, models, (10, 12), weight=weight).collect()}
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    back = np.linalg.inv([[0.9, 0.1, 1.0], [-0.1, 1.1, 2.0], [0.0, 0.0, 1.0]])
    at = {(y, x): tuple((back @ (y, x, 1))[:2]) for y in range(10) for x in range(12)}
    want = {k: 8 * sy + sx for k, (sy, sx) in at.items() if 0 <= sy < 7 and 0 <= sx < 7}
    assert len(want) > 30 and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def plain_two(a, b, a_ids, b_ids):
    """(id, id, d) of the nearest two in b of each of a, ties to the smaller id."""
    d = np.abs(a[:, None] - b).sum(2)
    return sorted((int(a_ids[i]), int(b_ids[j]), round(d[i, j], 9)) for i in range(len(a)) for j in np.lexsort((b_ids, d[i]))[:2])


@pytest.mark.parametrize("both", [False, True])
def test_copies_are_compared_once(monkeypatch, both):
    r = np.random.default_rng(3)
    a, b = r.normal(size=(900, 64)), r.normal(size=(700, 64))
    a[100:500], b[:300], b[300:350] = a[100], a[100], b[600]
    a_ids, b_ids = r.permutation(900) * 2, r.permutation(700) * 2 + 1
    taken, exactly = [], match._exactly
    monkeypatch.setattr(match, "_exactly", lambda a, b, i, j: taken.append(len(i)) or exactly(a, b, i, j))
    there, back = match.cell_nearest(a, b, a_ids, b_ids, both)
    listed = lambda own, other, f: sorted(zip(own.tolist(), other.tolist(), np.round(f[2], 9).tolist()))
    assert listed(a_ids[there[0]], b_ids[there[1]], there) == plain_two(a, b, a_ids, b_ids)
    if both:
        assert listed(b_ids[back[1]], a_ids[back[0]], back) == plain_two(b, a, b_ids, a_ids)
    assert sum(taken) < 20_000  # of 400 * 300 pairs of copies two by two
