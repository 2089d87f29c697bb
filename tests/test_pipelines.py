"""End-to-end questions on images with known answers, the driver's queries against their SQL, and the stream."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from rasterlake.plans import pipelines
from rasterlake.plans import queries as raster
from rasterlake.sources import images
from rasterlake.streaming import folders

SF = "/root/testdata/sf0.001"


def strokes(rows, height=400, width=110, size=4):
    a = np.zeros((height, width))
    for y in rows:
        a[y : y + size, 25:85] = 255
    return a


def pixels_of(spark, planes):
    rows = pd.concat([pd.DataFrame({"image_id": k, "y": np.repeat(np.arange(a.shape[0], dtype=np.int32), a.shape[1]), "x": np.tile(np.arange(a.shape[1], dtype=np.int32), a.shape[0]), **{c: a.ravel() for c in ("c0", "c1", "c2")}}) for k, a in planes.items()])
    df = spark.createDataFrame(rows, "image_id string, y int, x int, c0 double, c1 double, c2 double")
    return df, spark.createDataFrame([(k, *a.shape) for k, a in planes.items()], "image_id string, h int, w int")


def test_strokes_are_counted_and_compared(spark):
    even, uneven = strokes(range(40, 340, 60)), strokes((40, 95, 170, 215, 330))
    pixels, sizes = pixels_of(spark, {"even": even, "uneven": uneven})
    stats = pipelines.line_statistics(pixels, sizes)
    got = {r.image_id: r for r in stats.collect()}
    assert got["even"].n == got["uneven"].n == 5
    assert got["even"].spacing_mean == pytest.approx(60 / 400, abs=0.005) and got["even"].spacing_var < 1e-5 < got["uneven"].spacing_var
    pairs = spark.createDataFrame([("even", "uneven"), ("uneven", "even")], "img1_path string, img2_path string")
    verdicts = {r.img1_path: r.output_distance for r in pipelines.pair_verdicts(pairs, pixels, sizes).collect()}
    assert verdicts == {"even": 1, "uneven": 2}
    assert pipelines.statistics_table(stats).columns == images.STATISTICS.fieldNames()


def test_panorama_of_shifted_copies(spark):
    r = np.random.default_rng(0)
    scene = np.kron(r.integers(0, 256, (16, 40)), np.ones((4, 4))) * 0.5 + np.kron(r.integers(0, 256, (8, 20)), np.ones((8, 8))) * 0.5
    parts = {0: scene[:, :96], 1: scene[:, 24:120]}
    rows = pd.concat([pd.DataFrame({"panorama": "p", "seq": k, "y": np.repeat(np.arange(64, dtype=np.int32), 96), "x": np.tile(np.arange(96, dtype=np.int32), 64), **{c: a.ravel() for c in ("c0", "c1", "c2")}}) for k, a in parts.items()])
    pixels = spark.createDataFrame(rows, "panorama string, seq int, y int, x int, c0 double, c1 double, c2 double")
    sizes = spark.createDataFrame([("p", 0, 64, 96), ("p", 1, 64, 96)], "panorama string, seq int, h int, w int")
    points = pipelines.described(pixels, sizes, enough=60)
    (h,) = [np.array(x.h).reshape(3, 3) for x in pipelines.register(points, tries=20, within=2).collect()]
    assert np.allclose(h @ [30, 40, 1] / (h @ [30, 40, 1])[2], [30, 64, 1], atol=1.5)
    image = pipelines.panorama(pixels, sizes, enough=60, tries=20).toPandas()
    assert len(image) == 60 * (96 * 2 - 4)
    mine = image.pivot(index="y", columns="x", values="c0").to_numpy()
    assert np.abs(mine[4:56, 4:80] - scene[6:58, 6:82]).mean() < 6


def test_classifier(spark):
    r = np.random.default_rng(1)
    rows = []
    for k in range(24):
        label = k % 2
        y, x = np.mgrid[0:32, 0:32]
        a = 127 + 100 * np.sin((y if label else x) * r.uniform(0.6, 0.9)) + r.normal(0, 10, (32, 32))
        rows.append(pd.DataFrame({"image_id": k, "label": label, "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "v": a.ravel()}))
    table = lambda part: spark.createDataFrame(pd.concat(part), "image_id int, label int, y int, x int, v double")
    metrics, _ = pipelines.classify(table(rows[:16]), table(rows[16:]), k=4, height=32, width=32)
    got = {m.split: m for m in metrics.collect()}
    assert got["valid"].accuracy == 1 and got["valid"].auc == 1 and got["train"].f1 == 1


def normal(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    text = lambda v: "" if v is None else repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(text, row)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(raster.QUERIES))
def test_query_equals_its_sql(spark, name):
    got = raster.QUERIES[name](spark, SF).toPandas()
    if name not in raster.ORACLE:
        assert len(got)
        return
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings labels".split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(raster.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stencils_share_one_exchange(spark):
    from rasterlake.operators import stencil
    from rasterlake.plans import fixtures

    pixels = stencil.by_image(fixtures.raster8(spark, SF), "vec_id")
    chained = stencil.suppress(stencil.gradient(stencil.smooth(pixels, keys=("vec_id",)), ("vec_id",)), ("vec_id",))
    plan = chained._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_stream_of_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    image = strokes(range(40, 220, 60), 250)
    (tmp_path / "in" / "one.png").write_bytes(images.png(image))

    def decode(batch):
        paths = [r.path for r in batch.select("path").collect()]
        return images.read_images(spark, paths)

    query = folders.statistics_stream(folders.image_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), decode)
    query.awaitTermination(300)
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [3]


def test_svm_predict_fits_on_all_rows(spark, monkeypatch):
    from rasterlake.operators import learn
    from rasterlake.plans import queries

    fit, seen = learn.Classifier.fit, []
    monkeypatch.setattr(learn.Classifier, "fit", staticmethod(lambda train, *a, **how: (seen.append((train.count(), how)), fit(train, *a, **how))[1]))
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/embeddings.parquet").count()
    assert queries.svm_predict(spark, d).where("score between 0 and 1").count() == n and seen == [(n, {})]


def test_compound_shifts_of_an_unfinished_panorama(spark, tmp_path):
    rows = [(k, [0.0], k % 10) for k in (0, 1, 2, 3, 4, 5, 7, 14)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = raster.QUERIES["compound_shifts"](spark, str(tmp_path)).toPandas()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.sql(raster.ORACLE["compound_shifts"]).df()
    order = ["panorama", "seq"]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True), check_dtype=False)
