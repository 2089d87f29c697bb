"""Rasters, masks, layers, points and scores derived from the driver's tables; each with the same definition in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import stencil


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, p, e): components of the embeddings as doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "e"))


def raster8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, y, x, v): 8 x 8 rasters of whole values."""
    p = F.col("p")
    return elements(spark, sf_dir).select("vec_id", "label", F.floor(p / 8).cast("int").alias("y"), (p % 8).alias("x"), F.round(128 + 400 * F.col("e")).alias("v"))


R8 = "r AS (SELECT vec_id, label, (p // 8)::BIGINT AS y, (p % 8)::BIGINT AS x, round(128 + 400 * e::DOUBLE) AS v FROM (SELECT vec_id, label, unnest(embedding) AS e, unnest(range(0, len(embedding))) AS p FROM embeddings))"


def gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.gradient(stencil.by_image(raster8(spark, sf_dir), "vec_id"), ("vec_id",))


#: Sobel sums by joining each pixel with the eight it adds to
G8 = (
    R8
    + """, k(dy, dx, wx, wy) AS (VALUES (-1, -1, 1, -1), (-1, 0, 0, -2), (-1, 1, -1, -1), (0, -1, 2, 0), (0, 1, -2, 0), (1, -1, 1, 1), (1, 0, 0, 2), (1, 1, -1, 1)),
s AS (SELECT vec_id, y - dy AS y, x - dx AS x, sum(v * wx) AS gx, sum(v * wy) AS gy FROM r, k GROUP BY 1, 2, 3),
g AS (SELECT r.vec_id, r.label, r.y, r.x, r.v, s.gx + 0.0::DOUBLE AS gx, s.gy + 0.0::DOUBLE AS gy, sqrt(s.gx * s.gx + s.gy * s.gy) AS mag, 180 * atan2(s.gy + 0.0::DOUBLE, s.gx + 0.0::DOUBLE) / pi() AS theta FROM r JOIN s ON r.vec_id = s.vec_id AND r.y = s.y AND r.x = s.x)"""
)


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(panorama, seq, y, x, v, covered): five consecutive rasters a panorama, each 3 columns further right."""
    r = raster8(spark, sf_dir)
    return r.select(F.floor(F.col("vec_id") / 5).alias("panorama"), (F.col("vec_id") % 5).alias("seq"), "y", (F.col("x") + 3 * (F.col("vec_id") % 5)).alias("x"), "v", F.lit(True).alias("covered"))


LAYERS = R8 + ", l AS (SELECT vec_id // 5 AS panorama, vec_id % 5 AS seq, y, x + 3 * (vec_id % 5) AS x, v FROM r)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, item, line, y1, x1, y2, x2): an affine image of (quantity, discount) with noise by line number, per supplier."""
    y, x, n = F.col("l_quantity"), F.round(100 * F.col("l_discount")), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pair_id"), F.col("l_orderkey").alias("item"), n.cast("long").alias("line"), y.alias("y1"), x.alias("x1"), (0.9 * y + 0.1 * x + 3 + 0.01 * n).alias("y2"), (-0.1 * y + 1.1 * x + 2 - 0.02 * n).alias("x2"))


POINTS = "q AS (SELECT l_suppkey AS pair_id, l_orderkey AS item, l_linenumber::BIGINT AS line, l_quantity AS y1, round(100 * l_discount) AS x1, l_linenumber AS n FROM lineitem), m AS (SELECT pair_id, item, line, y1, x1, 0.9::DOUBLE * y1 + 0.1::DOUBLE * x1 + 3 + 0.01::DOUBLE * n AS y2, -0.1::DOUBLE * y1 + 1.1::DOUBLE * x1 + 2 - 0.02::DOUBLE * n AS x2 FROM q)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, truth, score, pred) of labelled documents by their length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").cast("long").alias("truth"), F.col("n_chars").cast("double").alias("score"), (F.col("n_chars") > 1000).cast("int").alias("pred"))


SCORED = "s AS (SELECT l.doc_id, quality::BIGINT AS truth, n_chars::DOUBLE AS score, (n_chars > 1000)::INT AS pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def user_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, label, gap): days since the user's event before."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(order).alias("label"), (F.timestamp_diff("MICROSECOND", F.lag("ts").over(order), F.col("ts")) / 86400e6).alias("gap"))


GAPS = "e AS (SELECT user_id, event_id, row_number() OVER w AS label, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 86400e6 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Descriptors of even and of odd vectors as the two sides of one pair."""
    d = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("pair_id"), F.col("vec_id").alias("kp_id"), F.col("embedding").cast("array<double>").alias("desc"))
    return d.where("kp_id % 2 = 0"), d.where("kp_id % 2 = 1")


#: nearest two from both sides: n has side, a, b, d, rank
NEAR = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
d AS (SELECT a.vec_id % 2 AS side, a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: abs(a.e[i] - b.e[i]))) AS d FROM v a, v b WHERE a.vec_id % 2 <> b.vec_id % 2),
n AS (SELECT *, row_number() OVER (PARTITION BY side, a ORDER BY round(d, 9), b) AS rank FROM d QUALIFY rank <= 2),
t AS (SELECT side, a, arg_min(b, rank) AS b, min(d) AS d, min(d) / max(d) AS ratio FROM n GROUP BY 1, 2)"""
