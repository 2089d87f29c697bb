"""Readers and writers: image folders, labelled trees, frames, regions, CSV and PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = T.StructType([T.StructField("image_name", T.StringType()), T.StructField("number of sutures", T.IntegerType())])
STATISTICS = T.StructType([*COUNTS.fields, *(T.StructField(n, T.DoubleType()) for n in ("mean inter suture spacing", "variance of inter suture spacing", "mean suture angle wrt x-axis", "variance of suture angle wrt x-axis"))])
PAIRS = T.StructType([T.StructField(n, T.StringType()) for n in ("img1_path", "img2_path")])
VERDICTS = T.StructType([*PAIRS.fields, *(T.StructField(n, T.IntegerType()) for n in ("output_distance", "output_angle"))])


def read_images(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(image_id, origin, h, w, channels, data): decoded images, channels blue first; image_id is the file's name."""
    reader = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", recursive)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    i = "image."
    return rows.select(F.element_at(F.split(i + "origin", "/"), -1).alias("image_id"), F.col(i + "origin").alias("origin"), F.col(i + "height").alias("h"), F.col(i + "width").alias("w"), F.col(i + "nChannels").alias("channels"), F.col(i + "data").alias("data"))


def numbered(images: DataFrame, keys=(), name: str = "image_id") -> DataFrame:
    """images with ``seq`` in the order of names as strings, from 0, within the keys; only names are sorted."""
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(name)
    seq = images.select(*keys, name).distinct().withColumn("seq", F.row_number().over(order) - 1)
    return images.join(seq, [*keys, name])


def named_images(spark: SparkSession, paths: DataFrame, column: str = "path", folder: str = "") -> DataFrame:
    """Images that a table names, each decoded once: contents are read only for joined paths."""
    wanted = paths.select(F.col(column).alias("path")).distinct()
    images = read_images(spark, folder)
    return images.join(wanted.select(F.element_at(F.split("path", "/"), -1).alias("image_id"), "path"), "image_id")


def pixels(images: DataFrame, *keep: str) -> DataFrame:
    """(keep, y, x, c0, c1, c2): one row a pixel; missing channels repeat the first. Expanded in Arrow batches, one image at a time."""
    keep = list(keep or ["image_id"])
    schema = images.select(*keep).schema
    for n, t in (("y", "integer"), ("x", "integer"), ("c0", "double"), ("c1", "double"), ("c2", "double")):
        schema = schema.add(n, t)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                h, w, n = (batch.column(c)[i].as_py() for c in ("h", "w", "channels"))
                raw = np.frombuffer(batch.column("data")[i].as_py(), np.uint8).reshape(h * w, n).astype(float)
                rows = max(1, 100_000 // max(w, 1)) * w
                for a in range(0, h * w, rows or 1):
                    part = raw[a : a + rows]
                    y, x = np.divmod(np.arange(a, a + len(part)), w)
                    same = [pa.repeat(batch.column(c)[i], len(part)) for c in keep]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), *(pa.array(part[:, min(c, n - 1)].copy()) for c in range(3))], names=schema.names)

    return images.select(*keep, *[c for c in ("h", "w", "channels", "data") if c not in keep]).mapInArrow(run, schema)


def labelled_tree(spark: SparkSession, root: str) -> DataFrame:
    """Images of root/{class}/{split}/*.jpg with class, split and label (0 for classes that begin with c, else 1)."""
    rows = read_images(spark, root, "*.jpg", recursive=True)
    part = F.split("origin", "/")
    out = rows.withColumns({"class": F.element_at(part, -3), "split": F.element_at(part, -2)})
    return out.withColumn("label", F.when(F.substring("class", 1, 1) == "c", 0).otherwise(1))


def sample_frames(frames: DataFrame, n: int = 6, keys=("video_id",)) -> DataFrame:
    """frames joined with their sample numbers ``i``: both ends and evenly between; a short video repeats frames."""
    count = frames.groupBy(*keys).agg((F.max("seq") + 1).alias("_n"))
    picks = count.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(*keys, "i", F.floor((F.col("_n") - 1) * F.col("i") / (n - 1)).cast(frames.schema["seq"].dataType).alias("seq"))
    return frames.join(picks, [*keys, "seq"])


def crop_regions(image_pixels: DataFrame, rois: DataFrame, keys=("image_id",), values=("v",), swapped: bool = True) -> DataFrame:
    """(keys, roi, y, x, values): pixels of each region (x, y, w, h) from its corner; regions of zeros alone are left out.

    ``swapped`` takes the region's x and w along rows, as the classifier was trained; without it x runs along columns.
    """
    keys = list(keys)
    r = rois.select(*keys, "roi", *[F.col(c).alias(f"_{c}") for c in "xywh"])
    row, height, column, width = ("_x", "_w", "_y", "_h") if swapped else ("_y", "_h", "_x", "_w")
    inside = image_pixels.join(r, keys).where((F.col("y") >= F.col(row)) & (F.col("y") < F.col(row) + F.col(height)) & (F.col("x") >= F.col(column)) & (F.col("x") < F.col(column) + F.col(width)))
    lit = inside.groupBy(*keys, "roi").agg(F.sum(sum(F.abs(F.col(v)) for v in values)).alias("_t")).where("_t > 0").select(*keys, "roi")
    return inside.join(lit, [*keys, "roi"], "left_semi").select(*keys, "roi", (F.col("y") - F.col(row)).alias("y"), (F.col("x") - F.col(column)).alias("x"), *values)


def landmark_boxes(landmarks: DataFrame, keys=("image_id", "hand")) -> DataFrame:
    """(keys, x, y, w, h): bounding boxes of landmarks (lx, ly as shares of w and h), both ends included."""
    px, py = (F.col("lx") * F.col("w")).cast("int"), (F.col("ly") * F.col("h")).cast("int")
    box = landmarks.groupBy(*keys).agg(F.min(px).alias("x"), F.min(py).alias("y"), F.max(px).alias("_r"), F.max(py).alias("_b"))
    return box.select(*keys, "x", "y", (F.col("_r") - F.col("x") + 1).alias("w"), (F.col("_b") - F.col("y") + 1).alias("h"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """With header and fixed schema; line ends of either kind."""
    return spark.read.option("header", True).option("ignoreTrailingWhiteSpace", True).schema(schema).csv(path)


def write_csv(rows: DataFrame, path: str, single: bool = True) -> None:
    """With header; ``single`` for result tables of a few rows an image."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("header", True).csv(path)


def png(plane: np.ndarray) -> bytes:
    """A PNG of (h, w) or (h, w, 3) values, red first, held to 0..255."""
    plane = np.clip(np.rint(plane), 0, 255).astype(np.uint8)
    h, w = plane.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + line.tobytes() for line in plane.reshape(h, -1))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if plane.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def encode_png(image_pixels: DataFrame, sizes: DataFrame, keys=("image_id",), values=("v",)) -> DataFrame:
    """(keys, png): images from their pixel rows; ``values`` is one column, or red, green and blue. ``sizes`` has keys, h and w."""
    keys, values = list(keys), list(values)
    rows = image_pixels.select(*keys, "y", "x", *values).join(sizes.select(*keys, "h", "w"), keys)
    schema = rows.select(*keys).schema.add("png", "binary")

    def each(table: pa.Table) -> pa.Table:
        h, w = table["h"][0].as_py(), table["w"][0].as_py()
        plane = np.zeros((h, w, len(values)))
        plane[table["y"].to_numpy(), table["x"].to_numpy()] = np.stack([table[v].to_numpy() for v in values], 1)
        return pa.Table.from_arrays([*(table[k].slice(0, 1) for k in keys), pa.array([png(plane if len(values) == 3 else plane[..., 0])], pa.binary())], names=[*keys, "png"])

    return rows.groupBy(*keys).applyInArrow(each, schema)


def region_dataset(image_pixels: DataFrame, sizes: DataFrame, rois: DataFrame, keys=("image_id",), values=("v",), mirror: bool = True, scale: float = 1.4, height: int = 128, width: int = 64, swapped: bool = True) -> DataFrame:
    """(keys, roi, png): each region of the mirrored images, enlarged, cut out and resized. Write it with ``cached``, which keeps what is there unless told to overwrite."""
    from ..functions import pixel as P
    from ..operators import geometry

    keys, by = list(keys), [*keys, "roi"]
    if mirror:
        image_pixels = image_pixels.join(sizes.select(*keys, F.col("w").alias("_w")), keys).withColumn("x", P.mirrored(F.col("x"), F.col("_w"))).drop("_w")
    box = P.enlarge_box(*[F.col(c) for c in "xywh"], scale=scale)
    parts = crop_regions(image_pixels, rois.select(*by, *[b.alias(c) for b, c in zip(box, "xywh")]), keys, values, swapped)
    shape = parts.groupBy(*by).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    sized = None
    for v in values:
        one = geometry.resize(parts, shape, height, width, by, v)
        sized = one if sized is None else sized.join(one, [*by, "y", "x"])
    return encode_png(sized, shape.select(*by, F.lit(height).alias("h"), F.lit(width).alias("w")), by, values)


def cached(spark: SparkSession, path: str, make, overwrite: bool = False) -> DataFrame:
    """The Parquet table at path, made and written first if it isn't there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    there = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop.Path(f"{path}/_SUCCESS"))
    if overwrite or not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
