"""A folder of images as a stream: statistics of each new image, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import hough, stencil
from ..plans.pipelines import line_statistics
from ..sources.images import pixels

BINARY = "path string, modificationTime timestamp, length long, content binary"


def image_stream(spark: SparkSession, folder: str, glob: str = "*", most: int = 100) -> DataFrame:
    """(path, content) of files as they arrive, at most ``most`` a batch."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).option("maxFilesPerTrigger", most).load(folder).select("path", "content")


def statistics_stream(arrivals: DataFrame, target: str, checkpoint: str, decode, part: int = 1) -> StreamingQuery:
    """Appends line statistics of each batch's images to the Parquet table at ``target``. ``decode`` makes (image_id, h, w, channels, data) of (path, content)."""

    def each(batch: DataFrame, number: int) -> None:
        images = decode(batch).persist()
        line_statistics(pixels(images), images.select("image_id", "h"), part).write.mode("overwrite").parquet(f"{target}/batch={number}")
        images.unpersist()

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def angle_stream(rasters: DataFrame) -> DataFrame:
    """A batch of rasters (image_id, y, x, v) to their weighted edge direction, for use in foreachBatch."""
    return hough.normal_angle(stencil.gradient(stencil.by_image(rasters, "image_id")))
