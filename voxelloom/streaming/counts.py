"""Region counts over a stream of points. All counts are sums, so they can be
kept up to date; an addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.regions import count_by_label
from ..sources.files import is_image, section_number


def streamed_counts(points: DataFrame, with_hemi: bool = True, with_damage: bool = True) -> DataFrame:
    """Counts per label of a streaming DataFrame; write in complete or update mode."""
    return count_by_label(points, None, with_hemi, with_damage)


def start_counts(points: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    counts = streamed_counts(points)
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(points: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Points per window and label; rows later than `late` are let go."""
    timed = points.withWatermark(time, late)
    return timed.groupBy(F.window(time, window), "label").agg(F.count("*").alias("pixel_count"))


def image_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Section images as they arrive in a folder."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).load(folder).filter(is_image(F.col("path")))
    return files.select("path", "content", section_number(F.col("path")).alias("section_number"))
