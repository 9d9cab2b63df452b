"""Pixel filters and projections of section images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a section keeps at most in the intensity pipeline.
SAMPLE = 100_000


def matches_colour(pixel_id: tuple[int, ...], channels: list[str], order: str = "reference") -> Column:
    """Pixels of one colour. A grey image compares its only channel with the
    first number. `reference` compares channels in stored order (blue, green,
    red) with the numbers as they come; `rgb` reads the numbers as red, green,
    blue."""
    wanted = list(pixel_id)[: len(channels)]
    if order == "rgb" and len(channels) == 3:
        wanted = wanted[::-1]
    test = F.lit(True)
    for channel, value in zip(channels, wanted, strict=False):
        test = test & (F.col(channel) == value)
    return test


def nonzero(channel: str = "value") -> Column:
    return F.coalesce(F.col(channel) != 0, F.lit(False))


def auto_colour(pixels: DataFrame, value: str = "value") -> DataFrame:
    """The second most frequent value of each section, the smaller one first on
    a tie; 255 where there are fewer than two."""
    counts = pixels.groupBy("section_number", value).count()
    place = F.row_number().over(Window.partitionBy("section_number").orderBy(F.desc("count"), value))
    second = counts.withColumn("_place", place).groupBy("section_number").agg(F.max(F.when(F.col("_place") == 2, F.col(value))).alias("pixel_id"))
    return second.withColumn("pixel_id", F.coalesce("pixel_id", F.lit(255).cast(pixels.schema[value].dataType)))


def bounded(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Values outside the bounds become 0; the pixels stay."""
    found = value
    if low is not None:
        found = F.when(value < low, F.lit(0.0)).otherwise(found)
    if high is not None:
        found = F.when(value > high, F.lit(0.0)).otherwise(found)
    return found


def signal(low: float | None = None, high: float | None = None, value: str = "value") -> Column:
    """Pixels that carry signal: those within the bounds, all where there are none."""
    test = F.lit(True)
    if low is not None:
        test = test & (F.col(value) >= low)
    if high is not None:
        test = test & (F.col(value) <= high)
    return test


def resize_nearest(raster: DataFrame, source: tuple[int, int], target: tuple[int, int], values: list[str]) -> DataFrame:
    """(height, width) of source to target; one join on the source cell."""
    (sh, sw), (th, tw) = source, target
    spark = raster.sparkSession
    rows = spark.range(th).select(F.col("id").cast("int").alias("_ty"), F.least(F.floor(F.col("id") * sh / th), F.lit(sh - 1)).cast("int").alias("y"))
    cols = spark.range(tw).select(F.col("id").cast("int").alias("_tx"), F.least(F.floor(F.col("id") * sw / tw), F.lit(sw - 1)).cast("int").alias("x"))
    found = raster.select("section_number", "y", "x", *values).join(rows, "y").join(cols, "x")
    return found.select("section_number", F.col("_ty").alias("y"), F.col("_tx").alias("x"), *values)


def resize_area(raster: DataFrame, source: tuple[int, int], target: tuple[int, int], value: str = "value") -> DataFrame:
    """Means weighted by overlap, for shrinking. Each pixel goes to the cells it
    overlaps; sums are partial."""
    (sh, sw), (th, tw) = source, target

    def spread(axis: str, n: int, m: int) -> tuple[Column, Column]:
        step = F.lit(m / n)
        low, high = F.col(axis) * step, (F.col(axis) + 1) * step
        first, last = F.floor(low + 1e-9), F.least(F.ceil(high - 1e-9) - 1, F.lit(m - 1))
        cells = F.sequence(first.cast("int"), F.greatest(first, last).cast("int"))
        return F.explode(cells), F.least(high, F.col(f"_{axis}") + 1) - F.greatest(low, F.col(f"_{axis}"))

    rows, hy = spread("y", sh, th)
    cols, hx = spread("x", sw, tw)
    cells = raster.withColumn("_y", rows).withColumn("_x", cols).withColumn("_w", hy * hx)
    mean = F.sum(F.col(value) * F.col("_w")) / F.sum("_w")
    return cells.groupBy("section_number", F.col("_y").alias("y"), F.col("_x").alias("x")).agg(mean.alias(value))


def stride_sample(pixels: DataFrame, most: int = SAMPLE, order: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """At most `most` rows of each section, evenly spread over their order: row
    floor(i (n-1) / (most-1)) for each i. Sections of up to `most` rows stay
    whole. This is the feature's own limit."""
    within = Window.partitionBy("section_number")
    ranked = pixels.withColumn("_rank", F.row_number().over(within.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(within))
    step = (F.col("_n") - 1) / F.lit(float(max(1, most - 1)))
    # rank r is taken if some i has floor(i step) = r
    i = F.ceil(F.col("_rank") / F.when(step > 0, step))
    taken = (F.col("_n") <= most) | ((i <= most - 1) & (F.floor(i * step) == F.col("_rank")))
    return ranked.filter(taken).drop("_rank", "_n")
