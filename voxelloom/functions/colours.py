"""Colour maps as column arithmetic, and as a 256-row table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numeric import clipped

#: Fixed luma weights of red, green and blue.
LUMA = (0.2989, 0.5870, 0.1140)
#: Fixed weights of a grey image from blue, green, red.
GREY = (0.114, 0.587, 0.299)

#: Red, green and blue of a value from 0 to 1, before they are cut to that range;
#: fixed values, as the established colour maps define them.
SHADES = {
    "viridis": lambda t: (1.0 - t, t, 0.5 + 0.5 * t),
    "plasma": lambda t: (t, 1.0 - t, 1.0 - 0.5 * t),
    "magma": lambda t: (t, t * t, 1.0 - t),
    "hot": lambda t: (3.0 * t, 3.0 * t - 1.0, 3.0 * t - 2.0),
}


def colour_of(value: Column, name: str = "gray") -> Column:
    """struct<r,g,b> of a value cut to 0..255; unknown names are grey."""
    whole = F.floor(clipped(value.cast("double"), 0.0, 255.0))
    if name not in SHADES:
        channels = [whole.cast("int")] * 3
    else:
        channels = [F.floor(clipped(c, 0.0, 1.0) * 255.0).cast("int") for c in SHADES[name](whole / F.lit(255.0))]
    return F.struct(*(c.alias(n) for c, n in zip(channels, "rgb", strict=True)))


def table_of(spark: SparkSession, name: str = "gray") -> DataFrame:
    values = spark.range(256).select(F.col("id").cast("int").alias("value"))
    return values.withColumn("colour", colour_of(F.col("value"), name)).select("value", "colour.r", "colour.g", "colour.b")


def luma(r: Column, g: Column, b: Column, whole: bool = True) -> Column:
    """The light of a colour, cut to a whole number unless told otherwise."""
    light = LUMA[0] * r + LUMA[1] * g + LUMA[2] * b
    return light.cast("int") if whole else light


def channel(b: Column, g: Column, r: Column, which: str = "grayscale") -> Column:
    """A plane of a blue-green-red image, or its grey value."""
    planes = {"B": b, "G": g, "R": r}
    if which in planes:
        return planes[which].cast("double")
    return F.rint(GREY[0] * b + GREY[1] * g + GREY[2] * r)
