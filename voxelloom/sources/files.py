"""Image folders: which files are images, and which section each one shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed list of image endings.
ENDINGS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "dzip")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def section_number(name: Column) -> Column:
    """The last number after `_s`, or else after `_`; an error without either."""
    base = file_name(name)
    strong = F.element_at(F.nullif(F.regexp_extract_all(base, F.lit(r"_s(\d+)"), F.lit(1)), F.array().cast("array<string>")), -1)
    weak = F.element_at(F.nullif(F.regexp_extract_all(base, F.lit(r"_(\d+)"), F.lit(1)), F.array().cast("array<string>")), -1)
    missing = F.raise_error(F.concat(F.lit("no section number in file name: "), base)).cast("int")
    return F.coalesce(strong.cast("int"), weak.cast("int"), missing)


def is_image(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin(*ENDINGS)


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content and section_number of a folder's images, not of folders
    below. An empty folder is an error."""
    files = spark.read.format("binaryFile").load(folder).filter(is_image(F.col("path")))
    if files.select("path").isEmpty():
        raise ValueError(f"no images in {folder}")
    return files.select("path", "content", section_number(F.col("path")).alias("section_number"))


def index_by_stem(files: DataFrame) -> DataFrame:
    """One path per file name without its ending, by the order of endings."""
    name = file_name(F.col("path"))
    ending = F.lower(F.element_at(F.split(name, r"\."), -1))
    priority = F.array_position(F.array(*map(F.lit, ("png", "tif", "tiff", "jpg", "jpeg"))), ending)
    ranked = files.withColumn("stem", F.regexp_replace(name, r"\.[^.]*$", "")).withColumn("_p", F.when(priority > 0, priority))
    return ranked.filter("_p is not null").groupBy("stem").agg(F.min_by("path", F.struct("_p", "path")).alias("path"))
