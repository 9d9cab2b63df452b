"""Registration files as a DataFrame with one row per section.

Two layouts of series files and single-section files with slice corners are
read, all through Spark, so that they may lie in any store that it reads; further
ones can be registered. Columns: section_number, section_id, width, height, the
nine plane numbers, markers, grid, gridx, gridy, grid_spacing, and field_folder,
where a section's displacement fields are."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.geometry import PLANE, norm

SECTIONS = (
    "ordinal int, section_number int, section_id string, width int, height int, anchoring array<double>, "
    "markers array<array<double>>, grid array<double>, gridx int, gridy int, grid_spacing int, field_folder string"
)
_SERIES = (
    "gridspacing int, slices array<struct<filename string, nr int, width int, height int, anchoring array<double>, "
    "markers array<array<double>>, grid array<double>, gridx int, gridy int>>, "
    "sections array<struct<filename string, snr int, width int, height int, ouv array<double>, markers array<array<double>>>>"
)


def number_in(name: str) -> int | None:
    """The last number after `_s` in a file name, or else after `_`."""
    base = os.path.basename(name)
    found = re.findall(r"_s(\d+)", base) or re.findall(r"_(\d+)", base)
    return int(found[-1]) if found else None


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Both series layouts: `slices` with `anchoring`, `sections` with `ouv`.
    Slices without a plane are left out; a missing number comes from the file
    name, or is 0."""
    whole = spark.read.schema(_SERIES).json(path, multiLine=True)
    of_slices = whole.select("gridspacing", F.posexplode("slices").alias("ordinal", "s")).select(
        "ordinal", F.col("s.nr").alias("nr"), "s.filename", "s.width", "s.height", "s.anchoring", "s.markers", "s.grid", "s.gridx", "s.gridy", "gridspacing"
    )
    of_sections = whole.select("gridspacing", F.posexplode("sections").alias("ordinal", "s")).select(
        "ordinal", F.lit(None).cast("int").alias("nr"), "s.filename", "s.width", "s.height", F.col("s.ouv").alias("anchoring"), "s.markers", "gridspacing"
    )
    every = of_slices.unionByName(of_sections, allowMissingColumns=True).filter("size(anchoring) = 9")
    name = F.element_at(F.split("filename", "/"), -1)
    strong, weak = (F.regexp_extract_all(name, F.lit(p), F.lit(1)) for p in (r"_s(\d+)", r"_(\d+)"))
    number = F.coalesce("nr", F.try_element_at(strong, F.lit(-1)).cast("int"), F.try_element_at(weak, F.lit(-1)).cast("int"), F.lit(0))
    return every.select(
        "ordinal", number.alias("section_number"), F.col("filename").alias("section_id"), "width", "height", "anchoring", "markers",
        "grid", "gridx", "gridy", F.col("gridspacing").alias("grid_spacing"), F.lit(None).cast("string").alias("field_folder"),
    )


def resolution_of(atlas: str) -> float:
    found = re.search(r"(\d+(?:\.\d+)?)um$", atlas)
    if not found:
        raise ValueError(f"the atlas name {atlas!r} does not end in a resolution like 25um")
    return float(found[1])


def plane_of_corners(corners: list[list[float]], resolution: float, shape: tuple[int, int, int]) -> list[float]:
    """The plane through a slice's corners (top left, top right, bottom left) in
    micrometres of the raw atlas, in internal axes."""
    raw = np.array(corners, float) / resolution
    inner = np.stack([shape[2] - 1 - raw[:, 2], shape[0] - 1 - raw[:, 0], shape[1] - 1 - raw[:, 1]], axis=1)
    return [*inner[0], *(inner[1] - inner[0]), *(inner[2] - inner[0])]


def _json(spark: SparkSession, path: str) -> object:
    """A small JSON file; None where it is broken."""
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    except ValueError:
        return None


def read_corners(spark: SparkSession, path: str, shape: tuple[int, int, int]) -> DataFrame:
    """A file of one section with `atlas_slice_corners`; shape is the raw atlas's.
    Displacement fields are looked for beside it."""
    found = _json(spark, path)
    plane = [float(v) for v in plane_of_corners(found["atlas_slice_corners"], resolution_of(found["atlas"]), shape)]
    number = number_in(found.get("moving_image") or "") or 0
    width, height = (int(np.sqrt(sum(v * v for v in plane[i : i + 3]))) + 1 for i in (3, 6))
    row = (0, number, str(number), width, height, plane, None, None, None, None, None, os.path.dirname(path) or ".")
    return spark.createDataFrame([row], SECTIONS)


def _has_corners(spark: SparkSession, path: str) -> bool:
    found = _json(spark, path) if path.endswith(".json") else None
    return isinstance(found, dict) and "atlas_slice_corners" in found


#: Fixed names of the files with displacements along y and x.
FIELDS = ("deformation_field_0.tiff", "deformation_field_1.tiff")


def read_fields(sections: DataFrame) -> DataFrame | None:
    """Rows (section_number, yi, xi, dx, dy) of the sections' displacement fields;
    None where no section has any, an error where a file is missing."""
    spark = sections.sparkSession
    folders = sections.filter("field_folder is not null").select("section_number", "field_folder").distinct().collect()
    if not folders:
        return None
    jvm, paths = spark._jvm, []
    for r in folders:
        for axis, name in enumerate(FIELDS):
            path = jvm.org.apache.hadoop.fs.Path(f"{r['field_folder']}/{name}")
            system = path.getFileSystem(spark._jsc.hadoopConfiguration())
            if not system.exists(path):
                raise FileNotFoundError(f"{name} is missing in {r['field_folder']}")
            paths.append((system.makeQualified(path).toString(), r["section_number"], axis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .rasters import decode_tiff

        for batch in batches:
            for content, number, axis in zip(*(batch.column(c) for c in ("content", "section_number", "axis")), strict=True):
                field = decode_tiff(content.as_py()).astype(float)
                flat, n = field.ravel(), field.size
                at = np.arange(n, dtype=np.int32)
                columns = [pa.array(np.full(n, number.as_py(), np.int32)), pa.array(at // field.shape[1]), pa.array(at % field.shape[1]), pa.array(np.full(n, axis.as_py(), np.int32)), pa.array(flat)]
                yield pa.RecordBatch.from_arrays(columns, names=["section_number", "yi", "xi", "axis", "v"])

    known = spark.createDataFrame(paths, "path string, section_number int, axis int")
    files = spark.read.format("binaryFile").load([p for p, *_ in paths]).select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), "content")
    files = files.join(known.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")), "path").select("content", "section_number", "axis")
    cells = files.mapInArrow(run, "section_number int, yi int, xi int, axis int, v double")
    along = lambda axis: F.max(F.when(F.col("axis") == axis, F.col("v")))
    return cells.groupBy("section_number", "yi", "xi").agg(along(1).alias("dx"), along(0).alias("dy"))


#: name: (whether it reads a path, reader); the first that does is used.
LOADERS: dict[str, tuple[Callable[[SparkSession, str], bool], Callable[..., DataFrame]]] = {
    "corners": (_has_corners, read_corners),
    "series": (lambda spark, path: path.endswith((".json", ".waln", ".wwrp")), lambda spark, path, shape=None: read_series(spark, path)),
}


def register_loader(name: str, reads: Callable[[SparkSession, str], bool], reader: Callable[..., DataFrame]) -> None:
    LOADERS[name] = (reads, reader)


def with_fields(folder: str) -> Callable[[DataFrame], DataFrame]:
    """A warp for read_registration: displacement fields from another folder."""
    return lambda sections: sections.withColumn("field_folder", F.lit(folder))


def last_of_each(sections: DataFrame) -> DataFrame:
    """Of sections with the same number the last one."""
    place = F.row_number().over(Window.partitionBy("section_number").orderBy(F.desc("ordinal")))
    return sections.withColumn("_p", place).filter("_p = 1").drop("_p")


def with_plane(sections: DataFrame) -> DataFrame:
    """The nine numbers as columns ox .. vz, and the plane's size in cells."""
    found = sections.withColumns({c: F.col("anchoring")[i] for i, c in enumerate(PLANE)})
    sizes = {n: (F.floor(norm(*(F.col(p + a) for a in "xyz"))) + 1).cast("int") for n, p in (("plane_width", "u"), ("plane_height", "v"))}
    return found.withColumns(sizes)


def read_registration(spark: SparkSession, path: str, loader: str | None = None, shape: tuple[int, int, int] | None = None,
                      with_warp: bool = True, with_damage: bool = True,
                      warp: Callable[[DataFrame], DataFrame] | None = None,
                      damage: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Sections of a registration file. warp and damage take the sections and
    replace markers, field folders or grids by others."""
    if loader is None:
        loader = next((n for n, (reads, _) in LOADERS.items() if reads(spark, path)), None)
    if loader not in LOADERS:
        raise ValueError(f"no loader reads {path}; there are {sorted(LOADERS)}")
    found = last_of_each(LOADERS[loader][1](spark, path, shape) if shape else LOADERS[loader][1](spark, path))
    if "field_folder" not in found.columns:
        found = found.withColumn("field_folder", F.lit(None).cast("string"))
    if warp:
        found = found.transform(warp)
    if damage:
        found = found.transform(damage)
    if not with_warp:
        found = found.withColumns({"markers": F.lit(None).cast("array<array<double>>"), "field_folder": F.lit(None).cast("string")})
    if not with_damage:
        found = found.withColumn("grid", F.lit(None).cast("array<double>"))
    return with_plane(found)
