"""Reports, point clouds, volumes and pictures, in any store that Arrow opens.

Clouds are grouped by Spark and streamed to one file part by part, volumes slab
by slab; a report is as large as the label table."""

from __future__ import annotations

import gzip
import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colours import colour_of, luma
from ..functions.numeric import scale_to_u8
from ..model import Extraction
from ..operators.geometry import INTERNAL, reorient
from ..sources.rasters import ENCODERS, encode_png, ending
from ..storage import durable, located, write_bytes

#: Clouds of more colours than this are drawn in steps of eight.
MOST_COLOURS = 1024
#: Points of a part of a cloud.
PART = 100_000
#: Voxels of a slab that the driver holds at a time.
SLAB = 64_000_000


def write_report(table: DataFrame, path: str) -> None:
    """One file, `;` between columns, in the label table's order."""
    order = [F.col("label_ordinal").asc_nulls_last()] if "label_ordinal" in table.columns else []
    rows = table.orderBy(*order, "idx") if "idx" in table.columns else table
    write_bytes(path, rows.drop("label_ordinal").toPandas().to_csv(sep=";", index=False, na_rep="").encode())


def _clouds(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points grouped by keys in parts of about PART points: keys, part, count (of
    the whole group) and flat triplets. No group is gathered as a whole, also not
    one whose points coincide: points are dealt by where they stand as well."""
    sizes = points.groupBy(*keys).agg(F.count("*").alias("count"))
    parts = F.ceil(F.col("count") / PART).cast("int")
    placed = points.select(*keys, "x", "y", "z", F.monotonically_increasing_id().alias("_at"))
    dealt = placed.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("x", "y", "z", "_at"), parts).cast("int"))
    spots = F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "z"))), lambda p: F.array(p["x"], p["y"], p["z"]))
    return dealt.groupBy(*keys, "part").agg(F.first("count").alias("count"), F.flatten(spots).alias("triplets"))


def region_clouds(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows per known region: idx (its place among all labels of points), part,
    count, name, colour and flat triplets."""
    order = points.select("label").distinct().withColumn("idx", F.dense_rank().over(Window.orderBy("label")) - 1)
    known = labels.select(F.col("idx").alias("label"), "name", "r", "g", "b")
    found = _clouds(points, ["label"]).join(order, "label").join(known, "label")
    return found.select("idx", "part", "count", "name", "triplets", "r", "g", "b")


def rgb_clouds(points: DataFrame) -> DataFrame:
    """Grouped by colour; steps of eight where there are too many colours."""
    n = points.select("r", "g", "b").distinct().limit(MOST_COLOURS + 1).count()
    rows = points
    if n > MOST_COLOURS:
        rows = points.withColumns({c: F.least(F.rint(F.col(c) / 8.0) * 8, F.lit(255.0)).cast("int") for c in "rgb"})
    name = F.format_string("Color %d,%d,%d", "r", "g", "b")
    # one row per colour, at most 1024 or 33 to the third
    order = rows.select("r", "g", "b").distinct().withColumn("idx", F.dense_rank().over(Window.orderBy("r", "g", "b")) - 1)
    found = _clouds(rows, ["r", "g", "b"]).join(order, ["r", "g", "b"])
    return found.select("idx", "part", "count", name.alias("name"), "triplets", "r", "g", "b")


def scalar_clouds(points: DataFrame, colormap: str = "gray") -> DataFrame:
    """Grouped by whole intensity, coloured by a colour map."""
    value = F.col("value").cast("int") if "value" in points.columns else luma(F.col("r"), F.col("g"), F.col("b"))
    found = _clouds(points.withColumn("idx", value), ["idx"]).withColumn("_c", colour_of(F.col("idx"), colormap))
    return found.select("idx", "part", "count", F.format_string("Intensity %d", "idx").alias("name"), "triplets", "_c.r", "_c.g", "_c.b")


def write_clouds(clouds: DataFrame, path: str) -> None:
    """A JSON list of groups; one part of one group is in the driver at a time."""
    system, place = located(path)
    if "/" in place:
        system.create_dir(place.rsplit("/", 1)[0])
    with system.open_output_stream(place, compression=None) as file:
        file.write(b"[")
        group = None
        for row in clouds.orderBy("idx", "part").toLocalIterator():
            if row["idx"] != group:
                head = {c: row[c] for c in ("idx", "count", "name", "r", "g", "b")}
                file.write((("" if group is None else "]},") + json.dumps(head)[:-1] + ', "triplets": [').encode())
                group, mark = row["idx"], ""
            file.write((mark + json.dumps(row["triplets"])[1:-1]).encode())
            mark = ", "
        file.write(b"]" if group is None else b"]}]")


def write_region_clouds(points: DataFrame, labels: DataFrame, folder: str, name: str, split: bool = True) -> None:
    """All points, and each hemisphere's where there are hemispheres."""
    if split and "hemi" in points.columns:
        for side, prefix in ((1, "left_hemisphere_"), (2, "right_hemisphere_")):
            write_clouds(region_clouds(points.filter(F.col("hemi") == side), labels), f"{folder}/{prefix}{name}")
    write_clouds(region_clouds(points, labels), f"{folder}/{name}")


def save_analysis(folder: str, result: Extraction, labels: DataFrame, table: DataFrame | None = None, colormap: str = "gray",
                  settings: dict | None = None) -> None:
    """Report, settings and clouds of undamaged points in internal orientation.
    A table with `original_idx` gets that as its idx."""

    def inner(points: DataFrame) -> DataFrame:
        kept = points.filter(F.coalesce("undamaged", F.lit(True))) if "undamaged" in points.columns else points
        shape = result.shape if result.orientation == INTERNAL else _turned(result)
        return reorient(kept, shape, INTERNAL, result.orientation)

    if table is not None:
        if "original_idx" in table.columns:
            table = table.withColumn("idx", F.col("original_idx")).drop("original_idx")
        kind = "intensity" if result.intensities is not None else "counts"
        write_report(table, f"{folder}/whole_series_report/{kind}.csv")
    if settings is not None:
        write_bytes(f"{folder}/settings.json", json.dumps(settings, indent=2).encode())
    clouds = f"{folder}/whole_series_clouds"
    points = durable(inner(result.points))  # written once, read by each cloud
    if result.intensities is not None:
        split = [("", points), *([(f"{n}_hemisphere_", points.filter(F.col("hemi") == i)) for i, n in ((1, "left"), (2, "right"))] if result.with_hemi else [])]
        for prefix, rows in split:
            found = rgb_clouds(rows) if colormap == "original_colours" and "r" in rows.columns else scalar_clouds(rows, colormap)
            write_clouds(found, f"{clouds}/{prefix}pixels_cloud.json")
        return
    write_region_clouds(points, labels, clouds, "pixels_cloud.json", result.with_hemi)
    if result.objects is not None:
        marks = points if result.objects is result.points else durable(inner(result.objects))
        write_region_clouds(marks, labels, clouds, "objects_cloud.json", result.with_hemi)


def _turned(result: Extraction) -> tuple[int, int, int]:
    from ..operators.geometry import shape_in

    return shape_in(result.shape, result.orientation)


def slabs(voxels: DataFrame, shape: tuple[int, ...], value: str, kind: str = "uint8", most: int = SLAB) -> Iterator[np.ndarray]:
    """A volume as arrays of whole layers of its last axis, one after another, of
    at most `most` voxels unless a layer has more. The voxels are stored by layer
    first, so that each slab reads its own."""
    step = max(1, most // max(1, shape[0] * shape[1]))
    rows = voxels.select("x", "y", "z", value)
    if step < shape[2]:
        rows = durable(rows.repartitionByRange("z").sortWithinPartitions("z"))
    for low in range(0, shape[2], step):
        out = np.zeros((*shape[:2], min(step, shape[2] - low)), kind)
        part = rows.filter(F.col("z").between(low, low + step - 1)).toPandas()
        out[part["x"], part["y"], part["z"] - low] = part[value]
        yield out


def dense(voxels: DataFrame, shape: tuple[int, ...], value: str, kind: str = "uint8") -> np.ndarray:
    """A volume as one array, for volumes that the driver can hold."""
    return np.concatenate(list(slabs(voxels, shape, value, kind)), axis=2)


def isotropic_size(base_um: float, atlas: tuple[int, ...] | None, volume: tuple[int, ...]) -> float:
    """The volume's voxel size: the middle one of the three axes' ratios."""
    if atlas is None or min(volume) <= 0:
        return float(base_um)
    return float(base_um * np.median([a / v for a, v in zip(atlas, volume, strict=True)]))


def nifti_header(shape: tuple[int, ...], size_um: float) -> bytes:
    """A NIfTI-1 header of an unsigned byte volume, centred, in micrometres."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<hh", head, 70, 2, 8)
    struct.pack_into("<8f", head, 76, 1.0, size_um, size_um, size_um, 1, 1, 1, 1)
    struct.pack_into("<f", head, 108, 352.0)
    struct.pack_into("<f", head, 112, 1.0)
    head[123] = 3
    struct.pack_into("<hh", head, 252, 1, 1)
    origin = [-0.5 * n * size_um for n in shape]
    struct.pack_into("<6f", head, 256, 0, 0, 0, *origin)
    for i in range(3):
        struct.pack_into("<4f", head, 280 + 16 * i, *[size_um if i == j else 0.0 for j in range(3)], origin[i])
    head[344:348] = b"n+1\0"
    return bytes(head)


def write_nifti(volume: np.ndarray | Iterator[np.ndarray], size_um: float, path: str, shape: tuple[int, ...] | None = None) -> None:
    """A volume, or its slabs along the last axis with the whole shape."""
    parts = [volume] if isinstance(volume, np.ndarray) else volume
    system, place = located(path if path.endswith(".nii.gz") else f"{path}.nii.gz")
    if "/" in place:
        system.create_dir(place.rsplit("/", 1)[0])
    with system.open_output_stream(place, compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=6) as file:
        file.write(nifti_header(shape or volume.shape, size_um))
        for part in parts:
            file.write(np.asarray(part, np.uint8).tobytes(order="F"))


def read_nifti(path: str) -> tuple[np.ndarray, float]:
    """The bytes and the voxel size of a volume that write_nifti has written."""
    system, place = located(path)
    with system.open_input_stream(place, compression=None) as file:
        raw = gzip.GzipFile(fileobj=io.BytesIO(file.read())).read()
    shape = struct.unpack("<8h", raw[40:56])[1:4]
    return np.frombuffer(raw, np.uint8, offset=352).reshape(shape, order="F"), struct.unpack("<f", raw[80:84])[0]


def save_volumes(folder: str, voxels: DataFrame, shape: tuple[int, ...], voxel_um: float, atlas: tuple[int, ...] | None = None,
                 damage: bool = False) -> None:
    """value, freq and maybe damage scaled to bytes, one NIfTI file each."""
    size = isotropic_size(voxel_um, atlas, shape)
    names = {"value": "interpolated_volume", "freq": "frequency_volume", **({"damage": "damage_volume"} if damage else {})}
    for column, name in names.items():
        write_nifti(slabs(scale_to_u8(voxels, column), shape, "u8"), size, f"{folder}/interpolated_volume/{name}", shape)


def write_sections(pixels: DataFrame, folder: str, name: str = "section_%03d.png") -> DataFrame:
    """Writes each section's pixels (section_number, height, width, y, x and c0, or
    b, g, r as c0, c1, c2) as a file of 8 bits, or of 16 where grey needs them, in
    the format that the name's ending says; colour as PNG. Rows (section_number,
    path)."""
    encode = ENCODERS[ending(name)]

    def write(section: pd.DataFrame) -> pd.DataFrame:
        number, grey = int(section["section_number"].iloc[0]), section["c1"].isna().all()
        size = (int(section["height"].iloc[0]), int(section["width"].iloc[0]))
        planes = section[["c0"]] if grey else section[["c2", "c1", "c0"]]
        image = np.zeros((*size, planes.shape[1]), np.uint16 if grey and section["c0"].max() > 255 else np.uint8)
        image[section["y"], section["x"]] = planes
        path = f"{folder}/{name % number}"
        write_bytes(path, encode(image[:, :, 0] if grey else image))
        return pd.DataFrame({"section_number": [number], "path": [path]})

    rows = pixels if "c1" in pixels.columns else pixels.withColumns({c: F.lit(None).cast("int") for c in ("c1", "c2")})
    return rows.select("section_number", "height", "width", "y", "x", "c0", "c1", "c2").groupBy("section_number").applyInPandas(write, "section_number int, path string")


def section_pictures(slices: DataFrame, labels: DataFrame, folder: str, overlay: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Writes a PNG of each coloured atlas slice (section_number, y, x, label), the
    colours inverted where overlay has pixels. 0 is black and unknown labels are
    grey. names gives sections a file name other than section_<n>_atlas.png. Rows
    (section_number, path, error): an error in one section leaves the others
    alone. folder must be shared."""
    colours = labels.select(F.col("idx").alias("label"), "r", "g", "b")
    rows = slices.select("section_number", "y", "x", "label").join(colours, "label", "left")
    shade = lambda c: F.when(F.col("label") == 0, 0).otherwise(F.coalesce(c, F.lit(128)))
    rows = rows.withColumns({c: shade(c).cast("int") for c in "rgb"})
    if overlay is not None:
        marks = overlay.select("section_number", "y", "x").distinct().withColumn("_m", F.lit(True))
        rows = rows.join(marks, ["section_number", "y", "x"], "left")
        rows = rows.withColumns({c: F.when(F.col("_m"), 255 - F.col(c)).otherwise(F.col(c)) for c in "rgb"}).drop("_m")
    usual = F.format_string("section_%03d_atlas.png", "section_number")
    if names is None:
        rows = rows.withColumn("name", usual)
    else:
        rows = rows.join(names.select("section_number", "name"), "section_number", "left").withColumn("name", F.coalesce("name", usual))

    def write(section: pd.DataFrame) -> pd.DataFrame:
        number, error = int(section["section_number"].iloc[0]), None
        path = f"{folder}/{section['name'].iloc[0]}"
        try:
            image = np.zeros((section["y"].max() + 1, section["x"].max() + 1, 3), np.uint8)
            image[section["y"], section["x"]] = section[["r", "g", "b"]]
            write_bytes(path, encode_png(image))
        except OSError as failure:
            error = str(failure)
        return pd.DataFrame({"section_number": [number], "path": [path], "error": [error]})

    return rows.groupBy("section_number").applyInPandas(write, "section_number int, path string, error string")
