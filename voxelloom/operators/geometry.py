"""Coordinate spaces: scaling, affine planes, orientation, cell lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable

INTERNAL = "lpi"
AXES = {"l": "lr", "r": "lr", "s": "si", "i": "si", "a": "ap", "p": "ap"}
PLANE = ("ox", "oy", "oz", "ux", "uy", "uz", "vx", "vy", "vz")


def scaled(value: Column, size: Column, registered: Column) -> Column:
    """An image coordinate in registration space."""
    return value * registered / size


def norm(*parts: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (p * p for p in parts)))


def plane_size(prefix: str) -> Column:
    """Cells of an atlas slice along u or v."""
    return (F.floor(norm(*(F.col(prefix + a) for a in "xyz"))) + 1).cast("int")


def to_atlas(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Adds ax, ay, az = o + x/width u + y/height v; rows hold the plane."""
    s, t = F.col(x) / F.col("width"), F.col(y) / F.col("height")
    return points.select("*", *[(F.col(f"o{a}") + s * F.col(f"u{a}") + t * F.col(f"v{a}")).alias(f"a{a}") for a in "xyz"])


def check_orientation(code: str) -> str:
    found = code.lower() if isinstance(code, str) else ""
    if len(found) != 3:
        raise ValueError(f"an orientation has three letters, not {code!r}")
    if any(c not in AXES for c in found):
        raise ValueError(f"an orientation is made of l, r, s, i, a and p, not {code!r}")
    if len({AXES[c] for c in found}) != 3:
        raise ValueError(f"an orientation names each axis once, not {code!r}")
    return found


def axis_map(source: str, target: str) -> list[tuple[int, bool]]:
    """For each target axis, the source axis and whether it is flipped."""
    source, target = check_orientation(source), check_orientation(target)
    kinds = [AXES[c] for c in source]
    return [(kinds.index(AXES[c]), source[kinds.index(AXES[c])] != c) for c in target]


def shape_in(shape: tuple[int, int, int], target: str, source: str = INTERNAL) -> tuple[int, ...]:
    return tuple(shape[axis] for axis, _ in axis_map(source, target))


def reorient(points: DataFrame, shape: tuple[int, int, int], target: str, source: str = INTERNAL,
             columns: tuple[str, str, str] = ("x", "y", "z"), flip_offset: int = 0) -> DataFrame:
    """Points of a volume of `shape` in another orientation. A flipped coordinate
    becomes shape - flip_offset - p: 0 for points, 1 for voxels."""
    moved = []
    for name, (axis, flipped) in zip(columns, axis_map(source, target), strict=True):
        old = F.col(columns[axis])
        moved.append(((shape[axis] - flip_offset) - old if flipped else old).alias(name))
    return points.select(*[c for c in points.columns if c not in columns], *moved)


def reorient_raw(voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """A raw volume's voxels in internal orientation: axes 2, 0, 1, all flipped."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return voxels.withColumns({"x": shape[2] - 1 - z, "y": shape[0] - 1 - x, "z": shape[1] - 1 - y})


def floor_cell(value: Column, registered: Column, cells: Column) -> Column:
    """The map cell of a point: ratio (cells-1)/(registered-1), rounded down."""
    return F.floor(value * (cells - 1) / F.when(registered > 1, registered - 1).otherwise(1))


def nearest_cell(value: Column, registered: Column, cells: Column) -> Column:
    """The map cell of an object's pixel: ratio cells/registered, half to even."""
    return F.rint(value * cells / registered).cast("long")


def resized_cell(cell: Column, source: Column, target: Column) -> Column:
    """The source cell of a target cell of a nearest-neighbour resize."""
    return F.least(F.floor(cell * source / target), source - 1)


def lookup_labels(points: DataFrame, raster: DataFrame, row: Column, col: Column, hemi: bool = False) -> DataFrame:
    """Adds label (and hemi) of the raster cell (section_number, y, x) that each
    point falls into; 0 outside."""
    cells = raster.select(
        "section_number", F.col("y").alias("_row"), F.col("x").alias("_col"), F.col("label").alias("_label"), *([F.col("hemi").alias("_hemi")] if hemi else [])
    )
    at = points.withColumns({"_row": row.cast("long"), "_col": col.cast("long")})
    found = at.join(cells, ["section_number", "_row", "_col"], "left")
    found = found.withColumn("label", F.coalesce("_label", F.lit(0)).cast("long"))
    if hemi:
        found = found.withColumn("hemi", F.coalesce("_hemi", F.lit(0)).cast("int"))
    return found.drop("_row", "_col", "_label", "_hemi")


def map_sizes(sections: DataFrame) -> DataFrame:
    return sections.select("section_number", plane_size("u").alias("map_width"), plane_size("v").alias("map_height"))


def voxel_below(x: Column, y: Column) -> list[Column]:
    """The voxel lx, ly, lz below cell (x, y) of a row that holds a plane and its
    map's size."""
    s, t = x / F.col("map_width").cast("double"), y / F.col("map_height").cast("double")
    return [F.floor(F.col(f"o{a}") + F.col(f"v{a}") * t + F.col(f"u{a}") * s).cast("int").alias(f"l{a}") for a in "xyz"]


def with_voxels(rows: DataFrame, voxels: DataFrame) -> DataFrame:
    """Label (and hemi) of the voxel lx, ly, lz of each row; 0 outside."""
    values = [c for c in ("label", "hemi") if c in voxels.columns]
    below = voxels.select(*(F.col(a).alias(f"l{a}") for a in "xyz"), *values)
    found = rows.drop(*values).join(below, ["lx", "ly", "lz"], "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0)).cast("long" if c == "label" else "int") for c in values})


def needed_voxels(voxels: DataFrame, *cells: DataFrame) -> DataFrame:
    """Those voxels that tables of cells (lx, ly, lz) name, stored: a volume is
    read and shuffled once for all of them."""
    wanted = reduce(lambda a, b: a.unionByName(b), (c.select("lx", "ly", "lz") for c in cells))
    wanted = wanted.filter("lx is not null and ly is not null and lz is not null").distinct()
    return durable(voxels.join(wanted.toDF("x", "y", "z"), ["x", "y", "z"], "left_semi"))


def slice_grid(sections: DataFrame) -> DataFrame:
    """Every cell (x, y) of each section's atlas slice with the voxel below it."""
    grid = sections.withColumns({"map_width": plane_size("u"), "map_height": plane_size("v")})
    grid = grid.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("map_height") - 1)))
    grid = grid.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("map_width") - 1)))
    return grid.select("section_number", "map_width", "map_height", "y", "x", *voxel_below(F.col("x"), F.col("y")))


def slice_atlas(sections: DataFrame, voxels: DataFrame) -> DataFrame:
    """Label and hemi of every cell of each section's slice; 0 outside."""
    return with_voxels(slice_grid(sections), voxels)
