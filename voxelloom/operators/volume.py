"""Heat-map volumes: points gathered into voxels, value modes, and gaps filled
from the nearest covered voxels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable

MODES = ("pixel_count", "mean", "object_count")


def volume_shape(atlas: tuple[int, int, int], scale: float = 1.0) -> tuple[int, ...]:
    if scale <= 0:
        raise ValueError("scale must be above 0")
    return tuple(max(1, round(n * scale)) for n in atlas)


def voxelise(points: DataFrame, shape: tuple[int, ...], scale: float = 1.0) -> DataFrame:
    """Per voxel: freq, total value, objects (distinct by section and component)
    and damage (a section with a mask marked it). Points outside are left out.
    Absent columns value, component and undamaged count as 1, none and none."""
    at = {a: F.rint(F.col(a) * scale).cast("int") for a in "xyz"}
    has = set(points.columns)
    rows = points.select(
        *(c.alias(a) for a, c in at.items()),
        (F.col("value").cast("double") if "value" in has else F.lit(1.0)).alias("value"),
        (F.when(F.col("component") > 0, F.struct("section_number", "component")) if "component" in has else F.lit(None).cast("int")).alias("object"),
        (F.coalesce(F.col("undamaged"), F.lit(False)).cast("int") if "undamaged" in has else F.lit(0)).alias("damage"),
    )
    for a, n in zip("xyz", shape, strict=True):
        rows = rows.filter((F.col(a) >= 0) & (F.col(a) < n))
    sums = [F.count("*").alias("freq"), F.sum("value").alias("total"), F.max("damage").alias("damage")]
    if "component" in has:
        return rows.groupBy("x", "y", "z").agg(*sums, F.count_distinct("object").alias("objects"))
    return rows.groupBy("x", "y", "z").agg(*sums, F.lit(0).cast("long").alias("objects"))


def value_of(mode: str) -> Column:
    if mode not in MODES:
        raise ValueError(f"a value mode is one of {MODES}, not {mode!r}")
    modes = {
        "pixel_count": F.col("total"),
        "mean": F.col("total") / F.col("freq"),
        "object_count": F.col("objects").cast("double"),
    }
    return modes[mode]


def with_values(voxels: DataFrame, mode: str = "pixel_count") -> DataFrame:
    return voxels.withColumn("value", value_of(mode))


def in_atlas(voxels: DataFrame, atlas: DataFrame) -> DataFrame:
    """Voxels of the atlas, where its label is not 0."""
    return voxels.join(atlas.filter("label <> 0").select("x", "y", "z"), ["x", "y", "z"], "left_semi")


def _span(known: DataFrame, targets: DataFrame) -> tuple[int, int]:
    """The longest side of the box around both, and how many voxels are known."""
    bounds = lambda names: [f(c) for c in names for f in (F.min, F.max)]
    *a, n = known.agg(*bounds(("_x", "_y", "_z")), F.count("*")).first()
    b = targets.agg(*bounds("xyz")).first()
    if a[0] is None or b[0] is None:
        return 1, n
    return 1 + max(max(a[i + 1], b[i + 1]) - min(a[i], b[i]) for i in (0, 2, 4)), n


def fill_nearest(targets: DataFrame, covered: DataFrame, k: int = 5, value: str = "value", edge: int | None = None,
                 how: str = "mean") -> DataFrame:
    """Each target voxel's value from its k nearest covered voxels (mean or
    max), ties by x, y, z; all of them where there are fewer than k."""
    return fill_all(targets, covered, {value: how}, k, edge)


def fill_all(targets: DataFrame, covered: DataFrame, values: dict[str, str], k: int = 5, edge: int | None = None) -> DataFrame:
    """fill_nearest of several columns, each with its own mean or max, from one
    search.

    Covered voxels are dealt into cubes. A target looks at the cubes around its
    own; its k nearest are certain once the k-th is no farther than the edge of
    what it looked at. Targets that are not certain look again with cubes twice
    as large, until a cube spans everything. Each round is an equi-join, and its
    outcome is stored, so that no round is computed twice."""
    held = [F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(values)]
    known = durable(covered.select(*(F.col(a).cast("int").alias(f"_{a}") for a in "xyz"), *held))
    left = durable(targets.select("x", "y", "z").distinct())
    span, n = _span(known, left)
    if edge is None:  # so that most targets have k voxels within an edge
        edge = max(1, math.ceil((k * span**3 / (2 * max(n, 1))) ** (1 / 3)))
    done = None
    while True:
        whole = edge >= span
        cubes = known.withColumns({f"_c{a}": F.floor(F.col(f"_{a}") / float(edge)) for a in "xyz"})
        around = F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip("xyz", (i, j, m), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for m in (-1, 0, 1)])
        looks = left.withColumn("_d", F.explode(around)).withColumns({f"_c{a}": F.floor(F.col(a) / float(edge)) + F.col(f"_d.{a}") for a in "xyz"})
        pairs = looks.join(cubes, ["_cx", "_cy", "_cz"])
        gap = sum(((F.col(a) - F.col(f"_{a}")).cast("long") * (F.col(a) - F.col(f"_{a}")) for a in "xyz"), F.lit(0).cast("long"))
        place = F.row_number().over(Window.partitionBy("x", "y", "z").orderBy("_gap", "_x", "_y", "_z"))
        near = pairs.withColumn("_gap", gap).withColumn("_place", place).filter(F.col("_place") <= k)
        found = [(F.avg if how == "mean" else F.max)(f"_v{i}").alias(c) for i, (c, how) in enumerate(values.items())]
        best = near.groupBy("x", "y", "z").agg(*found, F.count("*").alias("_n"), F.max("_gap").alias("_far"))
        # what lies beyond the cubes looked at is more than one edge away
        certain = best if whole else best.filter((F.col("_n") == k) & (F.col("_far") <= edge * edge))
        got = durable(certain.select("x", "y", "z", *values))
        done = got if done is None else done.unionByName(got)
        if whole:
            return done
        left = durable(left.join(got.select("x", "y", "z"), ["x", "y", "z"], "left_anti"))
        if left.isEmpty():
            return done
        edge *= 2


def finish(voxels: DataFrame, grid: DataFrame, interpolate: bool = True, k: int = 5, missing: float = float("nan"), mode: str = "pixel_count") -> DataFrame:
    """All grid voxels with value, freq and damage. With interpolation every
    value is the mean of its k nearest covered voxels and damage their largest
    above 0; without, uncovered voxels get `missing`."""
    covered = with_values(voxels, mode)
    found = grid.select("x", "y", "z").join(covered, ["x", "y", "z"], "left")
    if not interpolate:
        return found.select("x", "y", "z", F.coalesce("value", F.lit(missing)).alias("value"), F.coalesce("freq", F.lit(0)).alias("freq"), F.coalesce("damage", F.lit(0)).alias("damage"))
    near = fill_all(grid, covered.withColumnRenamed("damage", "_damage"), {"value": "mean", "_damage": "max"}, k)
    found = found.select("x", "y", "z", F.coalesce("freq", F.lit(0)).alias("freq")).join(near, ["x", "y", "z"], "left")
    return found.select("x", "y", "z", F.coalesce("value", F.lit(missing)).alias("value"), "freq", (F.coalesce("_damage", F.lit(0.0)) > 0).cast("int").alias("damage"))
