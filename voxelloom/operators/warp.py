"""Non-linear warps as data: triangles of a section's markers, and displacement
fields; and the damage grid."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRIANGLES = "section_number int, ordinal int, " + ", ".join(f"{c}{i} double" for i in (0, 1, 2) for c in ("x", "y", "mx", "my"))
#: How far the frame around the markers reaches beyond the image, as a share.
FRAME = 0.1


@dataclass
class Mesh:
    """Marker positions in the image (sources) and where they belong (targets),
    and the triangles between the targets, oldest first."""

    source: np.ndarray
    target: np.ndarray
    triangles: list[tuple[int, int, int]]


def _in_circle(a: np.ndarray, b: np.ndarray, c: np.ndarray, p: np.ndarray) -> bool:
    """Whether p lies within the circle through a, b and c."""
    rows = np.array([[*(q - p), ((q - p) ** 2).sum()] for q in (a, b, c)])
    turn = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return bool(np.linalg.det(rows) * np.sign(turn) > 1e-9)


def triangulate(width: float, height: float, markers: list[list[float]]) -> Mesh:
    """Incremental Delaunay triangulation (Bowyer and Watson) of the markers'
    last two numbers, from a frame around the image that stays where it is."""
    low, far = (-FRAME * width, -FRAME * height), ((1 + FRAME) * width, (1 + FRAME) * height)
    corners = [(low[0], low[1]), (far[0], low[1]), (low[0], far[1]), (far[0], far[1])]
    source = [*corners, *((m[0], m[1]) for m in markers)]
    target = np.array([*corners, *((m[2], m[3]) for m in markers)], float)
    triangles = [(0, 1, 2), (1, 2, 3)]
    for i in range(4, len(target)):
        hit = [t for t in triangles if _in_circle(*target[list(t)], target[i])]
        edges: dict[tuple[int, int], int] = {}
        for a, b, c in hit:
            for edge in ((a, b), (b, c), (a, c)):
                key = (min(edge), max(edge))
                edges[key] = edges.get(key, 0) + 1
        triangles = [t for t in triangles if t not in hit]
        triangles += [(a, b, i) for (a, b), n in edges.items() if n == 1]
    return Mesh(np.array(source, float), target, triangles)


def triangle_table(spark: SparkSession, sections: list[dict]) -> DataFrame:
    """Triangles of sections (section_number, width, height, markers); x, y are
    the targets' corners and mx, my the sources'. Markers are tens a section."""
    rows = []
    for s in sections:
        if not s.get("markers"):
            continue
        mesh = triangulate(s["width"], s["height"], s["markers"])
        for n, t in enumerate(mesh.triangles):
            rows.append((int(s["section_number"]), n, *(float(v) for i in t for v in (*mesh.target[i], *mesh.source[i]))))
    return spark.createDataFrame(rows, TRIANGLES)


#: Cells along either axis of a section that its triangles are dealt to.
CELLS = 16


def _meshes(triangles: DataFrame, p: str, q: str) -> tuple[DataFrame, DataFrame]:
    """Per section the box of its triangles' corners; and per cell of that box the
    triangles that may reach into it, in order. Triangles are tens to hundreds a
    section."""
    low = [F.least(*(f"{c}{i}" for i in (0, 1, 2))) for c in (p, q)]
    high = [F.greatest(*(f"{c}{i}" for i in (0, 1, 2))) for c in (p, q)]
    boxes = triangles.groupBy("section_number").agg(*[F.min(c).alias(f"_{n}0") for c, n in zip(low, "xy", strict=True)], *[F.max(c).alias(f"_{n}1") for c, n in zip(high, "xy", strict=True)])
    found = triangles.join(boxes, "section_number")
    for n, a, b in zip("xy", low, high, strict=True):
        found = found.withColumn(f"_c{n}", F.explode(F.sequence(_cell(a, n), _cell(b, n))))
    corners = F.struct("ordinal", *[f"{c}{i}" for i in (0, 1, 2) for c in ("x", "y", "mx", "my")])
    return boxes, found.groupBy("section_number", "_cx", "_cy").agg(F.array_sort(F.collect_list(corners)).alias("_mesh"))


def _cell(value: Column, axis: str) -> Column:
    """The cell of a coordinate; -1 and CELLS stand for what lies beyond the box."""
    low, high = F.col(f"_{axis}0"), F.col(f"_{axis}1")
    share = (value - low) * CELLS / F.when(high > low, high - low)
    at = F.least(F.greatest(F.floor(F.coalesce(share, F.lit(0.0))), F.lit(0)), F.lit(CELLS - 1))
    return F.when(value < low, -1).when(value > high, CELLS).otherwise(at).cast("int")


def _barycentric(x: Column, y: Column, corners: Column, p: str, q: str) -> tuple[Column, Column]:
    """(u, v) of a point in the triangle with corners p0 q0, p1 q1, p2 q2."""
    x0, y0 = corners[f"{p}0"], corners[f"{q}0"]
    ax, ay = corners[f"{p}1"] - x0, corners[f"{q}1"] - y0
    bx, by = corners[f"{p}2"] - x0, corners[f"{q}2"] - y0
    area = ax * by - ay * bx
    safe = F.when(area != 0, area)
    return ((x - x0) * by - (y - y0) * bx) / safe, (ax * (y - y0) - ay * (x - x0)) / safe


def warp_points(points: DataFrame, triangles: DataFrame, x: str = "x", y: str = "y", forward: bool = False) -> DataFrame:
    """Adds wx, wy: the place in the first triangle that holds the point, mapped
    to the other corners; (0, 0) where none does, the point itself where the
    section has no triangles.

    A point meets the triangles of its own cell in one equi-join on section and
    cell, and tries them in order; no point is held against a whole mesh, and
    points are neither grouped nor joined back."""
    p, q, to_p, to_q = ("mx", "my", "x", "y") if forward else ("x", "y", "mx", "my")
    boxes, cells = _meshes(triangles, p, q)
    at = points.join(boxes, "section_number", "left")
    at = at.withColumns({"_cx": _cell(F.col(x), "x"), "_cy": _cell(F.col(y), "y")}).join(cells, ["section_number", "_cx", "_cy"], "left")

    def inside(corners: Column) -> Column:
        u, v = _barycentric(F.col(x), F.col(y), corners, p, q)
        return F.coalesce((u >= 0) & (u <= 1) & (v >= 0) & (v <= 1) & (u + v <= 1), F.lit(False))

    def moved(corners: Column) -> Column:
        u, v = _barycentric(F.col(x), F.col(y), corners, p, q)
        to = lambda c: corners[f"{c}0"] + u * (corners[f"{c}1"] - corners[f"{c}0"]) + v * (corners[f"{c}2"] - corners[f"{c}0"])
        return F.struct(to(to_p).alias("wx"), to(to_q).alias("wy"))

    still = F.struct(F.col(x).cast("double").alias("wx"), F.col(y).cast("double").alias("wy"))
    nowhere = F.struct(F.lit(0.0).alias("wx"), F.lit(0.0).alias("wy"))
    hit = F.get(F.transform(F.slice(F.filter("_mesh", inside), 1, 1), moved), F.lit(0))
    at = at.withColumn("_hit", F.when(F.col("_x0").isNull(), still).otherwise(F.coalesce(hit, nowhere)))
    return at.withColumns({"wx": F.col("_hit.wx"), "wy": F.col("_hit.wy")}).drop("_hit", "_mesh", "_cx", "_cy", "_x0", "_x1", "_y0", "_y1")


def displace(points: DataFrame, field: DataFrame, width: Column, height: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Adds wx, wy: the point plus (dx, dy) of its nearest field cell, cells
    (section_number, yi, xi) of a field of field_width x field_height."""
    sizes = field.groupBy("section_number").agg((F.max("xi") + 1).alias("_fw"), (F.max("yi") + 1).alias("_fh"))
    at = points.join(sizes, "section_number")
    sx, sy = F.col("_fw") / width, F.col("_fh") / height
    xi = F.least(F.greatest(F.rint(F.col(x) * sx), F.lit(0)), F.col("_fw") - 1).cast("int")
    yi = F.least(F.greatest(F.rint(F.col(y) * sy), F.lit(0)), F.col("_fh") - 1).cast("int")
    found = at.withColumns({"xi": xi, "yi": yi}).join(field.select("section_number", "yi", "xi", "dx", "dy"), ["section_number", "yi", "xi"], "left")
    dx, dy = F.coalesce("dx", F.lit(0.0)), F.coalesce("dy", F.lit(0.0))
    return found.withColumns({"wx": F.col(x) + dx / sx, "wy": F.col(y) + dy / sy}).drop("_fw", "_fh", "xi", "yi", "dx", "dy")


def invert_field(field: DataFrame) -> DataFrame:
    """The inverse of a displacement field, on the same cells: every cell sends
    minus its displacement to the cell it points at, the last in raster order
    wins, and cells that get none take the nearest one's (ties: first in raster
    order). Sections are independent; one section is one raster."""
    sizes = field.groupBy("section_number").agg((F.max("xi") + 1).alias("_w"), (F.max("yi") + 1).alias("_h"))
    at = field.join(sizes, "section_number")
    at = at.withColumns({"_x": F.rint(F.col("xi") + F.col("dx")).cast("int"), "_y": F.rint(F.col("yi") + F.col("dy")).cast("int")})
    landed = at.filter("_x >= 0 and _x < _w and _y >= 0 and _y < _h")
    order = F.col("yi") * F.col("_w") + F.col("xi")
    sent = landed.groupBy("section_number", F.col("_y").alias("yi"), F.col("_x").alias("xi")).agg(
        F.max(F.struct(order.alias("o"), (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"))).alias("_got")
    )
    cells = field.select("section_number", "yi", "xi").join(sent, ["section_number", "yi", "xi"], "left")
    cells = cells.select("section_number", "yi", "xi", F.col("_got.dx").alias("dx"), F.col("_got.dy").alias("dy"))

    def fill(section: pd.DataFrame) -> pd.DataFrame:
        section = section.sort_values(["yi", "xi"], ignore_index=True)
        values = section[["dx", "dy"]].to_numpy(float)
        known = np.zeros((section["yi"].max() + 1, section["xi"].max() + 1), bool)
        known[section["yi"], section["xi"]] = ~np.isnan(values[:, 0])
        if not known.any():
            values[:] = 0.0
        elif np.isnan(values[:, 0]).any():
            place = np.zeros(known.shape, np.int64)
            place[section["yi"], section["xi"]] = np.arange(len(section))
            near_y, near_x = nearest_known(known)
            holes = np.isnan(values[:, 0])
            y, x = section["yi"].to_numpy()[holes], section["xi"].to_numpy()[holes]
            values[holes] = values[place[near_y[y, x], near_x[y, x]]]
        return section.assign(dx=values[:, 0], dy=values[:, 1])

    schema = field.select("section_number", "yi", "xi", F.col("dx").cast("double"), F.col("dy").cast("double")).schema
    return cells.select("section_number", "yi", "xi", F.col("dx").cast("double"), F.col("dy").cast("double")).groupBy("section_number").applyInPandas(fill, schema)


#: Unknown cells that look at all columns together.
LOOKS = 4_000_000


def nearest_known(known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the known cell nearest to each cell, the first in raster
    order on a tie. Rings of neighbours settle most cells; the others look at the
    nearest known cell of each column."""
    height, width = known.shape
    rows, columns = np.indices(known.shape)
    near_y, near_x = np.where(known, rows, -1), np.where(known, columns, -1)
    y, x = np.nonzero(~known)
    reach = range(-4, 5)
    for dy, dx in sorted(((i, j) for i in reach for j in reach if 0 < i * i + j * j <= 16), key=lambda d: (d[0] ** 2 + d[1] ** 2, d)):
        inside = (y + dy >= 0) & (y + dy < height) & (x + dx >= 0) & (x + dx < width)
        hit = inside.copy()
        hit[inside] = known[y[inside] + dy, x[inside] + dx]
        near_y[y[hit], x[hit]], near_x[y[hit], x[hit]] = y[hit] + dy, x[hit] + dx
        y, x = y[~hit], x[~hit]
    if len(y):
        up = np.maximum.accumulate(np.where(known, rows, -(1 << 20)), 0)
        down = np.minimum.accumulate(np.where(known, rows, 1 << 20)[::-1], 0)[::-1]
        best = np.where(rows - up <= down - rows, up, down)
        for part in np.array_split(np.arange(len(y)), -(-len(y) * width // LOOKS)):
            at = best[y[part]].astype(np.int64)
            gap = (at - y[part, None]) ** 2 + (np.arange(width) - x[part, None]) ** 2
            tied = np.where(gap == gap.min(1, keepdims=True), at, 1 << 21)
            pick = tied.argmin(1)
            near_y[y[part], x[part]], near_x[y[part], x[part]] = at[np.arange(len(part)), pick], pick
    return near_y, near_x


@dataclass
class Warps:
    """What moves the sections' points: triangles of markers, or displacement
    fields (section_number, yi, xi, dx, dy) over the sections' images, which lead
    to cells of the registration. Rows to be moved hold width and height."""

    triangles: DataFrame | None = None
    fields: DataFrame | None = None
    inverse: DataFrame | None = None

    def move(self, points: DataFrame, x: str = "x", y: str = "y", forward: bool = False) -> DataFrame:
        """Adds wx, wy; sections without a warp stay as they are."""
        if self.triangles is not None:
            moved = warp_points(points, self.triangles, x, y, forward)
        else:
            moved = points.withColumns({"wx": F.col(x).cast("double"), "wy": F.col(y).cast("double")})
        field = self.inverse if forward else self.fields
        return moved if field is None else _displaced(moved, field, x, y)


def _displaced(points: DataFrame, field: DataFrame, x: str, y: str) -> DataFrame:
    """wx, wy anew where the section has a field: the place in the field's own
    cells plus the displacement of the nearest one."""
    sizes = field.groupBy("section_number").agg((F.max("xi") + 1).alias("_fw"), (F.max("yi") + 1).alias("_fh"))
    at = points.join(sizes, "section_number", "left")
    own = {"_px": F.col(x) * (F.col("_fw") / F.col("width").cast("double")), "_py": F.col(y) * (F.col("_fh") / F.col("height").cast("double"))}
    at = at.withColumns(own)
    cell = {c: F.least(F.greatest(F.rint(p), F.lit(0.0)), F.col(n) - 1).cast("int") for c, p, n in (("xi", "_px", "_fw"), ("yi", "_py", "_fh"))}
    found = at.withColumns(cell).join(field.select("section_number", "yi", "xi", "dx", "dy"), ["section_number", "yi", "xi"], "left")
    place = lambda p, d, old: F.when(F.col("_fw").isNotNull(), F.col(p) + F.coalesce(d, F.lit(0.0))).otherwise(F.col(old))
    found = found.withColumns({"wx": place("_px", "dx", "wx"), "wy": place("_py", "dy", "wy")})
    return found.drop("_fw", "_fh", "_px", "_py", "xi", "yi", "dx", "dy")


def inverse_fields(sections: DataFrame, field: DataFrame) -> DataFrame:
    """The way back of the sections' fields, on the cells of their registration."""
    grid = sections.select("section_number", "width", "height").join(field.select("section_number").distinct(), "section_number")
    grid = grid.withColumn("yi", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("xi", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    grid = grid.withColumns({"_gx": F.col("xi").cast("double"), "_gy": F.col("yi").cast("double"), "wx": F.lit(0.0), "wy": F.lit(0.0)})
    there = _displaced(grid.withColumnsRenamed({"xi": "_xi", "yi": "_yi"}), field, "_gx", "_gy")
    return invert_field(there.select("section_number", F.col("_yi").alias("yi"), F.col("_xi").alias("xi"), (F.col("wx") - F.col("_gx")).alias("dx"), (F.col("wy") - F.col("_gy")).alias("dy")))


def source_cells(grid: DataFrame) -> DataFrame:
    """Adds sx, sy: the cell a warped atlas slice cell is pulled from. grid has
    wx, wy in registration space, and the sizes of slice and registration."""
    sx = (F.col("wx") / (F.col("width") / F.col("map_width").cast("double"))).cast("int")
    sy = (F.col("wy") / (F.col("height") / F.col("map_height").cast("double"))).cast("int")
    return grid.withColumns({"sx": sx, "sy": sy})


def warp_raster(raster: DataFrame, grid: DataFrame) -> DataFrame:
    """Pulls labels (and hemi) of raster (section_number, y, x) to grid cells with
    source cells sx, sy; 0 outside."""
    values = [c for c in ("label", "hemi") if c in raster.columns]
    below = raster.select("section_number", F.col("y").alias("sy"), F.col("x").alias("sx"), *values)
    found = grid.drop(*values).join(below, ["section_number", "sy", "sx"], "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in values})


def damage_cells(sections: DataFrame) -> DataFrame:
    """Cells (row, col) of each section's damage grid with undamaged true or
    false. sections: width, height, plane_width, plane_height, grid (row-major,
    4 is damaged), gridx, gridy, grid_spacing; without spacing there is no mask."""
    spaced = sections.filter("grid_spacing is not null and grid is not null")
    for side, at, plane, n in (("width", "gridx", "plane_width", "_nx"), ("height", "gridy", "plane_height", "_ny")):
        step = F.greatest(F.lit(1), F.floor(F.col(side) * F.col("grid_spacing") / F.col(plane)).cast("int"))
        count = F.greatest(F.lit(0), F.ceil((F.col(side) - F.col(at)) / step).cast("int"))
        spaced = spaced.withColumn(n, count)
    spaced = spaced.filter("_nx > 0 and _ny > 0")
    cells = spaced.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_nx") * F.col("_ny") - 1)))
    value = F.get("grid", F.col("_i"))
    return cells.select(
        "section_number",
        F.floor(F.col("_i") / F.col("_nx")).cast("int").alias("row"),
        (F.col("_i") % F.col("_nx")).cast("int").alias("col"),
        F.coalesce(value != 4, F.lit(True)).alias("undamaged"),
        F.col("_nx").alias("mask_width"),
        F.col("_ny").alias("mask_height"),
    )


def flag_damage(points: DataFrame, cells: DataFrame, width: Column, height: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Adds undamaged by the mask stretched over the registration: coordinates
    are rounded half to even and held inside; true where a section has no mask."""
    sizes = cells.select("section_number", "mask_width", "mask_height").distinct()
    at = points.join(sizes, "section_number", "left")
    px = F.least(F.greatest(F.rint(F.col(x)), F.lit(0.0)), width - 1)
    py = F.least(F.greatest(F.rint(F.col(y)), F.lit(0.0)), height - 1)
    at = at.withColumns({"row": F.floor(py * F.col("mask_height") / height).cast("int"), "col": F.floor(px * F.col("mask_width") / width).cast("int")})
    found = at.join(cells.select("section_number", "row", "col", "undamaged"), ["section_number", "row", "col"], "left")
    return found.withColumn("undamaged", F.coalesce("undamaged", F.lit(True))).drop("row", "col", "mask_width", "mask_height")


