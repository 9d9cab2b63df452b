"""Queries that go through files: inputs are written, read by the library's own
sources, run through an entry point or written by a sink, and read back. Their
SQL works on the tables that the files were made of."""

from __future__ import annotations

import io
import json
import zipfile
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, volume
from ..sinks import exports
from ..sources import atlases, files, rasters, registration, tables, volumes
from ..storage import scratch, write_bytes
from . import pipelines
from .fixtures import SHAPE, ctes, view
from .registry import _FOUND, _MARKERS, _PLACED, _SLICES, _VOXELS, _axes, _counts, _counts_cte, _fixture_atlas, _grid, _triangle_sql, _voxels, query

# --- rasters ------------------------------------------------------------------


def _written(spark: SparkSession, pixels: DataFrame, name: str) -> str:
    """A folder with a file of each section's pixels, 8 x 8."""
    folder = scratch(spark, "images")
    exports.write_sections(pixels.withColumns({"height": F.lit(8), "width": F.lit(8)}), folder, name).write.format("noop").mode("overwrite").save()
    return folder


def _grey(spark: SparkSession, sf: str, scale: int) -> DataFrame:
    return view(spark, sf, "fx_raster").select("section_number", "y", "x", F.floor(F.abs("v") * scale).cast("int").alias("c0"))


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return rasters.folder_pixels(spark, folder, files.image_files(spark, folder))


@query(f"{ctes('fx_raster')} select section_number, y, x, cast(floor(abs(v) * 200) as int) as c0 from fx_raster")
def png_file(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, _written(spark, _grey(spark, sf, 200), "grey_s%03d.png")).select("section_number", "y", "x", "c0")


@query(f"{ctes('fx_raster')} select section_number, y, x, cast(floor(abs(v) * 60000) as int) as c0 from fx_raster")
def tiff_file(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, _written(spark, _grey(spark, sf, 60_000), "label_s%03d.tif")).select("section_number", "y", "x", "c0")


@query(f"{ctes('fx_raster')} select section_number, y, x, cast(floor(abs(v) * 200) as int) as c0, cast(y * 30 as int) as c1, cast(x * 30 as int) as c2 from fx_raster")
def colour_file(spark: SparkSession, sf: str) -> DataFrame:
    rows = _grey(spark, sf, 200).withColumns({"c1": F.col("y") * 30, "c2": F.col("x") * 30})
    return _read(spark, _written(spark, rows, "rgb_s%03d.png")).select("section_number", "y", "x", "c0", "c1", "c2")


@query(f"{ctes('fx_raster')} select distinct section_number, 8 as seg_height, 8 as seg_width from fx_raster")
def image_headers(spark: SparkSession, sf: str) -> DataFrame:
    folder = _written(spark, _grey(spark, sf, 200), "grey_s%03d.png")
    return pipelines.section_sizes(files.image_files(spark, folder))


@query(f"{ctes('fx_raster')} select section_number, cast(floor(abs(v) * 9) as bigint) as label, cast(count(*) as bigint) as area from fx_raster group by 1, 2")
def run_length_file(spark: SparkSession, sf: str) -> DataFrame:
    folder = _written(spark, _grey(spark, sf, 9), "runs_s%03d.seg")
    found = spark.read.format("binaryFile").load(folder).select("path", "content", files.section_number(F.col("path")).alias("section_number"))
    return rasters.segrle_rows(found).groupBy("section_number", "label").agg(F.sum("length").alias("area"))


@query(f"{ctes('fx_raster')} select section_number, y, x, cast(floor(abs(v) * 60000) as int) as c0 from fx_raster")
def flat_file(spark: SparkSession, sf: str) -> DataFrame:
    folder = _written(spark, _grey(spark, sf, 60_000), "flat_s%03d.flat")
    found = spark.read.format("binaryFile").load(folder).select("path", "content", files.section_number(F.col("path")).alias("section_number"))
    return rasters.image_pixels(found).select("section_number", "y", "x", "c0")


@query(f"{ctes('fx_voxels')} select label, cast(count(*) as bigint) as n, cast(sum(x) as bigint) as xs, cast(sum(y) as bigint) as ys, cast(sum(z) as bigint) as zs from fx_voxels group by label")
def volume_file(spark: SparkSession, sf: str) -> DataFrame:
    x, y, z = np.indices(SHAPE, np.int32)
    path = f"{scratch(spark, 'volume')}/atlas.nrrd"
    volumes.write_nrrd(path, ((x // 10 * 7 + y // 10 * 3 + z // 8) % 160).astype(np.uint16))
    sums = [F.count("*").alias("n"), *[F.sum(a).alias(f"{a}s") for a in "xyz"]]
    return volumes.load_atlas(spark, path).groupBy("label").agg(*sums)


# --- tables and registrations -----------------------------------------------------


@query(ctes("fx_sections") + ", ".join(["select section_number", "width", "height", *geometry.PLANE]) + """,
    cast(floor(sqrt(ux*ux + uy*uy + uz*uz)) as int) + 1 as plane_width, cast(floor(sqrt(vx*vx + vy*vy + vz*vz)) as int) + 1 as plane_height from fx_sections""")  # fmt: skip
def series_file(spark: SparkSession, sf: str) -> DataFrame:
    found = registration.read_registration(spark, _series(spark, sf))
    return found.select("section_number", "width", "height", *geometry.PLANE, "plane_width", "plane_height")


def _series(spark: SparkSession, sf: str, markers: list | None = None) -> str:
    rows, more = view(spark, sf, "fx_sections").collect(), {"markers": markers} if markers else {}
    slices = [{"filename": f"m_s{r['section_number']:03d}.png", "nr": r["section_number"], "width": r["width"], "height": r["height"], "anchoring": [r[c] for c in geometry.PLANE], **more} for r in rows]
    path = f"{scratch(spark, 'series')}/series.json"
    write_bytes(path, json.dumps({"slices": slices}).encode())
    return path


@query("""select cast(n_nationkey as int) as section_number, cast(63 - n_nationkey as double) as ox, cast(109 as double) as oy, cast(74 as double) as oz,
    cast(-10 as double) as ux, cast(0 as double) as uy, cast(0 as double) as uz, cast(0 as double) as vx, cast(0 as double) as vy, cast(-20 as double) as vz, 11 as width, 21 as height from nation""")  # fmt: skip
def corner_files(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each of the sections."""
    folder, every = scratch(spark, "corners"), None
    for r in view(spark, sf, "fx_sections").select("section_number").collect():
        n, path = r[0], f"{folder}/{r[0]}.json"
        corners = [[0, 0, 25 * n], [0, 0, 25 * n + 250], [0, 500, 25 * n]]
        write_bytes(path, json.dumps({"atlas": "mouse_25um", "atlas_slice_corners": corners, "moving_image": f"x_s{n:03d}.tif"}).encode())
        found = registration.read_registration(spark, path, shape=SHAPE, with_warp=False)
        every = found if every is None else every.unionByName(found)
    return every.select("section_number", *geometry.PLANE, "width", "height")


_LABELS_SQL = ctes("fx_labels") + "select idx, name, r, g, b from fx_labels"


@query(_LABELS_SQL)
def label_file(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "labels")
    view(spark, sf, "fx_labels").coalesce(1).write.option("header", True).csv(folder)
    return tables.read_labels(spark, folder).select("idx", "name", "r", "g", "b")


@query(_LABELS_SQL)
def snap_label_file(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "labels")
    rows = view(spark, sf, "fx_labels").select(F.format_string('%d  %d %d %d  1 1 1 "%s"', "idx", "r", "g", "b", "name"))
    rows.write.text(folder)
    return tables.read_itksnap(spark, folder)


@query(ctes("fx_xy") + "select section_number, x, y, image_width, image_height from fx_xy")
def coordinate_file(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_coordinates(spark, _coordinates(spark, sf)).drop("ordinal")


def _coordinates(spark: SparkSession, sf: str) -> str:
    folder = scratch(spark, "coordinates")
    names = dict(zip(("x", "y", "image_width", "image_height", "section_number"), tables.COORDINATES, strict=True))
    view(spark, sf, "fx_xy").select(*[F.col(c).alias(n) for c, n in names.items()]).write.option("header", True).csv(folder)
    return folder


@query(
    ctes("fx_custom").replace("string", "varchar")
    + """select custom_id, custom_name, cast(custom_id * 9 as int) as r, cast(custom_id as int) as g, 7 as b, subregion_id from fx_custom
    union all select 0, 'unlabeled', 0, 0, 0, 0"""
)
def custom_region_file(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "fx_custom").orderBy("custom_id", "subregion_id").collect()
    names = {r["custom_id"]: r["custom_name"] for r in rows}
    columns = [[names[k], f"{k * 9};{k};7", *(str(r["subregion_id"]) for r in rows if r["custom_id"] == k)] for k in sorted(names)]
    lines = [["caption", "colour", *[""] * max(map(len, columns))], *columns]
    text = "\n".join("\t".join(line[i] if i < len(line) else "" for line in lines) for i in range(max(map(len, columns))))
    path = f"{scratch(spark, 'custom')}/regions.txt"
    write_bytes(path, text.encode())
    return tables.read_custom_regions(spark, path)


# --- sinks ----------------------------------------------------------------------


@query(f"{_counts_cte(True, True)} select idx, name, r, g, b, pixel_count, object_count, left_hemi_damaged_pixel_counts from named join counts on label = idx")
def report_file(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{scratch(spark, 'report')}/counts.csv"
    exports.write_report(_counts(spark, sf), path)
    names = ("idx", "name", "r", "g", "b", "pixel_count", "object_count", "left_hemi_damaged_pixel_counts")
    kinds = {"idx": "long", "name": "string", "r": "int", "g": "int", "b": "int"}
    return spark.read.option("header", True).option("sep", ";").csv(path).select(*[F.col(c).cast(kinds.get(c, "long")).alias(c) for c in names])


_SIDES = {"pixels_cloud.json": "true", "left_hemisphere_pixels_cloud.json": "hemi = 1", "right_hemisphere_pixels_cloud.json": "hemi = 2"}


@query(
    ctes("fx_points", "fx_labels")
    + " union all ".join(
        f"""select '{name}' as file, cast(place as bigint) as idx, name, cast(count(*) as bigint) as count, cast(3 * count(*) as bigint) as n_numbers,
        cast(sum(l_orderkey) as bigint) as xs, cast(sum(l_linenumber) as bigint) as ys, cast(sum(intensity) as bigint) as zs
        from (select *, dense_rank() over (order by label) - 1 as place from fx_points where {test}) join fx_labels l on l.idx = label group by place, name"""
        for name, test in _SIDES.items()
    )
)
def cloud_file(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "fx_points").select("label", "hemi", F.col("l_orderkey").alias("x"), F.col("l_linenumber").cast("long").alias("y"), F.col("intensity").alias("z"))
    folder = scratch(spark, "clouds")
    exports.write_region_clouds(rows, view(spark, sf, "fx_labels"), folder, "pixels_cloud.json")
    kind = "idx long, name string, count long, triplets array<long>"
    read = spark.read.schema(kind).option("multiLine", True).json(folder).select("*", files.file_name(F.col("_metadata.file_path")).alias("file"))
    along = lambda i: F.aggregate(F.filter("triplets", lambda v, k: k % 3 == i), F.lit(0).cast("long"), lambda a, v: a + v)
    return read.select("file", "idx", "name", "count", F.size("triplets").cast("long").alias("n_numbers"), along(0).alias("xs"), along(1).alias("ys"), along(2).alias("zs"))


@query(
    f"""{ctes('fx_xyz')}, {_VOXELS}, grid as (select cast(a.x as int) as x, cast(b.y as int) as y, cast(c.z as int) as z from range(20) a(x), range(16) b(y), range(12) c(z)),
    whole as (select g.*, coalesce(total, 0) as v from grid g left join vox using (x, y, z)), s as (select min(v) as lo, max(v) as hi from whole)
    select x, y, z, cast(round_even((v - lo) / (hi - lo) * 255, 0) as int) as u8, 12.5::double as size from whole, s"""
)
def nifti_file(spark: SparkSession, sf: str) -> DataFrame:
    rows = volume.finish(_voxels(spark, sf), _grid(spark), interpolate=False, missing=0.0)
    folder = scratch(spark, "nifti")
    exports.save_volumes(folder, rows, (20, 16, 12), 25.0, (10, 8, 6))
    found, size = exports.read_nifti(f"{folder}/interpolated_volume/interpolated_volume.nii.gz")
    x, y, z = (a.ravel().tolist() for a in np.indices(found.shape))
    cells = zip(x, y, z, found.ravel().tolist(), [size] * found.size, strict=True)
    return spark.createDataFrame(list(cells), "x int, y int, z int, u8 int, size double")


_OUT = """out as (select section_number, cast(b.y as int) as y, cast(a.x as int) as x, map_width, map_height from planes, range(125) a(x), range(37) b(y)),
    shown as (select o.section_number, o.y, o.x, m.label from out o join maps m on m.section_number = o.section_number
        and m.y = least(floor(o.y * o.map_height / 37.0::double), o.map_height - 1) and m.x = least(floor(o.x * o.map_width / 125.0::double), o.map_width - 1))"""


@query(
    f"""{ctes('fx_sections', 'fx_voxels', 'fx_labels')}, {_SLICES}, {_OUT}
    select section_number, case when label = 0 then 0 else coalesce(r, 128) end as r, case when label = 0 then 0 else coalesce(g, 128) end as g, case when label = 0 then 0 else coalesce(b, 128) end as b,
    cast(count(*) as bigint) as n, cast(sum(y) as bigint) as ys, cast(sum(x) as bigint) as xs from shown left join fx_labels l on l.idx = label group by 1, 2, 3, 4"""
)
def section_visual_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "visuals")
    sections = registration.read_registration(spark, _series(spark, sf))
    pipelines.section_visuals(spark, sections, _fixture_atlas(spark, sf), folder, None, 0.5).write.format("noop").mode("overwrite").save()
    cells = _read(spark, f"{folder}/visualisations")
    return cells.groupBy("section_number", F.col("c2").alias("r"), F.col("c1").alias("g"), F.col("c0").alias("b")).agg(F.count("*").alias("n"), F.sum("y").alias("ys"), F.sum("x").alias("xs"))


# --- entry points -------------------------------------------------------------------


_FRONT = "front as (select section_number, y, x, y * 8 + x as id from fx_raster where v > 0.1)"
_AREA = """area as (select m.label, sum(8 * 8 / (map_width * map_height)::double) as region_area from maps m
    where section_number in (select section_number from fx_raster) and hemi > 0 group by m.label)"""
_NAMED = "named as (select idx, name from fx_labels union all select 0, 'out_of_atlas')"


@query(
    f"""with recursive {ctes('fx_raster', 'fx_sections', 'fx_voxels', 'fx_labels')[5:]}, {_SLICES}, {_FRONT}, {_NAMED}, {_AREA},
    placed as (select f.section_number, x * width / 8.0::double as rx, y * height / 8.0::double as ry, width, height, map_width, map_height
        from front f join (select p.*, s.* exclude (section_number, ox, oy, oz, ux, uy, uz, vx, vy, vz, width, height) from planes p join fx_sections s using (section_number)) using (section_number)),
    found as (select p.*, coalesce(m.label, 0) as label, coalesce(m.hemi, 0) as hemi from placed p left join maps m on m.section_number = p.section_number
        and m.y = floor(ry * (p.map_height - 1) / (height - 1)) and m.x = floor(rx * (p.map_width - 1) / (width - 1))),
    n as (select label, count(*) as c, count(*) filter (where hemi = 1) as l, count(*) filter (where hemi = 2) as r from found group by label),
    reach(s, id, root) as (select section_number, id, id from front where section_number in (select section_number from fx_sections) union select r.s, b.id, r.root from reach r
        join front a on a.section_number = r.s and a.id = r.id join front b on b.section_number = r.s and abs(a.y - b.y) + abs(a.x - b.x) = 1),
    comp as (select s, id, min(root) as root from reach group by s, id),
    votes as (select c.s, c.root, m.label, count(*) as k from comp c join planes p on p.section_number = c.s join maps m on m.section_number = c.s
        and m.y = round_even((c.id // 8) * p.map_height / 8.0::double, 0) and m.x = round_even((c.id % 8) * p.map_width / 8.0::double, 0) group by 1, 2, 3),
    best as (select s, root, arg_min(label, struct_pack(a := -k, b := label)) as label from votes group by 1, 2),
    sized as (select s, root, count(*) as area from comp group by 1, 2 having count(*) > 2),
    o as (select coalesce(best.label, 0) as label, count(*) as c from sized left join best using (s, root) group by 1)
    select idx, name, cast(coalesce(n.c, 0) as bigint) as pixel_count, cast(coalesce(o.c, 0) as bigint) as object_count, cast(coalesce(l, 0) as bigint) as left_hemi_pixel_count,
    cast(coalesce(n.r, 0) as bigint) as right_hemi_pixel_count, round(coalesce(region_area, 0), 6) as region_area from named left join n on n.label = idx left join o on o.label = idx
    left join (select * from area where label <> 0) area on area.label = idx where idx <> 0 or n.c is not null or o.c is not null"""
)
def segmentation_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Binary images of every raster; those without a section are left out."""
    rows = view(spark, sf, "fx_raster").select("section_number", "y", "x", F.when(F.col("v") > 0.1, 0).otherwise(255).alias("c0"))
    folder, atlas = _written(spark, rows, "seg_s%03d.png"), _fixture_atlas(spark, sf)
    result = pipelines.segmentation_to_atlas(spark, folder, registration.read_registration(spark, _series(spark, sf)), atlas, (0, 0, 0), cutoff=2)
    found = pipelines.quantify(result, atlas.labels)
    return found.select("idx", "name", "pixel_count", "object_count", "left_hemi_pixel_count", "right_hemi_pixel_count", F.round(F.coalesce("region_area", F.lit(0.0)), 6).alias("region_area"))


def _spread(axis: str, n: str) -> str:
    """Cells that a pixel of 8 covers along an axis of n, and by how much."""
    return f"""select p, cast(q as int) as {axis}, least((p + 1) * {n} / 8.0::double, q + 1) - greatest(p * {n} / 8.0::double, q) as w{axis} from range(8) a(p), range({n}) b(q)
        where q + 1 > p * {n} / 8.0::double + 1e-9 and q < (p + 1) * {n} / 8.0::double - 1e-9"""


@query(
    f"""{ctes('fx_raster', 'fx_sections', 'fx_voxels', 'fx_labels')}, {_SLICES}, across as ({_spread('x', '250')}), down as ({_spread('y', '75')}),
    small as (select section_number, d.y, a.x, sum(case when floor(abs(v) * 200) < 5 then 0 else floor(abs(v) * 200) end * wx * wy) / sum(wx * wy) as value
        from fx_raster r join across a on a.p = r.x join down d on d.p = r.y where section_number in (select section_number from fx_sections) group by 1, 2, 3),
    spots as materialized (select s.section_number, cast(least(floor(s.y * p.map_height / 75.0::double), p.map_height - 1) as int) as r,
        cast(least(floor(s.x * p.map_width / 250.0::double), p.map_width - 1) as int) as c, case when value < 5 then 0 else value end as value from small s join planes p using (section_number)),
    cells as (select s.section_number, m.label, m.hemi, value from spots s join maps m on m.section_number = s.section_number and m.y = s.r and m.x = s.c),
    sums as (select label, sum(value) as total, count(*) as n, coalesce(sum(value) filter (where hemi = 1), 0) as left_total, count(*) filter (where hemi = 2) as right_n from cells group by label)
    select idx, name, round(coalesce(total, 0), 4) as sum_intensity, cast(coalesce(n, 0) as bigint) as pixel_count, round(coalesce(left_total, 0), 4) as left_hemi_sum_intensity,
    cast(coalesce(right_n, 0) as bigint) as right_hemi_pixel_count, round(case when coalesce(n, 0) > 0 then total / n else 0 end, 6) as mean_intensity from fx_labels left join sums on label = idx"""
)
def image_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Intensities of every raster as a grey image, values below 5 cut to 0."""
    folder, atlas = _written(spark, _grey(spark, sf, 200), "grey_s%03d.png"), _fixture_atlas(spark, sf)
    result = pipelines.image_to_atlas(spark, folder, registration.read_registration(spark, _series(spark, sf)), atlas, low=5)
    rounded = lambda c, n: F.round(c, n).alias(c)
    found = pipelines.quantify(result, atlas.labels)
    return found.select("idx", "name", rounded("sum_intensity", 4), "pixel_count", rounded("left_hemi_sum_intensity", 4), "right_hemi_pixel_count", rounded("mean_intensity", 6))


_SHIFT = "field as (select cast(b.y as int) as yi, cast(a.x as int) as xi, (a.x % 5)::double - 2 as dx, (b.y % 3)::double - 1 as dy from range(250) a(x), range(75) b(y))"


def _cell(value: str, size: str) -> str:
    return f"least(greatest(round_even({value}, 0), 0), {size} - 1)"


@query(
    f"""{ctes('fx_xy', 'fx_sections', 'fx_voxels')}, {_PLACED}, {_SLICES}, {_SHIFT},
    moved as (select p.*, rx + f.dx as wx, ry + f.dy as wy, floor(ry * (map_height - 1) / (height - 1)) as sy, floor(rx * (map_width - 1) / (width - 1)) as sx, map_width, map_height
        from placed p join (select section_number, map_width, map_height from planes) using (section_number) join field f on f.xi = {_cell('rx', 'width')} and f.yi = {_cell('ry', 'height')}),
    pulled as (select m.*, trunc((sx * width / map_width::double + f.dx) / (width / map_width::double)) as px, trunc((sy * height / map_height::double + f.dy) / (height / map_height::double)) as py
        from moved m join field f on f.xi = {_cell('sx * width / map_width::double', 'width')} and f.yi = {_cell('sy * height / map_height::double', 'height')}),
    found as (select p.*, case when sx >= 0 and sy >= 0 and sx < p.map_width and sy < p.map_height then coalesce(m.label, 0) else 0 end as label from pulled p
        left join maps m on m.section_number = p.section_number and m.y = py and m.x = px)
    select event_id, label, round(75 - ay, 6) as x, round(64 - az, 6) as y, round(110 - ax, 6) as z from (select event_id, label, {_axes('wx', 'wy')} from found)"""
)
def displacement_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates of a file through sections with displacement fields."""
    folder = scratch(spark, "fields")
    y, x = np.indices((75, 250))
    for name, field in zip(registration.FIELDS, (y % 3 - 1, x % 5 - 2), strict=True):
        write_bytes(f"{folder}/{name}", rasters.encode_tiff(field.astype(np.float32)))
    sections = registration.read_registration(spark, _series(spark, sf), warp=registration.with_fields(folder))
    points = view(spark, sf, "fx_xy").withColumnRenamed("event_id", "ordinal")
    result = pipelines.xy_to_atlas(points, sections, _fixture_atlas(spark, sf))
    return result.points.select(F.col("ordinal").alias("event_id"), "label", *[F.round(a, 6).alias(a) for a in "xyz"])


def _hit(name: str, table: str, x: str, y: str) -> str:
    """Points (event_id) of a table moved by the first triangle that holds them."""
    area = "((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0))"
    return f"""{name}_uv as (select event_id, t.*, (({x} - x0) * (y2 - y0) - ({y} - y0) * (x2 - x0)) / {area} as u, ((x1 - x0) * ({y} - y0) - (y1 - y0) * ({x} - x0)) / {area} as v from {table}, tri t where {area} <> 0),
    {name} as (select event_id, arg_min(mx0 + u * (mx1 - mx0) + v * (mx2 - mx0), o) as wx, arg_min(my0 + u * (my1 - my0) + v * (my2 - my0), o) as wy
        from {name}_uv where u >= 0 and u <= 1 and v >= 0 and v <= 1 and u + v <= 1 group by event_id)"""


@query(
    f"""{ctes('fx_xy', 'fx_sections', 'fx_voxels')}, {_PLACED}, {_SLICES}, {_triangle_sql()}, {_hit('moved', 'placed', 'rx', 'ry')},
    spots as (select p.*, map_width, map_height, floor(ry * (map_height - 1) / (height - 1)) as sy, floor(rx * (map_width - 1) / (width - 1)) as sx
        from placed p join (select section_number, map_width, map_height from planes) using (section_number)),
    corners as (select *, sx * width / map_width::double as px, sy * height / map_height::double as py from spots), {_hit('pulled', 'corners', 'px', 'py')},
    cells as (select c.*, trunc(coalesce(q.wx, 0) / (width / map_width::double)) as qx, trunc(coalesce(q.wy, 0) / (height / map_height::double)) as qy from corners c left join pulled q using (event_id)),
    found as (select c.*, coalesce(w.wx, 0) as wx, coalesce(w.wy, 0) as wy, case when sx >= 0 and sy >= 0 and sx < c.map_width and sy < c.map_height then coalesce(m.label, 0) else 0 end as label
        from cells c left join moved w using (event_id) left join maps m on m.section_number = c.section_number and m.y = qy and m.x = qx)
    select event_id, label, round(ax, 6) as x, round(ay, 6) as y, round(az, 6) as z from (select event_id, label, {_axes('wx', 'wy')} from found)"""
)
def marker_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates through sections whose registration file has markers."""
    sections = registration.read_registration(spark, _series(spark, sf, _MARKERS))
    result = pipelines.xy_to_atlas(view(spark, sf, "fx_xy").withColumnRenamed("event_id", "ordinal"), sections, _fixture_atlas(spark, sf), "lpi")
    return result.points.select(F.col("ordinal").alias("event_id"), "label", *[F.round(a, 6).alias(a) for a in "xyz"])


@query(f"{ctes('fx_raster')} select section_number, y, x, cast(floor(abs(v) * 200) as int) as c0 from fx_raster")
def deep_zoom_file(spark: SparkSession, sf: str) -> DataFrame:
    """Each raster as an archive of four tiles."""
    folder = scratch(spark, "zoom")
    head = '<Image TileSize="4" xmlns="http://schemas.microsoft.com/deepzoom/2008"><Size Width="8" Height="8"/></Image>'

    def write(section: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((8, 8), np.uint8)
        image[section["y"], section["x"]] = section["c0"]
        packed, number = io.BytesIO(), int(section["section_number"].iloc[0])
        with zipfile.ZipFile(packed, "w") as archive:
            archive.writestr("a.dzi", head)
            archive.writestr("a_files/0/0_0.png", rasters.encode_png(image[:1, :1]))
            for column, row in ((0, 0), (0, 1), (1, 0), (1, 1)):
                archive.writestr(f"a_files/3/{column}_{row}.png", rasters.encode_png(image[row * 4 : row * 4 + 4, column * 4 : column * 4 + 4]))
        write_bytes(f"{folder}/zoom_s{number:03d}.dzip", packed.getvalue())
        return section[["section_number"]].head(1)

    _grey(spark, sf, 200).groupBy("section_number").applyInPandas(write, "section_number int").write.format("noop").mode("overwrite").save()
    return _read(spark, folder).select("section_number", "y", "x", "c0")


@query(
    f"""{ctes('fx_voxels')} select label, hemi, cast(count(*) as bigint) as n, cast(sum(63 - z) as bigint) as xs, cast(sum(109 - x) as bigint) as ys, cast(sum(74 - y) as bigint) as zs
    from fx_voxels group by label, hemi"""
)
def array_atlas(spark: SparkSession, sf: str) -> DataFrame:
    """An atlas of arrays, turned to internal orientation."""
    x, y, z = np.indices(SHAPE, np.int32)

    class Held:
        annotation = (x // 10 * 7 + y // 10 * 3 + z // 8) % 160
        hemispheres = np.where(x < 55, 1, 2)
        structures_list: ClassVar[list] = []
        resolution = (25.0, 25.0, 25.0)

    found = atlases.resolve_atlas(spark, Held()).voxels
    return found.groupBy("label", "hemi").agg(F.count("*").alias("n"), *[F.sum(a).alias(f"{a}s") for a in "xyz"])


@query(ctes("fx_labels") + "select idx, name, r, g, b from fx_labels union all select 0, 'Clear Label', 0, 0, 0")
def structure_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "fx_labels").collect()

    class Held:
        structures_list: ClassVar[list] = [{"id": r["idx"], "name": r["name"], "rgb_triplet": [r["r"], r["g"], r["b"]]} for r in rows]

    return tables.resolve_labels(spark, Held()).select("idx", "name", "r", "g", "b")


@query(
    f"""{ctes('fx_xy', 'fx_sections', 'fx_voxels', 'fx_labels')}, {_PLACED}, {_SLICES}, {_FOUND},
    named as (select idx, name from fx_labels union all select 0, 'out_of_atlas'), n as (select label, count(*) as c from found group by label)
    select 'counts.csv' as file, name, cast(coalesce(c, 0) as bigint) as n from named left join n on label = idx where idx <> 0 or c is not null
    union all select f, name, n from (values ('pixels_cloud.json', 0), ('left_hemisphere_pixels_cloud.json', 1), ('right_hemisphere_pixels_cloud.json', 2),
        ('objects_cloud.json', 0), ('left_hemisphere_objects_cloud.json', 1), ('right_hemisphere_objects_cloud.json', 2)) as t(f, side),
        lateral (select name, cast(count(*) as bigint) as n from found join fx_labels on idx = label where side = 0 or hemi = side group by idx, name)"""
)
def analysis_files(spark: SparkSession, sf: str) -> DataFrame:
    """The report and the clouds that an analysis of coordinates leaves."""
    atlas, folder = _fixture_atlas(spark, sf), scratch(spark, "analysis")
    sections = registration.read_registration(spark, _series(spark, sf))
    result = pipelines.xy_to_atlas(view(spark, sf, "fx_xy").withColumnRenamed("event_id", "ordinal"), sections, atlas)
    exports.save_analysis(folder, result, atlas.labels, pipelines.quantify(result, atlas.labels), settings={"sf": sf})
    report = spark.read.option("header", True).option("sep", ";").csv(f"{folder}/whole_series_report/counts.csv")
    report = report.select(F.lit("counts.csv").alias("file"), "name", F.col("pixel_count").cast("long").alias("n"))
    clouds = spark.read.schema("name string, count long").option("multiLine", True).json(f"{folder}/whole_series_clouds")
    clouds = clouds.select(files.file_name(F.col("_metadata.file_path")).alias("file"), "name", F.col("count").alias("n"))
    return report.unionByName(clouds)


@query(
    f"""{ctes('fx_raster', 'fx_sections')}, planes as (select *, greatest(1, cast(round_even(sqrt(ux*ux + uy*uy + uz*uz), 0) as int)) as pw, greatest(1, cast(round_even(sqrt(vx*vx + vy*vy + vz*vz), 0) as int)) as ph from fx_sections
        where section_number in (select section_number from fx_raster)),
    grid as (select p.*, (a.x + 0.5::double) * width / pw as rx, (b.y + 0.5::double) * height / ph as ry from planes p, range(200) a(x), range(200) b(y) where a.x < pw and b.y < ph),
    spot as (select *, round_even(rx, 0) as cx, round_even(ry, 0) as cy from grid),
    seen as (select a.*, case when r.v > 0.1 then 1 else 0 end as value from spot a left join fx_raster r on r.section_number = a.section_number and cx < width and cy < height
        and r.x = least(floor(cx * 8 / width::double), 7) and r.y = least(floor(cy * 8 / height::double), 7)),
    vox as (select cast(round_even(ax, 0) as int) as x, cast(round_even(ay, 0) as int) as y, cast(round_even(az, 0) as int) as z, value from (select value, {_axes()} from seen))
    select x, y, z, cast(sum(value) as double) as value, cast(count(*) as bigint) as freq from vox where x between 0 and 109 and y between 0 and 74 and z between 0 and 63 group by x, y, z"""
)
def volume_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Voxels that the planes of images cover, without filling the others."""
    rows = view(spark, sf, "fx_raster").select("section_number", "y", "x", F.when(F.col("v") > 0.1, 0).otherwise(255).alias("c0"))
    folder = _written(spark, rows, "seg_s%03d.png")
    sections = registration.read_registration(spark, _series(spark, sf))
    made = pipelines.volume_from_images(spark, folder, sections, _fixture_atlas(spark, sf), "0,0,0", interpolate=False, use_mask=False, missing=0.0, orientation="lpi")
    return made.filter("freq > 0").select("x", "y", "z", "value", "freq")
