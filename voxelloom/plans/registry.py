"""Queries by name, with the SQL that must give the same rows.

Each query applies operators of the package to a projection of the tables; its
SQL is written from the operators' definitions for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colours, numeric
from ..model import Atlas
from ..operators import geometry, objects, pixels, regions, volume, warp
from ..sinks import exports
from ..sources.files import section_number
from . import pipelines
from .fixtures import SHAPE, ctes, table, view, voxels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- counts -----------------------------------------------------------------


def _count_sql(with_hemi: bool, with_damage: bool) -> list[tuple[str, str]]:
    sides = [("", "true")] + ([("left_hemi_", "hemi = 1"), ("right_hemi_", "hemi = 2")] if with_hemi else [])
    states = [("", "true")] + ([("undamaged_", "undamaged"), ("damaged_", "not undamaged")] if with_damage else [])
    found = []
    for entity in ("pixel", "object"):
        for p, a in sides:
            for q, b in states:
                name = f"{p}{q}{entity}_count" + ("s" if q and entity == "pixel" else "")
                found.append((name, f"cast(count(*) filter (where e = '{entity}' and {a} and {b}) as bigint) as {name}"))
    return found


def _counts_cte(with_hemi: bool, with_damage: bool) -> str:
    columns = ", ".join(sql for _, sql in _count_sql(with_hemi, with_damage))
    return f"""{ctes('fx_labels', 'fx_points', 'fx_objects')}, every as (
        select label, hemi, undamaged, 'pixel' as e from fx_points union all select label, hemi, undamaged, 'object' from fx_objects),
        named as (select * from fx_labels union all select 0, 'out_of_atlas', 0, 0, 0),
        counts as (select label, {columns} from every group by label) """


def _counts_sql(with_hemi: bool, with_damage: bool) -> str:
    names = ", ".join(name for name, _ in _count_sql(with_hemi, with_damage))
    return f"{_counts_cte(with_hemi, with_damage)} select idx, name, r, g, b, {names} from named join counts on label = idx"


def _counts(spark: SparkSession, sf: str, with_hemi: bool = True, with_damage: bool = True) -> DataFrame:
    return regions.region_counts(*(view(spark, sf, n) for n in ("fx_points", "fx_objects", "fx_labels")), with_hemi, with_damage)


@query(_counts_sql(True, True))
def region_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf)


@query(_counts_sql(False, True))
def region_counts_no_hemi(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf, with_hemi=False)


@query(_counts_sql(True, False))
def region_counts_no_damage(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf, with_damage=False)


@query(_counts_sql(False, False))
def region_counts_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf, False, False)


@query(
    ctes("fx_labels", "fx_points")
    + """select cast(count(*) as bigint) as n_points, cast(count(*) filter (where label = 0) as bigint) as out_of_atlas,
    cast(count(*) filter (where label in (select idx from fx_labels)) as bigint) as in_regions from fx_points"""
)
def out_of_atlas_conservation(spark: SparkSession, sf: str) -> DataFrame:
    points, labels = view(spark, sf, "fx_points"), view(spark, sf, "fx_labels")
    table_ = regions.region_counts(points, None, labels, False, False)
    sums = table_.agg(
        F.coalesce(F.sum(F.when(F.col("name") == "out_of_atlas", F.col("pixel_count"))), F.lit(0)).alias("out_of_atlas"),
        F.coalesce(F.sum(F.when(F.col("name") != "out_of_atlas", F.col("pixel_count"))), F.lit(0)).alias("in_regions"),
    )
    return points.agg(F.count("*").alias("n_points")).join(sums)


@query(
    ctes("fx_sections", "fx_points")
    + """select s.section_number, cast(count(p.undamaged) filter (where p.undamaged) as bigint) as n from fx_sections s left join fx_points p using (section_number) group by s.section_number"""
)
def filtered_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Sections without points have a row as well."""
    return regions.filtered_lengths(view(spark, sf, "fx_points"), view(spark, sf, "fx_sections"))


# --- areas, intensities, custom regions ---------------------------------------

_CELLS = """cells as (select section_number, y, x, cast(floor(abs(v) * 20) as bigint) as label, case when x < 4 then 1 else 2 end as hemi,
    y <> 3 as undamaged, cast(2.5 as double) as scale from fx_raster)"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "fx_raster")
    return rows.select(
        "section_number", "y", "x", F.floor(F.abs("v") * 20).cast("long").alias("label"), F.when(F.col("x") < 4, 1).otherwise(2).alias("hemi"),
        (F.col("y") != 3).alias("undamaged"), F.lit(2.5).alias("scale"), "v",
    )


def _area_sql(test: str) -> str:
    return f"cast(count(*) filter (where {test}) as double) * 2.5::double"


_AREAS = ", ".join(
    f"{_area_sql(test)} as {name}"
    for name, test in [
        *((f"{s}_hemi_{q}region_area", f"hemi = {h} and {t}") for h, s in ((1, "left"), (2, "right")) for q, t in (("undamaged_", "not undamaged"), ("damaged_", "undamaged"), ("", "true"))),
        ("undamaged_region_area", "not undamaged"), ("damaged_region_area", "undamaged"), ("region_area", "true"),
    ]
)


@query(f"{ctes('fx_raster')}, {_CELLS} select section_number, label as idx, {_AREAS} from cells group by section_number, label")
def region_areas(spark: SparkSession, sf: str) -> DataFrame:
    return regions.region_areas(_cells(spark, sf))


@query(
    f"""{ctes('fx_raster')}, {_CELLS} select label as idx, {_area_sql('true')} as region_area,
    {_area_sql('section_number % 2 = 0 and not undamaged')} as undamaged_region_area, {_area_sql('section_number % 2 = 0 and undamaged')} as damaged_region_area
    from cells group by label"""
)
def region_areas_series(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the sections have a damage mask."""
    cells = _cells(spark, sf)
    masked = regions.region_areas(cells.filter("section_number % 2 = 0"), False, True)
    plain = regions.region_areas(cells.filter("section_number % 2 <> 0"), False, False)
    return regions.combine_areas(masked, plain)


@query(f"{ctes('fx_raster')}, {_CELLS} select section_number, label as idx, {_area_sql('undamaged')} as undamaged_region_area, {_area_sql('not undamaged')} as damaged_region_area, {_area_sql('true')} as region_area from cells group by section_number, label")
def region_areas_corrected(spark: SparkSession, sf: str) -> DataFrame:
    return regions.region_areas(_cells(spark, sf), False, True, "corrected")


def _ratio(n: str, d: str) -> str:
    return f"case when {d} <> 0 then {n} / {d} when {n} > 0 then 'infinity'::double else 0::double end"


_FRACTIONS = ", ".join(f"{_ratio(f'cast({n} as double)', d)} as {name}" for n, d, name in regions.AREA_FRACTIONS)
_NAMES = [name for name, _ in _count_sql(True, True)]


@query(
    f"""{_counts_cte(True, True)}, fx_raster as ({ctes('fx_raster').split('fx_raster as (', 1)[1].rsplit(')', 1)[0]}), {_CELLS},
    areas as (select label, {_AREAS} from cells group by label),
    whole as (select named.*, {', '.join(f'coalesce(counts.{n}, 0) as {n}' for n in _NAMES)},
        {', '.join(f'coalesce(areas.{a}, 0) as {a}' for a in sorted({d for _, d, _ in regions.AREA_FRACTIONS} | {'damaged_region_area', 'left_hemi_damaged_region_area', 'right_hemi_damaged_region_area'}))}
        from named left join counts on counts.label = idx left join (select * from areas where label <> 0) areas on areas.label = idx
        where idx <> 0 or counts.label is not null)
    select *, {_FRACTIONS} from whole"""
)
def region_table(spark: SparkSession, sf: str) -> DataFrame:
    areas = regions.combine_areas(regions.region_areas(_cells(spark, sf)))
    return regions.region_table(_counts(spark, sf), view(spark, sf, "fx_labels"), areas).drop("label_ordinal")


_INTENSITY = """pix as (select section_number, case when undamaged then label else 0 end as idx, case when undamaged then intensity else 0 end as v,
    case when undamaged then hemi end as hemi from fx_points)"""
_SUMS = """cast(sum(v) as double) as sum_intensity, cast(count(*) as bigint) as pixel_count,
    cast(coalesce(sum(v) filter (where hemi = 1), 0) as double) as left_hemi_sum_intensity, cast(count(*) filter (where hemi = 1) as bigint) as left_hemi_pixel_count,
    cast(coalesce(sum(v) filter (where hemi = 2), 0) as double) as right_hemi_sum_intensity, cast(count(*) filter (where hemi = 2) as bigint) as right_hemi_pixel_count"""


@query(f"{ctes('fx_points')}, {_INTENSITY} select section_number, idx, {_SUMS} from pix group by section_number, idx")
def region_intensities(spark: SparkSession, sf: str) -> DataFrame:
    return regions.region_intensities(view(spark, sf, "fx_points").withColumnRenamed("intensity", "value"))


@query(
    f"""{ctes('fx_points', 'fx_labels')}, {_INTENSITY}, sums as (select idx, {_SUMS} from pix group by idx),
    whole as (select l.*, coalesce(sum_intensity, 0) as sum_intensity, coalesce(pixel_count, 0) as pixel_count,
      coalesce(left_hemi_sum_intensity, 0) as left_hemi_sum_intensity, coalesce(left_hemi_pixel_count, 0) as left_hemi_pixel_count,
      coalesce(right_hemi_sum_intensity, 0) as right_hemi_sum_intensity, coalesce(right_hemi_pixel_count, 0) as right_hemi_pixel_count
      from fx_labels l left join sums using (idx))
    select *, {', '.join(f"case when {d} > 0 then {n} / {d} else 0::double end as {m}" for n, d, m in regions.MEANS)} from whole"""
)
def mean_intensity(spark: SparkSession, sf: str) -> DataFrame:
    sections = regions.region_intensities(view(spark, sf, "fx_points").withColumnRenamed("intensity", "value"))
    return regions.quantify_intensity(regions.combine_intensities(sections), view(spark, sf, "fx_labels"))


@query(
    ctes("fx_points", "fx_custom").replace("string", "varchar")
    + "select coalesce(custom_id, 0) as custom_id, cast(count(*) as bigint) as n, cast(sum(label) as bigint) as labels from fx_points left join fx_custom on subregion_id = label group by 1"
)
def custom_region_map(spark: SparkSession, sf: str) -> DataFrame:
    mapped = regions.map_to_custom(view(spark, sf, "fx_points"), view(spark, sf, "fx_custom"))
    return mapped.groupBy("custom_id").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))


@query(
    f"{_counts_cte(True, True)}, fx_custom as ({ctes('fx_custom').replace('string', 'varchar').split('fx_custom as (', 1)[1].rsplit(')', 1)[0]}) select custom_name as name, "
    + ", ".join(f"cast(sum(coalesce({n}, 0)) as bigint) as {n}" for n in _NAMES)
    + " from fx_labels join fx_custom on subregion_id = idx left join counts on label = idx group by custom_name"
)
def custom_region_rollup(spark: SparkSession, sf: str) -> DataFrame:
    whole = regions.region_table(_counts(spark, sf), view(spark, sf, "fx_labels"))
    crosswalk = view(spark, sf, "fx_custom")
    regions.check_crosswalk(crosswalk)
    return regions.roll_up(whole, crosswalk)[0]


# --- geometry -------------------------------------------------------------------

_PLACED = """placed as (select event_id, section_number, x * width / image_width as rx, y * height / image_height as ry, s.*  exclude (section_number)
    from fx_xy join fx_sections s using (section_number))"""


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "fx_xy").join(view(spark, sf, "fx_sections"), "section_number")
    return rows.withColumns({"rx": geometry.scaled(F.col("x"), F.col("image_width"), F.col("width")), "ry": geometry.scaled(F.col("y"), F.col("image_height"), F.col("height"))})


def _axes(x: str = "rx", y: str = "ry") -> str:
    return ", ".join(f"o{a} + {x} / width * u{a} + {y} / height * v{a} as a{a}" for a in "xyz")


@query(f"{ctes('fx_xy', 'fx_sections')}, {_PLACED} select event_id, {_axes()} from placed")
def affine_to_atlas(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.to_atlas(_placed(spark, sf), "rx", "ry").select("event_id", "ax", "ay", "az")


_SLICES = """planes as (select *, cast(floor(sqrt(ux*ux + uy*uy + uz*uz)) as int) + 1 as map_width, cast(floor(sqrt(vx*vx + vy*vy + vz*vz)) as int) + 1 as map_height from fx_sections),
    grid as (select section_number, map_width, map_height, cast(b.y as int) as y, cast(a.x as int) as x, """ + ", ".join(
    f"cast(floor(o{a} + v{a} * (b.y / map_height::double) + u{a} * (a.x / map_width::double)) as int) as l{a}" for a in "xyz"
) + """ from planes, range(200) a(x), range(200) b(y) where a.x < map_width and b.y < map_height),
    maps as (select g.section_number, g.y, g.x, map_width, map_height, coalesce(v.label, 0) as label, coalesce(v.hemi, 0) as hemi
        from grid g left join fx_voxels v on lx = v.x and ly = v.y and lz = v.z)"""


@query(f"{ctes('fx_sections', 'fx_voxels')}, {_SLICES} select section_number, label, hemi, cast(count(*) as bigint) as n, cast(sum(x) as bigint) as xs, cast(sum(y) as bigint) as ys from maps group by section_number, label, hemi")
def slice_extract(spark: SparkSession, sf: str) -> DataFrame:
    cells = geometry.slice_atlas(view(spark, sf, "fx_sections"), voxels(spark))
    return cells.groupBy("section_number", "label", "hemi").agg(F.count("*").alias("n"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))


_FOUND = """found as (select p.*, coalesce(m.label, 0) as label, coalesce(m.hemi, 0) as hemi from (select p.*, l.map_width, l.map_height from placed p
    join planes l using (section_number)) p left join maps m on m.section_number = p.section_number
    and m.y = floor(ry * (p.map_height - 1) / (height - 1)) and m.x = floor(rx * (p.map_width - 1) / (width - 1)))"""


@query(f"{ctes('fx_xy', 'fx_sections', 'fx_voxels')}, {_PLACED}, {_SLICES}, {_FOUND} select event_id, label, hemi from found")
def label_lookup_floor(spark: SparkSession, sf: str) -> DataFrame:
    points = _placed(spark, sf).drop(*geometry.PLANE)
    return pipelines.labelled(points, view(spark, sf, "fx_sections"), _fixture_atlas(spark, sf)).select("event_id", "label", "hemi")


def _fixture_atlas(spark: SparkSession, sf: str) -> Atlas:
    return Atlas(voxels(spark), view(spark, sf, "fx_labels"), SHAPE, 25.0)


@query(
    f"""{ctes('fx_xy', 'fx_sections', 'fx_voxels', 'fx_labels')}, {_PLACED}, {_SLICES}, {_FOUND},
    named as (select idx, name from fx_labels union all select 0, 'out_of_atlas'),
    area as (select m.label, sum(500 * 150 / (map_width * map_height)::double) as region_area from maps m
        where section_number in (select section_number from fx_xy) and hemi > 0 group by m.label),
    n as (select label, count(*) as c, count(*) filter (where hemi = 1) as l, count(*) filter (where hemi = 2) as r from found group by label)
    select idx, name, cast(coalesce(c, 0) as bigint) as pixel_count, cast(coalesce(c, 0) as bigint) as object_count, cast(coalesce(l, 0) as bigint) as left_hemi_pixel_count,
    cast(coalesce(r, 0) as bigint) as right_hemi_pixel_count, round(coalesce(region_area, 0), 4) as region_area
    from named left join n on n.label = idx left join (select * from area where label <> 0) area on area.label = idx where idx <> 0 or c is not null"""
)
def xy_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates to the region table, all the way."""
    empty = {"markers": "array<array<double>>", "grid": "array<double>", "gridx": "int", "gridy": "int", "grid_spacing": "int"}
    sections = view(spark, sf, "fx_sections").withColumns({c: F.lit(None).cast(k) for c, k in empty.items()})
    sections = sections.withColumns({"plane_width": geometry.plane_size("u"), "plane_height": geometry.plane_size("v")})
    atlas = _fixture_atlas(spark, sf)
    result = pipelines.xy_to_atlas(view(spark, sf, "fx_xy").withColumnRenamed("event_id", "ordinal"), sections, atlas)
    found = pipelines.quantify(result, atlas.labels)
    return found.select("idx", "name", "pixel_count", "object_count", "left_hemi_pixel_count", "right_hemi_pixel_count", F.round(F.coalesce("region_area", F.lit(0.0)), 4).alias("region_area"))


@query(f"{ctes('fx_xyz')} select vec_id, 75 - y as x, 64 - z as y, 110 - x as z from fx_xyz")
def reorient_points(spark: SparkSession, sf: str) -> DataFrame:
    """Internal orientation to asr."""
    return geometry.reorient(view(spark, sf, "fx_xyz"), SHAPE, "asr")


# --- warps and damage -----------------------------------------------------------

_MARKERS = [[20.0, 20.0, 30.0, 25.0], [200.0, 10.0, 190.0, 20.0], [120.0, 60.0, 125.0, 50.0]]


def _triangles(spark: SparkSession) -> DataFrame:
    return warp.triangle_table(spark, [{"section_number": n, "width": 250, "height": 75, "markers": _MARKERS} for n in range(25)])


def _triangle_sql() -> str:
    mesh = warp.triangulate(250, 75, _MARKERS)
    rows = ", ".join(
        f"({n}, {', '.join(f'{float(v)!r}::double' for i in t for v in (*mesh.target[i], *mesh.source[i]))})" for n, t in enumerate(mesh.triangles)
    )
    names = ", ".join(f"{c}{i}" for i in (0, 1, 2) for c in ("x", "y", "mx", "my"))
    return f"tri(o, {names}) as (values {rows})"


_UV = """uv as (select event_id, t.*, ((rx - x0) * (y2 - y0) - (ry - y0) * (x2 - x0)) / ((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) as u,
    ((x1 - x0) * (ry - y0) - (y1 - y0) * (rx - x0)) / ((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) as v from placed, tri t
    where (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) <> 0),
    hit as (select event_id, arg_min(mx0 + u * (mx1 - mx0) + v * (mx2 - mx0), o) as wx, arg_min(my0 + u * (my1 - my0) + v * (my2 - my0), o) as wy
    from uv where u >= 0 and u <= 1 and v >= 0 and v <= 1 and u + v <= 1 group by event_id)"""


@query(f"{ctes('fx_xy', 'fx_sections')}, {_PLACED}, {_triangle_sql()}, {_UV} select event_id, round(coalesce(wx, 0), 6) as wx, round(coalesce(wy, 0), 6) as wy from placed left join hit using (event_id)")
def triangle_warp(spark: SparkSession, sf: str) -> DataFrame:
    moved = warp.warp_points(_placed(spark, sf), _triangles(spark), "rx", "ry")
    return moved.select("event_id", F.round("wx", 6).alias("wx"), F.round("wy", 6).alias("wy"))


_FIELD = """field as (select cast(s.n as int) as section_number, cast(b.y as int) as yi, cast(a.x as int) as xi, (a.x % 5)::double - 2 as dx, (b.y % 3)::double - 1 as dy
    from range(25) s(n), range(20) a(x), range(10) b(y))"""


def _field(spark: SparkSession) -> DataFrame:
    at = spark.range(25 * 200)
    cells = at.selectExpr("cast(id div 200 as int) section_number", "cast(id div 20 % 10 as int) yi", "cast(id % 20 as int) xi")
    return cells.withColumns({"dx": (F.col("xi") % 5).cast("double") - 2, "dy": (F.col("yi") % 3).cast("double") - 1})


@query(
    f"""{ctes('fx_xy', 'fx_sections')}, {_PLACED}, {_FIELD},
    spot as (select *, least(greatest(round_even(rx * (20 / width::double), 0), 0), 19) as cx, least(greatest(round_even(ry * (10 / height::double), 0), 0), 9) as cy from placed)
    select event_id, round(rx + dx / (20 / width::double), 6) as wx, round(ry + dy / (10 / height::double), 6) as wy from spot join field f on f.section_number = spot.section_number and xi = cx and yi = cy"""
)
def displacement_warp(spark: SparkSession, sf: str) -> DataFrame:
    moved = warp.displace(_placed(spark, sf), _field(spark), F.col("width"), F.col("height"), "rx", "ry")
    return moved.select("event_id", F.round("wx", 6).alias("wx"), F.round("wy", 6).alias("wy"))


@query(
    f"""{ctes('fx_sections')}, {_FIELD}, sent as (select section_number, cast(yi + dy as int) as yi, cast(xi + dx as int) as xi, arg_max(-dx, yi * 20 + xi) as dx, arg_max(-dy, yi * 20 + xi) as dy
        from field where xi + dx between 0 and 19 and yi + dy between 0 and 9 group by 1, 2, 3),
    near as (select f.section_number, f.yi, f.xi, s.dx, s.dy, row_number() over (partition by f.section_number, f.yi, f.xi
        order by (f.yi - s.yi) * (f.yi - s.yi) + (f.xi - s.xi) * (f.xi - s.xi), s.yi, s.xi) as place from field f join sent s using (section_number))
    select section_number, yi, xi, dx, dy from near where place = 1"""
)
def displacement_invert(spark: SparkSession, sf: str) -> DataFrame:
    return warp.invert_field(_field(spark))


_DAMAGE = """cells as (select section_number, cast(grid_pos // 10 as int) as row, cast(grid_pos % 10 as int) as col, grid_value <> 4 as undamaged from fx_grid)"""


def _damage(spark: SparkSession, sf: str) -> DataFrame:
    """Six rows of ten cells a section: spacing 25 of 250 and 12 of 75 from 3.
    What a grid holds beyond its cells is of no account."""
    ordered = F.array_sort(F.collect_list(F.struct("grid_pos", "grid_value")))
    grids = view(spark, sf, "fx_grid").groupBy("section_number").agg(F.transform(ordered, lambda s: s["grid_value"].cast("double")).alias("grid"))
    sections = view(spark, sf, "fx_sections").select("section_number", "width", "height").join(grids, "section_number")
    sizes = {"gridx": 3, "gridy": 3, "grid_spacing": 10, "plane_width": 100, "plane_height": 59}
    return warp.damage_cells(sections.withColumns({k: F.lit(v) for k, v in sizes.items()}))


@query(
    f"""{ctes('fx_grid')}, {_DAMAGE}, every as (select section_number, cast(r as int) as row, cast(c as int) as col from (select distinct section_number from cells) s, range(10) a(c), range(6) b(r))
    select e.section_number, e.row, e.col, coalesce(undamaged, true) as undamaged from every e left join cells c on c.section_number = e.section_number and c.row = e.row and c.col = e.col"""
)
def damage_mask(spark: SparkSession, sf: str) -> DataFrame:
    return _damage(spark, sf).select("section_number", "row", "col", "undamaged")


@query(
    f"""{ctes('fx_xy', 'fx_sections', 'fx_grid')}, {_PLACED}, {_DAMAGE}, spot as (select event_id, section_number, cast(floor(least(greatest(round_even(ry, 0), 0), height - 1) * 6 / height) as int) as row,
    cast(floor(least(greatest(round_even(rx, 0), 0), width - 1) * 10 / width) as int) as col from placed)
    select event_id, coalesce(undamaged, true) as undamaged from spot left join cells c on c.section_number = spot.section_number and c.row = spot.row and c.col = spot.col"""
)
def damage_flag(spark: SparkSession, sf: str) -> DataFrame:
    flagged = warp.flag_damage(_placed(spark, sf), _damage(spark, sf), F.col("width"), F.col("height"), "rx", "ry")
    return flagged.select("event_id", "undamaged")


# --- pixels and objects ------------------------------------------------------------

_COLOURED = "coloured as (select section_number, y, x, cast(floor(abs(v) * 6) as int) as c0, cast(y % 2 as int) as c1, cast(x % 2 as int) as c2, v from fx_raster)"


def _coloured(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "fx_raster")
    return rows.withColumns({"c0": F.floor(F.abs("v") * 6).cast("int"), "c1": F.col("y") % 2, "c2": F.col("x") % 2})


@query(f"{ctes('fx_raster')}, {_COLOURED} select section_number, y, x from coloured where c0 = 0 and c1 = 1 and c2 = 0")
def colour_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _coloured(spark, sf).filter(pixels.matches_colour((0, 1, 0), ["c0", "c1", "c2"])).select("section_number", "y", "x")


@query(
    f"""{ctes('fx_raster')}, {_COLOURED}, n as (select section_number, c0, count(*) as c from coloured group by 1, 2),
    ranked as (select *, row_number() over (partition by section_number order by c desc, c0) as place from n)
    select section_number, coalesce(max(case when place = 2 then c0 end), 255) as pixel_id from ranked group by section_number"""
)
def auto_colour(spark: SparkSession, sf: str) -> DataFrame:
    return pixels.auto_colour(_coloured(spark, sf), "c0")


@query(f"{ctes('fx_raster')}, {_COLOURED} select section_number, c0, cast(count(*) as bigint) as area, avg(y) as cy, avg(x) as cx from coloured where c0 <> 0 group by section_number, c0")
def labelled_objects(spark: SparkSession, sf: str) -> DataFrame:
    return objects.object_table(objects.labelled_pixels(_coloured(spark, sf), "c0"), "c0")


@query(f"{ctes('fx_raster')}, {_COLOURED} select section_number, c0, cast(count(*) as bigint) as area, avg(y) as cy, avg(x) as cx from coloured where c0 <> 0 group by section_number, c0 having count(*) > 9")
def object_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return objects.object_table(objects.labelled_pixels(_coloured(spark, sf), "c0"), "c0", 9)


def _components_sql(near: str) -> str:
    return f"""with recursive {ctes('fx_raster')[5:]}, mask as (select section_number as s, y, x, y * 8 + x as id from fx_raster where v > 0.1),
    reach(s, id, root) as (select s, id, id from mask union select r.s, b.id, r.root from reach r join mask a on a.s = r.s and a.id = r.id
        join mask b on b.s = r.s and {near}),
    comp as (select s, id, min(root) as root from reach group by s, id)
    select s as section_number, cast(root as int) as first, cast(count(*) as bigint) as area from comp group by s, root"""


def _components(spark: SparkSession, sf: str, connectivity: int) -> DataFrame:
    found = objects.connected_pixels(view(spark, sf, "fx_raster").filter("v > 0.1"), connectivity)
    groups = found.groupBy("section_number", "component").agg(F.min(F.col("y") * 8 + F.col("x")).alias("first"), F.count("*").alias("area"))
    return groups.drop("component")


@query(_components_sql("abs(a.y - b.y) + abs(a.x - b.x) = 1"))
def components4(spark: SparkSession, sf: str) -> DataFrame:
    return _components(spark, sf, 4)


@query(_components_sql("greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1"))
def components8(spark: SparkSession, sf: str) -> DataFrame:
    return _components(spark, sf, 8)


@query(
    f"""{ctes('fx_raster')}, {_COLOURED}, {_CELLS}, spot as (select o.section_number, o.c0, round_even(o.y * (6 / 8.0::double), 0) as ay, round_even(o.x * (6 / 8.0::double), 0) as ax from coloured o where c0 <> 0),
    votes as (select a.section_number, c0, label, count(*) as n from spot a join cells c on c.section_number = a.section_number and c.y = ay and c.x = ax where ay < 6 and ax < 6 group by 1, 2, 3),
    best as (select section_number, c0, arg_min(label, struct_pack(a := -n, b := label)) as label from votes group by 1, 2)
    select k.section_number, k.c0, coalesce(best.label, 0) as label from (select distinct section_number, c0 from spot) k left join best on best.section_number = k.section_number and best.c0 = k.c0"""
)
def object_vote_rint(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of 8x8 objects vote on a 6x6 map."""
    members = objects.labelled_pixels(_coloured(spark, sf), "c0").select("section_number", "y", "x", "c0")
    at = members.withColumns({f"_{a}": geometry.nearest_cell(F.col(a), F.lit(8.0), F.lit(6.0)) for a in "yx"})
    cells = _cells(spark, sf).filter("y < 6 and x < 6").select("section_number", F.col("y").cast("long").alias("_y"), F.col("x").cast("long").alias("_x"), "label")
    return objects.majority_labels(at.join(cells, ["section_number", "_y", "_x"], "left"), "c0")


@query(f"{ctes('fx_raster')} select section_number, y, x, case when v < -0.1 or v > 0.2 then 0::double else v end as v from fx_raster")
def intensity_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_raster").select("section_number", "y", "x", pixels.bounded(F.col("v"), -0.1, 0.2).alias("v"))


@query(f"{ctes('fx_raster')}, {_COLOURED} select section_number, y, x, round_even(0.114::double * (c0 * 20) + 0.587::double * (c1 * 90) + 0.299::double * (c2 * 70), 0) as grey, cast(c2 * 70 as double) as red from coloured")
def channel_gray(spark: SparkSession, sf: str) -> DataFrame:
    rows = _coloured(spark, sf)
    planes = (F.col("c0") * 20, F.col("c1") * 90, F.col("c2") * 70)
    return rows.select("section_number", "y", "x", colours.channel(*planes).alias("grey"), colours.channel(*planes, "R").alias("red"))


@query(f"{ctes('fx_raster')} select section_number, cast(b.y as int) as y, cast(a.x as int) as x, v from range(12) a(x), range(5) b(y) join fx_raster r on r.y = cast(floor(b.y * 8 / 5.0::double) as int) where r.x = cast(floor(a.x * 8 / 12.0::double) as int)")
def resize_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return pixels.resize_nearest(view(spark, sf, "fx_raster"), (8, 8), (5, 12), ["v"])


@query(f"{ctes('fx_raster')} select section_number, cast(y // 2 as int) as y, cast(x // 4 as int) as x, round(avg(v), 9) as v from fx_raster group by 1, 2, 3")
def resize_area(spark: SparkSession, sf: str) -> DataFrame:
    small = pixels.resize_area(view(spark, sf, "fx_raster"), (8, 8), (4, 2), "v")
    return small.withColumn("v", F.round("v", 9))


@query(
    f"""{ctes('fx_points')}, ranked as (select section_number, l_orderkey, l_linenumber, row_number() over (partition by section_number order by l_orderkey, l_linenumber) - 1 as rank,
    count(*) over (partition by section_number) as n from fx_points), picks as (select distinct section_number, cast(floor(i * ((n - 1) / 99.0::double)) as bigint) as rank
    from (select distinct section_number, n from ranked) s, range(100) t(i))
    select section_number, l_orderkey, l_linenumber from ranked join picks using (section_number, rank)"""
)
def stride_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred rows of each section."""
    rows = view(spark, sf, "fx_points").select("section_number", "l_orderkey", "l_linenumber")
    return pixels.stride_sample(rows, 100, ("l_orderkey", "l_linenumber"))


@query("""select o_orderkey, cast(o_orderkey % 1000 as int) as section_number from orders""")
def section_numbers(spark: SparkSession, sf: str) -> DataFrame:
    name = F.format_string("/data/run_7/mouse_12_s%03d.png", F.col("o_orderkey") % 1000)
    return table(spark, sf, "orders").select("o_orderkey", section_number(name).alias("section_number"))


# --- volumes -------------------------------------------------------------------------

_SCALED = "pts as (select vec_id, cast(vec_id % 5 as int) as section_number, cast(vec_id % 7 as int) as component, (x + 1) * 10 as x, (y + 1) * 8 as y, (z + 1) * 6 as z, cast(vec_id % 11 as double) as value, vec_id % 3 = 0 as undamaged from fx_xyz)"
_VOXELS = f"""{_SCALED}, vox as (select cast(round_even(x, 0) as int) as x, cast(round_even(y, 0) as int) as y, cast(round_even(z, 0) as int) as z, cast(count(*) as bigint) as freq, sum(value) as total,
    cast(max(case when undamaged then 1 else 0 end) as int) as damage, cast(count(distinct section_number * 100 + component) filter (where component > 0) as bigint) as objects from pts
    where round_even(x, 0) between 0 and 19 and round_even(y, 0) between 0 and 15 and round_even(z, 0) between 0 and 11 group by 1, 2, 3)"""
_SHAPE = (20, 16, 12)


def _voxels(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "fx_xyz").withColumns({"x": (F.col("x") + 1) * 10, "y": (F.col("y") + 1) * 8, "z": (F.col("z") + 1) * 6})
    key = F.col("vec_id")
    rows = rows.withColumns({"section_number": (key % 5).cast("int"), "component": (key % 7).cast("int"), "value": (key % 11).cast("double"), "undamaged": key % 3 == 0})
    return volume.voxelise(rows, _SHAPE)


@query(f"{ctes('fx_xyz')}, {_VOXELS} select x, y, z, freq, total, damage, objects from vox")
def voxelise(spark: SparkSession, sf: str) -> DataFrame:
    return _voxels(spark, sf)


@query(f"{ctes('fx_xyz')}, {_VOXELS} select x, y, z, total / freq as value from vox")
def value_mode_mean(spark: SparkSession, sf: str) -> DataFrame:
    return volume.with_values(_voxels(spark, sf), "mean").select("x", "y", "z", "value")


@query(f"{ctes('fx_xyz')}, {_VOXELS} select x, y, z, cast(objects as double) as value from vox")
def value_mode_objects(spark: SparkSession, sf: str) -> DataFrame:
    return volume.with_values(_voxels(spark, sf), "object_count").select("x", "y", "z", "value")


_NEAREST = f"""{_VOXELS}, grid as (select cast(a.x as int) as x, cast(b.y as int) as y, cast(c.z as int) as z from range(20) a(x), range(16) b(y), range(12) c(z)),
    near as (select g.x, g.y, g.z, total as v, damage, row_number() over (partition by g.x, g.y, g.z order by (g.x-v.x)*(g.x-v.x) + (g.y-v.y)*(g.y-v.y) + (g.z-v.z)*(g.z-v.z), v.x, v.y, v.z) as place from grid g, vox v)"""


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(20 * 16 * 12).selectExpr("cast(id div 192 as int) x", "cast(id div 12 % 16 as int) y", "cast(id % 12 as int) z")


@query(f"{ctes('fx_xyz')}, {_NEAREST} select x, y, z, round(avg(v), 6) as value from near where place <= 5 group by x, y, z")
def knn_fill(spark: SparkSession, sf: str) -> DataFrame:
    covered = volume.with_values(_voxels(spark, sf))
    filled = volume.fill_nearest(_grid(spark), covered, 5)
    return filled.withColumn("value", F.round("value", 6))


@query(f"{ctes('fx_xyz')}, {_NEAREST} select n.x, n.y, n.z, round(avg(v), 6) as value, coalesce(any_value(freq), 0) as freq, cast(max(n.damage) as int) as damage from near n left join vox on vox.x = n.x and vox.y = n.y and vox.z = n.z where place <= 5 group by n.x, n.y, n.z")
def damage_volume(spark: SparkSession, sf: str) -> DataFrame:
    done = volume.finish(_voxels(spark, sf), _grid(spark))
    return done.withColumn("value", F.round("value", 6))


# --- exports -------------------------------------------------------------------------

_TRIPLETS = "cast(3 * count(*) as bigint) as n_numbers, cast(sum(l_orderkey) as bigint) as xs, cast(sum(l_linenumber) as bigint) as ys, cast(sum(intensity) as bigint) as zs"

@query(
    ctes("fx_points", "fx_labels")
    + """, ranked as (select *, dense_rank() over (order by label) - 1 as place from fx_points)
    select cast(place as int) as idx, cast(count(*) as bigint) as count, name, r, g, b, """
    + _TRIPLETS
    + """ from ranked join fx_labels l on l.idx = label group by place, name, r, g, b"""
)
def cloud_regions(spark: SparkSession, sf: str) -> DataFrame:
    points = view(spark, sf, "fx_points").select("label", F.col("l_orderkey").alias("x"), F.col("l_linenumber").cast("long").alias("y"), F.col("intensity").alias("z"))
    clouds = exports.region_clouds(points, view(spark, sf, "fx_labels"))
    return _summed(clouds)


_RGB = "rgb as (select cast(l_orderkey % 256 as int) as r, cast(l_linenumber * 30 as int) as g, cast(intensity * 5 as int) as b, l_orderkey, l_linenumber, intensity from fx_points)"


def _rgb(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "fx_points")
    shades = {"r": F.col("l_orderkey") % 256, "g": F.col("l_linenumber") * 30, "b": F.col("intensity") * 5}
    return rows.select(*[c.cast("int").alias(n) for n, c in shades.items()], F.col("l_orderkey").alias("x"), F.col("l_linenumber").cast("long").alias("y"), F.col("intensity").alias("z"))


def _summed(clouds: DataFrame) -> DataFrame:
    """Clouds with all their parts' triplets summed up."""
    along = lambda n: F.sum(F.aggregate(F.filter("triplets", lambda v, i: i % 3 == n), F.lit(0).cast("long"), lambda a, v: a + v))
    whole = clouds.groupBy("idx", "count", "name", "r", "g", "b")
    return whole.agg(F.sum(F.size("triplets")).alias("n_numbers"), along(0).alias("xs"), along(1).alias("ys"), along(2).alias("zs"))


@query(
    ctes("fx_points")
    + f""", {_RGB}, n as (select count(*) as c from (select distinct r, g, b from rgb)),
    steps as (select l_orderkey, l_linenumber, intensity, case when c > 1024 then cast(least(round_even(r / 8.0::double, 0) * 8, 255) as int) else r end as r, case when c > 1024 then cast(least(round_even(g / 8.0::double, 0) * 8, 255) as int) else g end as g,
    case when c > 1024 then cast(least(round_even(b / 8.0::double, 0) * 8, 255) as int) else b end as b from rgb, n)
    select cast(dense_rank() over (order by r, g, b) - 1 as int) as idx, cast(count(*) as bigint) as count, concat('Color ', r, ',', g, ',', b) as name, r, g, b, {_TRIPLETS} from steps group by r, g, b"""
)
def cloud_rgb(spark: SparkSession, sf: str) -> DataFrame:
    return _summed(exports.rgb_clouds(_rgb(spark, sf)))


@query(
    ctes("fx_points")
    + f"""select cast(intensity as int) as idx, cast(count(*) as bigint) as count, concat('Intensity ', intensity) as name,
    cast(floor(least(1, intensity / 255.0::double * 3) * 255) as int) as r, cast(floor(least(1, greatest(0, intensity / 255.0::double * 3 - 1)) * 255) as int) as g, 0 as b, {_TRIPLETS} from fx_points group by intensity"""
)
def cloud_scalar(spark: SparkSession, sf: str) -> DataFrame:
    points = view(spark, sf, "fx_points").select(F.col("l_orderkey").alias("x"), F.col("l_linenumber").cast("long").alias("y"), F.col("intensity").alias("z"), F.col("intensity").alias("value"))
    return _summed(exports.scalar_clouds(points, "hot"))


_T = "(v / 255.0::double)"
_MAPS = {
    "gray": ("v", "v", "v"),
    "viridis": (f"(1 - {_T}) * 255", f"{_T} * 255", f"(0.5::double + 0.5::double * {_T}) * 255"),
    "plasma": (f"{_T} * 255", f"(1 - {_T}) * 255", f"(1 - 0.5::double * {_T}) * 255"),
    "magma": (f"{_T} * 255", f"{_T} * {_T} * 255", f"(1 - {_T}) * 255"),
    "hot": tuple(f"least(1, greatest(0, {_T} * 3 - {k})) * 255" for k in range(3)),
}


@query(" union all ".join(f"select '{n}' as colormap, cast(v as int) as value, {', '.join(f'cast(floor({e}) as int) as {c}' for e, c in zip(m, 'rgb', strict=True))} from range(256) t(v)" for n, m in _MAPS.items()))
def colormaps(spark: SparkSession, sf: str) -> DataFrame:
    every = None
    for name in _MAPS:
        rows = colours.table_of(spark, name).select(F.lit(name).alias("colormap"), "value", "r", "g", "b")
        every = rows if every is None else every.unionByName(rows)
    return every


@query(
    ctes("fx_raster")
    + """, s as (select min(v) as lo, max(v) as hi from fx_raster) select section_number, y, x, cast(round_even((v - lo) / (hi - lo) * 255, 0) as int) as u8 from fx_raster, s"""
)
def scale_u8(spark: SparkSession, sf: str) -> DataFrame:
    return numeric.scale_to_u8(view(spark, sf, "fx_raster"), "v").drop("v")


@query(f"{ctes('fx_points')}, {_RGB} select l_orderkey, cast(floor(0.2989::double * r + 0.5870::double * g + 0.1140::double * b) as int) as luma from rgb")
def luma(spark: SparkSession, sf: str) -> DataFrame:
    return _rgb(spark, sf).select(F.col("x").alias("l_orderkey"), colours.luma(F.col("r"), F.col("g"), F.col("b")).alias("luma"))


# the queries that go through files register themselves
from . import file_queries  # noqa: E402, F401
