"""Entry points: coordinates, segmentations and images to atlas space, region
tables and volumes. All of them are plans over whole series; a section is never
a loop in the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Atlas, Extraction
from ..operators import geometry, objects, pixels, regions, volume, warp
from ..operators.geometry import PLANE
from ..sinks.exports import section_pictures
from ..sources.files import image_files, index_by_stem
from ..sources.rasters import folder_pixels, image_sizes
from ..sources.registration import read_fields
from ..storage import durable

#: A segmentation format: which pixels are foreground, and what tells objects
#: apart (None: connected components).
FORMATS: dict[str, tuple[Callable[[object], Column], str | None]] = {
    "binary": (lambda pixel_id: pixels.matches_colour(tuple(pixel_id), ["c0", "c1", "c2"]), None),
    "cellpose": (lambda pixel_id: pixels.nonzero("c0"), "c0"),
}


def register_format(name: str, foreground: Callable[[object], Column], objects_by: str | None = None) -> None:
    FORMATS[name] = (foreground, objects_by)


def format_of(name: str) -> tuple[Callable[[object], Column], str | None]:
    if name not in FORMATS:
        raise ValueError(f"unknown segmentation format {name!r}; there are {sorted(FORMATS)}")
    return FORMATS[name]


def warps_of(sections: DataFrame, both_ways: bool = False) -> warp.Warps | None:
    """What moves points of the sections: markers' triangles, and the displacement
    fields in their folders; None where there is neither. Sections are tens to
    thousands."""
    rows = sections.filter("markers is not null and size(markers) > 0").select("section_number", "width", "height", "markers").collect()
    triangles = warp.triangle_table(sections.sparkSession, [r.asDict() for r in rows]) if rows else None
    fields = read_fields(sections) if "field_folder" in sections.columns else None
    if triangles is None and fields is None:
        return None
    inverse = durable(warp.inverse_fields(sections, fields)) if fields is not None and both_ways else None
    return warp.Warps(triangles, fields, inverse)


def section_maps(sections: DataFrame, atlas: Atlas, warps: warp.Warps | None = None) -> DataFrame:
    """Label (and hemi) of every cell of every section's slice, warped where the
    section has a warp."""
    raster = geometry.slice_atlas(sections, atlas.voxels)
    if warps is None:
        return raster
    sizes = sections.select("section_number", "width", "height")
    grid = raster.select("section_number", "map_width", "map_height", "y", "x").join(sizes, "section_number")
    grid = grid.withColumns({"rx": F.col("x") * F.col("width") / F.col("map_width").cast("double"), "ry": F.col("y") * F.col("height") / F.col("map_height").cast("double")})
    grid = warps.move(grid, "rx", "ry")
    return warp.warp_raster(raster, warp.source_cells(grid)).drop("rx", "ry", "wx", "wy", "sx", "sy", "width", "height")


def map_areas(maps: DataFrame, damage: DataFrame, sizes: DataFrame, with_hemi: bool, polarity: str = "reference") -> DataFrame:
    """Areas of regions per section, in segmentation pixels. sizes:
    section_number, seg_width, seg_height. Sections without a damage grid have no
    damaged or undamaged areas."""
    scaled = maps.join(sizes, "section_number").withColumn("scale", F.col("seg_width") * F.col("seg_height") / (F.col("map_width") * F.col("map_height")).cast("double"))
    masked = damage.select("section_number").distinct()
    plain = regions.region_areas(scaled.join(masked, "section_number", "left_anti"), with_hemi, False, polarity)
    inside = scaled.join(masked, "section_number", "left_semi").join(damage.select("section_number", "mask_width", "mask_height").distinct(), "section_number")
    inside = inside.withColumns(
        {"row": F.floor(F.col("y") * F.col("mask_height") / F.col("map_height")).cast("int"), "col": F.floor(F.col("x") * F.col("mask_width") / F.col("map_width")).cast("int")}
    )
    flagged = inside.join(damage.select("section_number", "row", "col", "undamaged"), ["section_number", "row", "col"], "left")
    return regions.region_areas(flagged, with_hemi, True, polarity).unionByName(plain, allowMissingColumns=True)


def place(points: DataFrame, sections: DataFrame, warps: warp.Warps | None, x: str, y: str) -> DataFrame:
    """Adds ax, ay, az: registration coordinates warped, then through the plane."""
    plane = sections.select("section_number", *PLANE)
    moved = points.withColumns({"wx": F.col(x), "wy": F.col(y)}) if warps is None else warps.move(points, x, y)
    return geometry.to_atlas(moved.join(plane, "section_number"), "wx", "wy").drop("wx", "wy", *PLANE)


def turned(points: DataFrame, atlas: Atlas, orientation: str) -> DataFrame:
    named = points.select(*[c for c in points.columns if c not in ("x", "y", "z", "ax", "ay", "az")], *[F.col(f"a{a}").alias(a) for a in "xyz"])
    return geometry.reorient(named, atlas.shape, orientation)


def voxel_cells(points: DataFrame, sections: DataFrame, warps: warp.Warps | None = None) -> DataFrame:
    """Adds lx, ly, lz: the voxel below the map cell that each point (rx, ry) falls
    into, null outside. It is found by arithmetic; no map is made."""
    plane = sections.select("section_number", *PLANE).join(geometry.map_sizes(sections), "section_number")
    at = points.drop("label", "hemi").join(plane, "section_number")
    at = at.withColumn("sy", geometry.floor_cell(F.col("ry"), F.col("height"), F.col("map_height")))
    at = at.withColumn("sx", geometry.floor_cell(F.col("rx"), F.col("width"), F.col("map_width")))
    inside = lambda: (F.col("sx") >= 0) & (F.col("sy") >= 0) & (F.col("sx") < F.col("map_width")) & (F.col("sy") < F.col("map_height"))
    at = at.withColumn("_in", inside())
    if warps is not None:
        at = at.withColumns({"_cx0": F.col("sx") * F.col("width") / F.col("map_width").cast("double"), "_cy0": F.col("sy") * F.col("height") / F.col("map_height").cast("double")})
        at = warp.source_cells(warps.move(at, "_cx0", "_cy0"))
        at = at.withColumn("_in", F.col("_in") & inside()).drop("wx", "wy", "_cx0", "_cy0")
    cells = [F.when(F.col("_in"), c).alias(n) for c, n in zip(geometry.voxel_below(F.col("sx"), F.col("sy")), ("lx", "ly", "lz"), strict=True)]
    return at.select(*points.drop("label", "hemi").columns, *cells)


def labelled(points: DataFrame, sections: DataFrame, atlas: Atlas, warps: warp.Warps | None = None) -> DataFrame:
    """Adds label and hemi of the map cell that each point (rx, ry) falls into; 0
    outside. Points meet the volume in one equi-join."""
    found = geometry.with_voxels(voxel_cells(points, sections, warps), atlas.voxels).drop("lx", "ly", "lz")
    return found if atlas.has_hemi else found.withColumn("hemi", F.lit(None).cast("int"))


def narrowed(atlas: Atlas, points: DataFrame, sections: DataFrame, warps: warp.Warps | None = None) -> Atlas:
    """The atlas with those voxels alone that the points and the slices of the
    sections look up, so that the volume is read and shuffled once for both."""
    cells = voxel_cells(points, sections, warps)
    return replace(atlas, voxels=geometry.needed_voxels(atlas.voxels, cells, geometry.slice_grid(sections)))


def xy_to_atlas(coordinates: DataFrame, sections: DataFrame, atlas: Atlas, orientation: str = "asr") -> Extraction:
    """coordinates: section_number, x, y, image_width, image_height, ordinal.
    A section's image size is that of its first row; every point is an object;
    sections without registration are left out."""
    geometry.check_orientation(orientation)
    first = F.min_by(F.struct("image_width", "image_height"), F.col("ordinal")).alias("_s")
    sizes = coordinates.groupBy("section_number").agg(first).select("section_number", F.col("_s.image_width").alias("seg_width"), F.col("_s.image_height").alias("seg_height"))
    sizes = durable(sizes)  # a row per section; the coordinates are read once for them
    used = durable(sections.join(sizes.select("section_number"), "section_number", "left_semi"))
    points = coordinates.select("section_number", "ordinal", "x", "y").join(sizes, "section_number").join(used.select("section_number", "width", "height"), "section_number")
    points = points.withColumns({"rx": geometry.scaled(F.col("x"), F.col("seg_width"), F.col("width")), "ry": geometry.scaled(F.col("y"), F.col("seg_height"), F.col("height"))})
    warps, damage = warps_of(used), warp.damage_cells(used)
    atlas = narrowed(atlas, points, used, warps)
    maps = section_maps(used, atlas, warps)
    found = labelled(points, used, atlas, warps)
    found = warp.flag_damage(found, damage, F.col("width"), F.col("height"), "rx", "ry")
    found = place(found, used, warps, "rx", "ry")
    result = turned(found.drop("x", "y", "rx", "ry", "seg_width", "seg_height", "width", "height"), atlas, orientation)
    return Extraction(result, result, map_areas(maps, damage, sizes, atlas.has_hemi), None, None, orientation, atlas.shape, atlas.has_hemi)


def _foreground(rows: DataFrame, name: str, pixel_id: object) -> DataFrame:
    foreground, _ = format_of(name)
    if pixel_id == "auto" and name == "binary":
        chosen = pixels.auto_colour(rows.withColumn("value", F.struct("c0", F.coalesce("c1", F.lit(-1)).alias("c1"), F.coalesce("c2", F.lit(-1)).alias("c2"))).select("section_number", F.to_json("value").alias("value")))
        keyed = rows.withColumn("_v", F.to_json(F.struct("c0", F.coalesce("c1", F.lit(-1)).alias("c1"), F.coalesce("c2", F.lit(-1)).alias("c2"))))
        return keyed.join(chosen, "section_number").filter("_v = pixel_id").drop("_v", "pixel_id")
    grey = F.col("c1").isNull()
    return rows.filter(F.when(grey, F.col("c0") == tuple(pixel_id)[0]).otherwise(foreground(pixel_id)) if name == "binary" else foreground(pixel_id))


def section_sizes(files: DataFrame) -> DataFrame:
    """section_number, seg_width and seg_height of all sections with an image,
    from the images' headers: an image without foreground counts as well."""
    size = F.min_by(F.struct("seg_width", "seg_height"), "path").alias("_s")
    return durable(image_sizes(files).groupBy("section_number").agg(size).select("section_number", "_s.*"))


def segmentation_to_atlas(spark: SparkSession, folder: str, sections: DataFrame, atlas: Atlas, pixel_id: object = (0, 0, 0),
                          cutoff: int = 0, name: str = "binary", orientation: str = "asr") -> Extraction:
    """Foreground pixels are points; objects are components or labels of more
    than `cutoff` pixels, at their centroid, in the region most of their pixels
    are in. Images without a section are listed and otherwise left out."""
    geometry.check_orientation(orientation)
    files = image_files(spark, folder)
    sizes = section_sizes(files)
    rows = folder_pixels(spark, folder, files, foreground=name != "binary")
    front = _foreground(rows, name, pixel_id).select("section_number", "y", "x", F.col("c0").alias("component"))
    by = format_of(name)[1]
    members = durable(front if by else objects.connected_pixels(front))  # each image is decoded and labelled once
    registered = sections.select("section_number", "width", "height")
    used = durable(sections.join(sizes.select("section_number"), "section_number", "left_semi"))
    warps, damage = warps_of(used), warp.damage_cells(used)
    maps = durable(section_maps(used, atlas, warps))

    def to_registration(df: DataFrame) -> DataFrame:
        at = df.join(sizes, "section_number").join(registered, "section_number")
        return at.withColumns({"rx": geometry.scaled(F.col("x"), F.col("seg_width"), F.col("width")), "ry": geometry.scaled(F.col("y"), F.col("seg_height"), F.col("height"))})

    points = labelled(to_registration(members), used, atlas, warps)
    points = warp.flag_damage(points, damage, F.col("width"), F.col("height"), "rx", "ry")
    points = place(points, used, warps, "rx", "ry")

    votes = members.join(sizes, "section_number").join(geometry.map_sizes(sections), "section_number")
    votes = votes.withColumns({"_r": geometry.nearest_cell(F.col("y"), F.col("seg_height"), F.col("map_height")), "_c": geometry.nearest_cell(F.col("x"), F.col("seg_width"), F.col("map_width"))})
    cells = maps.select("section_number", F.col("y").cast("long").alias("_r"), F.col("x").cast("long").alias("_c"), "label")
    voted = objects.majority_labels(votes.join(cells, ["section_number", "_r", "_c"], "left"))
    table = objects.object_table(members, cutoff=cutoff).withColumnsRenamed({"cy": "y", "cx": "x"})
    centres = labelled(to_registration(table), used, atlas, warps).drop("label").join(voted, ["section_number", "component"])
    centres = warp.flag_damage(centres, damage, F.col("width"), F.col("height"), "rx", "ry")
    centres = place(centres, used, warps, "rx", "ry")
    extra = ("rx", "ry", "seg_width", "seg_height", "width", "height")
    lengths = members.groupBy("section_number").agg(F.count("*").alias("n_points"))
    listed = files.select("path", "section_number").join(lengths.join(registered, "section_number", "left_semi"), "section_number", "left").fillna(0, ["n_points"]).orderBy("path")
    return Extraction(turned(points.drop(*extra), atlas, orientation), turned(centres.drop(*extra), atlas, orientation),
                      map_areas(maps, damage, sizes, atlas.has_hemi), None, listed, orientation, atlas.shape, atlas.has_hemi)


def _at_registration(maps: DataFrame, sections: DataFrame) -> DataFrame:
    """Section maps stretched over the registration, cell by cell."""
    grid = sections.select("section_number", "width", "height").join(geometry.map_sizes(sections), "section_number")
    grid = grid.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    grid = grid.withColumns({"_r": geometry.resized_cell(F.col("y"), F.col("map_height"), F.col("height")).cast("int"), "_c": geometry.resized_cell(F.col("x"), F.col("map_width"), F.col("width")).cast("int")})
    cells = maps.select("section_number", F.col("y").alias("_r"), F.col("x").alias("_c"), "label", *(["hemi"] if "hemi" in maps.columns else []))
    return grid.join(cells, ["section_number", "_r", "_c"]).drop("_r", "_c", "map_width", "map_height")


def image_to_atlas(spark: SparkSession, folder: str, sections: DataFrame, atlas: Atlas, channel: str = "grayscale", low: float | None = None,
                   high: float | None = None, orientation: str = "asr", most: int = pixels.SAMPLE) -> Extraction:
    """Intensity per region, and at most `most` signal pixels of each section with
    their value and colour. Images are brought to registration size by the mean
    of what a cell covers; a grey image's colour is its value."""
    from ..functions.colours import channel as plane
    from ..functions.colours import luma

    geometry.check_orientation(orientation)
    files = image_files(spark, folder)
    rows = folder_pixels(spark, folder, files)
    grey = F.when(F.col("c1").isNull(), F.col("c0").cast("double")).otherwise(plane(F.col("c0"), F.col("c1"), F.col("c2"), channel))
    rows = rows.withColumn("value", pixels.bounded(grey, low, high))
    sizes = section_sizes(files)
    registered = sections.select("section_number", "width", "height")
    at = rows.select("section_number", "y", "x", "value", "c0", "c1", "c2").join(sizes, "section_number").join(registered, "section_number")
    for axis, n, m in (("y", "seg_height", "height"), ("x", "seg_width", "width")):
        step = F.col(m) / F.col(n).cast("double")
        first = F.floor(F.col(axis) * step + 1e-9)
        last = F.greatest(first, F.least(F.ceil((F.col(axis) + 1) * step - 1e-9) - 1, F.col(m) - 1))
        at = at.withColumn(f"_{axis}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        at = at.withColumn(f"_w{axis}", F.least((F.col(axis) + 1) * step, F.col(f"_{axis}") + 1) - F.greatest(F.col(axis) * step, F.col(f"_{axis}")))
    weight = F.col("_wy") * F.col("_wx")
    mean = lambda c: F.sum(F.col(c) * weight) / F.sum(weight)
    small = at.groupBy("section_number", F.col("_y").alias("y"), F.col("_x").alias("x")).agg(mean("value").alias("value"), *[mean(c).alias(c) for c in ("c0", "c1", "c2")])
    small = small.withColumn("value", pixels.bounded(F.col("value"), low, high))
    shades = {n: F.rint(F.when(F.col("c1").isNull(), F.col("value")).otherwise(F.col(c))).cast("int") for n, c in (("b", "c0"), ("g", "c1"), ("r", "c2"))}
    small = small.withColumns(shades).drop("c0", "c1", "c2")
    light = luma(F.col("r"), F.col("g"), F.col("b"), whole=False)
    dark = (F.lit(low is not None) & (light < (low or 0))) | (F.lit(high is not None) & (light > (high or 0)))
    small = small.withColumns({c: F.when(dark, 0).otherwise(F.col(c)) for c in "rgb"})
    used = durable(sections.join(sizes.select("section_number"), "section_number", "left_semi"))
    warps, damage = warps_of(used), warp.damage_cells(used)
    maps = durable(section_maps(used, atlas, warps))
    cells = _at_registration(maps, used).join(small, ["section_number", "y", "x"])
    cells = durable(warp.flag_damage(cells, damage, F.col("width"), F.col("height")))
    series = regions.region_intensities(cells, atlas.has_hemi)
    shown = cells.filter(pixels.signal(low, high) & F.col("undamaged"))
    shown = pixels.stride_sample(shown, most).withColumns({"rx": F.col("x").cast("double"), "ry": F.col("y").cast("double")})
    hemi = F.col("hemi") if atlas.has_hemi else F.lit(0)
    points = place(shown.withColumn("hemi", hemi), used, warps, "rx", "ry")
    points = turned(points.drop("rx", "ry", "width", "height"), atlas, orientation)
    return Extraction(points, None, map_areas(maps, damage, sizes, atlas.has_hemi), series, files.select("path", "section_number").orderBy("path"), orientation, atlas.shape, atlas.has_hemi)


def section_visuals(spark: SparkSession, sections: DataFrame, atlas: Atlas, folder: str, segmentations: str | None = None, scale: float = 0.5,
                    pixel_id: object = (0, 0, 0), name: str = "binary") -> DataFrame:
    """Pictures of the sections' atlas slices in folder/visualisations, at the
    segmentation's size times scale, or else the registration's; segmentation
    pixels invert the colours. A section's segmentation is the image in the folder
    that has its file name but for the ending. Rows (section_number, path, error)."""
    stem = F.regexp_replace(F.element_at(F.split(F.coalesce("section_id", F.lit("")), "/"), -1), r"\.[^.]*$", "")
    named = sections.withColumn("stem", stem)
    place = F.row_number().over(Window.orderBy("ordinal")) - 1  # sections are tens to thousands
    named = named.withColumn("name", F.concat(F.format_string("section_%03d_", "section_number"), F.when(stem != "", stem).otherwise(F.format_string("slice_%03d", place)), F.lit("_atlas_colored.png")))
    marks = None
    if segmentations is not None:
        files = image_files(spark, segmentations)
        chosen = named.select("section_number", "stem").join(index_by_stem(files).select("stem", "path"), "stem")
        own = files.drop("section_number").join(chosen, "path").select("path", "content", "section_number")
        named = named.join(section_sizes(own), "section_number", "left")
    else:
        named = named.withColumns({c: F.lit(None).cast("int") for c in ("seg_width", "seg_height")})
    named = named.join(geometry.map_sizes(sections), "section_number")
    for side in ("width", "height"):
        known = (F.col("width") > 0) & (F.col("height") > 0)
        size = F.coalesce(f"seg_{side}", F.when(known, F.col(side)), F.col(f"map_{side}"))
        named = named.withColumn(f"out_{side}", F.greatest(F.lit(1), F.floor(size * scale).cast("int")))
    named = durable(named)
    grid = named.select("section_number", "out_width", "out_height", "map_width", "map_height", "seg_width", "seg_height")
    grid = grid.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("out_height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("out_width") - 1)))
    at = lambda axis, side, kind: geometry.resized_cell(F.col(axis), F.col(f"{kind}_{side}"), F.col(f"out_{side}")).cast("int")
    cells = geometry.slice_atlas(sections, atlas.voxels).select("section_number", F.col("y").alias("_r"), F.col("x").alias("_c"), "label")
    slices = grid.withColumns({"_r": at("y", "height", "map"), "_c": at("x", "width", "map")}).join(cells, ["section_number", "_r", "_c"])
    if segmentations is not None:
        rows = folder_pixels(spark, segmentations, own).join(chosen.select("path", "section_number").withColumnRenamed("section_number", "_n"), "path").withColumn("section_number", F.col("_n")).drop("_n")
        front = _foreground(rows, name, pixel_id).select("section_number", F.col("y").alias("_r"), F.col("x").alias("_c"))
        marks = grid.filter("seg_width is not null").withColumns({"_r": at("y", "height", "seg"), "_c": at("x", "width", "seg")}).join(front, ["section_number", "_r", "_c"], "left_semi")
    return section_pictures(slices, atlas.labels, f"{folder}/visualisations", marks, named)


def quantify(result: Extraction, labels: DataFrame) -> DataFrame:
    """The region table of an extraction."""
    if result.intensities is not None:
        return regions.quantify_intensity(regions.combine_intensities(result.intensities), labels)
    counts = regions.region_counts(result.points, result.objects, labels, result.with_hemi, result.with_damage)
    areas = regions.combine_areas(result.areas) if result.areas is not None else None
    return regions.region_table(counts, labels, areas)


def parse_colour(colour: object) -> object:
    """`auto` for nothing, "auto" or an empty text; numbers otherwise."""
    if colour is None or (isinstance(colour, str) and colour.strip().lower() in ("", "auto")):
        return "auto"
    if isinstance(colour, str):
        parts = [p.strip() for p in colour.strip().strip("[]").split(",") if p.strip()]
        if not parts or not all(p.isdigit() for p in parts):
            raise ValueError(f"a colour is auto, a number or numbers with commas, not {colour!r}")
        return tuple(map(int, parts))
    return tuple(colour)


def plane_samples(signal: DataFrame, sizes: DataFrame, sections: DataFrame, scale: float = 1.0, objects_too: bool = False) -> DataFrame:
    """Each section's plane in cells of 1/scale voxel: x, y, z of the volume,
    value, undamaged (true where a section's damage mask says so) and component.

    signal: section_number, y, x, value of image pixels that are not 0; sizes:
    section_number, seg_width, seg_height. A cell takes the pixel nearest to its
    centre, moved by the forward warp; outside it is 0."""
    used = sections.join(sizes, "section_number")
    for name, p in (("plane_w", "u"), ("plane_h", "v")):
        length = geometry.norm(*(F.col(p + a) for a in "xyz"))
        used = used.withColumn(name, F.greatest(F.lit(1), F.rint(length * scale).cast("int")))
    grid = used.select("section_number", "width", "height", "seg_width", "seg_height", "plane_w", "plane_h", *PLANE)
    grid = grid.withColumn("py", F.explode(F.sequence(F.lit(0), F.col("plane_h") - 1))).withColumn("px", F.explode(F.sequence(F.lit(0), F.col("plane_w") - 1)))
    grid = grid.withColumns({"rx": (F.col("px") + 0.5) * F.col("width") / F.col("plane_w"), "ry": (F.col("py") + 0.5) * F.col("height") / F.col("plane_h")})
    warps = warps_of(used, both_ways=True)
    grid = warps.move(grid, "rx", "ry", forward=True) if warps is not None else grid.withColumns({"wx": F.col("rx"), "wy": F.col("ry")})
    at = grid.withColumns({"_c": F.rint("wx").cast("int"), "_r": F.rint("wy").cast("int")})
    inside = (F.col("_c") >= 0) & (F.col("_c") < F.col("width")) & (F.col("_r") >= 0) & (F.col("_r") < F.col("height"))
    cells = {"x": geometry.resized_cell(F.col("_c"), F.col("seg_width"), F.col("width")), "y": geometry.resized_cell(F.col("_r"), F.col("seg_height"), F.col("height"))}
    at = at.withColumns({n: F.when(inside, c).cast("int") for n, c in cells.items()})
    found = at.join(signal.select("section_number", "y", "x", "value"), ["section_number", "y", "x"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    damage = warp.damage_cells(sections)
    masked = damage.select("section_number").distinct().withColumn("_m", F.lit(True))
    found = warp.flag_damage(found.join(masked, "section_number", "left"), damage, F.col("width"), F.col("height"), "wx", "wy")
    found = found.withColumn("undamaged", F.coalesce("_m", F.lit(False)) & F.col("undamaged") & inside)
    if objects_too:
        front = found.filter("value <> 0").select("section_number", F.col("py").alias("y"), F.col("px").alias("x"))
        marks = objects.connected_pixels(front, 8).withColumnsRenamed({"y": "py", "x": "px"})
        found = found.join(marks, ["section_number", "py", "px"], "left").withColumn("component", F.coalesce("component", F.lit(0)))
    placed = geometry.to_atlas(found, "rx", "ry")
    return placed.select("section_number", *[(F.col(f"a{a}") * scale).alias(a) for a in "xyz"], "value", "undamaged", *(["component"] if objects_too else []))


def volume_from_images(spark: SparkSession, folder: str, sections: DataFrame, atlas: Atlas, colour: object = "auto", scale: float = 1.0, mode: str = "pixel_count",
                       k: int = 5, interpolate: bool = True, use_mask: bool = True, missing: float = float("nan"), name: str = "binary", segmentation: bool = True,
                       channel: str = "grayscale", low: float | None = None, high: float | None = None, orientation: str = "asr") -> DataFrame:
    """The heat map of a folder of section images."""
    from ..functions.colours import channel as plane

    volume.value_of(mode)
    files = image_files(spark, folder)
    rows, sizes = folder_pixels(spark, folder, files), section_sizes(files)
    if segmentation:
        pixel_id = parse_colour(colour)
        signal = _foreground(rows, name, pixel_id if name == "binary" else None).select("section_number", "y", "x", F.lit(1.0).alias("value"))
    else:
        grey = F.when(F.col("c1").isNull(), F.col("c0").cast("double")).otherwise(plane(F.col("c0"), F.col("c1"), F.col("c2"), channel))
        signal = rows.select("section_number", "y", "x", pixels.bounded(grey, low, high).alias("value")).filter("value <> 0")
        if mode != "mean":
            signal = signal.withColumn("value", F.lit(1.0))
    samples = plane_samples(signal, sizes, sections, scale, mode == "object_count")
    return _volume(samples, atlas, scale, mode, k, interpolate, use_mask, missing, orientation, 1.0)


def interpolated_volume(points: DataFrame, atlas: Atlas, scale: float = 1.0, mode: str = "pixel_count", k: int = 5, interpolate: bool = True,
                        use_mask: bool = True, missing: float = float("nan"), orientation: str = "asr") -> DataFrame:
    """Voxels with value, freq and damage, of points in internal orientation. The
    atlas masks them only at its own scale."""
    volume.value_of(mode)
    return _volume(points, atlas, scale, mode, k, interpolate, use_mask, missing, orientation, scale)


def _volume(points: DataFrame, atlas: Atlas, scale: float, mode: str, k: int, interpolate: bool, use_mask: bool, missing: float, orientation: str, step: float) -> DataFrame:
    shape = volume.volume_shape(atlas.shape, scale)
    spark = points.sparkSession
    covered = volume.voxelise(points, shape, step)
    n = shape[0] * shape[1] * shape[2]
    at = F.col("id")
    grid = spark.range(n).select(*(c.cast("int").alias(a) for a, c in zip("xyz", (F.floor(at / (shape[1] * shape[2])), F.floor(at / shape[2]) % shape[1], at % shape[2]), strict=True)))
    if use_mask and shape == tuple(atlas.shape):
        grid = volume.in_atlas(grid, atlas.voxels)
    found = volume.finish(covered, grid, interpolate, k, missing, mode)
    return geometry.reorient(found, shape, orientation, flip_offset=1)
