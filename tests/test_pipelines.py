"""Entry points on images made here, exports, warps, and invariants."""

from __future__ import annotations

import gzip
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.model import Atlas
from voxelloom.operators import geometry, objects, pixels, regions, volume, warp
from voxelloom.plans import pipelines
from voxelloom.sinks import exports
from voxelloom.sources import rasters, registration, tables
from voxelloom.streaming import counts

SHAPE = (20, 10, 16)


@pytest.fixture(scope="module")
def atlas(spark):
    voxels = spark.range(SHAPE[0] * SHAPE[1] * SHAPE[2]).selectExpr("cast(id div 160 as int) x", "cast(id div 16 % 10 as int) y", "cast(id % 16 as int) z")
    voxels = voxels.withColumns({"label": F.expr("case when z < 8 then 1 when x < 10 then 2 else 3 end").cast("long"), "hemi": F.expr("case when x < 10 then 1 else 2 end")})
    labels = spark.createDataFrame([(1, "low", 10, 0, 0, 0), (2, "left", 0, 20, 0, 1), (3, "right", 0, 0, 30, 2)], "idx long, name string, r int, g int, b int, label_ordinal long")
    return Atlas(voxels, labels, SHAPE, 25.0)


@pytest.fixture(scope="module")
def series(tmp_path_factory):
    """Two sections at y = 3 and 6; the second has a damage grid and markers."""
    folder = tmp_path_factory.mktemp("series")
    plane = lambda y: [0.0, float(y), 15.99, 19.99, 0.0, 0.0, 0.0, 0.0, -15.99]
    slices = [{"filename": "m_s001.png", "nr": 1, "width": 40, "height": 32, "anchoring": plane(3)},
              {"filename": "m_s002.png", "nr": 2, "width": 40, "height": 32, "anchoring": plane(6), "grid": [4, 0, 0, 0], "gridx": 0, "gridy": 0,
               "markers": [[10, 10, 10, 10], [30, 20, 30, 20]]}]
    (folder / "reg.json").write_text(json.dumps({"gridspacing": 10, "slices": slices}))
    images = folder / "images"
    images.mkdir()
    made = {}
    for n in (1, 2, 9):
        image = np.full((64, 80, 3), 255, np.uint8)
        image[4:12, 6:16] = 0
        image[40:44, 60:61] = 0
        image[20:22, 20:22] = (0, 0, 9)
        made[n] = image
        (images / f"m_s00{n}.png").write_bytes(rasters.encode_png(image))
    return folder, made


@pytest.fixture(scope="module")
def sections(spark, series):
    return registration.read_registration(spark, str(series[0] / "reg.json"))


def test_segmentation(spark, series, sections, atlas, tmp_path):
    result = pipelines.segmentation_to_atlas(spark, str(series[0] / "images"), sections, atlas, (0, 0, 0), cutoff=10, orientation="lpi")
    points = result.points.toPandas()
    assert len(points) == 2 * 84
    table = pipelines.quantify(result, atlas.labels).toPandas().set_index("idx")
    assert table["pixel_count"].sum() == len(points)
    assert table["object_count"].sum() == 2  # the small ones are below the cutoff, their pixels are not
    assert (table["left_hemi_pixel_count"] + table["right_hemi_pixel_count"] <= table["pixel_count"]).all()
    assert table.loc[[1, 2, 3], "region_area"].sum() == pytest.approx(2 * 64 * 80, rel=0.01)
    first = points[points["section_number"] == 1]
    assert set(first["y"]) == {3.0} and first["x"].between(0, 20).all()
    assert first["x"].min() == pytest.approx(6 * 0.5 / 40 * 19.99) and first["z"].max() == pytest.approx(15.99 - 4 * 0.5 / 32 * 15.99)
    assert set(points.loc[points["section_number"] == 1, "undamaged"]) == {True}
    assert not points.loc[points["section_number"] == 2, "undamaged"].all()
    listed = {r["section_number"]: r["n_points"] for r in result.files.collect()}
    assert listed == {1: 84, 2: 84, 9: 0}
    exports.save_analysis(str(tmp_path), result, atlas.labels, pipelines.quantify(result, atlas.labels), settings={"a": 1})
    clouds = json.loads((tmp_path / "whole_series_clouds/pixels_cloud.json").read_text())
    assert sum(c["count"] for c in clouds) == points["undamaged"].sum() and all(len(c["triplets"]) == 3 * c["count"] for c in clouds)
    assert (tmp_path / "whole_series_clouds/left_hemisphere_objects_cloud.json").exists()
    report = (tmp_path / "whole_series_report/counts.csv").read_text().splitlines()
    assert report[0].startswith("idx;name;r;g;b;") and report[1].startswith("1;low;")
    assert json.loads((tmp_path / "settings.json").read_text()) == {"a": 1}


def test_orientations_agree(spark, series, sections, atlas):
    found = {}
    for code in ("lpi", "asr", "ras"):
        result = pipelines.segmentation_to_atlas(spark, str(series[0] / "images"), sections, atlas, orientation=code)
        back = geometry.reorient(result.points, geometry.shape_in(SHAPE, code), "lpi", code)
        found[code] = sorted((round(r.x, 6), round(r.y, 6), round(r.z, 6)) for r in back.select("x", "y", "z").collect())
    assert found["lpi"] == found["asr"] == found["ras"]
    for bad in ("", "lp", "lll", "xyz", "lrs", 3):
        with pytest.raises(ValueError):
            geometry.check_orientation(bad)


def test_auto_colour_and_labels(spark, series, sections, atlas, tmp_path):
    auto = pipelines.segmentation_to_atlas(spark, str(series[0] / "images"), sections, atlas, "auto")
    assert auto.points.count() == 2 * 84
    image = np.zeros((64, 80), np.uint16)
    image[2:6, 2:6], image[2:6, 6:9], image[30:31, 30:31] = 300, 301, 7
    (tmp_path / "c_s001.png").write_bytes(rasters.encode_png(image))
    found = pipelines.segmentation_to_atlas(spark, str(tmp_path), sections, atlas, cutoff=1, name="cellpose")
    assert found.points.count() == 29 and sorted(r["component"] for r in found.objects.collect()) == [300, 301]
    with pytest.raises(ValueError, match="binary"):
        pipelines.format_of("none")
    pipelines.register_format("dark", lambda _: F.col("c0") < 10, None)
    assert pipelines.segmentation_to_atlas(spark, str(series[0] / "images"), sections, atlas, name="dark").points.count() > 0


def test_images(spark, series, sections, atlas, tmp_path):
    result = pipelines.image_to_atlas(spark, str(series[0] / "images"), sections, atlas, "grayscale", 1, 254, most=1)
    table = pipelines.quantify(result, atlas.labels).toPandas().set_index("idx")
    cells = table["pixel_count"].sum()
    assert cells <= 2 * 40 * 32 and (table["mean_intensity"] <= 255).all()
    values = result.points.toPandas()
    assert values["value"].tolist() == [1.0] and values["section_number"].tolist() == [1]  # damaged in the other section
    whole = pipelines.image_to_atlas(spark, str(series[0] / "images"), sections, atlas)
    sums = whole.intensities.filter("section_number = 1").agg(F.sum("sum_intensity"), F.sum("pixel_count")).first()
    image = series[1][1].astype(float)
    grey = np.rint(0.114 * image[:, :, 2] + 0.587 * image[:, :, 1] + 0.299 * image[:, :, 0])
    assert sums[1] == 40 * 32 and sums[0] == pytest.approx(grey.sum() / 4, rel=1e-3)
    exports.save_analysis(str(tmp_path), whole, atlas.labels, table=pipelines.quantify(whole, atlas.labels), colormap="hot")
    assert (tmp_path / "whole_series_report/intensity.csv").exists()
    clouds = json.loads((tmp_path / "whole_series_clouds/pixels_cloud.json").read_text())
    assert clouds[-1]["name"] == "Intensity 255" and (clouds[-1]["r"], clouds[-1]["g"], clouds[-1]["b"]) == (255, 255, 255)


def test_coordinates(spark, sections, atlas):
    rows = [(1, 10.0, 10.0, 80, 64, 0), (1, 70.0, 50.0, 999, 999, 1), (2, 40.0, 5.0, 80, 64, 2), (5, 1.0, 1.0, 80, 64, 3)]
    xy = spark.createDataFrame(rows, "section_number int, x double, y double, image_width int, image_height int, ordinal long")
    result = pipelines.xy_to_atlas(xy, sections, atlas, "lpi")
    points = {r["ordinal"]: r for r in result.points.collect()}
    assert points.keys() == {0, 1, 2}
    assert points[0]["x"] == pytest.approx(10 / 80 * 19.99) and points[0]["z"] == pytest.approx(15.99 - 10 / 64 * 15.99)
    assert (points[0]["label"], points[0]["hemi"], points[1]["label"]) == (2, 1, 1)
    table = pipelines.quantify(result, atlas.labels).toPandas().set_index("idx")
    assert table["pixel_count"].sum() == 3 and table["object_count"].sum() == 3


def test_warp_at_markers(spark):
    markers = [[10.0, 12.0, 20.0, 22.0], [70.0, 30.0, 60.0, 28.0], [40.0, 44.0, 41.0, 40.0]]
    triangles = warp.triangle_table(spark, [{"section_number": 1, "width": 100, "height": 60, "markers": markers}, {"section_number": 2, "width": 1, "height": 1, "markers": None}])
    points = [(1, i, m[2], m[3]) for i, m in enumerate(markers)] + [(1, 9, -500.0, 0.0), (2, 10, 3.0, 4.0)]
    moved = {r["k"]: (r["wx"], r["wy"]) for r in warp.warp_points(spark.createDataFrame(points, "section_number int, k int, x double, y double"), triangles).collect()}
    for i, m in enumerate(markers):
        assert moved[i] == pytest.approx((m[0], m[1]))
    assert moved[9] == (0, 0) and moved[10] == (3, 4)
    grid = [(1, i, float(7 + i % 9 * 10), float(5 + i // 9 * 8)) for i in range(54)]
    there = warp.warp_points(spark.createDataFrame(grid, "section_number int, k int, x double, y double"), triangles)
    back = warp.warp_points(there.select("section_number", "k", F.col("wx").alias("x"), F.col("wy").alias("y")), triangles, forward=True)
    for r in back.collect():
        assert (r["wx"], r["wy"]) == pytest.approx(grid[r["k"]][2:], abs=1e-6)


def test_triangles_are_delaunay():
    picks = np.random.default_rng(8)
    markers = [[x, y, x, y] for x, y in picks.uniform(0, 100, (25, 2)).tolist()]
    mesh = warp.triangulate(100, 100, markers)
    area = sum(abs(np.cross(mesh.target[b] - mesh.target[a], mesh.target[c] - mesh.target[a])) / 2 for a, b, c in mesh.triangles)
    assert area == pytest.approx(120 * 120)
    for t in mesh.triangles:
        assert not any(warp._in_circle(*mesh.target[list(t)], p) for i, p in enumerate(mesh.target) if i not in t)


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components(connectivity):
    mask = np.random.default_rng(connectivity).random((40, 50)) < 0.5
    found = objects.label_components(mask, connectivity)
    want, n = np.zeros_like(found), 0
    for y, x in np.argwhere(mask):
        if not want[y, x]:
            n, stack = n + 1, [(y, x)]
            want[y, x] = n
            while stack:
                a, b = stack.pop()
                for i in (-1, 0, 1):
                    for j in (-1, 0, 1):
                        if (abs(i) + abs(j) == 1 or connectivity == 8) and 0 <= a + i < 40 and 0 <= b + j < 50 and mask[a + i, b + j] and not want[a + i, b + j]:
                            want[a + i, b + j] = n
                            stack.append((a + i, b + j))
    assert np.array_equal(found, want)


def test_volume(spark, atlas, tmp_path):
    rows = [(1, 1.2, 2.0, 3.0, 4.0, True), (1, 0.9, 2.0, 3.0, 2.0, False), (2, 10.0, 5.0, 8.0, 7.0, False), (2, 99.0, 0.0, 0.0, 1.0, True)]
    points = spark.createDataFrame(rows, "section_number int, x double, y double, z double, value double, undamaged boolean")
    plain = pipelines.interpolated_volume(points, atlas, mode="mean", interpolate=False, orientation="lpi").collect()
    at = {(r["x"], r["y"], r["z"]): r for r in plain}
    assert len(at) == math.prod(SHAPE) and at[1, 2, 3]["value"] == 3 and at[1, 2, 3]["freq"] == 2 and math.isnan(at[0, 0, 0]["value"])
    filled = pipelines.interpolated_volume(points, atlas, k=1, orientation="lpi")
    near = {(r["x"], r["y"], r["z"]): r["value"] for r in filled.collect()}
    assert near[0, 0, 0] == 6 and near[19, 9, 15] == 7 and set(near.values()) == {6, 7}
    assert pipelines.interpolated_volume(points, atlas, 0.5, interpolate=False).count() == 10 * 5 * 8
    with pytest.raises(ValueError):
        volume.value_of("median")
    with pytest.raises(ValueError):
        volume.volume_shape(SHAPE, 0)
    exports.save_volumes(str(tmp_path), filled, SHAPE, 25.0, SHAPE, damage=True)
    raw = gzip.open(tmp_path / "interpolated_volume/interpolated_volume.nii.gz").read()
    assert struct.unpack("<i", raw[:4])[0] == 348 and struct.unpack("<8h", raw[40:56])[1:4] == SHAPE and len(raw) == 352 + math.prod(SHAPE)
    assert struct.unpack("<f", raw[80:84])[0] == 25.0 and max(raw[352:]) == 255


@pytest.mark.parametrize("mode", ["pixel_count", "mean", "object_count"])
def test_volume_of_images(spark, series, sections, atlas, mode):
    """Against a plain loop over the cells of each plane, as if without markers."""
    plain = sections.withColumn("markers", F.lit(None).cast("array<array<double>>"))
    made = pipelines.volume_from_images(spark, str(series[0] / "images"), plain, atlas, "0,0,0", mode=mode, interpolate=False, missing=0.0, orientation="lpi")
    got = {(r["x"], r["y"], r["z"]): (r["value"], r["freq"], r["damage"]) for r in made.collect() if r["freq"]}
    sums, freq = {}, {}
    for n, y in ((1, 3), (2, 6)):
        mask = (series[1][n] == 0).all(2)
        cells = np.zeros((16, 20), bool)
        for j in range(16):
            for i in range(20):
                cells[j, i] = mask[round((j + 0.5) * 2) * 2, round((i + 0.5) * 2) * 2] if round((i + 0.5) * 2) < 40 and round((j + 0.5) * 2) < 32 else False
        groups = objects.label_components(cells, 8)
        for j in range(16):
            for i in range(20):
                at = (round((i + 0.5) / 20 * 19.99), y, round(15.99 - (j + 0.5) / 16 * 15.99))
                if at[0] < 20 and at[2] < 16:
                    freq[at] = freq.get(at, 0) + 1
                    sums.setdefault(at, []).append((n, groups[j, i]))
    assert got.keys() == freq.keys() and all(got[k][1] == freq[k] for k in freq)
    for k, cells in sums.items():
        front = [c for c in cells if c[1]]
        want = {"pixel_count": len(front), "mean": len(front) / freq[k], "object_count": len(set(front))}[mode]
        assert got[k][0] == want, k
    assert any(v[0] for v in got.values())
    assert {v[2] for k, v in got.items() if k[1] == 3} == {0} and {v[2] for k, v in got.items() if k[1] == 6} == {0, 1}


def test_volume_of_intensities(spark, series, sections, atlas):
    made = pipelines.volume_from_images(spark, str(series[0] / "images"), sections, atlas, segmentation=False, mode="mean", low=1, high=300, k=2, scale=0.5)
    values = [r["value"] for r in made.collect()]
    assert len(values) == 10 * 5 * 8 and all(0 <= v <= 255 for v in values) and max(values) > 0
    for text, want in (("auto", "auto"), (" ", "auto"), (None, "auto"), ("7", (7,)), ("[1, 2,3]", (1, 2, 3)), ([4, 5, 6], (4, 5, 6))):
        assert pipelines.parse_colour(text) == want
    with pytest.raises(ValueError):
        pipelines.parse_colour("blue")


def test_lookup_in_a_raster(spark):
    raster = spark.createDataFrame([(1, 0, 0, 5, 1), (1, 1, 2, 7, 2)], "section_number int, y int, x int, label long, hemi int")
    points = spark.createDataFrame([(1, 0.4, 0.9), (1, 1.0, 2.0), (1, 9.0, 0.0)], "section_number int, py double, px double")
    found = geometry.lookup_labels(points, raster, F.floor("py"), F.floor("px"), hemi=True).orderBy("py").collect()
    assert [(r["label"], r["hemi"]) for r in found] == [(5, 1), (7, 2), (0, 0)]


def test_pictures(spark, sections, atlas, tmp_path):
    maps = geometry.slice_atlas(sections, atlas.voxels)
    marks = spark.createDataFrame([(1, 0, 0)], "section_number int, y int, x int")
    done = exports.section_pictures(maps, atlas.labels, str(tmp_path), marks).collect()
    assert [r["error"] for r in done] == [None, None]
    image = rasters.decode_png((tmp_path / "section_001_atlas.png").read_bytes())
    assert image[0, 0].tolist() == [255, 235, 255] and image[0, 1].tolist() == [0, 20, 0] and image[-1, -1].tolist() == [0, 0, 10]


def test_counts_and_streams(spark, tmp_path):
    rows = [(1, 0, True), (1, 1, False), (0, 2, None), (77, 1, True), (-3, 1, True)]
    points = spark.createDataFrame(rows, "label long, hemi int, undamaged boolean")
    labels = spark.createDataFrame([(1, "a", 1, 2, 3)], "idx long, name string, r int, g int, b int")
    found = {r["idx"]: r for r in regions.region_counts(points, None, labels).collect()}
    assert found.keys() == {0, 1} and found[0]["name"] == "out_of_atlas" and found[1]["pixel_count"] == 2
    assert found[1]["undamaged_pixel_counts"] == 1 and found[0]["undamaged_pixel_counts"] == 1 and found[1]["object_count"] == 0
    table = regions.region_table(regions.region_counts(points, None, labels), labels)
    assert table.columns[:5] == ["idx", "name", "r", "g", "b"] and table.count() == 2
    points.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    query = counts.start_counts(stream, "streamed", str(tmp_path / "state"))
    query.awaitTermination(60)
    batch = {tuple(r) for r in regions.count_by_label(points, None).collect()}
    assert {tuple(r) for r in spark.table("streamed").collect()} == batch


def test_infinite_fractions(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.0), (3, 2.0)], "pixel_count long, region_area double")
    assert [r["area_fraction"] for r in regions.with_area_fractions(df).collect()] == [math.inf, 0.0, 1.5]


def test_custom_overlap(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "custom_id long, custom_name string, subregion_id long")
    with pytest.raises(ValueError, match="5"):
        regions.check_crosswalk(rows)


@pytest.mark.parametrize("n", [1, 5, 99, 100, 101, 250, 1234])
def test_stride(spark, n):
    rows = spark.range(n).selectExpr("1 as section_number", "cast(id as int) y", "0 as x")
    want = {int(i * ((n - 1) / 99.0)) for i in range(100)} if n > 100 else set(range(n))
    assert {r["y"] for r in pixels.stride_sample(rows, 100).collect()} == want


def test_tables_module_has_columns():
    assert tables.COORDINATES[-1] == "section number"


def test_empty_label_images_keep_their_areas(spark, sections, atlas, tmp_path):
    image = np.zeros((64, 80), np.uint16)
    (tmp_path / "a_s001.png").write_bytes(rasters.encode_png(image))
    image[3, 3] = 9
    (tmp_path / "a_s002.png").write_bytes(rasters.encode_png(image))
    result = pipelines.segmentation_to_atlas(spark, str(tmp_path), sections, atlas, name="cellpose")
    areas = {r["section_number"]: r["n"] for r in result.areas.groupBy("section_number").agg(F.sum("region_area").alias("n")).collect()}
    assert areas.keys() == {1, 2} and areas[1] == pytest.approx(areas[2]) and areas[1] == pytest.approx(64 * 80, rel=0.01)
    assert result.points.count() == 1 and {r["section_number"]: r["n_points"] for r in result.files.collect()} == {1: 0, 2: 1}
    blank = pipelines.segmentation_to_atlas(spark, str(tmp_path), sections, atlas, (7, 7, 7))
    assert blank.points.count() == 0 and pipelines.quantify(blank, atlas.labels).agg(F.sum("region_area")).first()[0] == pytest.approx(2 * 64 * 80, rel=0.01)


def test_colours_of_signal_pixels(spark, sections, atlas, tmp_path):
    image = np.zeros((32, 40, 3), np.uint8)
    image[:16], image[16:] = (200, 100, 50), (10, 0, 0)
    (tmp_path / "a_s001.png").write_bytes(rasters.encode_png(image))
    result = pipelines.image_to_atlas(spark, str(tmp_path), sections, atlas, low=20)
    assert {(r["r"], r["g"], r["b"]) for r in result.points.select("r", "g", "b").distinct().collect()} == {(200, 100, 50)}
    exports.save_analysis(str(tmp_path / "out"), result, atlas.labels, colormap="original_colours")
    (cloud,) = json.loads((tmp_path / "out/whole_series_clouds/pixels_cloud.json").read_text())
    assert cloud["name"] == "Color 200,100,50" and cloud["count"] == 16 * 40 and len(cloud["triplets"]) == 3 * 16 * 40


def test_jpegs_are_read_like_other_images(spark, sections, atlas, tmp_path):
    image = spark._jvm.java.awt.image.BufferedImage(80, 64, 1)
    for y in range(64):
        for x in range(80):
            image.setRGB(x, y, 0xFFFFFF if x < 40 else 0)
    spark._jvm.javax.imageio.ImageIO.write(image, "jpg", spark._jvm.java.io.File(str(tmp_path / "a_s001.jpg")))
    result = pipelines.segmentation_to_atlas(spark, str(tmp_path), sections, atlas)
    assert result.points.count() == pytest.approx(64 * 40, rel=0.05)
    assert pipelines.quantify(pipelines.image_to_atlas(spark, str(tmp_path), sections, atlas), atlas.labels).agg(F.max("mean_intensity")).first()[0] > 100


def test_sections_with_displacement_fields(spark, series, sections, atlas, tmp_path):
    """A field that shifts by a constant shifts the points, and the way back undoes it."""
    for name, shift in zip(registration.FIELDS, (2.0, -3.0), strict=True):
        (tmp_path / name).write_bytes(rasters.encode_tiff(np.full((32, 40), shift, np.float32)))
    plain = sections.filter("section_number = 1")
    moved = plain.withColumn("field_folder", F.lit(str(tmp_path)))
    xy = spark.createDataFrame([(1, 40.0, 20.0, 80, 64, 0), (1, 70.0, 50.0, 80, 64, 1)], "section_number int, x double, y double, image_width int, image_height int, ordinal long")
    at = {k: {r["ordinal"]: r for r in pipelines.xy_to_atlas(xy, s, atlas, "lpi").points.collect()} for k, s in (("plain", plain), ("moved", moved))}
    for n in (0, 1):
        assert at["moved"][n]["x"] == pytest.approx(at["plain"][n]["x"] - 3 / 40 * 19.99) and at["moved"][n]["z"] == pytest.approx(at["plain"][n]["z"] - 2 / 32 * 15.99)
    warps = pipelines.warps_of(moved, both_ways=True)
    points = spark.createDataFrame([(1, 40, 32, 17.0, 20.0)], "section_number int, width int, height int, x double, y double")
    there = warps.move(points).select("section_number", "width", "height", F.col("wx").alias("x"), F.col("wy").alias("y"))
    (back,) = warps.move(there, forward=True).collect()
    assert (there.first()["x"], there.first()["y"]) == (14, 22) and (back["wx"], back["wy"]) == (17, 20)
    made = pipelines.volume_from_images(spark, str(series[0] / "images"), moved, atlas, "0,0,0", interpolate=False, missing=0.0)
    assert made.agg(F.sum("value")).first()[0] > 0


@pytest.mark.parametrize("share", [0.0, 0.001, 0.3])
def test_nearest_known_cells(share):
    picks = np.random.default_rng(3)
    known = picks.random((40, 60)) < share
    known[7, 50] = True
    near_y, near_x = warp.nearest_known(known)
    places = np.argwhere(known)
    for y, x in picks.integers(0, (40, 60), (300, 2)):
        gaps = ((places - (y, x)) ** 2).sum(1)
        assert tuple(places[gaps.argmin()]) == (near_y[y, x], near_x[y, x])


def test_section_visuals(spark, series, sections, atlas, tmp_path):
    done = pipelines.section_visuals(spark, sections, atlas, str(tmp_path), str(series[0] / "images"), 0.5).collect()
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in done) == ["section_001_m_s001_atlas_colored.png", "section_002_m_s002_atlas_colored.png"]
    image = rasters.decode_png((tmp_path / "visualisations/section_001_m_s001_atlas_colored.png").read_bytes())
    assert image.shape == (32, 40, 3)
    maps = {(r["y"], r["x"]): r["label"] for r in geometry.slice_atlas(sections.filter("section_number = 1"), atlas.voxels).collect()}
    rows, columns = max(y for y, _ in maps) + 1, max(x for _, x in maps) + 1
    colours = {0: (0, 0, 0), 1: (10, 0, 0), 2: (0, 20, 0), 3: (0, 0, 30)}
    for y in range(32):
        for x in range(40):
            red, green, blue = colours[maps[y * rows // 32, x * columns // 40]]
            front = not series[1][1][y * 2, x * 2].any()
            want = (255 - blue, 255 - green, 255 - red) if front else (blue, green, red)
            assert tuple(image[y, x]) == want
    bare = pipelines.section_visuals(spark, sections, atlas, str(tmp_path / "bare"), None, 1.0)
    assert bare.filter("error is null").count() == 2
    assert rasters.decode_png((tmp_path / "bare/visualisations/section_002_m_s002_atlas_colored.png").read_bytes()).shape == (32, 40, 3)


def test_slabs(spark, atlas, tmp_path):
    whole = exports.dense(atlas.voxels, SHAPE, "label")
    parts = list(exports.slabs(atlas.voxels, SHAPE, "label", most=SHAPE[0] * SHAPE[1] * 3))
    assert len(parts) == 6 and np.array_equal(np.concatenate(parts, axis=2), whole)
    exports.write_nifti(iter(parts), 12.5, str(tmp_path / "v"), SHAPE)
    back, size = exports.read_nifti(str(tmp_path / "v.nii.gz"))
    assert size == 12.5 and np.array_equal(back, whole)


def test_points_that_coincide_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(exports, "PART", 100)
    points = spark.range(1000).select(F.lit(1).cast("long").alias("label"), *[F.lit(0.0).alias(a) for a in "xyz"])
    labels = spark.createDataFrame([(1, "a", 1, 2, 3)], "idx long, name string, r int, g int, b int")
    sizes = [len(r["triplets"]) // 3 for r in exports.region_clouds(points, labels).collect()]
    assert sum(sizes) == 1000 and len(sizes) == 10 and max(sizes) < 200


def test_public_functions(spark, series, atlas, tmp_path):
    import voxelloom

    assert len(voxelloom.__all__) == 14 and all(getattr(voxelloom, name) for name in voxelloom.__all__)
    sections = voxelloom.read_alignment(str(series[0] / "reg.json"))
    found = voxelloom.seg_to_coords(str(series[0] / "images"), sections, atlas, [0, 0, 0], 10)
    table = voxelloom.quantify_coords(found, atlas)
    assert table.agg(F.sum("pixel_count")).first()[0] == 168
    voxelloom.save_analysis(str(tmp_path), found, atlas, table)
    assert (tmp_path / "whole_series_report/counts.csv").exists()
    shown = voxelloom.image_to_coords(str(series[0] / "images"), sections, atlas, min_intensity=1)
    assert voxelloom.quantify_coords(shown, atlas).agg(F.sum("pixel_count")).first()[0] > 0
    (tmp_path / "xy.csv").write_text("X,Y,image_width,image_height,section number\n10,10,80,64,1\n")
    assert voxelloom.xy_to_coords(str(tmp_path / "xy.csv"), sections, atlas).points.count() == 1
    rows = voxelloom.interpolate_volume(segmentation_folder=str(series[0] / "images"), alignment_json=str(series[0] / "reg.json"), colour="0,0,0", atlas=atlas, do_interpolation=False, missing_fill=0.0)
    voxelloom.save_volume_niftis(output_folder=str(tmp_path), voxels=rows, atlas=atlas)
    back, size = exports.read_nifti(str(tmp_path / "interpolated_volume/interpolated_volume.nii.gz"))
    assert back.shape == geometry.shape_in(SHAPE, "asr") and size == 25 and back.max() == 255
    with pytest.raises(AttributeError):
        voxelloom.nothing  # noqa: B018


def test_storage(spark):
    from voxelloom import storage

    path = storage.scratch(spark, "odd")
    storage.write_bytes(f"{path}/a/b.bin", b"x")
    assert storage.located(path)[0].get_file_info(storage.located(f"{path}/a/b.bin")[1]).size == 1
    held = storage._made[:]
    storage._made[:] = [path]
    assert storage.clean(spark) == 1 and storage.located(path)[0].get_file_info(storage.located(path)[1]).type.name == "NotFound"
    storage._made[:] = held

    class Cluster:
        class sparkContext:
            master = "local-cluster[2,1,1024]"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda key, default=None: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Cluster)
