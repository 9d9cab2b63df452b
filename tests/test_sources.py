"""Readers: files, rasters, volumes, registrations, tables, settings."""

from __future__ import annotations

import gzip
import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.model import Settings
from voxelloom.sources import files, rasters, registration, tables, volumes


def filtered_png(image):
    """A PNG whose rows use all five filters in turn."""
    height, width = image.shape[:2]
    planes = 1 if image.ndim == 2 else image.shape[2]
    step = planes * image.dtype.itemsize
    data = image.astype(image.dtype.newbyteorder(">")).reshape(height, -1).view(np.uint8).reshape(height, -1).astype(int)
    out = []
    for y in range(height):
        kind, line = y % 5, data[y]
        up = data[y - 1] if y else np.zeros_like(line)
        left, corner = np.zeros_like(line), np.zeros_like(line)
        left[step:], corner[step:] = line[:-step], up[:-step]
        near = left + up - corner
        a, b, c = abs(near - left), abs(near - up), abs(near - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = [0, left, up, (left + up) // 2, paeth][kind]
        out.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
    head = struct.pack(">IIBBBBB", width, height, 8 * image.dtype.itemsize, {1: 0, 3: 2, 4: 6}[planes], 0, 0, 0)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(out))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("shape,kind", [((11, 7), np.uint8), ((10, 6), np.uint16), ((12, 5, 3), np.uint8), ((7, 9, 4), np.uint8)])
def test_png(shape, kind):
    image = np.random.default_rng(1).integers(0, np.iinfo(kind).max, shape).astype(kind)
    want = image if image.ndim == 2 else image[:, :, 2::-1]
    assert np.array_equal(rasters.decode_png(filtered_png(image)), want)
    if image.ndim == 2 or shape[2] == 3:
        assert np.array_equal(rasters.decode_png(rasters.encode_png(image)), want)


def test_bmp_and_flat():
    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    body = b"".join(line.tobytes() for line in image[::-1])
    head = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 4, 2, 1, 24, 0, len(body), 0, 0, 0, 0)
    assert np.array_equal(rasters.decode_bmp(head + body), image)
    flat = struct.pack(">BII", 2, 3, 2) + np.arange(6, dtype=">u2").tobytes()
    assert rasters.decode_flat(flat).tolist() == [[0, 1, 2], [3, 4, 5]]
    with pytest.raises(ValueError):
        rasters.decode_flat(struct.pack(">BII", 3, 1, 1))


@pytest.mark.parametrize("packing", [1, 8])
def test_tiff(packing):
    image = np.arange(12, dtype="<u2").reshape(3, 4)
    body = image.tobytes() if packing == 1 else zlib.compress(image.tobytes())
    tags = [(256, 3, 4), (257, 3, 3), (258, 3, 16), (259, 3, packing), (273, 4, 8), (277, 3, 1), (279, 4, len(body))]
    head = b"II*\0" + struct.pack("<I", 8 + len(body))
    entries = b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<I", v) for t, k, v in tags)
    assert np.array_equal(rasters.decode_tiff(head + body + struct.pack("<H", len(tags)) + entries), image)


def tiff(parts, image, tags, big=False):
    """A little-endian TIFF of encoded strips or tiles."""
    offset, body, places = 16 if big else 8, b"", []
    for part in parts:
        places.append((offset + len(body), len(part)))
        body += part
    tiled = 322 in tags
    entries = {256: (4, [image.shape[1]]), 257: (4, [image.shape[0]]), 324 if tiled else 273: (4, [p for p, _ in places]), 325 if tiled else 279: (4, [n for _, n in places]), **{t: (3, v) for t, v in tags.items()}}
    word = "Q" if big else "I"
    directory, extra, at = b"", b"", offset + len(body)
    extra_at = at + (8 + 20 * len(entries) + 8 if big else 2 + 12 * len(entries) + 4)
    for tag, (kind, values) in sorted(entries.items()):
        raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
        size = 8 if big else 4
        if len(raw) <= size:
            cell = raw.ljust(size, b"\0")
        else:
            cell = struct.pack("<" + word, extra_at + len(extra))
            extra += raw
        directory += struct.pack("<HH" + word, tag, kind, len(values)) + cell
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)
    return head + body + struct.pack("<Q" if big else "<H", len(entries)) + directory + b"\0" * (8 if big else 4) + extra


def lzw(data):
    codes, table, width, out, word = [], None, 9, "", b""

    def put(code):
        nonlocal out
        out += format(code, f"0{width}b")

    table = {bytes([i]): i for i in range(256)}
    put(256)
    for i in range(len(data)):
        byte = data[i : i + 1]
        if word + byte in table:
            word += byte
            continue
        put(table[word])
        table[word + byte] = len(table) + 2
        if len(table) + 2 == (1 << width) and width < 12:
            width += 1
        if len(table) + 2 >= 4094:
            put(256)
            table, width = {bytes([i]): i for i in range(256)}, 9
        word = byte
    put(table[word])
    put(257)
    assert codes == []
    return int(out.ljust(-(-len(out) // 8) * 8, "0"), 2).to_bytes(-(-len(out) // 8), "big")


@pytest.mark.parametrize("packing", [1, 5, 8, 32773])
@pytest.mark.parametrize("layout", ["strips", "tiles", "planes", "differences", "big"])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_tiff_layouts(packing, layout, kind):
    image = np.random.default_rng(5).integers(0, 9, (37, 45, 3)).astype(kind)
    pack = {1: bytes, 5: lzw, 8: zlib.compress, 32773: lambda d: b"".join(struct.pack("B", len(d[i : i + 100]) - 1) + d[i : i + 100] for i in range(0, len(d), 100))}[packing]
    tags = {258: [8 * image.itemsize] * 3, 259: [packing], 262: [2], 277: [3], 278: [10]}
    data = image
    if layout == "differences":
        tags[317] = [2]
        data = np.concatenate([image[:, :1], np.diff(image.astype(np.int64), axis=1).astype(kind)], axis=1)
    blocks = [data[y : y + 10] for y in range(0, 37, 10)]
    if layout == "planes":
        tags[284] = [2]
        blocks = [b[:, :, i] for i in range(3) for b in blocks]
    if layout == "tiles":
        tags |= {322: [16], 323: [16]}
        blocks = [np.pad(data, ((0, 11), (0, 3), (0, 0)))[y : y + 16, x : x + 16] for y in range(0, 37, 16) for x in range(0, 45, 16)]
    found = rasters.decode_tiff(made := tiff([pack(b.tobytes()) for b in blocks], image, tags, layout == "big"))
    assert np.array_equal(found, image[:, :, ::-1]) and rasters.size_of("a.tif", made) == (37, 45)


def test_tiff_grey_and_refusals():
    image = np.random.default_rng(6).integers(0, 255, (5, 4)).astype(np.uint8)
    tags = {258: [8], 259: [1], 262: [0], 277: [1]}
    assert np.array_equal(rasters.decode_tiff(tiff([image.tobytes()], image, tags)), 255 - image)
    bits = image > 99
    packed = np.packbits(bits, axis=1).tobytes()
    assert np.array_equal(rasters.decode_tiff(tiff([packed], image, {258: [1], 259: [1], 262: [1], 277: [1]})), bits * 255)
    for odd in ({259: [7]}, {317: [3]}, {258: [12]}):
        with pytest.raises(ValueError, match="not supported"):
            rasters.decode_tiff(tiff([image.tobytes()], image, tags | odd))


@pytest.mark.parametrize("shape,kind", [((11, 7), np.uint8), ((19, 23, 3), np.uint8), ((1, 1), np.uint8), ((9, 2), np.uint16)])
def test_interlaced_png(shape, kind):
    image = np.random.default_rng(7).integers(0, np.iinfo(kind).max, shape).astype(kind)
    rows = b""
    for y, x, dy, dx in rasters.ADAM7:
        part = image[y::dy, x::dx]
        if part.size:
            rows += b"".join(b"\0" + line.astype(np.dtype(kind).newbyteorder(">")).tobytes() for line in part)
    planes = 1 if image.ndim == 2 else 3
    head = struct.pack(">IIBBBBB", shape[1], shape[0], 8 * image.itemsize, {1: 0, 3: 2}[planes], 0, 0, 1)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert np.array_equal(rasters.decode_png(data), image if image.ndim == 2 else image[:, :, ::-1])
    assert rasters.size_of("a.PNG", data) == shape[:2]


def test_deep_zoom():
    image = np.random.default_rng(2).integers(0, 255, (6, 7, 3)).astype(np.uint8)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        archive.writestr("a.dzi", '<Image TileSize="4" xmlns="http://schemas.microsoft.com/deepzoom/2008"><Size Width="7" Height="6"/></Image>')
        archive.writestr("a_files/0/0_0.png", rasters.encode_png(image[:1, :1]))
        for col in range(2):
            for row in range(2):
                archive.writestr(f"a_files/3/{col}_{row}.png", rasters.encode_png(image[row * 4 : row * 4 + 4, col * 4 : col * 4 + 4]))
    assert np.array_equal(rasters.decode_dzi(packed.getvalue()), image[:, :, ::-1])


def test_run_lengths(spark, tmp_path):
    image = np.repeat(np.random.default_rng(3).integers(0, 400, 60), 7).reshape(20, 21)
    data = rasters.encode_segrle(image, "an atlas")
    width, height, runs = rasters.segrle_runs(data)
    assert (width, height) == (21, 20) and np.array_equal(np.concatenate([np.full(n, v) for _, n, v in runs]), image.ravel())
    (tmp_path / "x_s004.seg").write_bytes(data)
    rows = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content", files.section_number(F.col("path")).alias("section_number"))
    areas = {r["label"]: r["n"] for r in rasters.segrle_rows(rows).groupBy("label").agg(F.sum("length").alias("n")).collect()}
    assert areas == {int(v): int((image == v).sum()) for v in np.unique(image)}
    cells = rasters.run_pixels(rasters.segrle_rows(rows)).collect()
    assert len(cells) == 420 and all(image[r["y"], r["x"]] == r["label"] for r in cells) and cells[0]["section_number"] == 4
    for broken in (b"nonsense", data[:-2] + bytes([200, 1]), data[:-1] + bytes([120])):
        with pytest.raises((ValueError, IndexError)):
            rasters.segrle_runs(broken)


@pytest.mark.parametrize("packed", [False, True])
def test_nrrd(spark, tmp_path, packed):
    volume = np.random.default_rng(4).integers(0, 3, (5, 4, 6)).astype(np.uint16)
    path = str(tmp_path / "v.nrrd")
    volumes.write_nrrd(path, volume, packed)
    assert volumes.volume_shape(path) == (5, 4, 6)
    rows = volumes.read_nrrd(spark, path).collect()
    assert len(rows) == 120 and all(volume[r["x"], r["y"], r["z"]] == r["value"] for r in rows)
    assert volumes.read_nrrd(spark, path, nonzero=True).count() == (volume > 0).sum()
    slabs = volumes.NrrdReader({"path": path, "slabVoxels": "40"}).partitions()
    assert len(slabs) == (1 if packed else 3)
    atlas = volumes.load_atlas(spark, path, path)
    assert atlas.filter("label = hemi").count() == 120


def test_image_files(spark, tmp_path):
    for name in ("a_s001.png", "b_s002.PNG", "c_3_s10_s07.png", "notes.txt"):
        (tmp_path / name).write_bytes(rasters.encode_png(np.eye(3, dtype=np.uint8)))
    found = files.image_files(spark, str(tmp_path))
    assert sorted(r["section_number"] for r in found.collect()) == [1, 2, 7]
    cells = rasters.image_pixels(found, foreground=True)
    assert cells.count() == 9 and cells.filter("y = x and c0 = 1 and c1 is null").count() == 9
    stems = {r["stem"] for r in files.index_by_stem(found).collect()}
    assert stems == {"a_s001", "b_s002", "c_3_s10_s07"}
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        files.image_files(spark, str(tmp_path / "empty"))
    with pytest.raises(Exception, match="no section number"):
        spark.range(1).select(files.section_number(F.lit("none.png"))).collect()


def test_series(spark, tmp_path):
    plane = [float(i) for i in range(9)]
    (tmp_path / "a.json").write_text(json.dumps({"gridspacing": 20, "slices": [
        {"filename": "m_s002.png", "nr": 2, "width": 10, "height": 5, "anchoring": plane, "grid": [0, 4], "gridx": 1, "gridy": 1},
        {"filename": "m_s002b.png", "nr": 2, "width": 20, "height": 5, "anchoring": plane, "markers": [[1, 2, 3, 4]]},
        {"filename": "m_s003.png", "width": 10, "height": 5, "anchoring": plane}, {"filename": "m_s009.png", "nr": 9, "width": 1, "height": 1}]}))
    found = {r["section_number"]: r for r in registration.read_registration(spark, str(tmp_path / "a.json")).collect()}
    assert found.keys() == {2, 3} and found[2]["width"] == 20 and found[2]["markers"] == [[1, 2, 3, 4]]
    assert (found[3]["ox"], found[3]["vz"], found[3]["plane_width"], found[3]["grid_spacing"]) == (0, 8, 8, 20)
    (tmp_path / "b.waln").write_text(json.dumps({"atlas": "x", "sections": [{"filename": "p_5.png", "width": 3, "height": 4, "ouv": plane}]}))
    (row,) = registration.read_registration(spark, str(tmp_path / "b.waln")).collect()
    assert (row["section_number"], row["grid"]) == (5, None)
    bare = registration.read_registration(spark, str(tmp_path / "a.json"), with_warp=False, with_damage=False)
    assert bare.filter("markers is not null or grid is not null").count() == 0
    with pytest.raises(ValueError):
        registration.read_registration(spark, "x.unknown")


def test_corners(spark, tmp_path):
    corners = [[0, 0, 0], [0, 0, 250], [0, 500, 0], [0, 500, 250]]
    (tmp_path / "c.json").write_text(json.dumps({"atlas": "some_mouse_25um", "atlas_slice_corners": corners, "moving_image": "x_s311"}))
    (row,) = registration.read_registration(spark, str(tmp_path / "c.json"), shape=(30, 40, 50)).collect()
    assert row["section_number"] == 311 and (row["width"], row["height"]) == (11, 21)
    assert [row[c] for c in registration.PLANE] == [49, 29, 39, -10, 0, 0, 0, 0, -20]
    with pytest.raises(ValueError):
        registration.resolution_of("mouse")


def test_tables(spark, tmp_path):
    (tmp_path / "l.txt").write_text('# comment\n 5  1 2 3  1 1 1 "Corpus callosum, left"\n\n')
    (row,) = tables.read_itksnap(spark, str(tmp_path / "l.txt")).collect()
    assert tuple(row) == (5, "Corpus callosum, left", 1, 2, 3)
    (tmp_path / "l.csv").write_text("idx,name,r,g,b,a\n7,x,1,2,3,4\n3,y,4,5,6,7\n")
    assert [(r["idx"], r["a"]) for r in tables.read_labels(spark, str(tmp_path / "l.csv")).orderBy("label_ordinal").collect()] == [(7, "4"), (3, "7")]
    assert [r["idx"] for r in tables.atlas_labels(spark, [{"id": 9, "name": "z", "rgb_triplet": [1, 1, 1]}]).collect()] == [0, 9]
    (tmp_path / "xy.csv").write_text(",X,Y,image_width,image_height,section number\n0,5.5,2,100,50,311\n")
    (row,) = tables.read_coordinates(spark, str(tmp_path / "xy.csv")).collect()
    assert (row["x"], row["section_number"]) == (5.5, 311)
    (tmp_path / "bad.csv").write_text("X,Y\n1,2\n")
    with pytest.raises(ValueError, match="section number"):
        tables.read_coordinates(spark, str(tmp_path / "bad.csv"))


def test_labels_of_anything(spark):
    frame = spark.createDataFrame([(1,)], "idx long")

    class Holder:
        labels = frame

    class Atlas:
        structures_list = [{"id": 4, "name": "x", "rgb_triplet": [1, 2, 3]}]

    assert tables.resolve_labels(spark, frame) is frame and tables.resolve_labels(spark, Holder()) is frame
    assert tables.resolve_labels(spark, Atlas()).count() == 2
    with pytest.raises(TypeError):
        tables.resolve_labels(spark, 3)


def test_jpeg(spark, tmp_path):
    image = spark._jvm.java.awt.image.BufferedImage(8, 6, 1)
    for y in range(6):
        for x in range(8):
            image.setRGB(x, y, 0x102030)
    spark._jvm.javax.imageio.ImageIO.write(image, "jpg", spark._jvm.java.io.File(str(tmp_path / "a_s005.jpg")))
    (tmp_path / "b_s006.png").write_bytes(rasters.encode_png(np.zeros((3, 2), np.uint8)))
    found = files.image_files(spark, str(tmp_path))
    sizes = {r["section_number"]: (r["seg_height"], r["seg_width"]) for r in rasters.image_sizes(found).collect()}
    assert sizes == {5: (6, 8), 6: (3, 2)}
    assert rasters.folder_pixels(spark, str(tmp_path), found).count() == 54
    assert rasters.folder_pixels(spark, str(tmp_path), found, foreground=True).count() == 48
    rows = rasters.jpeg_pixels(spark, str(tmp_path)).collect()
    assert len(rows) == 48 and {r["section_number"] for r in rows} == {5}
    assert all(abs(r["c0"] - 0x30) < 4 and abs(r["c2"] - 0x10) < 4 for r in rows)


def test_custom_regions(spark, tmp_path):
    path = tmp_path / "c.txt"
    path.write_text("caption\tone\ttwo\nRGB\t1;2;3\t4;5;6\nids\t10\t20\n\t11\t\n")
    rows = {tuple(r) for r in tables.read_custom_regions(spark, str(path)).collect()}
    assert rows == {(1, "one", 1, 2, 3, 10), (1, "one", 1, 2, 3, 11), (2, "two", 4, 5, 6, 20), (0, "unlabeled", 0, 0, 0, 0)}
    path.write_text("caption\tone\ttwo\nRGB\t1;2;3\t4;5;6\nids\t0\t20\n")
    assert {r["custom_id"] for r in tables.read_custom_regions(spark, str(path)).collect()} == {0, 1}
    for text in ("a\n", "a\tone\nRGB\t1;2\n", "a\tone\nRGB\t1;2;300\n", "a\tone\tone\nRGB\t1;2;3\t1;2;3\n"):
        path.write_text(text)
        with pytest.raises(ValueError):
            tables.read_custom_regions(spark, str(path))


def test_settings(tmp_path):
    found = {"alignment_json": "a", "atlas_name": "x_25um", "voxel_size_um": 10, "segmentation_folder": "s", "atlas_path": ""}
    (tmp_path / "s.json").write_text(json.dumps(found))
    made = Settings.from_file(str(tmp_path / "s.json")).normalised()
    made.check()
    assert made.voxel_size_um is None and made.atlas_path is None
    for bad in ({"image_folder": "i"}, {"min_intensity": 3}, {"atlas_name": None}, {"atlas_path": "a", "label_path": "b"}):
        with pytest.raises(ValueError):
            Settings.from_dict({**found, **bad}).check()
    with pytest.raises(ValueError):
        Settings.from_dict({"alignment_json": "a", "atlas_name": "x", "image_folder": "i", "colour": 3}).check()
    with pytest.raises(KeyError):
        Settings.from_dict({})
    assert gzip


def spreadsheet(rows):
    """An XLSX file with shared, inline and numeric cells."""
    strings, cells = [], ""
    for y, row in enumerate(rows, 1):
        cells += f'<row r="{y}">'
        for x, value in enumerate(row):
            at = f"{chr(65 + x)}{y}"
            if isinstance(value, str) and value:
                strings.append(value)
                cells += f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>' if x % 2 else f'<c r="{at}" t="inlineStr"><is><t>{value}</t></is></c>'
            elif value != "":
                cells += f'<c r="{at}"><v>{value}</v></c>'
        cells += "</row>"
    shared = [f"<si><t>{s}</t></si>" for s in strings]
    packed = io.BytesIO()
    name = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(packed, "w") as archive:
        archive.writestr("xl/sharedStrings.xml", f'<sst xmlns="{name}">{"".join(shared)}</sst>')
        archive.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{name}"><sheetData/></worksheet>')
        archive.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{name}"><sheetData>{cells}</sheetData></worksheet>')
    return packed.getvalue()


def test_custom_regions_from_a_spreadsheet(spark, tmp_path):
    table = [["caption", "one", "two"], ["RGB", "1;2;3", "4;5;6"], ["ids", 10, 20], ["", 11, ""]]
    (tmp_path / "c.xlsx").write_bytes(spreadsheet(table))
    (tmp_path / "c.txt").write_text("\n".join("\t".join(map(str, row)) for row in table))
    rows = [{tuple(r) for r in tables.read_custom_regions(spark, str(tmp_path / f"c.{kind}")).collect()} for kind in ("xlsx", "txt")]
    assert rows[0] == rows[1] and len(rows[0]) == 4


def test_displacement_fields(spark, tmp_path):
    corners = [[0, 0, 0], [0, 0, 250], [0, 500, 0], [0, 500, 250]]
    (tmp_path / "c.json").write_text(json.dumps({"atlas": "some_25um", "atlas_slice_corners": corners, "moving_image": "x_s311"}))
    sections = registration.read_registration(spark, str(tmp_path / "c.json"), shape=(30, 40, 50))
    with pytest.raises(FileNotFoundError, match="deformation_field_0"):
        registration.read_fields(sections)
    fields = np.random.default_rng(1).normal(0, 1, (2, 21, 11)).astype(np.float32)
    for name, field in zip(registration.FIELDS, fields, strict=True):
        (tmp_path / name).write_bytes(rasters.encode_tiff(field))
    rows = registration.read_fields(sections).collect()
    assert len(rows) == 231 and all(r["section_number"] == 311 and (r["dy"], r["dx"]) == tuple(fields[:, r["yi"], r["xi"]]) for r in rows)
    plain = registration.read_registration(spark, str(tmp_path / "c.json"), shape=(30, 40, 50), with_warp=False)
    assert registration.read_fields(plain) is None
    other = registration.read_registration(spark, str(tmp_path / "c.json"), shape=(30, 40, 50), warp=registration.with_fields(str(tmp_path)))
    assert registration.read_fields(other).count() == 231


def test_atlas_of_arrays(spark):
    from voxelloom import resolve_atlas
    from voxelloom.sources import atlases

    class Held:
        annotation = np.random.default_rng(2).integers(0, 5, (4, 3, 2))
        hemispheres = np.random.default_rng(3).integers(1, 3, (4, 3, 2))
        structures_list = [{"id": 4, "name": "x", "rgb_triplet": [1, 2, 3]}]
        resolution = (25, 25, 25)

    found = atlases.resolve_atlas(spark, Held())
    assert found.shape == (2, 4, 3) and found.voxel_size_um == 25 and found.has_hemi and resolve_atlas(found) is found
    turned = Held.annotation.transpose(2, 0, 1)[::-1, ::-1, ::-1]
    assert all(turned[r["x"], r["y"], r["z"]] == r["label"] for r in found.voxels.collect()) and found.voxels.count() == 24
    with pytest.raises(TypeError):
        atlases.resolve_atlas(spark, 3)
