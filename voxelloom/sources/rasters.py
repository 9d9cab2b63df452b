"""Decoders of raster files, and image pixels as rows.

PNG (also interlaced), BMP, TIFF and BigTIFF (strips and tiles, plain, deflate,
LZW and PackBits, with horizontal differences, in one or several planes), Deep
Zoom archives of PNG tiles, SegRLE and flat rasters are decoded with numpy and
zlib; JPEG goes through Spark's image source. Colour comes in stored order blue,
green, red."""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "path string, section_number int, height int, width int, y int, x int, c0 int, c1 int, c2 int"
RUNS = "path string, section_number int, height int, width int, start long, length long, label long"
BATCH = 200_000


def decode_png(data: bytes) -> np.ndarray:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, palette, head = 8, [], None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    lines = zlib.decompress(b"".join(packed))
    image = np.zeros((height, width, planes), np.uint16 if depth == 16 else np.uint8)
    at = 0
    for y, x, dy, dx in ADAM7 if interlaced else ((0, 0, 1, 1),):
        place = image[y::dy, x::dx]
        if place.size:
            part, at = _pass(lines, at, place.shape[0], place.shape[1], planes, depth)
            place[:] = part
    if colour == 0 and depth < 8:
        image = image * np.uint8(255 // (2**depth - 1))
    if colour == 3:
        image = palette[image[:, :, 0]]
    if image.shape[2] >= 3:
        return image[:, :, 2::-1]
    return image[:, :, 0]


#: First row and column, and their steps, of the seven passes (fixed values).
ADAM7 = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _pass(data: bytes, at: int, height: int, width: int, planes: int, depth: int) -> tuple[np.ndarray, int]:
    """The pixels of one pass that starts at a byte, and where it ends."""
    row, step = (width * planes * depth + 7) // 8, max(1, planes * depth // 8)
    lines = np.frombuffer(data, np.uint8, height * (row + 1), at).reshape(height, row + 1)
    out = _unfiltered(lines[:, 0], lines[:, 1:], step)
    if depth == 16:
        image = out.view(">u2").astype(np.uint16)
    elif depth == 8:
        image = out
    else:
        bits = np.unpackbits(out, axis=1).reshape(height, -1, depth)[:, : width * planes]
        image = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
    return image.reshape(height, width, planes), at + height * (row + 1)


def _unfiltered(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Bytes of filtered lines. A byte depends on the ones before it, above it and
    before that, so all bytes on a diagonal are known at once."""
    height, row = lines.shape
    if not kinds.any():
        return np.ascontiguousarray(lines)
    width = -(-row // step)
    raw = np.zeros((height, width, step), np.int16)
    raw.reshape(height, -1)[:, :row] = lines
    out = np.zeros((height + 1, width + 1, step), np.int16)
    if kinds.max() <= 2:  # whole lines at a time
        for y, kind in enumerate(kinds.tolist()):
            if kind == 1:
                out[y + 1, 1:] = np.cumsum(raw[y], 0, dtype=np.int64) & 255
            else:
                out[y + 1, 1:] = raw[y] + (out[y, 1:] if kind == 2 else 0) & 255
    else:
        kinds = kinds.astype(np.int64)
        for d in range(width + height - 1):
            ys = np.arange(max(0, d - width + 1), min(height, d + 1))
            xs = d - ys
            a, b, c = (out[ys + i, xs + j].astype(np.int32) for i, j in ((1, 0), (0, 1), (0, 0)))
            kind = kinds[ys][:, None]
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            paeth = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
            guess = np.choose(kind, [np.zeros_like(a), a, b, (a + b) // 2, paeth])
            out[ys + 1, xs + 1] = raw[ys, xs] + guess & 255
    return np.ascontiguousarray(out[1:, 1:].reshape(height, -1)[:, :row].astype(np.uint8))


def encode_png(image: np.ndarray) -> bytes:
    """An 8- or 16-bit grey, or 8-bit red-green-blue image."""
    height, width = image.shape[:2]
    planes = 1 if image.ndim == 2 else image.shape[2]
    depth = 16 if image.dtype == np.uint16 else 8
    data = image.astype(">u2" if depth == 16 else np.uint8).reshape(height, -1)
    rows = b"".join(b"\0" + line.tobytes() for line in data)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, depth, {1: 0, 3: 2}[planes], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def decode_bmp(data: bytes) -> np.ndarray:
    offset, _, width, height, _, bits, packing = struct.unpack("<IIiiHHI", data[10:34])
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("only plain 8-, 24- and 32-bit BMP files are supported")
    row = (width * bits // 8 + 3) // 4 * 4
    lines = np.frombuffer(data, np.uint8, row * abs(height), offset).reshape(abs(height), row)[:, : width * bits // 8]
    image = lines.reshape(abs(height), width, -1)
    image = image[::-1] if height > 0 else image
    if bits > 8:
        return image[:, :, :3]
    palette = np.frombuffer(data[14 + struct.unpack("<I", data[14:18])[0] : offset], np.uint8).reshape(-1, 4)
    return palette[image[:, :, 0], :3]


def tiff_tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of the first image of a TIFF or BigTIFF file."""
    end = {b"II": "<", b"MM": ">"}[data[:2]]
    (version,) = struct.unpack(end + "H", data[2:4])
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    word, count, head, entry = ("Q", "Q", 8, 20) if version == 43 else ("I", "H", 4, 12)
    size = struct.calcsize(end + word)
    (at,) = struct.unpack_from(end + word, data, head)
    tags: dict[int, tuple] = {}
    (n_tags,) = struct.unpack_from(end + count, data, at)
    for i in range(n_tags):
        place = at + struct.calcsize(end + count) + entry * i
        tag, kind, n = struct.unpack_from(end + "HH" + word, data, place)
        code, width = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}.get(kind, ("B", 1))
        place += 4 + size
        if n * width > size:
            (place,) = struct.unpack_from(end + word, data, place)
        tags[tag] = struct.unpack_from(f"{end}{n}{code}", data, place)
    return end, tags


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first."""
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, before, out = list(fresh), 9, b"", []
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = list(fresh), 9, b""
            continue
        if code > len(table) or (code == len(table) and not before):
            raise ValueError("broken LZW data")
        word = table[code] if code < len(table) else before + before[:1]
        out.append(word)
        if before:
            table.append(before + word[:1])
        before = word
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


TIFF_PACKINGS = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def decode_tiff(data: bytes) -> np.ndarray:
    end, tags = tiff_tags(data)
    width, height = tags[256][0], tags[257][0]
    bits, planes, packing = tags.get(258, (1,))[0], tags.get(277, (1,))[0], tags.get(259, (1,))[0]
    predictor, photometric = tags.get(317, (1,))[0], tags.get(262, (1,))[0]
    whole = {1: "u", 2: "i", 3: "f"}.get(tags.get(339, (1,))[0])
    if packing not in TIFF_PACKINGS or predictor not in (1, 2) or bits not in (1, 8, 16, 32, 64) or whole is None or (bits == 1 and planes > 1):
        raise ValueError(f"TIFF compression {packing}, predictor {predictor}, {bits} bits of sample format {tags.get(339)} is not supported")
    kind = np.dtype(f"{end}{whole}{max(1, bits // 8)}")
    apart = tags.get(284, (1,))[0] == 2
    each = 1 if apart else planes
    if 322 in tags:
        wide, tall, starts, sizes = tags[322][0], tags[323][0], tags[324], tags[325]
    else:
        wide, tall, starts, sizes = width, min(height, tags.get(278, (height,))[0]), tags[273], tags[279]
    across, down = -(-width // wide), -(-height // tall)
    image = np.zeros((height, width, planes), kind.newbyteorder("="))
    for i, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        plane, place = divmod(i, across * down)
        y, x = place // across * tall, place % across * wide
        rows = tall if 322 in tags else min(tall, height - y)
        raw = TIFF_PACKINGS[packing](data[start : start + size])
        if bits == 1:
            line = -(-wide // 8)
            part = np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1)[:, :wide, None]
        else:
            part = np.frombuffer(raw, kind, rows * wide * each).reshape(rows, wide, each).astype(kind.newbyteorder("="))
        if predictor == 2:
            part = np.cumsum(part, 1, dtype=part.dtype)
        spot = image[y : y + tall, x : x + wide, plane : plane + 1] if apart else image[y : y + tall, x : x + wide]
        spot[:] = part[: spot.shape[0], : spot.shape[1]]
    if bits == 1:
        image = image * np.uint8(255)
    if photometric == 0 and whole == "u":
        image = np.iinfo(image.dtype).max - image
    if photometric == 3:
        colours = np.array(tags[320]).reshape(3, -1) >> 8
        return colours[::-1].T[image[:, :, 0]].astype(np.uint8)
    return image[:, :, 2::-1] if planes >= 3 else image[:, :, 0]


def encode_tiff(image: np.ndarray) -> bytes:
    """A plain TIFF of one grey plane, of whole numbers or floats."""
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    body = np.ascontiguousarray(image).astype(image.dtype.newbyteorder("<")).tobytes()
    tags = ((256, 4, image.shape[1]), (257, 4, image.shape[0]), (258, 3, 8 * image.itemsize), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (279, 4, len(body)), (339, 3, kind))
    entries = b"".join(struct.pack("<HHII", tag, code, 1, value) for tag, code, value in tags)
    return struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + struct.pack("<H", len(tags)) + entries + b"\0" * 4


def decode_dzi(data: bytes) -> np.ndarray:
    """A Deep Zoom archive from the tiles of its highest level; overlap is not
    taken into account."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        tiles = [n for n in archive.namelist() if n.endswith(".png")]
        top = max(int(n.split("/")[-2]) for n in tiles)
        root = ET.fromstring(archive.read(next(n for n in archive.namelist() if n.endswith(".dzi"))))
        size = next(e for e in root.iter() if e.tag.endswith("Size"))
        tile = int(root.attrib["TileSize"])
        image = np.zeros((int(size.attrib["Height"]), int(size.attrib["Width"]), 3), np.uint8)
        for name in tiles:
            if int(name.split("/")[-2]) != top:
                continue
            col, row = map(int, name.split("/")[-1].rsplit(".", 1)[0].split("_"))
            part = decode_png(archive.read(name))
            part = np.repeat(part[:, :, None], 3, 2) if part.ndim == 2 else part
            place = image[row * tile : row * tile + part.shape[0], col * tile : col * tile + part.shape[1]]
            place[:] = part[: place.shape[0], : place.shape[1]]
    return image


def decode_flat(data: bytes) -> np.ndarray:
    """Big-endian header (bytes per pixel, width, height), then pixels."""
    size, width, height = struct.unpack(">BII", data[:9])
    if size not in (1, 2):
        raise ValueError(f"a flat raster has 1 or 2 bytes a pixel, not {size}")
    return np.frombuffer(data, f">u{size}", width * height, 9).reshape(height, width).astype(float)


def encode_flat(image: np.ndarray) -> bytes:
    size = 2 if image.dtype.itemsize > 1 else 1
    return struct.pack(">BII", size, image.shape[1], image.shape[0]) + image.astype(f">u{size}").tobytes()


def segrle_runs(data: bytes) -> tuple[int, int, list[tuple[int, int, int]]]:
    """(width, height, runs of (start, length, label)) of a SegRLEv1 raster."""
    if data[:8] != b"SegRLEv1":
        raise ValueError("not a SegRLEv1 file")
    at = 8

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    size = number()
    at += size
    codes = [number() for _ in range(number())]
    width, height = number(), number()
    runs, start = [], 0
    while start < width * height:
        if len(codes) <= 256:
            code, at = data[at], at + 1
        else:
            code = number()
        length = number() + 1
        if code >= len(codes):
            raise ValueError(f"code {code} of {len(codes)} codes")
        if start + length > width * height:
            raise ValueError(f"a run ends at {start + length} of {width * height} pixels")
        runs.append((start, length, codes[code]))
        start += length
    return width, height, runs


def encode_segrle(image: np.ndarray, atlas: str = "") -> bytes:
    def number(value: int) -> bytes:
        out = b""
        while value > 127:
            out, value = out + bytes([value & 127 | 128]), value >> 7
        return out + bytes([value])

    flat, name = image.ravel(), atlas.encode()
    codes = np.unique(flat)
    cuts = np.flatnonzero(np.diff(flat)) + 1
    starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(flat)]])
    out = [b"SegRLEv1", number(len(name)), name, number(len(codes)), *map(number, codes.tolist()), number(image.shape[1]), number(image.shape[0])]
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        code = int(np.searchsorted(codes, flat[a]))
        out += [bytes([code]) if len(codes) <= 256 else number(code), number(b - a - 1)]
    return b"".join(out)


ENCODERS = {"png": encode_png, "tif": encode_tiff, "tiff": encode_tiff, "flat": encode_flat, "seg": encode_segrle}
DECODERS = {"png": decode_png, "bmp": decode_bmp, "tif": decode_tiff, "tiff": decode_tiff, "dzip": decode_dzi, "flat": decode_flat}
SIZES = "path string, section_number int, seg_height int, seg_width int"


def ending(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


def decode(path: str, data: bytes) -> np.ndarray:
    if ending(path) not in DECODERS:
        raise ValueError(f"no decoder for {path}")
    return DECODERS[ending(path)](data)


def jpeg_size(data: bytes) -> tuple[int, int]:
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return struct.unpack(">HH", data[at + 5 : at + 9])
        at += 1 if kind == 0xFF else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    raise ValueError("a JPEG file without a frame")


def size_of(path: str, data: bytes) -> tuple[int, int]:
    """Height and width from a file's header; no pixel is decoded."""
    kind = ending(path)
    if kind == "png":
        width, height = struct.unpack(">II", data[16:24])
    elif kind == "bmp":
        width, height = struct.unpack("<ii", data[18:26])
    elif kind in ("tif", "tiff"):
        tags = tiff_tags(data)[1]
        width, height = tags[256][0], tags[257][0]
    elif kind in ("jpg", "jpeg"):
        height, width = jpeg_size(data)
    elif kind == "flat":
        _, width, height = struct.unpack(">BII", data[:9])
    elif kind == "dzip":
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            root = ET.fromstring(archive.read(next(n for n in archive.namelist() if n.endswith(".dzi"))))
        size = next(e for e in root.iter() if e.tag.endswith("Size"))
        height, width = int(size.attrib["Height"]), int(size.attrib["Width"])
    else:
        raise ValueError(f"no decoder for {path}")
    return abs(height), width


def image_sizes(files: DataFrame) -> DataFrame:
    """path, section_number, seg_height and seg_width of every file, whether it
    has foreground or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [size_of(p.as_py(), c.as_py()) for p, c in zip(batch.column(0), batch.column(1), strict=True)]
            columns = [pa.array([s[i] for s in sizes], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=[c.split()[0] for c in SIZES.split(", ")])

    return files.select("path", "content", F.col("section_number").cast("int")).mapInArrow(run, SIZES)


def folder_pixels(spark: SparkSession, folder: str, files: DataFrame, foreground: bool = False) -> DataFrame:
    """Pixels of all images of a folder, in whatever format."""
    is_jpeg = F.lower("path").rlike(r"\.jpe?g$")
    rows = image_pixels(files.filter(~is_jpeg), foreground)
    if files.filter(is_jpeg).select("path").isEmpty():
        return rows
    jpegs = jpeg_pixels(spark, folder)
    if foreground:
        jpegs = jpegs.filter("c0 <> 0 or coalesce(c1, 0) <> 0 or coalesce(c2, 0) <> 0")
    return rows.unionByName(jpegs)


def image_pixels(files: DataFrame, foreground: bool = False) -> DataFrame:
    """Pixels of files (path, content, section_number) as rows; grey images have
    c0 alone. With foreground, pixels that are 0 in all channels stay in the
    decoder. One image is decoded by one task and leaves it in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in PIXELS.split(", ")]
        for batch in batches:
            for path, content, section in zip(*(batch.column(c) for c in ("path", "content", "section_number")), strict=True):
                image = decode(path.as_py(), content.as_py())
                planes = image[:, :, None] if image.ndim == 2 else image
                height, width = planes.shape[:2]
                keep = np.flatnonzero(planes.any(2)) if foreground else np.arange(height * width)
                flat = planes.reshape(height * width, -1)
                for at in np.array_split(keep, max(1, -(-len(keep) // BATCH))):
                    n = len(at)
                    channels = [pa.array(flat[at, i].astype(np.int32)) if i < flat.shape[1] else pa.nulls(n, pa.int32()) for i in range(3)]
                    columns = [pa.array([path.as_py()] * n), pa.array([section.as_py()] * n, pa.int32()), *(pa.array(np.full(n, v, np.int32)) for v in (height, width))]
                    columns += [pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32)), *channels]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return files.select("path", "content", F.col("section_number").cast("int")).mapInArrow(run, PIXELS)


def segrle_rows(files: DataFrame) -> DataFrame:
    """Runs of SegRLE files; areas are sums of `length`, no pixel is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in RUNS.split(", ")]
        for batch in batches:
            for path, content, section in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "section_number")), strict=True):
                width, height, runs = segrle_runs(content)
                n = len(runs)
                heads = [pa.array([path] * n), pa.array([section] * n, pa.int32()), pa.array([height] * n, pa.int32()), pa.array([width] * n, pa.int32())]
                yield pa.RecordBatch.from_arrays([*heads, *(pa.array([r[i] for r in runs], pa.int64()) for i in range(3))], names=names)

    return files.select("path", "content", F.col("section_number").cast("int")).mapInArrow(run, RUNS)


def run_pixels(runs: DataFrame) -> DataFrame:
    at = runs.withColumn("_i", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)))
    return at.select("path", "section_number", "height", "width", F.floor(F.col("_i") / F.col("width")).cast("int").alias("y"), (F.col("_i") % F.col("width")).cast("int").alias("x"), "label")


def jpeg_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of a folder's JPEG files, decoded by Spark's image source."""
    from .files import section_number

    files = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", "*.[jJ][pP]*[gG]").load(folder).select("image.*")
    files = files.withColumn("origin", F.regexp_replace("origin", "^file:/+", "file:/"))
    files = files.filter(F.lower("origin").rlike(r"\.jpe?g$")).withColumn("section_number", section_number(F.col("origin")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in PIXELS.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                height, width, planes = row["height"], row["width"], row["nChannels"]
                flat = np.frombuffer(row["data"], np.uint8).reshape(height * width, planes)
                for at in np.array_split(np.arange(height * width), max(1, -(-height * width // BATCH))):
                    n = len(at)
                    channels = [pa.array(flat[at, i].astype(np.int32)) if i < min(planes, 3) else pa.nulls(n, pa.int32()) for i in range(3)]
                    heads = [pa.array([row["origin"]] * n), *(pa.array(np.full(n, v, np.int32)) for v in (row["section_number"], height, width))]
                    yield pa.RecordBatch.from_arrays([*heads, pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32)), *channels], names=names)

    return files.select("origin", "section_number", "height", "width", "nChannels", "data").mapInArrow(run, PIXELS)
