"""Label tables, coordinate tables and custom regions."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "idx long, name string, r int, g int, b int"
COORDINATES = ("X", "Y", "image_width", "image_height", "section number")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A CSV label table; label_ordinal keeps the file's order."""
    rows = spark.read.csv(path, header=True).withColumn("label_ordinal", F.monotonically_increasing_id())
    kinds = {"idx": "long", "name": "string", "r": "int", "g": "int", "b": "int"}
    return rows.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()], *[c for c in rows.columns if c not in kinds])


def read_itksnap(spark: SparkSession, path: str) -> DataFrame:
    """Lines `idx r g b a vis mesh "name"`; comments start with #."""
    line = F.trim("value")
    rows = spark.read.text(path).filter((line != "") & ~line.startswith("#"))
    parts = F.split(F.trim("value"), r"\s+", 8)
    name = F.regexp_replace(parts[7], r'^"|"$', "")
    numbers = [F.try_element_at(parts, F.lit(i + 1)).try_cast("long" if i == 0 else "int").alias(c) for i, c in enumerate(("idx", "r", "g", "b"))]
    return rows.select(*numbers, name.alias("name")).filter("idx is not null").select("idx", "name", "r", "g", "b")


def atlas_labels(spark: SparkSession, structures: list[dict]) -> DataFrame:
    """Labels of an atlas's structures (id, name, rgb_triplet), after a row for 0."""
    rows = [(0, "Clear Label", 0, 0, 0), *((s["id"], s["name"], *s["rgb_triplet"]) for s in structures)]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], LABELS + ", label_ordinal long")


def resolve_labels(spark: SparkSession, found: object) -> DataFrame:
    """A label table from a DataFrame, an atlas, or a list of structures."""
    if isinstance(found, DataFrame):
        return found
    if isinstance(getattr(found, "labels", None), DataFrame):
        return found.labels
    structures = getattr(found, "structures_list", found)
    if isinstance(structures, list):
        return atlas_labels(spark, structures)
    raise TypeError(f"no labels in {type(found).__name__}")


def check_coordinates(df: DataFrame) -> DataFrame:
    missing = [c for c in COORDINATES if c not in df.columns]
    if missing:
        raise ValueError(f"the coordinate table lacks {missing}")
    return df


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """x, y, image_width, image_height, section_number of a coordinate CSV."""
    return named_coordinates(check_coordinates(spark.read.csv(path, header=True)))


def named_coordinates(rows: DataFrame) -> DataFrame:
    """A coordinate table under the library's names; ordinal keeps its order."""
    kinds = {"X": ("x", "double"), "Y": ("y", "double"), "image_width": ("image_width", "int"), "image_height": ("image_height", "int"), "section number": ("section_number", "int")}
    return rows.select(*[F.col(f"`{c}`").cast("double").cast(k).alias(n) for c, (n, k) in kinds.items()]).withColumn("ordinal", F.monotonically_increasing_id())


def sheet_rows(data: bytes) -> list[list[str]]:
    """The cells of an XLSX file's first sheet as text, empty ones as empty text."""

    def local(element: ET.Element) -> str:
        return element.tag.rsplit("}", 1)[-1]

    def text(element: ET.Element) -> str:
        return "".join(e.text or "" for e in element.iter() if local(e) == "t")

    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        strings = [text(e) for e in ET.fromstring(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        sheet = ET.fromstring(archive.read(sheets[0]))
    rows: list[list[str]] = []
    for row in (e for e in sheet.iter() if local(e) == "row"):
        cells: dict[int, str] = {}
        for cell in (e for e in row if local(e) == "c"):
            letters = re.sub(r"\d", "", cell.get("r", "")).upper()
            at = len(cells)
            if letters:
                at = -1
                for letter in letters:
                    at = (at + 1) * 26 + ord(letter) - ord("A")
            value = next((e.text or "" for e in cell if local(e) == "v"), "")
            cells[at] = strings[int(value)] if cell.get("t") == "s" else text(cell) if cell.get("t") == "inlineStr" else value
        rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return rows


def read_custom_regions(spark: SparkSession, path: str) -> DataFrame:
    """A wide table of custom regions, as tab-separated text or a spreadsheet:
    names, then `R;G;B`, then atlas ids below each name; the first column is a
    caption. Rows (custom_id, custom_name, r, g,
    b, subregion_id); a group that holds 0 gets id 0, and `unlabeled` is added
    where none does. The file is a handful of columns."""
    if path.lower().endswith(".xlsx"):
        lines = sheet_rows(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
    else:
        lines = [r[0].split("\t") for r in spark.read.text(path).collect()]
    if not lines or len(lines[0]) < 2:
        raise ValueError("a custom region file has at least two columns")
    names, colours, body = lines[0][1:], lines[1][1:], lines[2:]
    if len(set(names)) != len(names):
        raise ValueError("custom region names repeat")
    rows, next_id, has_zero = [], 1, False
    for i, name in enumerate(names):
        parts = (colours[i] if i < len(colours) else "").split(";")
        if len(parts) != 3 or not all(p.strip().isdigit() and int(p) <= 255 for p in parts):
            raise ValueError(f"{name}: a colour is three numbers from 0 to 255 like 10;20;30")
        ids = [int(float(line[i + 1])) for line in body if i + 1 < len(line) and line[i + 1].strip()]
        custom = 0 if 0 in ids else next_id
        has_zero, next_id = has_zero or custom == 0, next_id + (custom != 0)
        rows += [(custom, name, *map(int, parts), region) for region in ids]
    if not has_zero:
        rows.append((0, "unlabeled", 0, 0, 0, 0))
    return spark.createDataFrame(rows, "custom_id long, custom_name string, r int, g int, b int, subregion_id long")
