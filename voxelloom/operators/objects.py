"""Objects in section images: labelled regions, connected components, and the
region that most of an object's pixels lie in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = "section_number int, y int, x int, component int"
#: Cells of a mask that sections share.
STACKED = 4_000_000


def label_components(mask: np.ndarray, connectivity: int = 4) -> np.ndarray:
    """Components of a boolean raster numbered from 1 in raster order of their
    first pixel; 0 is background. Runs of each row are joined by union-find."""
    height, width = mask.shape
    padded = np.zeros((height, width + 2), np.int8)
    padded[:, 1:-1] = mask
    change = np.diff(padded, axis=1)
    row, start = np.nonzero(change == 1)
    stop = np.nonzero(change == -1)[1]
    up = np.arange(len(row))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    reach = 1 if connectivity == 8 else 0
    first = np.searchsorted(row, np.arange(height + 1))
    for y in range(1, height):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] < stop[j] + reach and start[j] < stop[i] + reach:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
            if stop[i] < stop[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(row))], np.int64)
    numbers = np.unique(roots, return_inverse=True)[1] + 1 if len(roots) else roots
    out = np.zeros((height, width), np.int32)
    for y, a, b, n in zip(row, start, stop, numbers, strict=True):
        out[y, a:b] = n
    return out


def label_sections(section: np.ndarray, y: np.ndarray, x: np.ndarray, connectivity: int = 4) -> np.ndarray:
    """Components of the pixels of many sections, sorted by section, each
    section's numbered from 1. Sections are stacked with an empty line between
    them and labelled together, as many at a time as a small mask holds."""
    starts = np.flatnonzero(np.diff(section, prepend=section[:1] - 1)) if len(section) else np.array([], int)
    stops = np.append(starts[1:], len(section))
    out = np.zeros(len(section), np.int32)
    at = 0
    while at < len(starts):
        height = width = 0
        place, n = [], at
        while n < len(starts):
            rows = slice(starts[n], stops[n])
            low, wide = y[rows].min(), x[rows].max() - x[rows].min() + 1
            tall = y[rows].max() - low + 2
            if n > at and (height + tall) * max(width, wide) > STACKED:
                break
            place.append((rows, low, x[rows].min(), height))
            height, width, n = height + tall, max(width, wide), n + 1
        mask = np.zeros((height, width), bool)
        spots = [(y[rows] - low + top, x[rows] - left) for rows, low, left, top in place]
        for spot in spots:
            mask[spot] = True
        found = label_components(mask, connectivity)
        for (rows, *_), spot in zip(place, spots, strict=True):
            numbers = found[spot]
            out[rows] = numbers - numbers.min() + 1
        at = n
    return out


def connected_pixels(pixels: DataFrame, connectivity: int = 4) -> DataFrame:
    """Foreground pixels (section_number, y, x) with their component. A section
    is one image and is held by one task, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def labelled(columns: list[np.ndarray]) -> pa.RecordBatch:
            found = label_sections(*columns, connectivity)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, found)], names=["section_number", "y", "x", "component"])

        def together() -> list[np.ndarray]:
            return [np.concatenate([part[i] for part in held]) for i in range(3)]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy() for c in batch.columns])
            if held[0][0][0] != held[-1][0][-1]:  # a section has ended
                columns = together()
                whole = int(np.searchsorted(columns[0], columns[0][-1]))
                yield labelled([c[:whole] for c in columns])
                held = [[c[whole:] for c in columns]]
        if held:
            yield labelled(together())

    rows = pixels.select(*[F.col(c).cast("int") for c in ("section_number", "y", "x")]).filter("section_number is not null and y is not null and x is not null")
    return rows.repartition("section_number").sortWithinPartitions("section_number").mapInArrow(run, COMPONENTS)


def object_table(pixels: DataFrame, by: str = "component", cutoff: int = 0) -> DataFrame:
    """Area and centroid of each object; objects of at most `cutoff` pixels are
    left out, their pixels are not."""
    found = pixels.groupBy("section_number", by).agg(F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    return found.filter(F.col("area") > cutoff)


def object_pixels(pixels: DataFrame, by: str = "component") -> DataFrame:
    """The pixel list of each object, in raster order."""
    return pixels.groupBy("section_number", by).agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("coords"))


def labelled_pixels(raster: DataFrame, value: str = "value") -> DataFrame:
    """Pixels of a label image, each non-zero value an object."""
    return raster.filter(F.col(value) != 0)


def majority_labels(pixels: DataFrame, by: str = "component", label: str = "label") -> DataFrame:
    """The label most pixels of an object have, the smallest on a tie. Pixels
    outside the map have a null label and don't vote; without votes it is 0."""
    votes = pixels.groupBy("section_number", by, label).agg(F.count(label).alias("n"))
    vote = F.when(F.col(label).isNotNull(), F.struct("n", (-F.col(label)).alias("least")))
    found = votes.groupBy("section_number", by).agg(F.max(vote).alias("best"))
    return found.select("section_number", by, F.coalesce(-F.col("best.least"), F.lit(0)).cast("long").alias("label"))
