"""Atlases from files, from objects that hold arrays, or as they are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Atlas
from ..operators.geometry import reorient_raw
from ..storage import scratch
from .tables import atlas_labels, read_labels
from .volumes import load_atlas, volume_shape

#: Voxels of an array that go to Spark at a time.
SLAB = 4_000_000


def voxels_of(spark: SparkSession, annotation: np.ndarray, hemispheres: np.ndarray | None = None) -> DataFrame:
    """x, y, z, label (and hemi) of arrays that the driver holds, written slab by
    slab as a table, so that no plan carries a volume."""
    path, kind = scratch(spark, "atlas"), "x int, y int, z int, label long" + (", hemi int" if hemispheres is not None else "")
    nx, ny, nz = annotation.shape
    step = max(1, SLAB // max(1, ny * nz))
    for low in range(0, nx, step):
        part = annotation[low : low + step]
        x, y, z = np.indices(part.shape, np.int32).reshape(3, -1)
        columns = {"x": x + np.int32(low), "y": y, "z": z, "label": part.ravel().astype(np.int64)}
        if hemispheres is not None:
            columns["hemi"] = hemispheres[low : low + step].ravel().astype(np.int32)
        spark.createDataFrame(pa.table(columns)).write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)


def custom_atlas(spark: SparkSession, annotation: str, labels: str, hemispheres: str | None = None, voxel_size_um: float | None = None) -> Atlas:
    """An atlas of NRRD files and a label table, as they are oriented."""
    return Atlas(load_atlas(spark, annotation, hemispheres), read_labels(spark, labels), volume_shape(annotation), voxel_size_um)


def resolve_atlas(spark: SparkSession, found: object) -> Atlas:
    """An Atlas as it is; of an object with the arrays `annotation` and maybe
    `hemispheres`, `structures_list` and `resolution`, its volumes turned to
    internal orientation and its labels."""
    if isinstance(found, Atlas):
        return found
    annotation = getattr(found, "annotation", None)
    if annotation is None:
        raise TypeError(f"no atlas in {type(found).__name__}")
    raw = np.asarray(annotation)
    hemispheres = getattr(found, "hemispheres", None)
    voxels = voxels_of(spark, raw, None if hemispheres is None else np.asarray(hemispheres))
    resolution = getattr(found, "resolution", None)
    shape = (raw.shape[2], raw.shape[0], raw.shape[1])
    turned = reorient_raw(voxels, raw.shape).select(*(F.col(c).cast("int") for c in "xyz"), *voxels.columns[3:])
    return Atlas(turned, atlas_labels(spark, found.structures_list), shape, float(resolution[0]) if resolution is not None else None)
