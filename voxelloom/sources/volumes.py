"""NRRD volumes as a Python data source: one partition per slab of the last
axis, so that a large volume is read by many tasks where it is stored plain."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import located, write_bytes

SCHEMA = "x int, y int, z int, value double"
TYPES = {
    "int8": "i1", "signed char": "i1", "uint8": "u1", "uchar": "u1", "unsigned char": "u1",
    "int16": "i2", "short": "i2", "uint16": "u2", "ushort": "u2", "unsigned short": "u2",
    "int32": "i4", "int": "i4", "uint32": "u4", "uint": "u4", "unsigned int": "u4",
    "int64": "i8", "uint64": "u8", "float": "f4", "double": "f8",
}


def parse_header(head: bytes) -> tuple[dict[str, str], int]:
    """Fields of an attached NRRD header, and where the data starts."""
    if not head.startswith(b"NRRD"):
        raise ValueError("not an NRRD file")
    stop = head.find(b"\n\n")
    if stop < 0:
        raise ValueError("the NRRD header has no end")
    fields = {}
    for line in head[:stop].decode("ascii", "replace").splitlines()[1:]:
        name, mark, value = line.partition(":")
        if mark and not line.startswith("#"):
            fields[name.strip().lower()] = value.lstrip("=").strip()
    return fields, stop + 2


def dtype_of(fields: dict[str, str]) -> np.dtype:
    order = ">" if fields.get("endian", "little") == "big" else "<"
    return np.dtype(order + TYPES[fields["type"]])


def write_nrrd(path: str, volume: np.ndarray, packed: bool = False) -> None:
    names = {"i": "int", "u": "uint", "f": "float"}
    size = volume.dtype.itemsize
    kind = names[volume.dtype.kind] + str(8 * size) if volume.dtype.kind != "f" else {4: "float", 8: "double"}[size]
    head = f"NRRD0004\ntype: {kind}\ndimension: 3\nsizes: {' '.join(map(str, volume.shape))}\nendian: little\nencoding: {'gzip' if packed else 'raw'}\n\n"
    body = np.asfortranarray(volume).astype(volume.dtype.newbyteorder("<")).tobytes(order="F")
    write_bytes(path, head.encode() + (gzip.compress(body) if packed else body))


@dataclass
class Slab(InputPartition):
    start: int
    stop: int


class NrrdReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.nonzero = options["path"], options.get("nonzero", "false").lower() == "true"
        self.most = int(options.get("slabVoxels", 4_000_000))
        system, path = located(self.path)
        with system.open_input_file(path) as file:
            self.fields, self.offset = parse_header(file.read(65536))
        self.shape = tuple(map(int, self.fields["sizes"].split()))
        if len(self.shape) != 3:
            raise ValueError("only volumes of three axes are supported")

    def partitions(self) -> Sequence[InputPartition]:
        nx, ny, nz = self.shape
        if self.fields.get("encoding", "raw") != "raw":
            return [Slab(0, nz)]  # a packed stream has no other start
        step = max(1, self.most // max(1, nx * ny))
        return [Slab(z, min(z + step, nz)) for z in range(0, nz, step)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        nx, ny, _ = self.shape
        kind, system_path = dtype_of(self.fields), located(self.path)
        layer = nx * ny * kind.itemsize
        with system_path[0].open_input_file(system_path[1]) as file:
            if self.fields.get("encoding", "raw") == "raw":
                file.seek(self.offset + partition.start * layer)
                take = file.read
            else:
                file.seek(self.offset)
                inflate, held = zlib.decompressobj(47), bytearray()

                def take(size: int) -> bytes:
                    while len(held) < size and (packed := inflate.unconsumed_tail or file.read(1 << 16)):
                        held.extend(inflate.decompress(packed, 1 << 22))
                    out = bytes(held[:size])
                    del held[:size]
                    return out

            for z in range(partition.start, partition.stop):
                flat = np.frombuffer(take(layer), kind)
                at = np.flatnonzero(flat) if self.nonzero else np.arange(len(flat))
                columns = [pa.array((at % nx).astype(np.int32)), pa.array((at // nx).astype(np.int32)), pa.array(np.full(len(at), z, np.int32)), pa.array(flat[at].astype(float))]
                yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "z", "value"])


class NrrdSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nrrd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> NrrdReader:
        return NrrdReader(dict(self.options))


def read_nrrd(spark: SparkSession, path: str, nonzero: bool = False) -> DataFrame:
    spark.dataSource.register(NrrdSource)
    return spark.read.format("nrrd").option("nonzero", str(nonzero).lower()).load(path)


def volume_shape(path: str) -> tuple[int, ...]:
    return NrrdReader({"path": path}).shape


def load_atlas(spark: SparkSession, annotation: str, hemispheres: str | None = None) -> DataFrame:
    """Voxels (x, y, z, label, hemi) of a custom atlas; not reoriented."""
    labels = read_nrrd(spark, annotation).selectExpr("x", "y", "z", "cast(value as long) label")
    if hemispheres is None:
        return labels
    hemi = read_nrrd(spark, hemispheres).selectExpr("x", "y", "z", "cast(value as int) hemi")
    return labels.join(hemi, ["x", "y", "z"], "left")
