"""NIfTI-1 images as voxel rows: a Python data source, and writing of single images.

Each file is one input partition, parsed once however many jobs name it. Values are
scaled as the header says; the grid's affine is the sform, else the qform, else the
voxel sizes.
"""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GZIP = b"\x1f\x8b"
#: Codes of the public NIfTI-1 standard that are read, as numpy kinds (fixed values).
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
VOXEL_SCHEMA = "volume_id string, i int, j int, k int, value double"
VOLUME_SCHEMA = "volume_id string, dim array<int>, affine array<double>"


def affine(header: bytes, order: str) -> np.ndarray:
    """The 4 x 4 affine of a header."""
    qform, sform = struct.unpack_from(order + "2h", header, 252)
    pixdim = struct.unpack_from(order + "8f", header, 76)
    out = np.eye(4)
    if sform > 0:
        out[:3] = np.array(struct.unpack_from(order + "12f", header, 280)).reshape(3, 4)
    elif qform > 0:
        b, c, d, *offset = struct.unpack_from(order + "6f", header, 256)
        a = np.sqrt(max(0.0, 1.0 - b * b - c * c - d * d))
        turn = np.array([
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ])
        zoom = np.array([pixdim[1], pixdim[2], pixdim[3] * (-1.0 if pixdim[0] < 0 else 1.0)])
        out[:3, :3], out[:3, 3] = turn * zoom, offset
    else:
        out[:3, :3] = np.diag(pixdim[1:4])
    return out


@dataclass(frozen=True)
class Header:
    """What a NIfTI-1 header says of the grid and of how its values are stored."""

    order: str
    kind: str
    shape: tuple[int, ...]
    offset: int
    slope: float
    shift: float
    affine: np.ndarray

    @property
    def plane_bytes(self) -> int:
        return self.shape[0] * self.shape[1] * np.dtype(self.kind).itemsize

    def scaled(self, raw: bytes, shape: tuple[int, ...]) -> np.ndarray:
        values = np.frombuffer(raw, np.dtype(self.order + self.kind), int(np.prod(shape))).reshape(shape, order="F").astype(float)
        return values * self.slope + self.shift if self.slope and not np.isnan(self.slope) else values


HEADER_BYTES = 348


def header_of(start: bytes) -> Header:
    """The header in the first bytes of an image that isn't compressed."""
    order = next((o for o in "<>" if len(start) >= HEADER_BYTES and struct.unpack_from(o + "i", start, 0)[0] == HEADER_BYTES), None)
    if order is None or start[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 image")
    dim = struct.unpack_from(order + "8h", start, 40)
    code = struct.unpack_from(order + "h", start, 70)[0]
    if code not in KINDS:
        raise ValueError(f"NIfTI data type {code} is not supported")
    offset, slope, shift = struct.unpack_from(order + "3f", start, 108)
    shape = tuple(max(1, n) for n in dim[1 : 1 + max(3, dim[0])])[: max(3, dim[0])]
    return Header(order, KINDS[code], shape, int(offset), slope, shift, affine(start, order))


def parse(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(values, affine) of an image, gzipped or not."""
    if content[:2] == GZIP:
        content = gzip.decompress(content)
    head = header_of(content[:HEADER_BYTES])
    return head.scaled(content[head.offset :], head.shape), head.affine


def volume_shape(head: Header) -> tuple[int, int, int]:
    """The shape of a single volume; ValueError for an image of several frames, which has no one value at a voxel."""
    if np.prod(head.shape[3:], dtype=int) > 1:
        raise ValueError(f"an image of shape {head.shape} has several frames")
    return head.shape[:3]


class Planes:
    """The planes of a volume along its last axis, read one after another from an open file, gzipped or not."""

    def __init__(self, file: BinaryIO) -> None:
        self.packed = file.read(2) == GZIP
        file.seek(0)
        self.file = gzip.GzipFile(fileobj=file) if self.packed else file
        self.head = header_of(self.file.read(HEADER_BYTES))
        self.shape = volume_shape(self.head)

    def skip_to(self, k: int) -> None:
        """Goes to plane k: at once in a plain file, by reading on in a gzipped one."""
        self.file.seek(self.head.offset + k * self.head.plane_bytes)

    def read(self, n: int) -> np.ndarray:
        raw = self.file.read(n * self.head.plane_bytes)
        if len(raw) < n * self.head.plane_bytes:
            raise ValueError("an image ends before its last plane")
        return self.head.scaled(raw, (*self.shape[:2], n))


def build(values: np.ndarray, grid: np.ndarray | None = None, compress: bool = True) -> bytes:
    """A float64 NIfTI-1 image of a 3-D array."""
    grid = np.eye(4) if grid is None else grid
    header = bytearray(352)
    struct.pack_into("<i", header, 0, 348)
    struct.pack_into("<8h", header, 40, 3, *values.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", header, 70, 64, 64)
    struct.pack_into("<8f", header, 76, 1.0, *np.linalg.norm(grid[:3, :3], axis=0), 1, 1, 1, 1)
    struct.pack_into("<3f", header, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", header, 252, 0, 1)
    struct.pack_into("<12f", header, 280, *grid[:3].reshape(-1))
    header[344:348] = b"n+1\x00"
    out = bytes(header) + np.asarray(values, "<f8").tobytes(order="F")
    return gzip.compress(out, mtime=0) if compress else out


def voxel_batch(volume_id: str, content: bytes) -> pa.RecordBatch:
    head = Planes(io.BytesIO(content))
    head.skip_to(0)
    values = head.read(head.shape[2])
    i, j, k = np.indices(values.shape[:3]).reshape(3, -1).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array([volume_id] * len(i)), pa.array(i), pa.array(j), pa.array(k), pa.array(values.reshape(-1))], ["volume_id", "i", "j", "k", "value"])


def voxels_of(images: DataFrame) -> DataFrame:
    """Voxel rows of a table (volume_id, content) of images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("volume_id").to_pylist(), b.column("content").to_pylist()):
                yield voxel_batch(name, content)

    return images.select("volume_id", "content").mapInArrow(run, VOXEL_SCHEMA)


def volumes_of(images: DataFrame) -> DataFrame:
    """volume_id, dim, affine of a table (volume_id, content) of images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [Planes(io.BytesIO(c)).head for c in b.column("content").to_pylist()]  # headers alone
            dims, grids = [list(h.shape) for h in read], [h.affine.reshape(-1).tolist() for h in read]
            yield pa.RecordBatch.from_arrays([b.column("volume_id"), pa.array(dims, pa.list_(pa.int32())), pa.array(grids, pa.list_(pa.float64()))], ["volume_id", "dim", "affine"])

    return images.select("volume_id", "content").mapInArrow(run, VOLUME_SCHEMA)


def read_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """volume_id (its path) and content of image files in any store that Spark reads."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("volume_id"), "content")


class VolumeSource(DataSource):
    """`spark.read.format("volume").option("paths", "a.nii.gz,b.nii")`: voxel rows of files on a shared mount."""

    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return VOXEL_SCHEMA

    def reader(self, schema) -> "VolumeReader":
        return VolumeReader([p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p])


class VolumeReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = sorted(set(paths))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(partition.value, "rb") as f:
            yield voxel_batch(partition.value, f.read())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VolumeSource)
