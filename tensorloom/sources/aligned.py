"""The images of a job as one scan: a row for each voxel of its mask with a column for each image.

A job's baseline, post-injection, mask and segmentation images are read side by side, a few
planes at a time, so no voxel is joined or shuffled and an image of any size takes the
memory of some planes. Only headers are compared before: images whose shapes or affines
differ, images of several frames and unknown signal types fail the job.

`spark.read.format("aligned")` reads files that executors can open. A partition is a job's
slab of planes, of which a plain file gives its byte range; gzipped files have no such
ranges, so their job is one partition. A filter on `mask` is applied in the reader where
Spark pushes filters down to Python sources. `aligned_images` does the same for images that
are rows of a table, from any store that Spark reads: whole files, not voxels, are brought
together for each job.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, InputPartition, IsNotNull

from ..functions.tracer import SIGNALS
from .nifti import Planes

ROLES = ("baseline", "post_injection", "mask", "segmentation")
PATHS = [f"{role}_path" for role in ROLES]
JOB = ["ord", "subject", "time_point", "signal_type"]
ALIGNED = "ord bigint, subject string, time_point int, signal_type string, i int, j int, k int, baseline double, post_injection double, mask double, segmentation double"
NAMES = [c.split()[0] for c in ALIGNED.split(", ")]
KINDS = [pa.int64(), pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 3, *[pa.float64()] * 4]

#: Voxels that are read at once, about, and slabs of a job's planes.
BATCH_VOXELS, SLABS = 1 << 18, 4
#: Bytes of a manifest that goes to all tasks, at most, and bytes of a job in it, about.
MANIFEST_BYTES, JOB_BYTES = 64 << 20, 1 << 10


def check_grids(job: dict, images: dict[str, Planes]) -> None:
    """ValueError unless all images of a job lie on the baseline's grid."""
    if job["signal_type"] not in SIGNALS:
        raise ValueError(f"unknown signal_type {job['signal_type']!r}")
    for role in ROLES:
        if role not in images and (role != "segmentation" or job[f"{role}_path"] is not None):
            raise ValueError(f"no {role} image: {job[f'{role}_path']}")
    base = images["baseline"]
    for role, image in images.items():
        if image.shape != base.shape:
            raise ValueError(f"images of different shapes: {base.shape} of {job['baseline_path']}, {image.shape} of {job[f'{role}_path']}")
        if not np.allclose(base.head.affine, image.head.affine):
            raise ValueError(f"images not on one grid: {job['baseline_path']} and {job[f'{role}_path']}")


def voxel_batches(job: dict, files: dict[str, BinaryIO], slab: int, slabs: int, above: float | None) -> Iterator[pa.RecordBatch]:
    """ALIGNED rows of a slab of a job's planes; above: only voxels whose mask is greater (None: all)."""
    images = {role: Planes(f) for role, f in files.items()}
    check_grids(job, images)
    if any(image.packed for image in images.values()):
        if slab:
            return
        slabs = 1
    nx, ny, nz = images["baseline"].shape
    at, stop = slab * nz // slabs, (slab + 1) * nz // slabs
    for image in images.values():
        image.skip_to(at)
    step = max(1, BATCH_VOXELS // (nx * ny))
    while at < stop:
        n = min(step, stop - at)
        held = {role: image.read(n) for role, image in images.items()}
        inside = np.ones((nx, ny, n), bool) if above is None else held["mask"] > above
        i, j, k = (x.astype(np.int32) for x in np.nonzero(inside))
        columns = [pa.array([job[c]] * len(i), kind) for c, kind in zip(JOB, KINDS)] + [pa.array(i), pa.array(j), pa.array(k + np.int32(at))]
        columns += [pa.array(held[role][inside]) if role in held else pa.nulls(len(i), pa.float64()) for role in ROLES]
        yield pa.RecordBatch.from_arrays(columns, NAMES)
        at += n


def open_file(path: str) -> BinaryIO:
    """A file by its path, or by a URI of a file system that Arrow knows."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow.fs import FileSystem

        system, name = FileSystem.from_uri(path)
        return system.open_input_file(name)
    return open(path.removeprefix("file://").removeprefix("file:"), "rb")


class SlabPartition(InputPartition):
    def __init__(self, job: dict, slab: int) -> None:
        super().__init__((job, slab))
        self.job, self.slab = job, slab


class AlignedSource(DataSource):
    """Options: jobs (JSON list of manifest rows with ord), slabs."""

    @classmethod
    def name(cls) -> str:
        return "aligned"

    def schema(self) -> str:
        return ALIGNED

    def reader(self, schema) -> "AlignedReader":
        return AlignedReader(json.loads(self.options.get("jobs", "[]")), int(self.options.get("slabs", SLABS)))


class AlignedReader(DataSourceReader):
    def __init__(self, jobs: list[dict], slabs: int) -> None:
        self.jobs, self.slabs, self.above, self.only = jobs, slabs, None, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes mask > x and equality of a job's columns."""
        for f in filters:
            if isinstance(f, GreaterThan) and f.attribute == ("mask",):
                self.above = max(f.value, self.above) if self.above is not None else f.value
            elif isinstance(f, EqualTo) and f.attribute in [(c,) for c in JOB]:
                self.only[f.attribute[0]] = f.value
            elif not (isinstance(f, IsNotNull) and f.attribute in [("mask",), *[(c,) for c in self.only]]):
                yield f

    def partitions(self) -> list[InputPartition]:
        chosen = [job for job in self.jobs if all(job[c] == v for c, v in self.only.items())]
        return [SlabPartition(job, slab) for job in chosen for slab in range(self.slabs)]

    def read(self, partition: SlabPartition) -> Iterator[pa.RecordBatch]:
        opened: dict[str, BinaryIO] = {}
        try:
            for role in ROLES:
                if (path := partition.job[f"{role}_path"]) is not None:
                    opened[role] = open_file(path)
            yield from voxel_batches(partition.job, opened, partition.slab, self.slabs, self.above)
        finally:
            for f in opened.values():
                f.close()


def _jobs(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.col("ord").cast("long").alias("ord"), F.col("subject").cast("string").alias("subject"), F.col("time_point").cast("int").alias("time_point"), "signal_type", *PATHS)


def read_aligned(manifest: DataFrame, slabs: int = SLABS) -> DataFrame:
    """ALIGNED rows of the masks of all jobs of a manifest (with ord) whose images are files that executors can open.

    The manifest becomes the list of partitions, so it reaches the driver, a row for each job.
    """
    spark = manifest.sparkSession
    spark.dataSource.register(AlignedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    jobs = [r.asDict() for r in _jobs(manifest).collect()]
    return spark.read.format("aligned").option("jobs", json.dumps(jobs)).option("slabs", str(slabs)).load().where("mask > 0 AND NOT isnan(mask)")


def aligned_images(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """ALIGNED rows of the masks of all jobs of a manifest (with ord), images being rows (volume_id, content).

    Each job's files are brought into one row, which a task then reads plane by plane.
    """
    jobs = _jobs(manifest)
    roles = F.array(*[F.struct(F.lit(role).alias("role"), F.col(path).alias("volume_id")) for role, path in zip(ROLES, PATHS)])
    named = jobs.select("ord", F.inline(F.filter(roles, lambda r: r["volume_id"].isNotNull())))
    if jobs.count() * JOB_BYTES <= MANIFEST_BYTES:
        named = F.broadcast(named)
    files = images.select("volume_id", "content").join(named, "volume_id").groupBy("ord").agg(F.collect_list(F.struct("role", "content")).alias("files"))
    rows = jobs.join(files, "ord", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                held = {f["role"]: io.BytesIO(f["content"]) for f in row["files"] or []}
                yield from voxel_batches(row, held, 0, 1, 0.0)

    return rows.mapInArrow(run, ALIGNED)
