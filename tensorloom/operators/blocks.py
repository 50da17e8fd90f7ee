"""A tensor as blocks of index ranges, dealt into buckets on disk once.

A block holds the cells of one range of indices in every mode: a full box as its values
alone, another one with their coordinates. Blocks lie in a bucketed table, so a pass over the
tensor reads them where they are: slices of the factors go to the blocks that need them,
and only partial products and slices go through a shuffle, never a cell.

A factor is a table of slices (b, m): the rows of index range b as packed numbers. The
columns of many starts lie side by side in it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import forget, settled, shared_path
from . import kernel

#: Cells of a block, about; the box of a sparse one may be SPARSE times as large.
BLOCK_CELLS, SPARSE = 1 << 20, 8
#: Indices of a range at most, so that a slice of a few hundred columns stays small.
SIDE = 4096
#: Bytes of a factor up to which its slices are broadcast; blocks that one copy of a larger one's slice serves.
SHARED_BYTES, FAN_OUT = 64 << 20, 64
MAX_BUCKETS = 20_000

BLOCKS = "block long, at array<int>, x binary, cells binary"


def sides_of(shape: tuple[int, ...], cells: int) -> tuple[int, ...]:
    """The lengths of the index ranges in each mode: halves of the longest, till a block is small enough."""
    volume = float(np.prod(shape, dtype=float))
    most = min(BLOCK_CELLS * volume / max(1, cells), float(BLOCK_CELLS * SPARSE))
    sides = list(shape)
    while np.prod(sides, dtype=float) > most or max(sides) > SIDE:
        k = int(np.argmax(sides))
        if sides[k] == 1:
            break
        sides[k] = -(-sides[k] // 2)
    return tuple(sides)


def _modes(coo: DataFrame) -> list[str]:
    return sorted((c for c in coo.columns if c.startswith("m") and c[1:].isdigit()), key=lambda c: int(c[1:]))


def examined(coo: DataFrame) -> tuple[tuple[int, ...], int]:
    """(shape, number of cells); ValueError for missing cells and for more cells than the shape has."""
    modes = _modes(coo)
    bad = F.col("x").isNull() | F.isnan("x") | reduce(lambda a, b: a | b, [F.col(m).isNull() | (F.col(m) < 0) for m in modes])
    n, missing, *top = coo.agg(F.count(F.lit(1)), F.count_if(bad), *[F.max(m) for m in modes]).first()
    if missing:
        raise ValueError("the tensor has NULL or NaN cells")
    shape = tuple(int(t) + 1 if t is not None else 0 for t in top)
    if n > np.prod(shape, dtype=float):
        raise ValueError("the tensor has repeated cells")
    return shape, n


def _pack(sides: tuple[int, ...], shape: tuple[int, ...]) -> Callable[[pa.Table], pa.Table]:
    def pack(cells: pa.Table) -> pa.Table:
        index = [cells.column(f"m{k}").to_numpy().astype(np.int64) for k in range(len(sides))]
        x = cells.column("x").to_numpy()
        at = [int(i[0]) // s for i, s in zip(index, sides)]
        box = [min(s, n - b * s) for s, n, b in zip(sides, shape, at)]
        inner = [i - b * s for i, b, s in zip(index, at, sides)]
        flat = np.ravel_multi_index(inner, box)
        if len(np.unique(flat)) < len(flat):
            raise ValueError("the tensor has repeated cells")
        order = np.argsort(flat)
        places = b"" if len(flat) == np.prod(box) else np.stack(inner)[:, order].astype("<i4").tobytes()
        row = {"block": cells.column("block")[0].as_py(), "at": at, "x": x[order].tobytes(), "cells": places}
        return pa.Table.from_pylist([row], pa.schema([("block", pa.int64()), ("at", pa.list_(pa.int32())), ("x", pa.binary()), ("cells", pa.binary())]))

    return pack


def _block_product(x: bytes, cells: bytes, box: list[int], slices: list[np.ndarray], mode: int, columns: int) -> np.ndarray:
    """The block's share of the product along a mode; slices: of every mode but that."""
    if not cells:
        return kernel.product(np.frombuffer(x).reshape(box), slices, mode)
    index, values = np.frombuffer(cells, "<i4").reshape(len(box), -1), np.frombuffer(x)
    out = np.empty((box[mode], columns))
    for c in range(columns):
        weight = values
        for k, f in enumerate(slices):
            if k != mode:
                weight = weight * f[index[k], c]
        out[:, c] = np.bincount(index[mode], weights=weight, minlength=box[mode])
    return out


def slice_table(b: int, m: np.ndarray, *more: tuple[str, object]) -> pa.Table:
    return pa.table({"b": pa.array([b], pa.int32()), "m": pa.array([np.ascontiguousarray(m).tobytes()], pa.binary()), **{name: pa.array([v]) for name, v in more}})


@dataclass
class BlockedTensor:
    """blocks: the bucketed table; places: block and its range b0 ... in each mode."""

    spark: SparkSession
    name: str
    path: str
    shape: tuple[int, ...]
    sides: tuple[int, ...]
    places: DataFrame
    n_blocks: int

    @classmethod
    def build(cls, coo: DataFrame) -> BlockedTensor:
        """Blocks of a table m0 ... and x, written by one shuffle of its cells. Repeated or missing cells raise."""
        shape, n = examined(coo)
        sides, spark = sides_of(shape, n), coo.sparkSession
        counts = [max(1, -(-size // s)) for size, s in zip(shape, sides)]
        block = reduce(lambda a, k: a * counts[k] + F.floor(F.col(f"m{k}") / sides[k]), range(1, len(sides)), F.floor(F.col("m0") / sides[0])) if n else F.lit(0)
        held = coo.select(*_modes(coo), F.col("x").cast("double").alias("x"), block.cast("long").alias("block"))
        sizes = settled(held.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "block-sizes")
        n_blocks, most = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
        if most is not None and most > np.prod(sides, dtype=float):
            raise ValueError("the tensor has repeated cells")
        buckets = max(1, min(n_blocks, MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks // FAN_OUT)))
        packed = held.repartition(buckets, "block").groupBy("block").applyInArrow(_pack(sides, shape), BLOCKS)
        name, path = f"tensor_{uuid.uuid4().hex}", shared_path(spark, "tensor-blocks")
        packed.write.bucketBy(buckets, "block").sortBy("block").option("path", path).format("parquet").saveAsTable(name)
        rest, places = F.col("block"), []
        for k in reversed(range(len(sides))):
            places.insert(0, (rest % counts[k]).cast("int").alias(f"b{k}"))
            rest = F.floor(rest / counts[k])
        return cls(spark, name, path, shape, sides, sizes.select("block", *places), n_blocks)

    @property
    def blocks(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        forget(self.spark, self.path)

    def n_slices(self, mode: int) -> int:
        return -(-self.shape[mode] // self.sides[mode])

    def _sent(self, factor: DataFrame, mode: int, columns: int) -> DataFrame:
        """block, mode, m: the factor's slice that each block needs."""
        places, key = self.places.select("block", F.col(f"b{mode}").alias("b")), ["b"]
        slices = factor.select("b", "m")
        if 8 * self.shape[mode] * columns <= SHARED_BYTES:
            slices = F.broadcast(slices)
        else:  # a slice that many blocks need is sent on by many tasks
            copies = max(1, self.n_blocks // self.n_slices(mode) // FAN_OUT)
            places, key = places.withColumn("copy", (F.col("block") % copies).cast("int")), ["b", "copy"]
            slices = slices.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        return places.join(slices, key).select("block", F.lit(mode).alias("mode"), "m")

    def _with_slices(self, factors: list[DataFrame], modes: list[int], columns: int, run: Callable, schema: str) -> DataFrame:
        """run(at, box, x, cells, slices by mode) -> a table, for each block; the blocks themselves stay where they lie."""
        shape, sides = self.shape, self.sides
        sent = reduce(DataFrame.unionByName, [self._sent(factors[k], k, columns) for k in modes])

        def meet(block: pa.Table, slices: pa.Table) -> pa.Table:
            at, x, cells = (block.column(c)[0].as_py() for c in ("at", "x", "cells"))
            box = [min(s, n - b * s) for s, n, b in zip(sides, shape, at)]
            held: list = [None] * len(box)
            for k, m in zip(slices.column("mode").to_pylist(), slices.column("m").to_pylist()):
                held[k] = np.frombuffer(m).reshape(box[k], columns)
            return run(at, box, x, cells, held)

        return self.blocks.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(meet, schema)

    def partial_products(self, factors: list[DataFrame], mode: int, columns: int) -> DataFrame:
        """b, m: shares of the product along a mode (the tensor unfolded times the Khatri-Rao product of the other factors).

        Where many blocks have a share in one slice, shares are added up in groups first.
        """

        def run(at, box, x, cells, slices) -> pa.Table:
            return slice_table(at[mode], _block_product(x, cells, box, slices, mode, columns))

        shares = self._with_slices(factors, [k for k in range(len(self.shape)) if k != mode], columns, run, "b int, m binary")
        groups = self.n_blocks // max(1, self.n_slices(mode)) // FAN_OUT
        if groups > 1:
            part = F.pmod(F.xxhash64("m"), F.lit(groups)).alias("part")
            shares = shares.select("b", "m", part).groupBy("b", "part").applyInArrow(lambda t: slice_table(t.column("b")[0].as_py(), added(t, columns)), "b int, m binary")
        return shares

    def product(self, factors: list[DataFrame], mode: int, columns: int) -> DataFrame:
        """b, m: the product along a mode; slices without cells are left out."""
        return self.partial_products(factors, mode, columns).groupBy("b").applyInArrow(lambda t: slice_table(t.column("b")[0].as_py(), added(t, columns)), "b int, m binary")

    def row_norms(self) -> DataFrame:
        """idx, norm2: the squared norm of each index of mode 0 that has cells."""
        shape, sides = self.shape, self.sides

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                for at, x, cells in zip(*(t.column(c).to_pylist() for c in ("at", "x", "cells"))):
                    n, values = min(sides[0], shape[0] - at[0] * sides[0]), np.frombuffer(x) ** 2
                    rows = np.frombuffer(cells, "<i4")[: len(values)] if cells else np.repeat(np.arange(n), len(values) // n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + at[0] * sides[0], pa.int32()), pa.array(np.bincount(rows, weights=values, minlength=n))], ["idx", "norm2"])

        return self.blocks.select("at", "x", "cells").mapInArrow(run, "idx int, norm2 double").groupBy("idx").agg(F.sum("norm2").alias("norm2"))

    def reconstructed(self, factors: list[DataFrame], columns: int) -> DataFrame:
        """m0 ..., x, x_hat: the model's value at each cell."""
        sides, order = self.sides, len(self.shape)

        def run(at, box, x, cells, slices) -> pa.Table:
            index = np.frombuffer(cells, "<i4").reshape(order, -1) if cells else np.indices(box).reshape(order, -1)
            model = reduce(np.multiply, [f[i] for f, i in zip(slices, index)]).sum(axis=1)
            return pa.table({f"m{k}": pa.array((i + b * s).astype(np.int32)) for k, (i, b, s) in enumerate(zip(index, at, sides))} | {"x": np.frombuffer(x), "x_hat": model})

        schema = ", ".join(f"m{k} int" for k in range(order)) + ", x double, x_hat double"
        return self._with_slices(factors, list(range(order)), columns, run, schema)


def added(slices: pa.Table, columns: int) -> np.ndarray:
    """The sum of slices."""
    parts = (np.frombuffer(m.as_py()) for m in slices.column("m"))
    return reduce(np.add, parts).reshape(-1, columns)


def packed(factor: DataFrame, n: int, side: int, columns: int) -> DataFrame:
    """The slices (b, m) of a factor (idx, row); rows it lacks are 0."""

    def run(t: pa.Table, at: pa.Table) -> pa.Table:
        b = at.column("b")[0].as_py()
        m = np.zeros((min(side, n - b * side), columns))
        if t.num_rows:
            m[t.column("idx").to_numpy() - b * side] = np.array(t.column("row").to_pylist(), dtype=float)
        return slice_table(b, m)

    rows = factor.select(F.floor(F.col("idx") / side).cast("int").alias("b"), "idx", "row")
    return rows.groupBy("b").cogroup(ranges(factor.sparkSession, n, side).groupBy("b")).applyInArrow(run, "b int, m binary")


def ranges(spark: SparkSession, n: int, side: int) -> DataFrame:
    """b: every index range of a mode."""
    return spark.range(-(-n // side)).select(F.col("id").cast("int").alias("b"))


def unpacked(slices: DataFrame, side: int, columns: int, first: int, rank: int) -> DataFrame:
    """idx, row: `rank` columns of a factor's slices from column `first` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for b, m in zip(t.column("b").to_pylist(), t.column("m").to_pylist()):
                rows = np.frombuffer(m).reshape(-1, columns)[:, first : first + rank]
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rank)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32) + b * side), pa.ListArray.from_arrays(ends, pa.array(rows.reshape(-1)))], ["idx", "row"])

    return slices.select("b", "m").mapInArrow(run, "idx int, row array<double>")
