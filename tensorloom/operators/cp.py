"""Non-negative CP decompositions from many random starts.

Two ways behind one call. A tensor that fits a task is shared with all of them and every
(task, start) is a row whose kernel runs in one Python batch: tasks times starts is the
parallelism, and control crosses to the executors once. A larger tensor stays a table of
blocks (blocks.py): an update is one pass over them for many starts and tasks at once,
whose columns lie side by side in a factor's slices. Writing the slices ends lineage; what
the driver needs of them are the R x R Grams, which are summed from parts beside each
slice. A task of some rows of mode 0 has columns whose other rows are zero: an update by
factors leaves them so, and what they would add to other modes is nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schema import ConvergenceError
from ..session import forget, settled, settled_at
from . import kernel
from .blocks import BlockedTensor, added, examined, packed, ranges, slice_table, unpacked
from .draws import uniform

#: Bytes of a dense tensor up to which every task gets it whole.
TASK_BYTES = 256 << 20

#: Columns (tasks times starts times rank) that one pass over a tensor held as blocks updates, about.
PASS_COLUMNS = 512

#: Numbers of a factor (starts times R x R + 1) up to which they are added up while it is written; more take a job of their own.
OBSERVED = 64

RESULT = "task string, seed int, status string, n_iter int, error double, mode int, idx int, row array<double>"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
KINDS = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.float64())]


@dataclass(frozen=True)
class CPOptions:
    max_iter: int = 5000
    starts: int = 50
    tol: float = 1e-5


def dense(coo: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """A small tensor on the driver (its size is checked by the caller); repeated cells raise."""
    out = np.zeros(shape)
    rows = coo.toPandas()
    if rows.duplicated([f"m{k}" for k in range(len(shape))]).any():
        raise ValueError("the tensor has repeated cells")
    out[tuple(rows[f"m{k}"] for k in range(len(shape)))] = rows["x"]
    return out


def fit_starts(spark: SparkSession, x: np.ndarray, tasks: dict[str, list[int] | None], rank: int, options: CPOptions) -> DataFrame:
    """RESULT rows of every start of every task (a task: rows of x, None for all).

    A rejected start gives one row without a factor, so that its status is seen.
    """
    shared = spark.sparkContext.broadcast((x, tasks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, members = shared.value
        for b in batches:
            for task, seed in zip(b.column("task").to_pylist(), b.column("seed").to_pylist()):
                chosen = members[task]
                fit = kernel.decompose(whole if chosen is None else whole[chosen], rank, options.max_iter, options.tol, seed)
                state = kernel.status(fit.errors, [f.T @ f for f in fit.factors], options.max_iter)
                head = [task, seed, state, len(fit.errors), fit.errors[-1] if fit.errors else None]
                if state == "accepted":
                    rows = [(*head, m, i, f[i].tolist()) for m, f in enumerate(fit.factors) for i in range(len(f))]
                else:
                    rows = [(*head, None, None, None)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], NAMES)

    frame = pd.DataFrame([(t, s) for t in tasks for s in range(options.starts)], columns=["task", "seed"]).astype({"seed": "int32"})
    # each start is a task of its own, so that slow ones don't wait for each other
    return spark.createDataFrame(frame).repartition(max(1, len(frame)), "task", "seed").mapInArrow(run, RESULT)


def best_start(results: DataFrame) -> DataFrame:
    """The rows of each task's accepted start with the least error; of equal errors the lowest seed."""
    known = results.where("status = 'accepted' AND NOT isnan(error)")
    best = known.where("mode = 0 AND idx = 0").groupBy("task").agg(F.min(F.struct("error", "seed")).alias("_b")).select("task", F.col("_b.seed").alias("seed"))
    return known.join(best, ["task", "seed"])


def fits(results: DataFrame) -> DataFrame:
    """task, seed, status, n_iter, error: one row per start."""
    return results.where("mode IS NULL OR (mode = 0 AND idx = 0)").select("task", "seed", "status", "n_iter", "error")


def cp(coo: DataFrame, rank: int, options: CPOptions = CPOptions(), task_bytes: int = TASK_BYTES) -> DataFrame:
    """RESULT rows (task 'all') of the best accepted start of a tensor of any order >= 2.

    Raises ConvergenceError if no start is accepted, ValueError for NULL, NaN or repeated cells.
    """
    coo = settled(coo, "tensor")
    shape, _ = examined(coo)
    if 8 * np.prod(shape, dtype=float) <= task_bytes:
        results = settled(fit_starts(coo.sparkSession, dense(coo, shape), {"all": None}, rank, options), "cp-starts")
        best = best_start(results)
        if best.isEmpty():
            raise ConvergenceError(f"none of {options.starts} starts was accepted: {[tuple(r) for r in fits(results).groupBy('status').count().collect()]}")
        return best
    return best_tables(coo, {"all": None}, rank, options)


def best_tables(coo: DataFrame, tasks: dict[str, None] | DataFrame, rank: int, options: CPOptions) -> DataFrame:
    """RESULT rows of the best accepted start of each task, all tasks and starts in shared passes over the tensor's blocks.

    tasks: a table (task, pos, sample_idx) of the rows of mode 0 that are the task's, in
    their order, or {"all": None}. A task without an accepted start raises ConvergenceError.
    """
    spark, tensor = coo.sparkSession, BlockedTensor.build(coo)
    members = tasks if isinstance(tasks, DataFrame) else None
    names = sorted(tasks) if members is None else sorted(r[0] for r in members.select("task").distinct().collect())  # as many as tasks
    try:
        found = fit_tables(tensor, [(t, s) for t in names for s in range(options.starts)], rank, options, members)
    finally:
        tensor.close()
    states = {key: kernel.status(fit.errors, fit.grams, options.max_iter) for key, fit in found.items()}
    best = {}
    for name in names:
        good = [(found[name, s].errors[-1], s) for s in range(options.starts) if states[name, s] == "accepted"]
        if not good:
            raise ConvergenceError(f"none of {options.starts} starts was accepted for task {name}: {[states[name, s] for s in range(options.starts)]}")
        best[name] = min(good)
    parts = []
    shots = {id(found[t, s].shot): found[t, s].shot for t, (_, s) in best.items()}
    for key, shot in shots.items():
        chosen = [(t, s, len(found[t, s].errors), e, found[t, s].first) for t, (e, s) in best.items() if id(found[t, s].shot) == key]
        parts += [_rows_of(shot, m, side, rank, chosen) for m, side in enumerate(tensor.sides)]
    rows = reduce(DataFrame.unionByName, parts)
    if members is None:
        return rows
    at = members.select("task", F.lit(0).alias("mode"), F.col("sample_idx").alias("idx"), "pos")
    own = rows.where("mode = 0").join(at, ["task", "mode", "idx"]).withColumn("idx", F.col("pos").cast("int")).drop("pos")
    return own.unionByName(rows.where("mode > 0"))


@dataclass
class Shot:
    """Factors (b, m) of several fits side by side."""

    factors: list[DataFrame]
    columns: int


@dataclass
class TableFit:
    """One start of a task: its columns of a shot, the error after each iteration, and the factors' Grams."""

    shot: Shot
    first: int
    rank: int
    sides: tuple[int, ...]
    errors: list[float] = field(default_factory=list)
    grams: list[np.ndarray] = field(default_factory=list)

    @property
    def factors(self) -> list[DataFrame]:
        """idx, row of each mode."""
        return [unpacked(f, side, self.shot.columns, self.first, self.rank) for f, side in zip(self.shot.factors, self.sides)]


def _rows_of(shot: Shot, mode: int, side: int, rank: int, chosen: list[tuple[str, int, int, float, int]]) -> DataFrame:
    """RESULT rows of a mode of the chosen fits (task, seed, iterations, error, first column)."""
    columns = shot.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for b, m in zip(t.column("b").to_pylist(), t.column("m").to_pylist()):
                whole = np.frombuffer(m).reshape(-1, columns)
                for task, seed, n, error, first in chosen:
                    rows = [(task, seed, "accepted", n, error, mode, i + b * side, r.tolist()) for i, r in enumerate(whole[:, first : first + rank])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], NAMES)

    return shot.factors[mode].select("b", "m").mapInArrow(run, RESULT)


SLICE = "b int, m binary, sums array<double>"


def _sums(m: np.ndarray, product: np.ndarray | None, rank: int) -> list[float]:
    """A slice's share of each start's Gram, and of its inner product with the product along the mode."""
    blocks = m.reshape(len(m), -1, rank)
    inner = np.zeros(blocks.shape[1]) if product is None else (m * product).reshape(len(m), -1, rank).sum(axis=(0, 2))
    return [*np.einsum("ijr,ijs->jrs", blocks, blocks).reshape(-1), *inner]


def _starts(tensor: BlockedTensor, mode: int, keys: list[tuple[str, int]], rank: int, members: DataFrame | None, sizes: dict[str, int]) -> DataFrame:
    """SLICE rows of the starts of all keys (task, seed), equal to kernel.start of each task's tensor.

    sizes: each task's rows of mode 0, whose numbers come first in a seed's stream. With
    members, rows of mode 0 start at their place in the task.
    """
    n, side = tensor.shape[mode], tensor.sides[mode]
    every = ranges(tensor.spark, n, side)
    first = {t: (sizes[t] + sum(tensor.shape[1:mode]) if mode else 0) for t, _ in keys}

    def drawn(task: str, seed: int, at: int, rows: int) -> np.ndarray:
        return uniform(seed, (first[task] + at) * rank, rows * rank).reshape(rows, rank)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for b in t.column("b").to_pylist():
                m = np.hstack([drawn(task, seed, b * side, min(side, n - b * side)) for task, seed in keys])
                yield from slice_table(b, m, ("sums", _sums(m, None, rank))).to_batches()

    if members is None or mode:
        return every.mapInArrow(whole, SLICE)
    tasks = {t for t, _ in keys}

    def masked(t: pa.Table, at: pa.Table) -> pa.Table:
        b = at.column("b")[0].as_py()
        size = min(side, n - b * side)
        names, rows, pos = (t.column(c).to_numpy(zero_copy_only=False) for c in ("task", "sample_idx", "pos"))
        m = np.zeros((size, len(keys) * rank))
        own = {task: names == task for task in tasks}
        for k, (task, seed) in enumerate(keys):
            at = pos[own[task]]
            if len(at):
                m[rows[own[task]] - b * side, k * rank : (k + 1) * rank] = drawn(task, seed, int(at.min()), int(np.ptp(at)) + 1)[at - at.min()]
        return slice_table(b, m, ("sums", _sums(m, None, rank)))

    placed = members.select("task", "sample_idx", "pos", F.floor(F.col("sample_idx") / side).cast("int").alias("b"))
    return placed.groupBy("b").cogroup(every.groupBy("b")).applyInArrow(masked, SLICE)


def _updated(factor: DataFrame, products: DataFrame, others: np.ndarray, rank: int, old: int, kept: list[int]) -> DataFrame:
    """SLICE rows after one multiplicative update; of the `old` starts in factor those in `kept` go on, which products have."""
    columns = len(kept) * rank

    def run(shares: pa.Table, before: pa.Table) -> pa.Table:
        b = before.column("b")[0].as_py()
        m = np.frombuffer(before.column("m")[0].as_py()).reshape(-1, old, rank)[:, kept]
        product = added(shares, columns) if shares.num_rows else np.zeros((len(m), columns))
        model = np.einsum("ijr,jrs->ijs", m, others)
        new = (m * np.maximum(product.reshape(m.shape), kernel.EPS) / np.maximum(model, kernel.EPS)).reshape(len(m), columns)
        return slice_table(b, new, ("sums", _sums(new, product, rank)))

    return products.groupBy("b").cogroup(factor.select("b", "m").groupBy("b")).applyInArrow(run, SLICE)


def _narrowed(factor: DataFrame, rank: int, old: int, kept: list[int]) -> DataFrame:
    """b, m with the columns of the kept starts alone."""
    if len(kept) == old:
        return factor.select("b", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for b, m in zip(t.column("b").to_pylist(), t.column("m").to_pylist()):
                yield from slice_table(b, np.frombuffer(m).reshape(-1, old, rank)[:, kept].reshape(-1, len(kept) * rank)).to_batches()

    return factor.select("b", "m").mapInArrow(run, "b int, m binary")


def _written(slices: DataFrame, rank: int, starts: int) -> tuple[str, DataFrame, np.ndarray, np.ndarray]:
    """Path and table of a factor, its starts' Grams, and inner products with what it was updated by."""
    size = starts * rank * rank
    sums = np.zeros(size + starts)
    if len(sums) <= OBSERVED:
        seen = Observation()
        path, factor = settled_at(slices.observe(seen, *[F.sum(F.col("sums")[k]).alias(str(k)) for k in range(len(sums))]), "factor")
        sums[:] = [seen.get[str(k)] or 0.0 for k in range(len(sums))]
    else:
        path, factor = settled_at(slices, "factor")
        for k, v in factor.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).collect():  # starts x (R x R + 1) numbers
            sums[k] = v
    return path, factor, sums[:size].reshape(starts, rank, rank), sums[size:]


def fit_tables(tensor: BlockedTensor, keys: list[tuple[str, int]], rank: int, options: CPOptions, members: DataFrame | None = None, init: list[DataFrame] | None = None) -> dict[tuple[str, int], TableFit]:
    """The fits of all keys (task, seed), PASS_COLUMNS columns in a pass over the blocks.

    members: task, pos, sample_idx of the rows of mode 0 that are a task's (default: all of
    every task). init: factors (idx, row) to start the first key from.
    """
    norms = tensor.row_norms()
    if members is None:
        total = norms.agg(F.sum("norm2")).first()[0] or 0.0
        norm2, sizes = {t: total for t, _ in keys}, {t: tensor.shape[0] for t, _ in keys}
    else:
        own = members.join(norms, members.sample_idx == norms.idx, "left").groupBy("task").agg(F.sum("norm2"), F.count(F.lit(1))).collect()  # two numbers a task
        norm2, sizes = ({t: 0 for t, _ in keys} | {r[0]: r[k] or 0 for r in own} for k in (1, 2))
    together = max(1, PASS_COLUMNS // rank)
    out: dict[tuple[str, int], TableFit] = {}
    for at in range(0, len(keys), together):
        out |= _fit_together(tensor, keys[at : at + together], norm2, sizes, rank, options, members, init if at == 0 else None)
    return out


def _fit_together(tensor: BlockedTensor, active: list[tuple[str, int]], norm2: dict[str, float], sizes: dict[str, int], rank: int, options: CPOptions, members: DataFrame | None, init: list[DataFrame] | None) -> dict[tuple[str, int], TableFit]:
    modes = range(len(tensor.shape))
    if init:
        begun = [_with_sums(packed(f, n, s, rank), rank) for f, n, s in zip(init, tensor.shape, tensor.sides)]
    else:
        begun = [_starts(tensor, m, active, rank, members, sizes) for m in modes]
    held = [_written(f, rank, len(active)) for f in begun]
    paths, factors, grams = [h[0] for h in held], [h[1] for h in held], [h[2] for h in held]
    widths, kept = [len(active)] * len(modes), [list(range(len(active)))] * len(modes)
    errors: dict[tuple[str, int], list[float]] = {k: [] for k in active}
    out: dict[tuple[str, int], TableFit] = {}
    pinned: set[str] = set()
    for step in range(options.max_iter):
        for mode in modes:
            columns = len(active) * rank
            narrow = [_narrowed(f, rank, w, k) for f, w, k in zip(factors, widths, kept)]
            others = reduce(np.multiply, [g for k, g in enumerate(grams) if k != mode])
            products = tensor.partial_products(narrow, mode, columns)
            before = paths[mode]
            paths[mode], factors[mode], grams[mode], inner = _written(_updated(factors[mode], products, others, rank, widths[mode], kept[mode]), rank, len(active))
            widths[mode], kept[mode] = len(active), list(range(len(active)))
            if before not in pinned:
                forget(tensor.spark, before)
        models = reduce(np.multiply, grams).sum(axis=(1, 2))
        shot, going = Shot(list(factors), len(active) * rank), []
        for k, key in enumerate(active):
            seen, size = errors[key], norm2[key[0]]
            seen.append(float(np.sqrt(abs(size + models[k] - 2 * inner[k])) / np.sqrt(size)) if size else 0.0)
            if step + 1 == options.max_iter or (len(seen) > 1 and abs(seen[-2] - seen[-1]) < options.tol):
                out[key] = TableFit(shot, k * rank, rank, tensor.sides, seen, [g[k] for g in grams])
            else:
                going.append(k)
        if len(going) < len(active):
            pinned.update(paths)  # fits that have ended are read from these
            active = [active[k] for k in going]
            if not active:
                break
            kept = [going] * len(modes)
            grams = [g[going] for g in grams]
    return out


def _with_sums(slices: DataFrame, rank: int) -> DataFrame:
    """SLICE rows of one start's slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for b, m in zip(t.column("b").to_pylist(), t.column("m").to_pylist()):
                rows = np.frombuffer(m).reshape(-1, rank)
                yield from slice_table(b, rows, ("sums", _sums(rows, None, rank))).to_batches()

    return slices.mapInArrow(run, SLICE)


def cp_tables(coo: DataFrame, rank: int, options: CPOptions, seeds: Iterable[int], init: list[DataFrame] | None = None) -> dict[int, TableFit]:
    """The fits of all seeds with the tensor as blocks and its factors as slices; init starts the first seed."""
    tensor = BlockedTensor.build(coo)
    try:
        return {seed: fit for (_, seed), fit in fit_tables(tensor, [("all", s) for s in seeds], rank, options, init=init).items()}
    finally:
        tensor.close()


def cp_table(coo: DataFrame, rank: int, options: CPOptions = CPOptions(), seed: int = 0, init: list[DataFrame] | None = None) -> tuple[list[DataFrame], list[float]]:
    """One start with the tensor and its factors as tables; (factors, errors)."""
    fit = cp_tables(coo, rank, options, [seed], init)[seed]
    return fit.factors, fit.errors
