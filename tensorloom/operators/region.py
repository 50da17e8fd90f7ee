"""Per-region summaries of voxel signals, and the way from images to the long table.

A region of any size is the work of many tasks: sums and the like are added up before the
shuffle, percentiles come from counts over ranges of values, and a reducer of one's own
runs as partial states that are merged.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, Protocol, runtime_checkable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tracer import tracer, valid_label
from ..schema import known, require
from ..sources.aligned import JOB, aligned_images, read_aligned
from .stats import percentiles

REDUCERS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "std": F.stddev_pop,
    "count": lambda x: F.count(x).cast("double"),
}
SHARES = {"median": 0.5, "p5": 0.05, "p95": 0.95}
#: States that a task holds before it hands them on.
MAX_STATES = 100_000


@runtime_checkable
class Reducer(Protocol):
    """A reducer by parts: states of parts of a region are merged, in any order. States are pickled and should be small."""

    def init(self) -> Any: ...

    def update(self, state: Any, values: np.ndarray) -> Any: ...

    def merge(self, a: Any, b: Any) -> Any: ...

    def finish(self, state: Any) -> float: ...


class Moments:
    """The standardised moment of an order from 3 on (3 skewness, 4 kurtosis), from central sums that merge exactly."""

    def __init__(self, order: int = 3) -> None:
        self.order = order

    def init(self) -> tuple[float, ...]:
        return (0.0,) * (self.order + 1)

    def update(self, state: tuple[float, ...], values: np.ndarray) -> tuple[float, ...]:
        mean = float(values.mean())
        return self.merge(state, (float(len(values)), mean, *[float(((values - mean) ** p).sum()) for p in range(2, self.order + 1)]))

    def merge(self, a: tuple[float, ...], b: tuple[float, ...]) -> tuple[float, ...]:
        """n, mean and central sums of both parts, each moved to the common mean."""
        if not a[0] or not b[0]:
            return a if a[0] else b
        n = a[0] + b[0]
        mean = (a[0] * a[1] + b[0] * b[1]) / n
        moved = [self._about(s, s[1] - mean) for s in (a, b)]
        return (n, mean, *[x + y for x, y in zip(*moved)])

    def _about(self, state: tuple[float, ...], shift: float) -> list[float]:
        """Sums of powers about a mean that lies `shift` below the state's own."""
        central = [state[0], 0.0, *state[2:]]
        return [sum(float(_binomial(p, q)) * central[q] * shift ** (p - q) for q in range(p + 1)) for p in range(2, self.order + 1)]

    def finish(self, state: tuple[float, ...]) -> float:
        if not state[0] or state[2] <= 0:
            return float("nan")
        return (state[self.order] / state[0]) / (state[2] / state[0]) ** (self.order / 2)


def _binomial(n: int, k: int) -> int:
    out = 1
    for j in range(k):
        out = out * (n - j) // (j + 1)
    return out


def _whole(func: Callable) -> Callable[[Column], Column]:
    """Any function of an array of known values as a grouped aggregate; a task holds the values of a region."""

    @F.pandas_udf(T.DoubleType())
    def reduce(values: pd.Series) -> float:
        found = func(values.dropna().to_numpy())
        return float(found) if found is not None else float("nan")

    return lambda x: known(reduce(x))


def merged_states(held: DataFrame, keys: list[str], value: str, reducer: Reducer) -> DataFrame:
    """keys, values: the reducer's result for the known values of each group; its states are made where the rows lie, and only they are shuffled."""
    rows = held.select(*keys, F.col(value).alias("_x"))
    fields = rows.schema.fields[:-1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}

        def handed() -> pa.RecordBatch:
            columns = [pa.array([k[c] for k in states], kinds[c]) for c in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], [*keys, "_state"])

        for b in batches:
            kinds = [c.type for c in b.columns[:-1]]
            codes = np.zeros(b.num_rows, np.int64)
            for c in b.columns[:-1]:
                encoded = c.dictionary_encode(null_encoding="encode")
                codes = np.unique(codes * (len(encoded.dictionary) + 1) + encoded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            x = b.column("_x").to_numpy(zero_copy_only=False).astype(float)
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            for at in np.split(order, cuts) if len(order) else []:
                key = tuple(c[int(at[0])].as_py() for c in b.columns[:-1])
                values = x[at]
                values, state = values[~np.isnan(values)], states.get(key)
                state = reducer.init() if state is None else state
                states[key] = reducer.update(state, values) if len(values) else state
            if len(states) > MAX_STATES:
                yield handed()
                states.clear()
        if states:
            yield handed()

    def merge(t: pa.Table) -> pa.Table:
        state = reducer.init()
        for s in t.column("_state"):
            state = reducer.merge(state, pickle.loads(s.as_py()))
        found = reducer.finish(state)
        return pa.table({**{k: t.column(k)[:1] for k in keys}, "values": pa.array([None if found is None or np.isnan(found) else float(found)], pa.float64())})

    states = rows.mapInArrow(partial, T.StructType([*fields, T.StructField("_state", T.BinaryType())]))
    return states.groupBy(*keys).applyInArrow(merge, T.StructType([*fields, T.StructField("values", T.DoubleType())]))


def region_summary(voxels: DataFrame, keys: list[str], label: str = "label", value: str = "value", func: str | Reducer | Callable = "median") -> DataFrame:
    """keys, labels, values: one row per valid region, missing voxels ignored.

    func is a name, a Reducer, or any function of an array, for which a task has to hold a
    region. Regions are told apart by the label as it is; it is rounded (half to even) only
    on the way out, so two regions may come out under one number. A region whose voxels are
    all missing stays, with NULL.
    """
    require(voxels, *keys, label, value)
    held = voxels.where(valid_label(F.col(label))).withColumn("_x", known(F.col(value)))
    if isinstance(func, str) and func in SHARES:
        out = percentiles(held, [*keys, label], "_x", keep=True, values=SHARES[func])
    elif isinstance(func, Reducer):
        out = merged_states(held, [*keys, label], "_x", func)
    elif callable(func) or func in REDUCERS:
        out = held.groupBy(*keys, label).agg((_whole(func) if callable(func) else REDUCERS[func])(F.col("_x")).alias("values"))
    else:
        raise ValueError(f"unknown reducer {func!r}; known: {sorted([*REDUCERS, *SHARES])}")
    return out.select(*keys, F.rint(F.col(label).cast("double")).alias("labels"), "values")


def _signals(voxels: DataFrame) -> DataFrame:
    base, post = F.col("baseline"), F.col("post_injection")
    signal = F.when(F.col("signal_type") == "T1map", tracer(base, post, "T1map")).otherwise(tracer(base, post, "T1w"))
    return voxels.withColumn("value", signal)


def tracer_table(manifest: DataFrame, images: DataFrame | None = None, func: str | Reducer | Callable = "median") -> DataFrame:
    """The long table (labels, values, subject, time_point, ord) of all jobs of a manifest.

    images: rows (volume_id, content) of all images under their paths; without it they are
    read as files. Either way a job's images are read side by side, once, and only the
    region aggregate shuffles. A job without segmentation gives its voxels, with NULL
    labels. Images that don't lie on the baseline's grid or have another shape or several
    frames, and unknown signal types, fail the job when it runs.
    """
    jobs = manifest.withColumn("ord", F.monotonically_increasing_id()) if "ord" not in manifest.columns else manifest
    scan = (lambda chosen: aligned_images(chosen, images)) if images is not None else read_aligned
    keys = [c for c in JOB if c != "signal_type"]
    regions = region_summary(_signals(scan(jobs.where("segmentation_path IS NOT NULL"))), keys, "segmentation", "value", func)
    plain = _signals(scan(jobs.where("segmentation_path IS NULL"))).select(*keys, F.lit(None).cast("double").alias("labels"), F.col("value").alias("values"))
    return regions.unionByName(plain).select("labels", "values", "subject", "time_point", "ord")
