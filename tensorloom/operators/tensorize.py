"""From the long table to a complete subject x time x label tensor in coordinates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import known, require
from ..session import settled


def group_filter(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose text column equals value; a column of another type matches nothing."""
    require(df, column)
    return df.where(F.col(column) == F.lit(value)) if dict(df.dtypes)[column] == "string" else df.limit(0)


def pivot_first(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """keys, value: the first known value of each cell in the stated order; cells without one are left out."""
    held = df.dropna(subset=keys).withColumn("_x", known(F.col(value))).where("_x IS NOT NULL")
    return held.groupBy(*keys).agg(F.min_by("_x", F.struct(*order)).alias(value))


def complete_labels(cells: DataFrame, row_keys: list[str], label: str) -> DataFrame:
    """Cells of the labels that have a value in every row (combination of row_keys) that occurs."""
    n_rows = cells.select(*row_keys).distinct().agg(F.count(F.lit(1)).alias("_rows"))
    full = cells.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(n_rows), F.col("_n") == F.col("_rows"), "left_semi")  # one row is broadcast
    return cells.join(full.select(label), label, "left_semi")


def complete_subjects(cells: DataFrame, subject: str = "subject", time: str = "time_point") -> DataFrame:
    """Cells of the subjects that occur at every time point that occurs."""
    rows = cells.select(subject, time).distinct()
    n_times = rows.agg(F.countDistinct(time).alias("_times"))
    full = rows.groupBy(subject).agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(n_times), F.col("_n") == F.col("_times"), "left_semi")
    return cells.join(full.select(subject), subject, "left_semi")


def valid_subjects(cells: DataFrame, subject: str = "subject") -> DataFrame:
    """Subjects with a value anywhere: all that a pivot of known values still holds."""
    return cells.select(subject).distinct()


def axis(df: DataFrame, key: str) -> DataFrame:
    """key, idx: the sorted distinct keys numbered from 0.

    An axis is a dictionary of the tensor and has to fit a worker, as its factor does;
    so one task numbers its distinct keys, never its rows.
    """
    keys = df.select(key).distinct()
    return keys.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("idx"))


@dataclass
class Tensor:
    """x at (m0, m1, m2) and the key of each index: subjects (m0), time points (m1), labels (m2)."""

    coo: DataFrame
    subjects: DataFrame
    time_points: DataFrame
    labels: DataFrame

    def to_numpy(self, max_cells: int = 1 << 27):
        """(array, subjects, time points, labels) on the driver; refuses more than max_cells cells."""
        keys = [[r[0] for r in a.orderBy("idx").collect()] for a in (self.subjects, self.time_points, self.labels)]
        shape = tuple(map(len, keys))
        if np.prod(shape, dtype=float) > max_cells:
            raise ValueError(f"a tensor of shape {shape} is too large for the driver")
        out = np.full(shape, np.nan)
        rows = self.coo.select("m0", "m1", "m2", "x").toPandas()
        out[rows.m0, rows.m1, rows.m2] = rows.x
        return out, np.array(keys[0]).astype(str), np.array(keys[1]).astype(int), np.array(keys[2]).astype(int)


def prepare_tensor(df: DataFrame, group_filtering: tuple[str, str] | None = None, order: list[str] | None = None, incomplete: str = "error") -> Tensor:
    """The tensor of a long table (labels, values, subject, time_point).

    Of several values of one cell the first in `order` counts (default: column ord where
    there is one, else the smallest value). Labels with a hole are dropped. A panel whose
    subjects lack time points is an error while any label survives; incomplete="drop"
    drops those subjects first. No rows give an empty tensor.
    """
    if incomplete not in ("error", "drop"):
        raise ValueError("incomplete must be 'error' or 'drop'")
    require(df, "labels", "values", "subject", "time_point")
    if group_filtering is not None:
        df = group_filter(df, *group_filtering)
    order = order or (["ord"] if "ord" in df.columns else ["values"])
    # written once: axes, completeness and coordinates all read these cells, not their source
    cells = settled(pivot_first(df, ["subject", "time_point", "labels"], "values", order), "cells")
    if incomplete == "drop":
        cells = complete_subjects(cells)
    valid = complete_labels(cells, ["subject", "time_point"], "labels")
    s, t, l = axis(cells, "subject"), axis(cells, "time_point"), axis(valid, "labels")
    if incomplete == "error":
        rows = cells.select("subject", "time_point").distinct().count()
        if rows != s.count() * t.count() and not valid.isEmpty():
            raise ValueError("subjects lack time points; use incomplete='drop' to leave them out")
    of = lambda a, key, m: a.select(F.col(key), F.col("idx").alias(m))
    coo = valid.join(of(s, "subject", "m0"), "subject").join(of(t, "time_point", "m1"), "time_point").join(of(l, "labels", "m2"), "labels")
    return Tensor(coo.select("m0", "m1", "m2", F.col("values").alias("x")), s, t, l)


def from_numpy(spark, array: np.ndarray) -> DataFrame:
    """A dense array as coordinates m0.. and x."""
    at = np.indices(array.shape).reshape(array.ndim, -1)
    import pandas as pd

    frame = pd.DataFrame({f"m{k}": at[k].astype("int32") for k in range(array.ndim)} | {"x": array.reshape(-1).astype(float)})
    return spark.createDataFrame(frame)


def gather_rows(coo: DataFrame, tasks: DataFrame) -> DataFrame:
    """The sub-tensor of each task: rows m0 = sample_idx renumbered to the task's pos."""
    found = coo.join(tasks, coo.m0 == tasks.sample_idx).drop("m0", "sample_idx").withColumnRenamed("pos", "m0")
    return found.select(*[c for c in tasks.columns if c not in ("pos", "sample_idx")], *coo.columns)
