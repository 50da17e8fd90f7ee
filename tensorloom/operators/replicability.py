"""Resampling tasks, factor match scores, and replicability of decompositions.

Splits are made by a portable integer hash of the sample index, so they don't depend on
partitioning; the same arithmetic can be written in any SQL.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ConvergenceError
from ..session import settled
from . import kernel, linalg
from .blocks import examined
from .cp import TASK_BYTES, CPOptions, best_start, best_tables, dense, fit_starts


def mixed(idx: Column, round_: Column, seed: int = 0) -> Column:
    """Order of a sample in a round: a prime-modulus hash, ties by index."""
    return (idx.cast("long") * 2654435761 + (round_.cast("long") + seed * 7919) * 40503) % 1000003


#: Values of the hash, and sample indices, that are numbered together.
HASH_RANGE, INDEX_RANGE = 64, 4096
#: Rows that a task numbers, about.
TASK_ROWS = 1 << 18


def numbered(rows: DataFrame, n: int, by: list[str], name: str, order: str, width: int, *ties: str, beside: DataFrame | None = None) -> DataFrame:
    """n rows with their place, from 0, in the order of a whole number and then of ties, which tell the rows of `by` apart.

    Ranges of `width` values are counted and the counts added up; then rows are numbered
    in their range. So nothing is sorted but the rows of a range, and a group of any size
    is the work of many tasks: one for TASK_ROWS rows, whatever the session's number of
    partitions. Rows are sorted once, as the join by range keeps the order of their numbers.
    The join has to merge: by the size of a compressed file Spark would send all rows to every task.
    beside: further columns by columns of `by`, joined to the ranges and not to the rows.
    """
    held = rows.withColumn("_range", F.floor(F.col(order) / width))
    counts = held.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*by, "_range", before.alias("_before"))
    if beside is not None:
        starts = starts.join(beside, [c for c in by if c in beside.columns])
    placed = held.repartition(max(1, -(-n // TASK_ROWS)), *by, "_range").withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order, *ties)) - 1)
    return placed.join(starts.hint("merge"), [*by, "_range"]).withColumn(name, (F.col("_place") + F.col("_before")).cast("int")).drop("_range", "_before", "_place")


def strata_counts(samples: DataFrame) -> DataFrame:
    """stratum, n_c, first: one row per class, classes known by their first sample."""
    return samples.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_c"), F.min("sample_idx").alias("first"))


def train_counts(samples: DataFrame) -> DataFrame:
    """stratum, n_c, n_train: shares of n - ceil(n / 2) by floor, the rest to the largest fractions.

    Works on one row per class; of equal fractions the class that appears first is served.
    """
    c = strata_counts(samples)
    n = F.sum("n_c").over(Window.partitionBy())
    train = F.floor(n / 2)
    exact = F.col("n_c") * train
    c = c.withColumns({"_low": F.floor(exact / n), "_frac": exact % n, "_left": train})
    c = c.withColumn("_left", F.col("_left") - F.sum("_low").over(Window.partitionBy()))
    order = Window.orderBy(F.desc("_frac"), "first")
    return c.select("stratum", "n_c", (F.col("_low") + (F.row_number().over(order) <= F.col("_left")).cast("int")).alias("n_train"))


def check_strata(samples: DataFrame) -> None:
    n, classes, least = strata_counts(samples).agg(F.sum("n_c"), F.count(F.lit(1)), F.min("n_c")).first()
    if least is not None and classes > 1 and least < 2:
        raise ValueError("every stratum needs at least 2 samples")
    if n is not None and n // 2 < classes:
        raise ValueError("each half needs a sample of every stratum")


def half_half(samples: DataFrame, repeats: int, seed: int = 0) -> DataFrame:
    """task_a (split), task_b (0 train, 1 test), pos, sample_idx of stratified half splits."""
    n = samples.count() * repeats
    rows = samples.select("sample_idx", "stratum", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("task_a"))
    rows = rows.withColumn("_h", mixed(F.col("sample_idx"), F.col("task_a"), seed))
    rows = numbered(rows, n, ["task_a", "stratum"], "_k", "_h", HASH_RANGE, "sample_idx", beside=train_counts(samples).select("stratum", "n_train"))
    rows = rows.select("task_a", (F.col("_k") >= F.col("n_train")).cast("int").alias("task_b"), "sample_idx")
    return numbered(rows, n, ["task_a", "task_b"], "pos", "sample_idx", INDEX_RANGE).select("task_a", "task_b", "pos", "sample_idx")


def cv_folds(samples: DataFrame, splits: int, repeats: int, seed: int = 0) -> DataFrame:
    """repeat, fold, sample_idx: the fold that tests each sample, in every repeat.

    Samples are placed class by class (classes by first appearance), hashed inside each;
    the fold is the place modulo splits, so sizes differ by one at most.
    """
    c = strata_counts(samples)
    before = F.coalesce(F.sum("n_c").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.select("stratum", before.alias("_first"))
    rows = samples.select("sample_idx", "stratum", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    rows = rows.withColumn("_h", mixed(F.col("sample_idx"), F.col("repeat"), seed))
    rows = numbered(rows, samples.count() * repeats, ["repeat", "stratum"], "_k", "_h", HASH_RANGE, "sample_idx", beside=c)
    return rows.select("repeat", ((F.col("_first") + F.col("_k")) % splits).cast("int").alias("fold"), "sample_idx")


def cv_tasks(samples: DataFrame, splits: int, repeats: int, seed: int = 0) -> DataFrame:
    """task_a (repeat * splits + fold), task_b (repeat), pos, sample_idx: all samples but those of the fold."""
    folds = cv_folds(samples, splits, repeats, seed)
    other = F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("_out")
    rows = folds.select("repeat", "fold", "sample_idx", other).where("_out != fold")
    rows = rows.select((F.col("repeat") * splits + F.col("_out")).alias("task_a"), F.col("repeat").alias("task_b"), "sample_idx")
    return numbered(rows, samples.count() * repeats * (splits - 1), ["task_a"], "pos", "sample_idx", INDEX_RANGE).select("task_a", "task_b", "pos", "sample_idx")


def cv_pairs(splits: int, repeats: int, spark) -> DataFrame:
    """fold_i < fold_j of one repeat."""
    folds = spark.range(splits * repeats).select(F.col("id").cast("int").alias("fold_i"), F.floor(F.col("id") / splits).cast("int").alias("repeat"))
    other = folds.withColumnRenamed("fold_i", "fold_j")
    return folds.join(other, "repeat").where("fold_i < fold_j")


def common_train(folds: DataFrame, splits: int, repeats: int) -> DataFrame:
    """fold_i, fold_j and the samples that the train sets of both hold: those that neither fold tests.

    folds is the table of cv_folds; the few pairs go to its rows, so no sample is shuffled or sorted.
    """
    pairs = F.broadcast(cv_pairs(splits, repeats, folds.sparkSession))
    held = [F.col(side) % splits != F.col("fold") for side in ("fold_i", "fold_j")]
    return folds.join(pairs, "repeat").where(held[0] & held[1]).select("fold_i", "fold_j", "sample_idx")


def common_members(members: DataFrame, pairs: DataFrame, group: str, member: str) -> DataFrame:
    """fold_i, fold_j and the members that both groups of each pair hold."""
    sides = [members.select(F.col(group).alias(side), member) for side in ("fold_i", "fold_j")]
    return sides[0].join(pairs, "fold_i").join(sides[1], ["fold_j", member]).select("fold_i", "fold_j", member)


@F.pandas_udf(T.DoubleType())
def matched(cosines: pd.Series, rank: pd.Series) -> pd.Series:
    return pd.Series([kernel.match_score(np.array([list(m) for m in c]).reshape(-1, int(r), int(r)))[0] for c, r in zip(cosines, rank)], dtype="float64")


def factor_match(a: DataFrame, b: DataFrame, keys: list[str], rank: int, skip_mode: int | None = None) -> DataFrame:
    """keys, score: factor match of two models' rows (keys, mode, idx, row), weights ignored.

    The best one-to-one matching of components maximises the mean over components of the
    product over modes (but skip_mode) of absolute cosines. Indices that one side lacks
    are left out before norms are taken.
    """
    keep = F.lit(True) if skip_mode is None else F.col("mode") != skip_mode
    per_mode = linalg.congruence(a.where(keep), b.where(keep), [*keys, "mode"], rank)
    held = per_mode.groupBy(*keys).agg(F.collect_list("cosines").alias("_c"))  # one array per mode
    return held.select(*keys, matched(F.col("_c"), F.lit(rank)).alias("score"))


class Engine(Protocol):
    """A way to resample and compare: tasks of the samples, and scores of the fitted models."""

    def tasks(self, samples: DataFrame) -> DataFrame: ...

    def compare(self, models: DataFrame, tasks: DataFrame, rank: int) -> DataFrame: ...


class HalfHalf:
    """Half splits; the halves are compared over all modes but the samples'."""

    def __init__(self, repeats: int, seed: int = 0) -> None:
        self.repeats, self.seed = repeats, seed

    def tasks(self, samples: DataFrame) -> DataFrame:
        check_strata(samples)
        return half_half(samples, self.repeats, self.seed)

    def compare(self, models: DataFrame, tasks: DataFrame, rank: int) -> DataFrame:
        """split, score."""
        named = models.withColumn("split", F.split("task", ":")[0].cast("int"))
        a, b = (named.where(F.col("task").endswith(f":{half}")) for half in (0, 1))
        return factor_match(a, b, ["split"], rank, skip_mode=0)


class CrossValidation:
    """Train sets of repeated stratified folds; pairs in a repeat are compared on their common samples."""

    def __init__(self, splits: int, repeats: int, seed: int = 0) -> None:
        self.splits, self.repeats, self.seed = splits, repeats, seed
        self.nb_folds = splits * repeats

    def tasks(self, samples: DataFrame) -> DataFrame:
        largest = strata_counts(samples).agg(F.max("n_c")).first()[0]
        if largest is not None and self.splits > largest:
            raise ValueError("more splits than samples in any stratum")
        return cv_tasks(samples, self.splits, self.repeats, self.seed)

    def compare(self, models: DataFrame, tasks: DataFrame, rank: int) -> DataFrame:
        """common, fold_i, fold_j, score; pairs without common samples are left out."""
        pairs = cv_pairs(self.splits, self.repeats, models.sparkSession).drop("repeat")
        at = tasks.select(F.concat_ws(":", "task_a", "task_b").alias("task"), F.lit(0).alias("mode"), F.col("pos").alias("idx"), "sample_idx")
        # rows of mode 0 are known by their sample, so the join below aligns the folds
        named = models.join(at, ["task", "mode", "idx"], "left").withColumn("idx", F.coalesce("sample_idx", "idx"))
        named = named.withColumn("fold", F.split("task", ":")[0].cast("int")).select("fold", "mode", "idx", "row")
        a = named.withColumnRenamed("fold", "fold_i").join(pairs, "fold_i")
        b = named.withColumnRenamed("fold", "fold_j").join(pairs, "fold_j")
        both = common_members(named.where("mode = 0").select("fold", "idx"), pairs, "fold", "idx")
        common = both.groupBy("fold_i", "fold_j").agg(F.array_sort(F.collect_list("idx")).alias("common"))
        scores = factor_match(a, b, ["fold_i", "fold_j"], rank)
        return common.join(scores, ["fold_i", "fold_j"]).select("common", "fold_i", "fold_j", "score")


#: Bytes that a sample of a task takes on the driver, about.
MEMBER_BYTES = 64


def evaluate(engine: Engine, coo: DataFrame, rank: int, strata: DataFrame | None = None, options: CPOptions = CPOptions(), task_bytes: int = TASK_BYTES) -> DataFrame:
    """Scores of the engine's comparison for a tensor whose mode 0 are the samples.

    strata: sample_idx, stratum (default: one class). A task without an accepted start
    raises ConvergenceError. Where tensor and tasks fit a worker (their sizes are checked)
    every task's starts run side by side; else all tasks and starts share the passes over
    the tensor's blocks. Both ways start alike.
    """
    coo = settled(coo, "tensor")
    shape, _ = examined(coo)
    samples = strata if strata is not None else coo.select(F.col("m0").alias("sample_idx")).distinct().withColumn("stratum", F.lit("all"))
    tasks = settled(engine.tasks(samples), "tasks")
    if max(8 * np.prod(shape, dtype=float), MEMBER_BYTES * tasks.count()) > task_bytes:
        named = tasks.select(F.concat_ws(":", "task_a", "task_b").alias("task"), "pos", "sample_idx")
        models = settled(best_tables(coo, named, rank, options).select("task", "mode", "idx", "row"), "models")
        return engine.compare(models, tasks, rank)
    members: dict[str, list[int]] = {}
    for a, b, _, i in tasks.select("task_a", "task_b", "pos", "sample_idx").orderBy("task_a", "task_b", "pos").collect():
        members.setdefault(f"{a}:{b}", []).append(i)
    results = settled(fit_starts(coo.sparkSession, dense(coo, shape), members, rank, options), "cp-starts")
    models = best_start(results).select("task", "mode", "idx", "row")
    done = {r[0] for r in models.select("task").distinct().collect()}
    if failed := sorted(set(members) - done):
        raise ConvergenceError(f"no start was accepted for tasks {failed[:10]}")
    return engine.compare(models, tasks, rank)
