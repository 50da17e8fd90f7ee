"""Group statistics behind the reports: boxes, percentiles, regressions, rank tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pvalues import rank_test_p, regression_p
from ..functions.tracer import fit_text, stars
from ..schema import known
from ..session import settled
from .linalg import first_position


def percentiles(df: DataFrame, by: list[str], value: str, keep: bool = False, **shares: float) -> DataFrame:
    """by, n, a column for each share: that percentile of the known values, linear between neighbours.

    Values are counted, counts are added up in ranges of values, and each share takes the
    two values at its place; so no task holds a group. Rows without a group, and groups
    without a known value, are left out; with `keep` both stay, the latter with NULL.
    """
    held = df.select(F.struct(*by).alias("_by"), *([] if keep else by), known(F.col(value)).alias("_x"))
    held = held if keep else held.dropna(subset=[*by, "_x"])
    counts = held.groupBy("_by", "_x").agg(F.count("_x").alias("_n"))  # a row without a value counts nothing
    placed = sums_before(settled(counts, "counts") if keep else counts, ["_by"], "_x", _below="_n")
    totals = placed.groupBy("_by").agg(F.sum("_n").alias("n"))
    low = {name: F.floor(F.lit(share) * (F.col("n") - 1)) for name, share in shares.items()}
    high = {name: F.least(low[name] + 1, F.col("n") - 1) for name in shares}
    at = lambda place: F.max(F.when((F.col("_below") <= place) & (place < F.col("_below") + F.col("_n")), F.col("_x")))
    found = placed.join(totals, "_by").groupBy("_by", "n").agg(*[at(place[name]).alias(f"_{side}_{name}") for side, place in (("low", low), ("high", high)) for name in shares])
    part = {name: F.lit(share) * (F.col("n") - 1) - low[name] for name, share in shares.items()}
    return found.select("_by.*", "n", *[(F.col(f"_low_{name}") + part[name] * (F.col(f"_high_{name}") - F.col(f"_low_{name}"))).alias(name) for name in shares])


def box_stats(df: DataFrame, category: str | list[str], value: str) -> DataFrame:
    """category (one column or several), n, q1, median, q3, low, high, n_fliers: whiskers reach the last point within 1.5 IQR."""
    keys = [category] if isinstance(category, str) else category
    held = df.select(*keys, known(F.col(value)).alias("_x")).where("_x IS NOT NULL")
    q = percentiles(held, keys, "_x", q1=0.25, median=0.5, q3=0.75).drop("n")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("_x") >= F.col("q1") - reach) & (F.col("_x") <= F.col("q3") + reach)
    return held.join(q, keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(inside, F.col("_x"))).alias("low"), F.max(F.when(inside, F.col("_x"))).alias("high"), F.count_if(~inside).alias("n_fliers")
    )


def colour_limits(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, vmin, vmax: the 5th and 95th percentile of the positive values."""
    return percentiles(df.where(known(F.col(value)) > 0), by, value, vmin=0.05, vmax=0.95).drop("n")


def average_rank(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with rank_avg, the mean rank of equal values within by.

    Ranks come from the counts of distinct values, added up in ranges of values.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = sums_before(counts, by, value, _below="_n").select(*by, value, (F.col("_below") + (F.col("_n") + 1) / 2.0).alias("rank_avg"))
    return df.join(ranks, [*by, value])


def sums_before(df: DataFrame, by: list[str], order: str, **sums: str) -> DataFrame:
    """df with new columns: for each name=column the sum of column over the rows of `by` with a smaller `order`.

    Rows are dealt out by ranges of (by, order), summed inside each range, and the ranges'
    totals, one row for each, are added up; so a group of any size is the work of many
    tasks. `order` is unique in `by`.
    """
    ranged = settled(df.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()), "ranges")
    here = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_total_{name}") for name, c in sums.items()])
    starts = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_total_{name}").over(earlier), F.lit(0)).alias(f"_start_{name}") for name in sums])
    found = ranged.join(starts, [*by, "_range"])
    for name, c in sums.items():
        found = found.withColumn(name, F.coalesce(F.sum(c).over(here), F.lit(0)) + F.col(f"_start_{name}"))
    return found.drop("_range", *[f"_start_{name}" for name in sums])


def rank_tests(df: DataFrame, category: str, value: str, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """by, category_a, category_b, n_a, n_b, u, p, star for all pairs, in order of first appearance.

    Mann-Whitney, two-sided, u is that of category_a. All pairs come from one ordered pass:
    a row for each distinct value holds the counts of all categories, ranges of values
    start from the counts below them, and each range gives the matrices of its share in
    every u and every sum of ties.
    """
    held = df.withColumn("_x", known(F.col(value))).where(F.col("_x").isNotNull() & F.col(category).isNotNull())
    hist = held.groupBy(*by, category, "_x").agg(F.count(F.lit(1)).alias("_n"))
    sizes = hist.groupBy(*by, category).agg(F.sum("_n").alias("n"))
    named = settled(first_position(held, category, order, by).join(sizes, [*by, category]), "categories")
    cells = hist.join(named.select(*by, category, "pos"), [*by, category]).groupBy(*by, "_x").agg(F.collect_list(F.struct("pos", F.col("_n").alias("n"))).alias("_cells"))
    ranged = settled(cells.repartitionByRange(*by, "_x").withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.select(*by, "_range", F.explode("_cells").alias("_cell")).groupBy(*by, "_range", "_cell.pos").agg(F.sum("_cell.n").alias("_n"))
    # what lies below a range is what the ranges before it hold, so counts are carried to every later range
    last = named.groupBy(*by).agg(F.max("pos").alias("_last"))
    spans = totals.select(*by, "_range").distinct()
    spans = spans.join(last, list(by)) if by else spans.withColumn("_last", F.lit(last.first()[0] or 0))  # one number
    spans = spans.select(*by, "_range", F.explode(F.sequence(F.lit(0), "_last")).alias("pos"))
    earlier = Window.partitionBy(*by, "pos").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    below = spans.join(totals, [*by, "_range", "pos"], "left").select(*by, "_range", "pos", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_below"))
    starts = below.groupBy(*by, "_range").agg(F.array_sort(F.collect_list(F.struct("pos", "_below"))).alias("_starts"))
    shares = ranged.join(starts, [*by, "_range"]).groupBy(*by, "_range").applyInArrow(_rank_shares(list(by)), T.StructType([*[ranged.schema[c] for c in by], *RANK_SHARES.fields]))
    sums = shares.groupBy(*by, "_pa", "_pb").agg(F.sum("u").alias("u"), F.sum("ties").alias("_ties"))
    side = lambda s: named.select(*by, F.col("pos").alias(f"_p{s}"), F.col(category).alias(f"category_{s}"), F.col("n").alias(f"n_{s}"))
    pairs = sums.join(side("a"), [*by, "_pa"]).join(side("b"), [*by, "_pb"])
    tested = pairs.withColumn("p", rank_test_p("u", "n_a", "n_b", "_ties"))
    return tested.select(*by, "category_a", "category_b", "n_a", "n_b", "u", "p", stars(F.col("p")).alias("star"))


RANK_SHARES = T.StructType([T.StructField("_pa", T.IntegerType()), T.StructField("_pb", T.IntegerType()), T.StructField("u", T.DoubleType()), T.StructField("ties", T.DoubleType())])


def _rank_shares(by: list[str]):
    """Of a range of values: its share in u and in the sum of ties of each pair of categories."""

    def run(t: pa.Table) -> pa.Table:
        start = np.array([s["_below"] for s in t.column("_starts")[0].as_py()], dtype=float)
        lists = t.column("_cells").combine_chunks()
        value, cells = np.argsort(t.column("_x").to_numpy()), lists.flatten()
        row = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
        counts = np.zeros((t.num_rows, len(start)))
        counts[row, cells.field("pos").to_numpy()] = cells.field("n").to_numpy()
        counts = counts[value]
        u = counts.T @ (start + np.cumsum(counts, axis=0) - counts / 2)
        one, three, mixed = counts.sum(axis=0), (counts**3).sum(axis=0), (counts**2).T @ counts
        ties = three[:, None] + three[None, :] + 3 * (mixed + mixed.T) - one[:, None] - one[None, :]
        a, b = np.triu_indices(len(start), 1)
        keys = {c: t.column(c).take(pa.array(np.zeros(len(a), np.int64))) for c in by}
        return pa.table({**keys, "_pa": pa.array(a, pa.int32()), "_pb": pa.array(b, pa.int32()), "u": u[a, b], "ties": ties[a, b]})

    return run


#: Bins of a bandwidth, points of a density, and bandwidths that it reaches beyond its values.
BINS, GRID, CUT = 64, 100, 2.0


def violins(df: DataFrame, keys: list[str], value: str, row: list[str]) -> DataFrame:
    """keys, n, step, y, density, width: the density of the known values of each group at GRID even points.

    A Gaussian kernel of Scott's bandwidth (n^(-1/5) deviations). Values are counted in
    bins of 1/BINS bandwidth, and bins, not values, meet the kernel. width is the share of
    a place that a violin fills: 1 at the peak of the largest group that has the same
    `row`, less in proportion to n elsewhere. A group without deviation is one point.
    """
    held = df.select(*keys, known(F.col(value)).alias("_x")).dropna(subset=["_x"])
    groups = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("_x").alias("_sd"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    wide = F.col("_sd") > 0
    groups = settled(groups.withColumn("_h", F.when(wide, F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.col("_sd"))), "violins")
    step = (F.col("_max") - F.col("_min") + 2 * CUT * F.col("_h")) / (GRID - 1)
    bins = held.join(groups.where("_h IS NOT NULL"), keys).withColumn("_bin", F.floor((F.col("_x") - F.col("_min")) / (F.col("_h") / BINS) + 0.5))
    bins = bins.groupBy(*keys, "n", "_h", "_min", "_max", "_bin").agg(F.count(F.lit(1)).alias("_c"))
    points = bins.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))).withColumn("y", F.col("_min") - CUT * F.col("_h") + F.col("step") * step)
    z = (F.col("y") - (F.col("_min") + F.col("_bin") * F.col("_h") / BINS)) / F.col("_h")
    kernel = F.sum(F.col("_c") * F.exp(-z * z / 2)) / (F.first("n") * F.first("_h") * math.sqrt(2 * math.pi))
    curves = points.groupBy(*keys, "step").agg(F.first("n").alias("n"), F.first("y").alias("y"), kernel.alias("density"))
    single = groups.where("_h IS NULL").select(*keys, F.lit(0).alias("step"), "n", F.col("_min").alias("y"), F.lit(1.0).alias("density"))
    rows = settled(curves.unionByName(single), "violin-curves")
    peaks = rows.groupBy(*keys, "n").agg(F.max("density").alias("_peak"))
    most = peaks.groupBy(*row).agg(F.max("n").alias("_most")) if row else peaks.agg(F.max("n").alias("_most"))
    peaks = peaks.join(most, row) if row else peaks.join(F.broadcast(most))  # one row is broadcast
    found = rows.join(peaks.drop("n"), keys)
    return found.select(*keys, "n", "step", "y", "density", (F.col("density") / F.col("_peak") * F.col("n") / F.col("_most")).alias("width"))


def shown_pairs(tests: DataFrame) -> DataFrame:
    """The rank tests that a plot marks: those with p of at most 0.05."""
    return tests.where(F.col("p") <= 0.05)


def regressions(df: DataFrame, category: list[str], x: str, y: str) -> DataFrame:
    """category, n, slope, intercept, r, r2, p, significant, text of y on x; NULL for constant x or too few points."""
    held = df.select(*category, known(F.col(x)).alias("_x"), known(F.col(y)).alias("_y")).dropna(subset=["_x", "_y"])
    r = F.try_divide(F.covar_pop("_y", "_x"), F.sqrt(F.var_pop("_x") * F.var_pop("_y")))
    out = held.groupBy(*category).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), r.alias("r"))
    return _tested(out)


#: Parts in which the matrices of a group are added up first.
PARTS = 16
#: Deviations of a column that rounding alone makes, in units of its mean.
CONSTANT = 1e-14


def pair_regressions(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """component_x, component_y, by, n, slope, ...: regressions of every ordered pair of columns, as regressions() has them, in each group.

    Rows are not expanded into pairs: a batch gives the matrices of counts, sums and
    products of all pairs about the group's means, in which each pair leaves out its own
    missing values; matrices are added up.
    """
    held = df.select(by, *[known(F.col(c)).alias(f"_{k}") for k, c in enumerate(columns)])
    size, kind = len(columns), held.schema[by]
    means = held.groupBy(by).agg(F.array(*[F.coalesce(F.avg(f"_{k}"), F.lit(0.0)) for k in range(size)]).alias("_means"))
    means = settled(means, "group-means")
    rows = held.withColumn("_by", F.struct(by)).join(means.select(F.struct(by).alias("_by"), "_means"), "_by").drop("_by")
    state = T.StructType([kind, T.StructField("_part", T.IntegerType()), T.StructField("_sums", T.BinaryType())])

    def packed(group: pa.Array, part: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([group, pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], [by, "_part", "_sums"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sums, groups = TaskContext.get().partitionId() % PARTS, {}, {}
        for b in batches:
            code = b.column(by).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            x = np.column_stack([b.column(f"_{k}").to_numpy(zero_copy_only=False).astype(float) for k in range(size)])
            for c in np.unique(code):
                at = np.flatnonzero(code == c)
                key, pivot = b.column(by)[int(at[0])].as_py(), np.array(b.column("_means")[int(at[0])].as_py())
                seen = ~np.isnan(x[at])
                d = np.where(seen, x[at] - pivot, 0.0)
                ones = seen.astype(float)
                groups.setdefault(key, b.column(by).take(pa.array([int(at[0])])))
                sums[key] = sums.get(key, 0.0) + np.stack([ones.T @ ones, d.T @ ones, (d * d).T @ ones, d.T @ d])
        for key, total in sums.items():
            yield packed(groups[key], part, total)

    def merged(t: pa.Table) -> np.ndarray:
        return sum(np.frombuffer(m.as_py()) for m in t.column("_sums")).reshape(4, size, size)

    def first(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([packed(t.column(by).combine_chunks()[:1], t.column("_part")[0].as_py(), merged(t))])

    shape = T.StructType([T.StructField("component_x", T.IntegerType()), T.StructField("component_y", T.IntegerType()), kind, *[T.StructField(c, T.DoubleType()) for c in ("_n", "_sx", "_sy", "_xx", "_yy", "_xy")]])

    def pairs(t: pa.Table) -> pa.Table:
        n, sums, squares, products = merged(t)
        x, y = np.nonzero(~np.eye(size, dtype=bool) & (n > 0))
        group = t.column(by).combine_chunks().take(pa.array(np.zeros(len(x), np.int64)))
        return pa.table({"component_x": x.astype(np.int32), "component_y": y.astype(np.int32), by: group, "_n": n[x, y], "_sx": sums[x, y], "_sy": sums[y, x], "_xx": squares[x, y], "_yy": squares[y, x], "_xy": products[x, y]})

    matrices = rows.mapInArrow(partial, state).groupBy(by, "_part").applyInArrow(first, state)
    found = matrices.groupBy(by).applyInArrow(pairs, shape).withColumn("_by", F.struct(by)).join(means.select(F.struct(by).alias("_by"), "_means"), "_by")
    mean = lambda side: F.get("_means", F.col(f"component_{side}"))
    spread = lambda side: F.col(f"_{side}{side}") - F.col(f"_s{side}") * F.col(f"_s{side}") / F.col("_n")
    known_spread = lambda side: F.when(spread(side) > F.col("_n") * F.pow(F.lit(CONSTANT) * mean(side), F.lit(2.0)), spread(side))
    found = found.withColumns({"_vx": known_spread("x"), "_vy": known_spread("y"), "_c": F.col("_xy") - F.col("_sx") * F.col("_sy") / F.col("_n")})
    slope = F.col("_c") / F.col("_vx")
    intercept = mean("y") + F.col("_sy") / F.col("_n") - slope * (mean("x") + F.col("_sx") / F.col("_n"))
    out = found.select("component_x", "component_y", by, F.col("_n").cast("long").alias("n"), slope.alias("slope"), intercept.alias("intercept"), (F.col("_c") / F.sqrt(F.col("_vx") * F.col("_vy"))).alias("r"))
    return _tested(out)


def _tested(fits: DataFrame) -> DataFrame:
    """fits (..., n, slope, intercept, r) with r2, p, significant, text."""
    out = fits.withColumn("p", regression_p("r", "n")).withColumns({"r2": F.col("r") * F.col("r"), "significant": F.col("p") < 0.05})
    return out.select(*fits.columns, "r2", "p", "significant", fit_text(F.col("r2"), F.col("p")).alias("text"))


def regression_lines(fits: DataFrame, df: DataFrame, x: str, points: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """fits with step, x, y_hat at evenly spaced points over the range of x in all of df, or in its rows of `by`."""
    span = df.groupBy(*by).agg(F.min(known(F.col(x))).alias("_lo"), F.max(known(F.col(x))).alias("_hi"))
    ranged = fits.join(span, list(by)) if by else fits.join(F.broadcast(span))  # one row is broadcast
    rows = ranged.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    rows = rows.withColumn("x", F.col("_lo") + F.col("step") * (F.col("_hi") - F.col("_lo")) / float(points - 1))
    return rows.withColumn("y_hat", F.col("slope") * F.col("x") + F.col("intercept")).drop("_lo", "_hi")
