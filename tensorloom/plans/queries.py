"""The engine's operators over the driver's tables, one query each.

A voxel is a lineitem (baseline l_discount, post l_tax), a subject a supplier's nation, a
time point a shipping year, a label a return flag or line number.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tracer import aligned, rot90, stars, tracer, valid_label
from ..operators import cp as cps
from ..operators import linalg, report, stats, tensorize
from ..operators import replicability as rep
from ..operators.region import Moments, region_summary, tracer_table
from ..session import settled
from ..sources import nifti

RANK = 2
FLAGS = {"A": 1.0, "N": 2.0, "R": 3.0}
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns, cast, in order."""
    return df.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def rounded(name: str, places: int = 6) -> Column:
    """A double rounded for comparison, without a negative zero."""
    return (F.round(F.col(name).cast("double"), places) + F.lit(0.0)).alias(name)


def voxels(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with subject, time_point, label (line number), flag (return flag as a number)."""
    flag = F.coalesce(*[F.when(F.col("l_returnflag") == k, F.lit(v)) for k, v in FLAGS.items()])
    return (
        table(spark, d, "lineitem")
        .join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
        .withColumns({"subject": F.col("s_nationkey").cast("string"), "time_point": F.year("l_shipdate"), "label": F.col("l_linenumber").cast("double"), "flag": flag})
        .withColumn("value", tracer(F.col("l_discount"), F.col("l_tax"), "T1w"))
    )


def long_table(spark: SparkSession, d: str, label: str = "label", func="median") -> DataFrame:
    return region_summary(voxels(spark, d), ["subject", "time_point"], label, "value", func)


def coo(spark: SparkSession, d: str) -> DataFrame:
    """Medians by nation, year and return flag as a complete tensor."""
    return tensorize.prepare_tensor(long_table(spark, d, "flag"), incomplete="drop").coo


def fixed_factor(coo_: DataFrame, mode: int) -> DataFrame:
    """A factor of known numbers for every index of a mode."""
    idx = coo_.select(F.col(f"m{mode}").alias("idx")).distinct()
    return idx.select("idx", F.array(*[(1 + (7 * F.col("idx") + 3 * r) % 5).cast("double") for r in range(RANK)]).alias("row"))


def fixed_model(coo_: DataFrame) -> list[DataFrame]:
    return [fixed_factor(coo_, m) for m in range(3)]


def _signal(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "lineitem").withColumn("signal", tracer(F.col("l_discount"), F.col("l_tax"), kind))
        return typed(rows, l_orderkey="bigint", l_linenumber="bigint", l_partkey="bigint", l_suppkey="bigint", signal="double")

    return query


def mask_and_label_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where((F.col("l_quantity") - 25 > 0) & valid_label(F.col("l_linenumber") - 1.0))
    return typed(rows, l_orderkey="bigint", l_linenumber="bigint", l_partkey="bigint", l_quantity="double")


def grid_alignment(spark: SparkSession, d: str) -> DataFrame:
    a = F.transform("embedding", lambda v: v.cast("double"))
    b = F.transform(a, lambda v: v * (1 + (F.col("vec_id") % 4) * 5e-6))
    return typed(table(spark, d, "embeddings").withColumn("on_grid", aligned(a, b)), vec_id="bigint", on_grid="boolean")


def _reduced(func) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = typed(long_table(spark, d, func=func), subject="string", time_point="bigint", labels="double", values="double")
        return rows.withColumn("values", rounded("values"))

    return query


def group_filter(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = voxels(spark, d).join(named, F.col("s_nationkey") == F.col("n_nationkey"))
    return typed(tensorize.group_filter(rows, "r_name", "EUROPE"), l_orderkey="bigint", l_linenumber="bigint", l_partkey="bigint", subject="string", value="double")


def pivot_first(spark: SparkSession, d: str) -> DataFrame:
    cells = tensorize.pivot_first(voxels(spark, d), ["subject", "time_point", "label"], "value", ORDER)
    return typed(cells, subject="string", time_point="bigint", label="double", value="double")


def event_cells(spark: SparkSession, d: str) -> DataFrame:
    """events as a sparse panel: user by day by type."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("subject"), F.to_date("ts").alias("time_point"), F.col("event_type").alias("labels"), "value", "event_id")
    return tensorize.pivot_first(rows, ["subject", "time_point", "labels"], "value", ["event_id"])


def valid_subjects(spark: SparkSession, d: str) -> DataFrame:
    return typed(tensorize.valid_subjects(event_cells(spark, d)), subject="bigint")


def label_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Event types that occur on every day that occurs."""
    cells = event_cells(spark, d)
    daily = cells.groupBy("time_point", "labels").agg(F.min("value").alias("value"))
    full = tensorize.complete_labels(daily, ["time_point"], "labels")
    return typed(full.groupBy("labels").agg(F.count(F.lit(1)).alias("n_rows")), labels="string", n_rows="bigint")


def tensor_coo(spark: SparkSession, d: str) -> DataFrame:
    return typed(coo(spark, d), m0="bigint", m1="bigint", m2="bigint", x="double").withColumn("x", rounded("x"))


def axis_index(spark: SparkSession, d: str) -> DataFrame:
    t = tensorize.prepare_tensor(long_table(spark, d, "flag"), incomplete="drop")
    parts = [a.select(F.lit(n).alias("axis"), F.col(k).cast("double").cast("string").alias("key"), F.col("idx").cast("bigint").alias("idx")) for n, a, k in ((1, t.time_points, "time_point"), (2, t.labels, "labels"))]
    names = t.subjects.select(F.lit(0).alias("axis"), F.col("subject").alias("key"), F.col("idx").cast("bigint").alias("idx"))
    rows = names.unionByName(parts[0]).unionByName(parts[1])
    return rows.select(F.col("axis").cast("bigint").alias("axis"), F.when(F.col("axis") == 0, F.col("key")).otherwise(F.col("key").cast("double").cast("bigint").cast("string")).alias("key"), "idx")


def row_gather(spark: SparkSession, d: str) -> DataFrame:
    x = coo(spark, d)
    half = x.select(F.col("m0").alias("sample_idx"), (F.col("m0") % 2).alias("task")).distinct()
    tasks = half.select("task", F.floor(F.col("sample_idx") / 2).cast("int").alias("pos"), "sample_idx")
    return typed(tensorize.gather_rows(x, tasks), task="bigint", m0="bigint", m1="bigint", m2="bigint", x="double").withColumn("x", rounded("x"))


def union_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = [long_table(spark, d, label).withColumn("job", F.lit(job)) for job, label in (("line", "label"), ("flag", "flag"))]
    return typed(jobs[0].unionByName(jobs[1]), job="string", labels="double", values="double", subject="string", time_point="bigint").withColumn("values", rounded("values"))


def common_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Customers seen in both of two years, for each pair of years."""
    members = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_custkey").alias("c")).distinct()
    years = members.groupBy(F.lit(0).alias("all")).agg(F.sort_array(F.collect_set("y")).alias("ys"))  # a few years
    pairs = years.select("ys", F.explode("ys").alias("fold_i")).select("fold_i", F.explode("ys").alias("fold_j")).where("fold_i < fold_j")
    rows = rep.common_members(members, pairs, "y", "c").groupBy("fold_i", "fold_j").agg(F.count(F.lit(1)).alias("n_common"), F.sum("c").alias("key_sum"))
    return typed(rows.withColumnsRenamed({"fold_i": "year_a", "fold_j": "year_b"}), year_a="bigint", year_b="bigint", n_common="bigint", key_sum="bigint")


def embedding_cells(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, dim, value of all embeddings."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


def mode_scale(spark: SparkSession, d: str) -> DataFrame:
    scaled = linalg.scale_columns(embedding_cells(spark, d), ["dim"])
    return typed(scaled, vec_id="bigint", dim="bigint", value="double").withColumn("value", rounded("value", 8))


def gram(spark: SparkSession, d: str) -> DataFrame:
    packed = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.transform("embedding", lambda v: v.cast("double")).alias("row"))
    return typed(linalg.gram_cells(packed), r="bigint", s="bigint", value="double").withColumn("value", rounded("value"))


def mttkrp(spark: SparkSession, d: str) -> DataFrame:
    x = coo(spark, d)
    rows = linalg.to_long(linalg.mttkrp(x, fixed_model(x), 0, RANK))
    return typed(rows, idx="bigint", r="bigint", value="double").withColumn("value", rounded("value", 4))


def mu_step(spark: SparkSession, d: str) -> DataFrame:
    x = settled(coo(spark, d))
    factors = fixed_model(x)
    others = linalg.gram_matrix(factors[1], RANK) * linalg.gram_matrix(factors[2], RANK)
    rows = linalg.to_long(linalg.mu_step(factors[0], linalg.mttkrp(x, factors, 0, RANK), others))
    return typed(rows, idx="bigint", r="bigint", value="double").withColumn("value", rounded("value"))


def cp_norm_error(spark: SparkSession, d: str) -> DataFrame:
    x = settled(coo(spark, d))
    factors = fixed_model(x)
    norm2 = x.agg(F.sum(F.col("x") * F.col("x"))).first()[0]
    error = linalg.relative_error(norm2, linalg.mttkrp(x, factors, 2, RANK), factors[2], [linalg.gram_matrix(f, RANK) for f in factors])
    return x.agg(F.count(F.lit(1)).alias("n_cells"), F.first(F.round(F.lit(error), 6)).alias("error"))


def planted(spark: SparkSession, d: str) -> DataFrame:
    """An outer product of three columns of numbers that part gives: by brand, size and type."""
    part = table(spark, d, "part")
    modes = []
    for m, (key, value) in enumerate((("p_brand", F.sqrt(F.avg("p_retailprice"))), ("p_size", F.count(F.lit(1)) / 10.0), ("p_type", F.count(F.lit(1)) / 100.0))):
        modes.append(tensorize.axis(part, key).join(part.groupBy(key).agg(value.alias(f"v{m}")), key).select(F.col("idx").alias(f"m{m}"), f"v{m}"))
    n1, n2 = modes[1].count(), modes[2].count()
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    cells = modes[0].select("m0", "v0", every(n1, "m1")).select("m0", "v0", "m1", every(n2, "m2")).join(modes[1], "m1").join(modes[2], "m2")
    return cells.select("m0", "m1", "m2", (F.col("v0") * F.col("v1") * F.col("v2")).alias("x"))


def cp_rank1(spark: SparkSession, d: str) -> DataFrame:
    x = settled(planted(spark, d))
    best = cps.cp(x, 1, cps.CPOptions(max_iter=100, starts=2, tol=1e-9))
    factors = [best.where(F.col("mode") == m).select("idx", "row") for m in range(3)]
    return typed(linalg.reconstruct(x, factors), m0="bigint", m1="bigint", m2="bigint", x_hat="double").withColumn("x_hat", rounded("x_hat", 5))


FULL = cps.CPOptions()


def cp_best_of_n(spark: SparkSession, d: str) -> DataFrame:
    best = cps.cp(coo(spark, d), RANK, FULL)
    rows = best.select("seed", "n_iter", "error", "mode", "idx", F.posexplode("row").alias("r", "value"))
    rows = typed(rows, seed="bigint", n_iter="bigint", error="double", mode="bigint", idx="bigint", r="bigint", value="double")
    return rows.withColumns({"error": rounded("error"), "value": rounded("value", 5)})


def cp_table_fit(spark: SparkSession, d: str) -> DataFrame:
    """One start, run to its tolerance with the tensor as blocks and its factors as slices."""
    factors, errors = cps.cp_table(settled(coo(spark, d)), RANK, FULL)
    out = None
    for m, f in enumerate(factors):
        part = linalg.to_long(f).withColumns({"mode": F.lit(m), "error": F.lit(errors[-1])})
        out = part if out is None else out.unionByName(part)
    return typed(out, mode="bigint", idx="bigint", r="bigint", value="double", error="double").withColumns({c: rounded(c) for c in ("value", "error")})


def n_labels(spark: SparkSession, d: str) -> int:
    """Labels of the embeddings, numbered from 0."""
    return (table(spark, d, "embeddings").agg(F.max("label")).first()[0] or 0) + 1


def label_model(spark: SparkSession, d: str, stat: str = "avg") -> DataFrame:
    """mode 0: a row for each dimension, a component for each label, of the embeddings' mean (or maximum)."""
    cells = embedding_cells(spark, d)
    value = F.avg("value") if stat == "avg" else F.max("value")
    by = cells.groupBy("dim", "label").agg(value.alias("value"))
    row = F.array(*[F.coalesce(F.max(F.when(F.col("label") == r, F.col("value"))), F.lit(0.0)) for r in range(n_labels(spark, d))])
    return by.groupBy(F.col("dim").alias("idx")).agg(row.alias("row")).withColumns({"pair": F.lit(1), "mode": F.lit(0)})


def _cosines(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    rows = linalg.congruence(a, b, ["pair", "mode"], n).select(F.posexplode("cosines").alias("p", "cosine"))
    rows = rows.select(F.floor(F.col("p") / n).alias("r"), (F.col("p") % n).alias("s"), "cosine")
    return typed(rows, r="bigint", s="bigint", cosine="double").withColumn("cosine", rounded("cosine"))


def congruence(spark: SparkSession, d: str) -> DataFrame:
    return _cosines(label_model(spark, d), label_model(spark, d, "max"), n_labels(spark, d))


def degeneracy(spark: SparkSession, d: str) -> DataFrame:
    a = label_model(spark, d)
    rows = _cosines(a, a, n_labels(spark, d)).where("r != s")
    return rows.agg(F.min("cosine").alias("degeneracy"))


def _fms(other: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        a = label_model(spark, d)
        found = rep.factor_match(a, other(a), ["pair"], n_labels(spark, d))
        return typed(found, pair="bigint", score="double").withColumn("score", rounded("score"))

    return query


def _permuted(a: DataFrame) -> DataFrame:
    return a.withColumn("row", F.reverse(F.transform("row", lambda v, k: v * (k + 2.0))))


def fms_models(spark: SparkSession, d: str) -> DataFrame:
    """Means against maxima of the embeddings of three labels: two models whose components have to be matched."""
    three = [label_model(spark, d, stat).withColumn("row", F.slice("row", 1, 3)) for stat in ("avg", "max")]
    return typed(rep.factor_match(*three, ["pair"], 3), pair="bigint", score="double").withColumn("score", rounded("score"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("sample_idx"), F.col("c_mktsegment").alias("stratum"))


def half_half_split(spark: SparkSession, d: str) -> DataFrame:
    return typed(rep.half_half(samples(spark, d), 3), task_a="bigint", task_b="bigint", pos="bigint", sample_idx="bigint")


def half_half_sizes(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    rows = rep.half_half(s, 3).join(s, "sample_idx").groupBy("task_a", "task_b", "stratum").agg(F.count(F.lit(1)).alias("n"))
    return typed(rows, task_a="bigint", task_b="bigint", stratum="string", n="bigint")


def cv_folds(spark: SparkSession, d: str) -> DataFrame:
    return typed(rep.cv_folds(samples(spark, d), 5, 2), repeat="bigint", fold="bigint", sample_idx="bigint")


def cv_fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    rows = rep.cv_folds(s, 5, 2).join(s, "sample_idx").groupBy("repeat", "fold", "stratum").agg(F.count(F.lit(1)).alias("n"))
    return typed(rows, repeat="bigint", fold="bigint", stratum="string", n="bigint")


def cv_pairs(spark: SparkSession, d: str) -> DataFrame:
    """For each pair of folds of one repeat, the samples that both train sets hold."""
    both = rep.common_train(rep.cv_folds(samples(spark, d), 5, 2), 5, 2)
    rows = both.groupBy("fold_i", "fold_j").agg(F.count(F.lit(1)).alias("n_common"))
    return typed(rows, fold_i="bigint", fold_j="bigint", n_common="bigint")


#: Ten starts for each of the 20 halves and the 10 train sets.
SCORED = cps.CPOptions(starts=10)


def fms_half(spark: SparkSession, d: str) -> DataFrame:
    rows = rep.evaluate(rep.HalfHalf(10), coo(spark, d), RANK, options=SCORED)
    return typed(rows, split="bigint", score="double").withColumn("score", rounded("score"))


def fms_cv(spark: SparkSession, d: str) -> DataFrame:
    rows = rep.evaluate(rep.CrossValidation(5, 2), coo(spark, d), RANK, options=SCORED).withColumn("common", F.array_join("common", ","))
    return typed(rows, common="string", fold_i="bigint", fold_j="bigint", score="double").withColumn("score", rounded("score"))


def nation_mode(spark: SparkSession, d: str) -> DataFrame:
    """Long subject mode (subjects, r, value): mean, highest and number of balances of each nation."""
    by = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("subjects")).agg(F.avg("c_acctbal").alias("a"), F.max("c_acctbal").alias("b"), F.count(F.lit(1)).cast("double").alias("c"))
    cells = F.array(*[F.struct(F.lit(r).alias("r"), F.col(c).alias("value")) for r, c in enumerate("abc")])
    return by.select("subjects", F.inline(cells))


def merged(spark: SparkSession, d: str) -> DataFrame:
    info = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("subjects"), "n_name", "r_name")
    return report.subject_table(nation_mode(spark, d), info, "r_name", 3)


def subject_plots(spark: SparkSession, d: str) -> report.SubjectReport:
    """The report of the nations' mode by region, with the number of letters of the name and the key as variables."""
    rows = merged(spark, d).withColumns({"letters": F.length("n_name").cast("double"), "key": F.col("subjects").cast("double")})
    return report.SubjectReport(rows, 3, "r_name", ("letters", "key"), legend=0.5)


def subject_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = typed(merged(spark, d), subjects="bigint", n_name="string", r_name="string", comp_0="double", comp_1="double", comp_2="double")
    return rows.withColumns({f"comp_{k}": rounded(f"comp_{k}") for k in range(3)})


def subject_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of components by region (plot data of the subject mode)."""
    rows = typed(subject_plots(spark, d).boxes, component="bigint", r_name="string", n="bigint", q1="double", median="double", q3="double", low="double", high="double", n_fliers="bigint")
    return rows.withColumns({c: rounded(c) for c in ("q1", "median", "q3", "low", "high")})


def subject_violins(spark: SparkSession, d: str) -> DataFrame:
    """Densities of components by region, with the widths of their violins."""
    rows = typed(subject_plots(spark, d).violins, component="bigint", r_name="string", n="bigint", step="bigint", y="double", density="double", width="double")
    return rows.withColumns({c: rounded(c) for c in ("y", "density", "width")})


def customer_violins(spark: SparkSession, d: str) -> DataFrame:
    """Densities of account balances by market segment."""
    rows = typed(stats.violins(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", []), c_mktsegment="string", n="bigint", step="bigint", y="double", density="double", width="double")
    return rows.withColumns({"y": rounded("y", 4), "density": rounded("density", 9), "width": rounded("width")})


def subject_tests(spark: SparkSession, d: str) -> DataFrame:
    rows = subject_plots(spark, d).tests
    return typed(rows, component="bigint", category_a="string", category_b="string", n_a="bigint", n_b="bigint", u="double")


def subject_fits(spark: SparkSession, d: str) -> DataFrame:
    rows = typed(subject_plots(spark, d).regressions, variable="string", component="bigint", r_name="string", n="bigint", slope="double", r2="double", p="double", significant="boolean")
    return rows.withColumns({c: rounded(c) for c in ("slope", "r2", "p")})


def subject_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = typed(subject_plots(spark, d).lines, variable="string", component="bigint", r_name="string", step="bigint", x="double", y_hat="double")
    return rows.withColumns({c: rounded(c) for c in ("x", "y_hat")})


def subject_limits(spark: SparkSession, d: str) -> DataFrame:
    """Limits that the plots of a row share."""
    rows = typed(subject_plots(spark, d).limits, component="bigint", y_low="double", y_high="double", x_low="double", x_high="double")
    return rows.withColumns({c: rounded(c) for c in ("y_high", "x_high")})


def subject_strips(spark: SparkSession, d: str) -> DataFrame:
    """Each point with the place of its box, and whether it lies within a strip's width of it."""
    rows = subject_plots(spark, d).strips.withColumn("inside", F.abs(F.col("at") - F.col("pos")) <= report.JITTER)
    return typed(rows, component="bigint", subjects="bigint", r_name="string", pos="bigint", inside="boolean", value="double").withColumn("value", rounded("value"))


def component_limits(spark: SparkSession, d: str) -> DataFrame:
    """Limits of each cell of the plot of components against each other."""
    rows = report.ComponentReport(merged(spark, d), 3, "r_name").limits
    rows = typed(rows, component_y="bigint", component_x="bigint", y_low="double", y_high="double", x_low="double", x_high="double")
    return rows.withColumns({c: rounded(c) for c in ("y_high", "x_low", "x_high")})


def component_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = report.ComponentReport(merged(spark, d), 3, "r_name").lines
    rows = typed(rows, component_x="bigint", component_y="bigint", r_name="string", step="bigint", x="double", y_hat="double")
    return rows.withColumns({c: rounded(c) for c in ("x", "y_hat")})


def box_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.box_stats(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    rows = typed(rows, o_orderpriority="string", n="bigint", q1="double", median="double", q3="double", low="double", high="double", n_fliers="bigint")
    return rows.withColumns({c: rounded(c, 4) for c in ("q1", "median", "q3", "low", "high")})


def colour_limits(spark: SparkSession, d: str) -> DataFrame:
    shifted = table(spark, d, "orders").withColumn("v", F.col("o_totalprice") - 100000.0)
    rows = typed(stats.colour_limits(shifted, ["o_orderstatus"], "v"), o_orderstatus="string", vmin="double", vmax="double")
    return rows.withColumns({c: rounded(c, 4) for c in ("vmin", "vmax")})


def avg_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.average_rank(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], "c_acctbal")
    return typed(rows, c_custkey="bigint", c_mktsegment="string", rank_avg="double")


def _tests(spark: SparkSession, d: str) -> DataFrame:
    return stats.rank_tests(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", ["c_custkey"])


def mann_whitney_u(spark: SparkSession, d: str) -> DataFrame:
    return typed(_tests(spark, d), category_a="string", category_b="string", n_a="bigint", n_b="bigint", u="double")


def mann_whitney_p(spark: SparkSession, d: str) -> DataFrame:
    return typed(_tests(spark, d), category_a="string", category_b="string", u="double", p="double", star="string").withColumn("p", rounded("p"))


def shown_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of line numbers whose prices differ visibly."""
    tests = stats.rank_tests(table(spark, d, "lineitem").select("l_linenumber", "l_extendedprice"), "l_linenumber", "l_extendedprice", ["l_linenumber"])
    return typed(stats.shown_pairs(tests), category_a="bigint", category_b="bigint", u="double", p="double", star="string").withColumn("p", rounded("p"))


def _fits(spark: SparkSession, d: str) -> DataFrame:
    return stats.regressions(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")


def linregress(spark: SparkSession, d: str) -> DataFrame:
    rows = typed(_fits(spark, d), l_returnflag="string", n="bigint", slope="double", intercept="double", r2="double")
    return rows.withColumns({"slope": rounded("slope", 4), "intercept": rounded("intercept", 3), "r2": rounded("r2")})


def regression_test(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.regressions(table(spark, d, "lineitem"), ["l_returnflag", "l_linenumber"], "l_discount", "l_tax")
    rows = typed(rows, l_returnflag="string", l_linenumber="bigint", n="bigint", r="double", p="double", significant="boolean", text="string")
    return rows.withColumns({c: rounded(c) for c in ("r", "p")})


def global_regression(spark: SparkSession, d: str) -> DataFrame:
    """One line through all rows."""
    rows = typed(stats.regressions(table(spark, d, "lineitem"), [], "l_discount", "l_tax"), n="bigint", slope="double", intercept="double", r2="double", p="double", significant="boolean", text="string")
    return rows.withColumns({c: rounded(c) for c in ("slope", "intercept", "r2", "p")})


def regression_line(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.regression_lines(_fits(spark, d), table(spark, d, "lineitem"), "l_quantity")
    rows = typed(rows, l_returnflag="string", step="bigint", x="double", y_hat="double")
    return rows.withColumns({"x": rounded("x"), "y_hat": rounded("y_hat", 2)})


def component_pairs(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    n = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    comps = [F.get("embedding", F.lit(k)).alias(f"comp_{k}") for k in range(n)]
    rows = report.component_correlations(vectors.select("label", *comps), n, "label")
    rows = typed(rows, component_x="bigint", component_y="bigint", label="bigint", n="bigint", slope="double", r2="double")
    return rows.withColumns({c: rounded(c) for c in ("slope", "r2")})


SHAPE = (11, 13, 1 << 20)
SLAB = 16


def voxel_index(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        key.alias("l"), (key % 11).cast("int").alias("i"), (F.floor(key / 11) % 13).cast("int").alias("j"), F.floor(key / 143).cast("int").alias("k"),
        (F.col("p_size") > 25).alias("is_csf"), (F.col("p_size") <= 25).alias("is_parenchyma"),
    )


def spatial_mode(spark: SparkSession, d: str) -> DataFrame:
    cells = F.array(F.struct(F.lit(0).alias("r"), F.col("p_retailprice").alias("value")), F.struct(F.lit(1).alias("r"), F.col("p_size").cast("double").alias("value")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("l"), F.inline(cells))


def voxel_scatter(spark: SparkSession, d: str) -> DataFrame:
    grid = report.scatter_to_grid(linalg.scale_columns(spatial_mode(spark, d), ["r"]), voxel_index(spark, d), "is_csf")
    return typed(grid, r="bigint", i="bigint", j="bigint", k="bigint", value="double").withColumn("value", rounded("value", 8))


def slice_rot90(spark: SparkSession, d: str) -> DataFrame:
    """Each slice along the last axis, turned for display."""
    row, col = rot90(F.col("i"), F.col("j"), 11, 13)
    grid = report.scatter_to_grid(spatial_mode(spark, d), voxel_index(spark, d))
    return typed(grid.select("r", F.col("k").alias("slice"), row.alias("row"), col.alias("col"), "value"), r="bigint", slice="bigint", row="bigint", col="bigint", value="double")


def spatial_limits(spark: SparkSession, d: str) -> DataFrame:
    _, limits = report.spatial_report(spatial_mode(spark, d), voxel_index(spark, d), SHAPE, (5, 6, 0))
    return typed(limits, tissue="string", r="bigint", vmin="double", vmax="double").withColumns({c: rounded(c, 8) for c in ("vmin", "vmax")})


def time_curve(spark: SparkSession, d: str) -> DataFrame:
    x = coo(spark, d).groupBy(F.col("m1").alias("t"), F.col("m2").alias("r")).agg(F.avg("x").alias("value"))
    rows = typed(report.time_curve(x, 3), r="bigint", t="bigint", value="double", y_low="double", y_high="double")
    return rows.withColumns({c: rounded(c) for c in ("value", "y_high")})


def star_labels(spark: SparkSession, d: str) -> DataFrame:
    """The text of each supplier's share of the balance range, taken as a p-value."""
    p = F.abs("s_acctbal") / 100000.0
    return typed(table(spark, d, "supplier").withColumn("p", p).withColumn("star", stars(F.col("p"))), s_suppkey="bigint", p="double", star="string")


def volume_scan(spark: SparkSession, d: str) -> DataFrame:
    """Each part as a voxel, in images of SLAB slices: built as NIfTI-1 bytes and read back as voxel rows."""
    at = voxel_index(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("l"), F.col("p_retailprice").alias("v")), "l")
    cells = at.select(F.concat(F.lit("slab"), F.floor(F.col("k") / SLAB)).alias("slab"), "i", "j", (F.col("k") % SLAB).alias("k"), "v")

    def image(key, pdf):
        import pandas as pd

        out = np.full((11, 13, SLAB), np.nan)
        out[pdf.i, pdf.j, pdf.k] = pdf.v
        return pd.DataFrame({"volume_id": [key[0]], "content": [nifti.build(out)]})

    images = cells.groupBy("slab").applyInPandas(image, "volume_id string, content binary")  # SLAB * 143 voxels at most
    return typed(nifti.voxels_of(images).where("NOT isnan(value)"), volume_id="string", i="bigint", j="bigint", k="bigint", value="double")


def image_regions(spark: SparkSession, d: str) -> DataFrame:
    """From images to the long table: each slab of parts is a subject with two time points, a mask and half-way labels."""
    size = F.col("p_size").cast("double")
    values = {"retail": F.col("p_retailprice"), "shifted": F.col("p_retailprice") + 10.0 * size, "size": size, "mask": size - 10.0, "regions": (F.col("p_partkey") % 6) * 0.5}
    names = list(values)
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l"), *[v.cast("double").alias(name) for name, v in values.items()])
    cells = voxel_index(spark, d).join(parts, "l").withColumns({"slab": F.concat(F.lit("slab"), F.floor(F.col("k") / SLAB)), "k": F.col("k") % SLAB})

    def made(key, pdf):
        import pandas as pd

        rows = []
        for name in names:
            out = np.full((11, 13, SLAB), np.nan)
            out[pdf.i, pdf.j, pdf.k] = pdf[name]
            rows.append((f"{key[0]}/{name}", nifti.build(out)))
        return pd.DataFrame(rows, columns=["volume_id", "content"])

    images = settled(cells.select("slab", "i", "j", "k", *names).groupBy("slab").applyInPandas(made, "volume_id string, content binary"))
    path = lambda name: F.concat("subject", F.lit(f"/{name}"))
    subjects = cells.select(F.col("slab").alias("subject")).distinct()
    jobs = [
        subjects.select("subject", F.lit(t).alias("time_point"), path(a).alias("baseline_path"), path(b).alias("post_injection_path"), F.lit(kind).alias("signal_type"), path("mask").alias("mask_path"), path("regions").alias("segmentation_path"))
        for t, (a, b, kind) in enumerate((("retail", "shifted", "T1w"), ("size", "retail", "T1map")))
    ]
    found = tracer_table(settled(jobs[0].unionByName(jobs[1])), images)
    return typed(found, labels="double", values="double", subject="string", time_point="bigint").withColumn("values", rounded("values"))


def plane_pixels(spark: SparkSession, d: str) -> DataFrame:
    """The pixels of three planes, turned and, for the first, mirrored; those that an overlay shows."""
    pixels, _ = report.spatial_report(spatial_mode(spark, d), voxel_index(spark, d), SHAPE, (5, 6, 0))
    return typed(report.overlay(pixels), tissue="string", plane="bigint", r="bigint", row="bigint", col="bigint", value="double").withColumn("value", rounded("value", 8))


def masked_overlay(spark: SparkSession, d: str) -> DataFrame:
    """A plane of an image in grey and the signal over it where the mask holds, zeros too."""
    index = voxel_index(spark, d)
    image = index.join(table(spark, d, "part").select(F.col("p_partkey").alias("l"), F.col("p_size").cast("double").alias("value")), "l")
    grid = report.scatter_to_grid(spatial_mode(spark, d), index)
    grey, shown = report.enhancement(image, grid, SHAPE, 1, 6, index.where("is_csf"))
    rows = grey.withColumn("r", F.lit(-1)).unionByName(shown)
    return typed(rows, r="bigint", row="bigint", col="bigint", value="double")


def mode_grid(spark: SparkSession, d: str) -> DataFrame:
    """The sagittal pixels of both tissues with the limits of their colours, and the points of the time curves."""
    x = coo(spark, d).groupBy(F.col("m1").alias("t"), F.col("m2").alias("r")).agg(F.avg("x").alias("value"))
    index = voxel_index(spark, d)
    image = index.withColumn("value", F.lit(1.0))
    g = report.ModeGrid(x, merged(spark, d), "r_name", spatial_mode(spark, d), index, image, SHAPE, 5, 3)
    pixels = g.pixels.join(g.colours, ["tissue", "r"]).select(F.col("tissue").alias("part"), "r", F.col("row").alias("a"), F.col("col").alias("b"), "value", F.col("vmin").alias("low"), F.col("vmax").alias("high"))
    curves = g.curves.select(F.lit("time").alias("part"), "r", F.col("t").alias("a"), F.lit(0).alias("b"), "value", F.col("y_low").alias("low"), F.col("y_high").alias("high"))
    rows = typed(pixels.unionByName(curves), part="string", r="bigint", a="bigint", b="bigint", value="double", low="double", high="double")
    return rows.withColumns({c: rounded(c) for c in ("value", "low", "high")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        mask_and_label_filter, grid_alignment, group_filter, pivot_first, valid_subjects, label_completeness, tensor_coo, axis_index, row_gather, union_jobs, common_subjects,
        mode_scale, gram, mttkrp, mu_step, cp_norm_error, cp_rank1, cp_best_of_n, cp_table_fit, congruence, degeneracy, fms_models, half_half_split, half_half_sizes, cv_folds, cv_fold_sizes, cv_pairs,
        fms_half, fms_cv, subject_merge, subject_boxes, subject_violins, customer_violins, subject_tests, subject_fits, subject_lines, subject_limits, subject_strips, component_limits, component_lines, box_stats, colour_limits, avg_rank, mann_whitney_u, mann_whitney_p, shown_pairs, linregress, regression_test, global_regression, regression_line, component_pairs,
        voxel_scatter, slice_rot90, spatial_limits, time_curve, star_labels, volume_scan, image_regions, plane_pixels, masked_overlay, mode_grid,
    ]
    out = {"tracer_t1map": _signal("T1map"), "tracer_t1w": _signal("T1w")}
    out |= {f"region_{n}": _reduced(f) for n, f in (("median", "median"), ("reduce_mean", "mean"), ("reduce_min", "min"), ("reduce_max", "max"), ("reduce_std", "std"), ("reduce_pct", "p95"), ("reduce_skew", Moments(3)), ("udf", np.median))}
    out |= {"fms_identity": _fms(lambda a: a), "fms_permuted": _fms(_permuted)}
    return out | {f.__name__: f for f in named}
