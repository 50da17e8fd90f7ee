"""Decompositions: kernel, best of many starts, the table form, matching, replicability."""

import itertools
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import cp, kernel, linalg, tensorize
from tensorloom.operators import replicability as rep
from tensorloom.schema import ConvergenceError


def planted(shape=(12, 4, 20), rank=2, seed=1):
    rng = np.random.default_rng(seed)
    f = [rng.random((n, rank)) for n in shape]
    return np.einsum("ar,br,cr->abc", *f), f


def cosines(a, b):
    unit = lambda f: f / np.linalg.norm(f, axis=0)
    return np.array([unit(x).T @ unit(y) for x, y in zip(a, b)])


def test_rank_one_fixture():
    fit = kernel.decompose(np.outer([0, 0, 1, 0], [0, 1, 0, 0]), 1, 1000, 1e-5, 1)
    assert np.allclose(fit.weights, 1.0) and fit.errors[-1] < 1e-6


def test_planted_is_found_and_errors_fall():
    x, truth = planted()
    fits = [kernel.decompose(x, 2, 5000, 1e-7, s) for s in range(3)]
    for fit in fits:
        assert all(b <= a + 1e-9 for a, b in zip(fit.errors, fit.errors[1:]))
    best = min(fits, key=lambda f: f.errors[-1])
    assert best.errors[-1] < 1e-3 and kernel.match_score(cosines(best.factors, truth))[0] > 0.99


def test_product_of_any_order():
    rng = np.random.default_rng(0)
    for shape in ((3, 4), (3, 4, 5), (2, 3, 4, 5)):
        x, f = rng.random(shape), [rng.random((n, 2)) for n in shape]
        names = "abcd"[: len(shape)]
        for mode in range(len(shape)):
            others = [f"{c}r" for k, c in enumerate(names) if k != mode]
            want = np.einsum(f"{names},{','.join(others)}->{names[mode]}r", x, *[g for k, g in enumerate(f) if k != mode])
            assert np.allclose(kernel.product(x, f, mode), want)


def test_matching_is_the_best_permutation():
    rng = np.random.default_rng(2)
    for rank in (1, 2, 4, 5):
        c = rng.random((2, rank, rank))
        prod = c.prod(axis=0)
        want = max(np.mean([prod[r, p[r]] for r in range(rank)]) for p in itertools.permutations(range(rank)))
        assert kernel.match_score(c)[0] == pytest.approx(want)


def test_cp_in_spark(spark):
    x, truth = planted()
    coo = tensorize.from_numpy(spark, x)
    best = cp.cp(coo, 2, cp.CPOptions(5000, 4, 1e-7)).toPandas()
    factors = [np.stack(g.sort_values("idx").row.to_list()) for _, g in best.groupby("mode")]
    assert kernel.match_score(cosines(factors, truth))[0] > 0.99
    kept = min((kernel.decompose(x, 2, 5000, 1e-7, s).errors[-1], s) for s in range(4))
    assert best.seed.unique().tolist() == [kept[1]]
    with pytest.raises(ConvergenceError):
        cp.cp(coo, 2, cp.CPOptions(5, 2, 1e-12))
    with pytest.raises(ValueError):
        cp.cp(coo.withColumn("x", F.lit(None).cast("double")), 2)


@pytest.mark.parametrize("observed", [0, cp.OBSERVED])
def test_table_form_equals_kernel(spark, monkeypatch, observed):
    """Sums of slices added up in a job of their own, and while slices are written."""
    monkeypatch.setattr(cp, "OBSERVED", observed)
    x, _ = planted((5, 3, 4))
    coo = tensorize.from_numpy(spark, x)
    init = [spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(f)], "idx int, row array<double>") for f in kernel.start(x.shape, 2, 3)]
    factors, errors = cp.cp_table(coo, 2, cp.CPOptions(2, 1, 0.0), init=init)
    want = kernel.decompose(x, 2, 2, 0.0, 3)
    assert np.allclose(errors, want.errors, atol=1e-8)
    got = np.array([r["row"] for r in factors[0].orderBy("idx").collect()])
    assert np.allclose(got, want.factors[0], atol=1e-8)


def test_starts_side_by_side_equal_the_kernel(spark, monkeypatch):
    """Starts that end at different iterations and passes of few columns give each seed's own model."""
    x, _ = planted((5, 3, 4))
    coo, options = tensorize.from_numpy(spark, x), cp.CPOptions(12, 5, 2e-2)
    monkeypatch.setattr(cp, "PASS_COLUMNS", 6)
    found = cp.cp_tables(coo, 2, options, range(5))
    want = {s: kernel.decompose(x, 2, 12, 2e-2, s) for s in range(5)}
    assert len({len(w.errors) for w in want.values()}) > 1
    for seed, fit in found.items():
        assert np.allclose(fit.errors, want[seed].errors, atol=1e-8) and len(fit.errors) == len(want[seed].errors)
        for table, gram, array in zip(fit.factors, fit.grams, want[seed].factors):
            assert np.allclose(np.array([r["row"] for r in table.orderBy("idx").collect()]), array, atol=1e-8)
            assert np.allclose(gram, array.T @ array, atol=1e-8)


def test_scaling_of_a_zero_column(spark):
    df = spark.createDataFrame([(0, 3.0), (0, 4.0), (1, 0.0)], "r int, value double")
    assert sorted((r["r"], r["value"]) for r in linalg.scale_columns(df, ["r"]).collect() if r["value"] is not None) == [(0, 0.6), (0, 0.8)]


def classes(spark, n, strata=("a",)):
    return spark.createDataFrame([(i, strata[i % len(strata)]) for i in range(n)], "sample_idx int, stratum string")


def test_half_tasks(spark):
    got = rep.HalfHalf(100).tasks(classes(spark, 30)).toPandas()
    sizes = got.groupby(["task_a", "task_b"]).size()
    assert len(sizes) == 200 and (sizes == 15).all()
    for _, g in got.groupby("task_a"):
        assert sorted(g.sample_idx) == list(range(30))
    odd = rep.HalfHalf(1).tasks(classes(spark, 31)).groupBy("task_b").count().collect()
    assert {r[0]: r[1] for r in odd} == {0: 15, 1: 16}
    with pytest.raises(ValueError):
        rep.HalfHalf(1).tasks(spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "sample_idx int, stratum string"))


def test_cv_tasks(spark):
    engine = rep.CrossValidation(10, 10)
    got = engine.tasks(classes(spark, 30, ("a", "b", "b"))).toPandas()
    assert got.task_a.nunique() == engine.nb_folds == 100
    assert set(got.groupby("task_a").size()) == {27}
    with pytest.raises(ValueError):
        rep.CrossValidation(40, 1).tasks(classes(spark, 30))


def test_train_sets_in_common(spark):
    """The pairs of train sets from folds are those of a join of the train sets."""
    samples = classes(spark, 31, ("a", "b", "b"))
    joined = rep.common_members(rep.cv_tasks(samples, 4, 3), rep.cv_pairs(4, 3, spark).drop("repeat"), "task_a", "sample_idx")
    found = rep.common_train(rep.cv_folds(samples, 4, 3), 4, 3)
    assert found.columns == joined.columns and sorted(found.collect()) == sorted(joined.collect()) and found.count() == 3 * 6 * 31 // 2


@pytest.mark.parametrize("make", [lambda s: rep.cv_folds(s, 5, 2), lambda s: rep.cv_tasks(s, 5, 2), lambda s: rep.half_half(s, 3)])
def test_numbers_do_not_depend_on_parts(spark, monkeypatch, make):
    whole = sorted(make(classes(spark, 200, ("a", "b", "b"))).collect())
    monkeypatch.setattr(rep, "TASK_ROWS", 7)
    assert sorted(make(classes(spark, 200, ("a", "b", "b"))).collect()) == whole


def peak_mb(spark, df):
    """The most execution memory that one task of df takes."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "peak")
    df.write.format("noop").mode("overwrite").save()
    sc._jsc.clearJobGroup()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    store, peak = sc._jsc.sc().statusStore(), 0
    for stage in {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}:
        tasks = store.taskList(stage, 0, 10_000)
        peak = max([peak, *(tasks.apply(k).taskMetrics().get().peakExecutionMemory() for k in range(tasks.size()))])
    return peak / 1e6


@pytest.mark.parametrize("make", [lambda s: rep.cv_folds(s, 5, 2), lambda s: rep.half_half(s, 2)])
def test_a_task_holds_a_part_of_the_samples(spark, monkeypatch, tmp_path, make):
    """Rows that are small in a file are neither sent to every task nor sorted in few: 1,200,000 take what 150,000 take."""
    monkeypatch.setattr(rep, "TASK_ROWS", 1 << 16, raising=False)
    peaks = []
    for n in (75_000, 600_000):
        spark.range(n).select(F.col("id").alias("sample_idx"), F.concat(F.lit("class "), F.col("id") % 5).alias("stratum")).write.parquet(f"{tmp_path}/{n}")
        peaks.append(peak_mb(spark, make(spark.read.parquet(f"{tmp_path}/{n}"))))
    assert 0 < peaks[1] < 1.5 * peaks[0], peaks


def test_scores(spark):
    x, _ = planted((12, 4, 10))
    coo = tensorize.from_numpy(spark, x)
    options = cp.CPOptions(3000, 2, 1e-6)
    half = rep.evaluate(rep.HalfHalf(2), coo, 2, options=options).toPandas()
    assert sorted(half.split) == [0, 1] and (half.score > 0.9).all()
    cv = rep.evaluate(rep.CrossValidation(3, 1), coo, 2, options=options).toPandas()
    assert len(cv) == 3 and (cv.score > 0.9).all() and all(len(c) == 4 for c in cv.common)
    assert rep.evaluate(rep.CrossValidation(2, 1), coo, 2, options=options).count() == 0


def test_both_ways_start_and_end_alike(spark):
    """A seed means the same start as arrays and as tables, and so the same model."""
    x, _ = planted((4, 3, 3))
    coo, options = tensorize.from_numpy(spark, x), cp.CPOptions(60, 1, 3e-2)
    rows = [sorted(map(tuple, cp.cp(coo, 1, options, task_bytes=b).select("n_iter", "mode", "idx", F.round(F.col("row")[0], 8)).collect())) for b in (1 << 20, 0)]
    assert rows[0] == rows[1]


def test_scores_of_a_tensor_that_stays_a_table(spark):
    x, _ = planted((6, 2, 2))
    coo, options = tensorize.from_numpy(spark, x), cp.CPOptions(40, 1, 5e-2)
    small, large = (rep.evaluate(rep.HalfHalf(1), coo, 1, options=options, task_bytes=b).first()["score"] for b in (1 << 20, 0))
    assert small == pytest.approx(large, abs=1e-8)


def test_status_is_told_from_grams():
    rng = np.random.default_rng(1)
    a = rng.random((5, 2))
    opposed = np.c_[a[:, 0], -a[:, 0] + 1e-3 * a[:, 1]]
    grams = lambda fs: [f.T @ f for f in fs]
    assert kernel.status([0.5, 0.4], grams([a, a]), 10) == "accepted" and kernel.status([0.5, 0.4], grams([np.c_[a[:, 0], a[:, 0]], opposed, np.c_[a[:, 1], a[:, 1]]]), 10) == "degenerate"
    assert kernel.status([0.5, float("nan")], grams([a, a]), 10) == "not finite" and kernel.status([0.5] * 10, grams([a, a]), 10) == "not converged"


def test_matching_many_components():
    rng = np.random.default_rng(6)
    order = rng.permutation(60)
    c = 0.5 * rng.random((1, 60, 60))
    c[0, np.arange(60), order] = 0.9
    assert kernel.match_score(c)[1] == order.tolist()


def test_match_is_blind_to_order_and_scale(spark):
    rng = np.random.default_rng(4)
    rows = [(1, m, i, rng.random(3).tolist()) for m in range(2) for i in range(6)]
    a = spark.createDataFrame(rows, "pair int, mode int, idx int, row array<double>")
    b = a.withColumn("row", F.transform(F.reverse("row"), lambda v, k: v * (k + 1)))
    assert rep.factor_match(a, b, ["pair"], 3).first()["score"] == pytest.approx(1.0)


def test_best_of_n_takes_the_default_starts(spark, data, monkeypatch):
    from tensorloom.operators import cp as cps
    from tensorloom.plans import queries

    taken = []
    monkeypatch.setattr(cps, "cp", lambda coo, rank, options: taken.append(options) or spark.createDataFrame([], cps.RESULT))
    queries.cp_best_of_n(spark, data)
    assert taken == [cps.CPOptions()]
