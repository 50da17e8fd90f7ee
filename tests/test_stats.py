"""Rank tests, regressions, boxes and report tables."""

import itertools

import numpy as np
import pytest

from pyspark.sql import functions as F

from tensorloom.functions import pvalues
from tensorloom.functions.tracer import fit_text, one_digit
from tensorloom.operators import report, stats


def brute_p(a, b):
    pooled, n = a + b, len(a)
    u = lambda xs, ys: sum((x > y) + 0.5 * (x == y) for x in xs for y in ys)
    mine = max(u(a, b), u(b, a))
    all_u = [u([pooled[i] for i in c], [pooled[i] for i in range(len(pooled)) if i not in c]) for c in itertools.combinations(range(len(pooled)), n)]
    return min(1.0, 2 * sum(x >= mine for x in all_u) / len(all_u))


def test_exact_rank_test():
    rng = np.random.default_rng(0)
    for n, m in ((3, 4), (1, 5), (4, 4), (2, 6)):
        a, b = rng.random(n).tolist(), rng.random(m).tolist()
        u = sum(x > y for x in a for y in b)
        assert pvalues.mann_whitney_p(u, n, m, 0) == pytest.approx(brute_p(a, b))


def test_published_values():
    # Student's t: P(|T| > 2.228) = 0.05 with 10 degrees of freedom, P(|T| > 12.706) = 0.05 with 1
    for t, df in ((2.228139, 10), (12.7062, 1), (1.959964, 10**7)):
        r = t / np.sqrt(df + t * t)
        assert pvalues.correlation_p(r, df + 2) == pytest.approx(0.05, abs=2e-5)
    assert pvalues.correlation_p(0.5, 2) is None
    # a large sample is near normal: z = 1.96
    n = 100
    u = n * n / 2 + 0.5 + 1.959964 * np.sqrt(n * n * (2 * n + 1) / 12)
    assert pvalues.mann_whitney_p(u, n, n, 0) == pytest.approx(0.05, abs=1e-6)


def test_sums_over_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v), int(n)) for g in "ab" for v, n in zip(rng.permutation(300), rng.integers(1, 9, 300))]
    got = stats.sums_before(spark.createDataFrame(rows, "g string, v double, n long"), ["g"], "v", below="n").collect()
    assert len(got) == 600 and all(r["below"] == sum(n for g, v, n in rows if g == r["g"] and v < r["v"]) for r in got)


def test_exact_tests_of_uneven_samples_are_quick():
    assert pvalues.mann_whitney_p(3 * 200_000.0, 3, 200_000, 0) == pytest.approx(2 / (200_003 * 200_002 * 200_001 / 6))


def test_rank_tests_with_ties(spark):
    rows = [(k, g, v) for k, (g, v) in enumerate([("b", 1.0), ("a", 2.0), ("b", 2.0), ("a", 3.0), ("c", 1.0), ("a", None)])]
    got = {(r["category_a"], r["category_b"]): r for r in stats.rank_tests(spark.createDataFrame(rows, "k int, g string, v double"), "g", "v", ["k"]).collect()}
    assert set(got) == {("b", "a"), ("b", "c"), ("a", "c")}
    assert got["b", "a"]["u"] == 0.5 and got["a", "c"]["u"] == 2.0


def test_regression(spark):
    rows = [("a", float(x), 2.0 * x + 1 + (x % 2)) for x in range(8)] + [("b", 1.0, float(x)) for x in range(3)]
    got = {r["g"]: r for r in stats.regressions(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    xs, ys = np.arange(8.0), 2 * np.arange(8.0) + 1 + np.arange(8) % 2
    slope, intercept = np.polyfit(xs, ys, 1)
    assert got["a"]["slope"] == pytest.approx(slope) and got["a"]["intercept"] == pytest.approx(intercept) and got["a"]["significant"]
    assert got["b"]["slope"] is None and got["b"]["p"] is None


def test_box(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 100.0, float("nan")]
    r = stats.box_stats(spark.createDataFrame([("a", x) for x in xs], "g string, x double"), "g", "x").first()
    assert (r["n"], r["q1"], r["median"], r["q3"], r["low"], r["high"], r["n_fliers"]) == (5, 2.0, 3.0, 4.0, 1.0, 4.0, 1)


def mode(spark, names):
    return spark.createDataFrame([(s, r, float(k + r + 1)) for k, s in enumerate(names) for r in range(2)], "subjects string, r int, value double")


def test_subject_table(spark):
    info = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0), ("c", "x", 5.0), ("d", "y", 3.0)], "subjects string, g string, v double")
    table = report.subject_table(mode(spark, "abcd"), info, "g", 2, ("v",))
    assert table.count() == 4
    assert sum(r["comp_0"] ** 2 for r in table.collect()) == pytest.approx(1.0)
    out = report.SubjectReport(table, 2, "g", ("v",))
    assert report.SubjectReport(table, 2, "g").lines.count() == 0 and out.strips.count() == 8 and out.limits.count() == 2
    assert all(abs(r["at"] - r["pos"]) <= report.JITTER for r in out.strips.collect())
    assert out.boxes.count() == 4 and out.tests.count() == 2 and out.regressions.count() == 4 and out.lines.count() == 200 and out.points.count() == 8
    assert report.component_correlations(table, 2, "g").count() == 4
    doubled = info.unionByName(info.where("subjects = 'a'"))
    assert report.subject_table(mode(spark, "abcd"), doubled, "g", 2).count() == 5
    for bad in (info.drop("g"), info.drop("subjects"), info.where("false"), info.where("subjects != 'a'"), info.where("g = 'x'")):
        with pytest.raises(ValueError):
            report.subject_table(mode(spark, "abc"), bad, "g", 2)


def test_percentiles(spark):
    rng = np.random.default_rng(3)
    rows = [(g, None if rng.random() < 0.05 else float(rng.integers(0, top))) for g, top in (("a", 5), ("b", 10**6), ("c", 2)) for _ in range(400)] + [("d", 7.0), ("e", None), (None, 1.0), ("d", float("nan"))]
    got = {r["g"]: r for r in stats.percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", low=0.05, mid=0.5, top=1.0).collect()}
    assert set(got) == set("abcd")
    for g, r in got.items():
        xs = [x for h, x in rows if h == g and x is not None and x == x]
        assert r["n"] == len(xs) and [r["low"], r["mid"], r["top"]] == pytest.approx(np.percentile(xs, [5, 50, 100]).tolist())
    assert stats.percentiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", mid=0.5).count() == 0


def test_texts_as_printed(spark):
    values = [0.0, 1e-300, 3.21e-5, 9.6e-5, 0.00034, 0.0099, 0.034, 0.26, 0.97, 1.0, 23.0, None]
    df = spark.createDataFrame([(v,) for v in values], "p double").select(one_digit(F.col("p")).alias("t"), fit_text(F.lit(0.126), F.col("p")).alias("f"))
    rows = df.collect()
    assert [r["t"] for r in rows] == [None if v is None else f"{v:.1g}" for v in values]
    assert rows[6]["f"] == "$R^2=0.13$, $p=0.03 $" and rows[-1]["f"] is None


def test_tissues(spark):
    index = spark.createDataFrame([(1, 0, 0, 0, True, False), (2, 0, 1, 0, False, True), (3, 1, 0, 0, None, False)], "l long, i int, j int, k int, is_csf boolean, is_parenchyma boolean")
    rows = [(n, r, float(n + r)) for n in (1, 2, 3) for r in (0, 1)]
    values = lambda held: spark.createDataFrame(held, "l long, r int, value double")
    got = report.tissue_grid(values(rows), index).where("r = 0").collect()
    assert sorted((g["tissue"], g["j"], round(g["value"], 6)) for g in got) == [("csf", 0, round(1 / 14**0.5, 6)), ("parenchyma", 1, round(2 / 14**0.5, 6))]
    assert report.tissue_grid(values([]), index).count() == 0
    for bad in (rows[:-1], rows[2:], [*rows[:4], rows[0], rows[1]]):
        with pytest.raises(ValueError):
            report.tissue_grid(values(bad), index)
    grid = report.scatter_to_grid(values(rows), index)
    grey, shown = report.enhancement(index.withColumn("value", F.lit(5.0)), grid, (2, 2, 1), 2, 0, index.where("l = 2"))
    assert {(p["row"], p["col"]) for p in grey.collect()} == {(1, 0), (0, 0), (1, 1)} and {(p["row"], p["col"], p["value"]) for p in shown.where("r = 0").collect()} == {(0, 0, 2.0)}
    assert report.enhancement(grid, grid, (2, 2, 1), 2, 0)[1].count() == 6


def test_slices_turn_as_numpy_does(spark):
    shape = (3, 4, 5)
    x = np.arange(60.0).reshape(shape) + 1
    rows = [(0, *map(int, at), float(x[at])) for at in np.ndindex(shape)]
    grid = spark.createDataFrame(rows, "r int, i int, j int, k int, value double")
    for axis, plane in ((0, np.flip(np.rot90(x[1]), 1)), (1, np.rot90(x[:, 2])), (2, np.rot90(x[:, :, 3]))):
        got = np.zeros(plane.shape)
        for p in report.slice_pixels(grid, shape, axis, axis + 1).collect():
            got[p["row"], p["col"]] = p["value"]
        assert (got == plane).all()


def test_layout():
    assert report.figure_size(3, 2, 7.0, 1.75) == (7.0, pytest.approx(6.6)) and report.palette(3) == ["C0", "C3", "C6"]
    assert report.plane_widths((4, 2, 8)) == [1.0, 2.0, 0.5, 0.05]
    assert report.grid_widths((9, 4, 2), 0.5) == ([1.0, 1.0, 3.0, 3.0], 1.5)

def test_violins(spark):
    """Densities against plain kernel sums; groups of one value or of equal ones are points, missing values don't count."""

    from tensorloom.operators.stats import violins

    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(5, 2, 400), "b": rng.gamma(2, 3, 37), "c": np.array([1.0, 1.0]), "d": np.array([4.0]), "e": np.array([0.0, 1e3, 1e3 + 1])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", float("nan")), ("f", None)]
    got = violins(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", []).toPandas()
    assert set(got.g) == set("abcde")
    for k, x in groups.items():
        mine = got[got.g == k].sort_values("step")
        if len(x) == 1 or x.std() == 0:
            assert mine[["step", "y", "density"]].values.tolist() == [[0, x[0], 1.0]] and mine.width.item() == pytest.approx(len(x) / 400)
            continue
        h = x.std(ddof=1) * len(x) ** -0.2
        y = np.linspace(x.min() - 2 * h, x.max() + 2 * h, 100)
        want = np.exp(-(((y[:, None] - x) / h) ** 2) / 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
        assert np.allclose(mine.y, y) and np.allclose(mine.density, want, rtol=2e-2, atol=1e-3 * want.max())
        assert mine.width.max() == pytest.approx(len(x) / 400)


def test_rank_tests_over_many_ranges(spark):
    """All pairs from one pass equal pairwise counting, whatever the ranges; a category without values has no pair."""

    from tensorloom.operators.stats import rank_tests

    rng = np.random.default_rng(8)
    rows = [(int(k), f"c{rng.integers(5)}", "xy"[k % 2], float(rng.integers(0, 12))) for k in range(600)] + [(600 + k, "late", "x", float("nan")) for k in range(3)] + [(700, "only", "y", 3.0)]
    df = spark.createDataFrame(rows, "id int, g string, part string, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    got = {(r["part"], r["category_a"], r["category_b"]): r for r in rank_tests(df, "g", "v", ["id"], ("part",)).collect()}
    alone = {(r["category_a"], r["category_b"]): r for r in rank_tests(df, "g", "v", ["id"]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for found, part in ((got, "x"), (got, "y"), (alone, None)):
        values = {}
        for _, g, p, v in rows:
            if v == v and part in (None, p):
                values.setdefault(g, []).append(v)
        names = list(values)
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        assert {k[-2:] for k in found if part is None or k[0] == part} == set(pairs)
        for a, b in pairs:
            r = found[(a, b) if part is None else (part, a, b)]
            want = sum((x > y) + 0.5 * (x == y) for x in values[a] for y in values[b])
            assert (r["u"], r["n_a"], r["n_b"]) == (want, len(values[a]), len(values[b]))
    assert rank_tests(df.limit(0), "g", "v", ["id"]).count() == 0


def test_pairs_from_moments(spark):
    """Matrices give what regressions of expanded pairs give, with values missing here and there, constants and lone rows."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(300):
        x = rng.normal(1e3, 1, 4)
        x[1] = 2 * x[0] + rng.normal(0, 0.1)
        x[3] = 7.1 if k % 3 else x[3]
        rows.append((None if k % 5 == 0 else f"g{k % 3}", *[None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else float(v) for v in x]))
    rows += [("one", 1.0, 2.0, None, 3.0), ("none", None, None, None, None)]
    df = spark.createDataFrame(rows, "g string, comp_0 double, comp_1 double, comp_2 double, comp_3 double").repartition(5)
    keys = ["component_x", "component_y", "g"]
    got = {tuple(r[k] for k in keys): r for r in stats.pair_regressions(df, [f"comp_{k}" for k in range(4)], "g").collect()}
    want = {tuple(r[k] for k in keys): r for r in stats.regressions(report.component_points(df, 4, "g"), keys, "x", "y").collect()}
    assert set(got) == set(want)
    for key, w in want.items():
        for c in ("n", "slope", "intercept", "r", "r2", "p"):
            assert got[key][c] == (None if w[c] is None else pytest.approx(w[c], rel=1e-6, abs=1e-9)), (key, c)
