"""Blocks of a tensor: products and models equal those of arrays, cells stay where they lie, repeats are refused."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import blocks, cp, kernel, linalg, tensorize
from tensorloom.operators import replicability as rep


def rows(spark, f):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(f)], "idx int, row array<double>")


def table(df):
    return {r["idx"]: r["row"] for r in df.collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 12)
    monkeypatch.setattr(blocks, "FAN_OUT", 2)


@pytest.mark.parametrize("shape, share", [((7, 5), 1.0), ((6, 4, 9), 1.0), ((6, 4, 9), 0.3), ((5, 3, 4, 3), 0.5)])
@pytest.mark.parametrize("shared", [1 << 20, 0])
def test_products(spark, small_blocks, monkeypatch, shape, share, shared):
    monkeypatch.setattr(blocks, "SHARED_BYTES", shared)
    rng = np.random.default_rng(len(shape))
    x = rng.random(shape) * (rng.random(shape) < share)
    x[tuple(n - 1 for n in shape)] = 1.0
    coo = tensorize.from_numpy(spark, x).where("x != 0").repartition(3)
    factors = [rng.random((n, 3)) for n in shape]
    tensor = blocks.BlockedTensor.build(coo)
    assert tensor.n_blocks > 3
    for mode, n in enumerate(shape):
        got = table(linalg.mttkrp(tensor, [rows(spark, f) for f in factors], mode, 3))
        assert np.allclose([got.get(i, [0, 0, 0]) for i in range(n)], kernel.product(x, factors, mode))
    names = "abcd"[: len(shape)]
    model = np.einsum(",".join(f"{c}r" for c in names) + "->" + names, *factors)
    cells = linalg.reconstruct(tensor, [rows(spark, f) for f in factors]).collect()
    assert len(cells) == (x != 0).sum()
    for c in cells:
        at = tuple(c[f"m{k}"] for k in range(len(shape)))
        assert c["x"] == x[at] and c["x_hat"] == pytest.approx(model[at])
    assert {r["idx"]: pytest.approx(r["norm2"]) for r in tensor.row_norms().collect()} == {i: (x[i] ** 2).sum() for i in range(shape[0]) if x[i].any() or i in {r["idx"] for r in tensor.row_norms().collect()}}
    tensor.close()


def test_cells_are_not_moved_by_an_update(spark, small_blocks):
    x = np.random.default_rng(1).random((6, 4, 9))
    tensor = blocks.BlockedTensor.build(tensorize.from_numpy(spark, x))
    factors = [blocks.packed(rows(spark, np.ones((n, 2))), n, s, 2) for n, s in zip(tensor.shape, tensor.sides)]
    plan = tensor.product(factors, 0, 2)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if "FileScan" in line and "cells" in line)
    assert "Bucketed: true" in lines[at] and "SelectedBucketsCount" in lines[at]
    depth = lambda line: len(re.match(r"[\s:+\-|]*", line)[0])
    above, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            above.append(line)
    joined = next(k for k, line in enumerate(above) if "CoGroup" in line)
    assert not any("Exchange" in line for line in above[:joined])


def test_repeated_cells_are_refused(spark, small_blocks):
    x = np.random.default_rng(2).random((4, 3, 3))
    coo = tensorize.from_numpy(spark, x)
    twice = coo.where("m0 > 0").unionByName(coo.where("m0 = 1 AND m1 = 1 AND m2 = 1"))
    for task_bytes in (1 << 20, 0):
        with pytest.raises(Exception, match="repeated cells"):
            cp.cp(twice, 1, cp.CPOptions(3, 1), task_bytes=task_bytes).collect()
    with pytest.raises(ValueError, match="repeated cells"):
        cp.cp(coo.unionByName(coo), 1)
    with pytest.raises(ValueError, match="NULL or NaN"):
        cp.cp(coo.withColumn("m1", F.lit(None).cast("int")), 1)


def test_tasks_share_passes(spark, small_blocks, monkeypatch):
    """All tasks and starts go through the tensor together and end as each would alone."""
    rng = np.random.default_rng(3)
    x = np.einsum("ar,br,cr->abc", *[rng.random((n, 2)) for n in (10, 3, 6)])
    coo, options = tensorize.from_numpy(spark, x), cp.CPOptions(60, 2, 3e-2)
    passes, fit = [], cp._fit_together
    monkeypatch.setattr(cp, "_fit_together", lambda tensor, keys, *rest: passes.append(len(keys)) or fit(tensor, keys, *rest))
    for engine in (rep.HalfHalf(3), rep.CrossValidation(3, 1)):
        small, large = (rep.evaluate(engine, coo, 2, options=options, task_bytes=b).collect() for b in (1 << 20, 0))
        assert sorted(tuple(r[:-1]) for r in small) == sorted(tuple(r[:-1]) for r in large)
        scores = [dict((tuple(map(str, r[:-1])), r["score"]) for r in rows) for rows in (small, large)]
        assert scores[0] == pytest.approx(scores[1], abs=1e-7)
    assert passes == [12, 6]
