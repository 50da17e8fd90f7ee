"""The way from the long table to a tensor."""

import numpy as np
import pytest

from tensorloom.operators import tensorize

SCHEMA = "labels double, values double, subject string, time_point int, g string, n int, ord int"
NAN = float("nan")


def table(spark, rows):
    return spark.createDataFrame([(*r[:4], *(r[4:6] if len(r) > 5 else ("x", 1)), k) for k, r in enumerate(rows)], SCHEMA)


def full(skip=()):
    return [(float(l), 100.0 * s + 10 * t + l, f"s{s}", t) for s in (1, 2) for t in (1, 2) for l in (3, 1, 2) if (s, t, l) not in skip]


def test_complete(spark):
    x, s, t, l = tensorize.prepare_tensor(table(spark, full())).to_numpy()
    assert x.shape == (2, 2, 3) and list(s) == ["s1", "s2"] and list(t) == [1, 2] and list(l) == [1, 2, 3]
    assert x[1, 0, 2] == 213.0 and not np.isnan(x).any()


def test_label_hole_drops_the_label(spark):
    rows = [(l, NAN if (s, t, l) == ("s1", 1, 2.0) else v, s, t) for l, v, s, t in full()]
    assert list(tensorize.prepare_tensor(table(spark, rows)).to_numpy()[3]) == [1, 3]


def test_ragged_panel(spark):
    rows = [r for r in full() if (r[2], r[3]) != ("s2", 2)]
    with pytest.raises(ValueError):
        tensorize.prepare_tensor(table(spark, rows))
    assert list(tensorize.prepare_tensor(table(spark, rows), incomplete="drop").to_numpy()[1]) == ["s1"]


def test_ragged_without_a_label_is_empty(spark):
    rows = [(1.0, 1.0, "a", 1), (2.0, 1.0, "a", 2), (1.0, 1.0, "b", 1)]
    assert tensorize.prepare_tensor(table(spark, rows)).to_numpy()[0].size == 0


def test_first_known_value_in_order(spark):
    rows = [(1.0, NAN, "a", 1), (1.0, 5.0, "a", 1), (1.0, 6.0, "a", 1), (1.0, 7.0, None, 1)]
    assert tensorize.prepare_tensor(table(spark, rows)).to_numpy()[0].tolist() == [[[5.0]]]


def test_group_filter(spark):
    rows = [(1.0, 1.0, "a", 1, "x", 1), (1.0, 2.0, "b", 1, "y", 1)]
    get = lambda f: tensorize.prepare_tensor(table(spark, rows), f).to_numpy()
    assert list(get(("g", "y"))[1]) == ["b"]
    assert get(("g", "z"))[0].size == 0 and get(("n", "1"))[0].size == 0
    with pytest.raises(ValueError):
        get(("no", "x"))


def test_gather(spark):
    x = np.arange(24.0).reshape(4, 3, 2)
    tasks = spark.createDataFrame([(0, 3), (1, 1)], "pos int, sample_idx int")
    got = tensorize.gather_rows(tensorize.from_numpy(spark, x), tasks).toPandas()
    out = np.zeros((2, 3, 2))
    out[got.m0, got.m1, got.m2] = got.x
    assert (out == x[[3, 1]]).all()
