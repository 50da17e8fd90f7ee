"""Clustering against plain rounds in whole numbers, and its edge cases."""

import hashlib
import math

import numpy as np
import pytest
from conftest import same_as_sql

from tensorloom.llm import clustering, oracles
from tensorloom.llm.queries import op11_kmeans

SCHEMA = "vec_id long, embedding array<double>, cluster string, v string"


def plain(rows, k, rounds, dim):
    """{(id, vector): (cluster, distance)} and centroids by comparing all with all."""
    kept = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in order[:k]]
    best = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        found = [best(v)[1] for _, v in kept]
        for j in range(len(centres)):
            if own := [v for (_, v), f in zip(kept, found) if f == j]:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((str(i), *best(v)[::-1]) for i, v in kept), centres


def found(df):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in df.collect())


def test_table(spark, data, duck):
    same_as_sql(op11_kmeans(spark, data), duck, oracles.oracle_sql()["op11_kmeans"])


@pytest.mark.parametrize("seed", range(4))
def test_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    dim, k = 3, 7
    grid = rng.integers(-2, 3, (120, dim)) / (256.0 if seed % 2 else 4.0)  # many ties and repeats
    rows = [(int(i // 2), [float(x) for x in v]) for i, v in enumerate(grid)]
    df = clustering.cluster(spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(5), k, 5, dim=dim)
    expected, centres = plain(rows, k, 5, dim)
    assert found(df) == expected
    digests = {r["cluster"]: r["centroid_sha256"] for r in df.collect()}
    assert digests == {c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest() for c in digests}
    own = {c: sum(d for _, j, d in expected if j == c) for c in digests}
    assert {(r["cluster"], r["cluster_inertia"], r["inertia"]) for r in df.collect()} == {(c, n, sum(own.values())) for c, n in own.items()}


def test_search_leaves_work_out():
    """Bounds and balls give what measuring all gives, with fewer distances, over centroids that move."""
    rng = np.random.default_rng(5)
    heart = rng.integers(-3000, 3000, (20, 4))
    x = (heart[rng.integers(0, 20, 3000)] + rng.integers(-60, 60, (3000, 4))).astype(np.int64)
    centres, before = x[:20].copy(), None
    near, other, upper, lower = np.zeros(3000, np.int32), np.ones(3000, np.int32), np.full(3000, np.inf), np.full(3000, -np.inf)
    for _ in range(8):
        search = clustering.Shallot(centres, before)
        search.nearest(x, near, other, upper, lower)
        d = np.stack([clustering.squared(x, c) for c in centres], axis=1)
        assert (near == d.argmin(axis=1)).all()
        root = np.sqrt(d.astype(float))
        assert (upper >= root[np.arange(3000), near]).all()
        root[np.arange(3000), near] = np.inf
        assert (lower <= root.min(axis=1)).all()
        before = centres
        centres = np.array([x[near == c].sum(axis=0) // max(1, (near == c).sum()) if (near == c).any() else centres[c] for c in range(20)])
    assert search.measured < 0.2 * 20 * 3000


def test_edges(spark):
    rows = [(None, [1.0, 2.0]), (1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 0.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, [-0.001, 5.0])]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    assert found(clustering.cluster(df, 40, 5, dim=2)) == plain(rows, 40, 5, 2)[0]
    assert found(clustering.cluster(df, 1, 5, dim=2)) == plain(rows, 1, 5, 2)[0]
    assert found(clustering.cluster(df, 2, 0, dim=2)) == plain(rows, 2, 0, 2)[0]
    empty = clustering.cluster(df.limit(0), 40, 5, dim=2)
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "cluster", "distance"]
    with pytest.raises(Exception, match="64 bits"):
        clustering.cluster(spark.createDataFrame([(1, [1e9, 0.0], "a", "b")], SCHEMA), 2, 1, dim=2)
