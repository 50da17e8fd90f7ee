"""Exact k-means of integer vectors by Shallot search.

Every vector remembers its nearest and its second-nearest centroid with a bound on the
distance to the first (upper) and to all others (lower). When centroids have moved, most
vectors are settled by their bounds. For the others both remembered centroids are
measured, the scan starts from the closer one and goes through its neighbours, nearest
first; it ends where the gap to the next neighbour exceeds the distance to the start plus
that to the second-nearest centroid so far, a ball that shrinks while the scan finds
closer ones. What the ball leaves is compared in whole numbers, so ties are exact.

A round is one pass without a shuffle of vectors: it reads vectors with their bounds,
writes them anew and, for each task, a row of what moved between centroids. k and the
number of components bound all that reaches the driver or goes out to tasks.

Vectors that are null, of another length, or with a null or non-finite component are left
out. Repeated rows are vectors of their own; a null identifier is one that never starts a
centroid while others can. With fewer vectors than k there are as many centroids as
vectors, an empty table gives an empty result. Components may be at most 2^27 in size
after scaling, so that squared distances are whole numbers of 64 bits; larger ones raise.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, settled_at
from .common import map_batches, written

DIM, SCALE, LIMIT = 64, 256, 1 << 27
BATCH_ROWS = 8192
#: Bounds are sums of rounded roots; each is widened by this share, far above what rounding can do.
SLACK = 1e-12

STATE = "vec_id {id}, v binary, near int, other int, upper double, lower double, moved array<bigint>"
FINAL = "vec_id {id}, cluster int, distance bigint"


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


class Shallot:
    """Centroids with their sorted neighbours, and the search among them."""

    def __init__(self, centres: np.ndarray, before: np.ndarray | None = None) -> None:
        self.centres, self.k = centres, len(centres)
        self.gaps = np.sqrt(np.stack([squared(centres, c) for c in centres]).astype(float))
        self.order = np.argsort(self.gaps, axis=1, kind="stable")
        apart = self.gaps + np.diag(np.full(self.k, np.inf))
        self.half = apart.min(axis=1) / 2 * (1 - SLACK)
        self.drift = np.zeros(self.k) if before is None else np.sqrt(squared(centres, before).astype(float))
        others = np.where(np.eye(self.k, dtype=bool), 0.0, self.drift[None, :])
        self.sunk = others.max(axis=1)
        self.measured = 0

    def nearest(self, x: np.ndarray, near: np.ndarray, other: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Brings near, other, upper and lower (all changed in place) of the vectors x up to these centroids."""
        upper += self.drift[near] + SLACK * (upper + self.drift[near])
        lower -= self.sunk[near] + SLACK * np.abs(lower) + SLACK * self.sunk[near]
        bound = np.maximum(lower, self.half[near])
        rows = np.flatnonzero(~(upper < bound))
        if self.k == 1 or not len(rows):
            return
        first = self._measure(x, rows, near[rows])
        upper[rows] = np.sqrt(first.astype(float)) * (1 + SLACK)
        loose = ~(upper[rows] < bound[rows])
        rows, first = rows[loose], first[loose]
        a, b = near[rows], other[rows]
        second = self._measure(x, rows, b)
        swap = (second < first) | ((second == first) & (b < a))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        first, second = np.where(swap, second, first), np.where(swap, first, second)
        for start in np.unique(a):
            self._scan(x, int(start), np.flatnonzero(a == start), rows, a, b, first, second)
        near[rows], other[rows] = a, b
        upper[rows] = np.sqrt(first.astype(float)) * (1 + SLACK)
        lower[rows] = np.sqrt(second.astype(float)) * (1 - SLACK)

    def _measure(self, x: np.ndarray, rows: np.ndarray, centres) -> np.ndarray:
        self.measured += len(rows)
        return squared(x[rows], self.centres[centres])

    def _scan(self, x, start: int, at: np.ndarray, rows, a, b, first, second) -> None:
        """Neighbours of a start, nearest first, while they lie in the ball; at: places in rows, a, b, first, second."""
        radius, remembered = np.sqrt(first[at].astype(float)), b[at].copy()
        for c in self.order[start]:
            if c == start:
                continue
            inside = self.gaps[start, c] <= (radius + np.sqrt(second[at].astype(float))) * (1 + SLACK)
            at, radius, remembered = at[inside], radius[inside], remembered[inside]
            if not len(at):
                return
            seen = remembered != c
            here = at[seen]
            d = self._measure(x, rows[here], np.full(len(here), c))
            closest = (d < first[here]) | ((d == first[here]) & (c < a[here]))
            closer = ~closest & ((d < second[here]) | ((d == second[here]) & (c < b[here])))
            won, next_ = here[closest], here[closer]
            b[won], second[won] = a[won], first[won]
            a[won], first[won] = c, d[closest]
            b[next_], second[next_] = c, d[closer]


def scaled(values: np.ndarray, dim: int) -> np.ndarray:
    """Rows of floor(SCALE * x) as whole numbers."""
    x = np.floor(values.astype(float) * SCALE).reshape(-1, dim)
    if len(x) and np.abs(x).max() > LIMIT:
        raise ValueError(f"components above {LIMIT} after scaling: squared distances would pass 64 bits")
    return x.astype(np.int64)


def kept_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = DIM) -> DataFrame:
    """vec_id, v: the rows that are clustered."""
    v = F.col(embedding).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).where((F.size("v") == dim) & F.coalesce(whole, F.lit(False)))


def start_centres(held: DataFrame, k: int, dim: int = DIM) -> np.ndarray:
    """The k vectors with the smallest sha256 of `2:<vec_id>`, rows of one identifier by their components."""
    place = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = held.orderBy(place.asc_nulls_last(), F.transform("v", lambda x: F.floor(x * SCALE))).limit(k).collect()  # k rows
    return scaled(np.array([r["v"] for r in rows], dtype=float), dim)


def _vectors(b: pa.RecordBatch, dim: int) -> np.ndarray:
    column = b.column("v")
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)
    return scaled(column.flatten().to_numpy(zero_copy_only=False), dim)


def _state(b: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """near, other, upper, lower of a batch; of a first round bounds that settle nothing."""
    if "near" in b.schema.names:
        return [b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("near", "other", "upper", "lower")]
    n = b.num_rows
    return [np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32), np.full(n, np.inf), np.full(n, -np.inf)]


def _round(rows: DataFrame, centres: np.ndarray, before: np.ndarray | None, kind: str) -> DataFrame:
    """STATE rows after one assignment; a row without a vector holds what a task's vectors moved: k x (dim + 1) sums and counts."""
    k, dim = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, moved, ids, schema = Shallot(centres, before), np.zeros((k, dim + 1), np.int64), None, None
        for b in batches:
            x, state = _vectors(b, dim), _state(b, k)
            was, fresh = state[0].copy(), "near" not in b.schema.names
            search.nearest(x, *state)
            new = state[0]
            changed = np.ones(len(x), bool) if fresh else was != new
            for c in np.unique(new[changed]):
                moved[c] += [*x[changed & (new == c)].sum(axis=0), (changed & (new == c)).sum()]
            for c in np.unique(was[changed]) if not fresh else ():
                moved[c] -= [*x[changed & (was == c)].sum(axis=0), (changed & (was == c)).sum()]
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (4 * dim)).buffers()[1]
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, ends, pa.py_buffer(x.astype("<i4").tobytes())])
            out = [b.column("vec_id"), packed, *[pa.array(s) for s in state], pa.nulls(len(x), pa.list_(pa.int64()))]
            ids, batch = b.column("vec_id").type, pa.RecordBatch.from_arrays(out, ["vec_id", "v", "near", "other", "upper", "lower", "moved"])
            schema = batch.schema
            yield batch
        if schema is not None:
            yield pa.RecordBatch.from_pylist([{"moved": moved.reshape(-1).tolist()}], schema)

    return map_batches(rows, run, STATE.format(id=kind), BATCH_ROWS)


def _moved(state: DataFrame, k: int, dim: int) -> list[list[int]]:
    """The tasks' sums, added up cell by cell: k rows of dim sums and a count, exact."""
    cells = state.where("v IS NULL").select(F.posexplode("moved").alias("cell", "n"))
    total = {r[0]: int(r[1]) for r in cells.groupBy("cell").agg(F.sum(F.col("n").cast("decimal(38,0)"))).collect()}  # k x (dim + 1) cells
    return [[total.get(c * (dim + 1) + j, 0) for j in range(dim + 1)] for c in range(k)]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    `rounds` rounds of assignment and exact means (floor of sum by count; an empty cluster
    keeps its centroid), then one more assignment. Ties go to the smaller number.
    """
    spark = vectors.sparkSession
    held = kept_vectors(vectors, vec_id, embedding, dim)
    kind = held.schema["vec_id"].dataType.simpleString()
    centres, before, rows, path = start_centres(held, k, dim), None, held, None
    k = len(centres)
    if not k:
        empty = spark.createDataFrame([], FINAL.format(id=kind))
        return _with_clusters(empty, np.zeros((0, dim), np.int64))
    sums = [[0] * (dim + 1) for _ in range(k)]
    for _ in range(rounds):
        new_path, state = settled_at(_round(rows, centres, before, kind), "clusters")
        if path:
            forget(spark, path)
        path, rows = new_path, state.where("v IS NOT NULL").drop("moved")
        sums = [[a + b for a, b in zip(old, new)] for old, new in zip(sums, _moved(state, k, dim))]
        before, centres = centres, np.array([[s // row[-1] for s in row[:-1]] if row[-1] else list(c) for row, c in zip(sums, centres.tolist())], np.int64)
    last = _assigned(rows, centres, before, kind)
    done = written(last, "clustered")
    if path:
        forget(spark, path)
    return _with_clusters(done, centres)


def _assigned(rows: DataFrame, centres: np.ndarray, before: np.ndarray | None, kind: str) -> DataFrame:
    """FINAL rows: the nearest centroid and its exact squared distance."""
    k, dim = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Shallot(centres, before)
        for b in batches:
            x, state = _vectors(b, dim), _state(b, k)
            search.nearest(x, *state)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(state[0]), pa.array(squared(x, centres[state[0]]))], ["vec_id", "cluster", "distance"])

    return map_batches(rows, run, FINAL.format(id=kind), BATCH_ROWS)


def _with_clusters(done: DataFrame, centres: np.ndarray) -> DataFrame:
    """done with what its clusters share: k rows are sent out."""
    own = dict(tuple(r) for r in done.groupBy("cluster").agg(F.sum("distance")).collect())  # k rows
    named = [(c, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centres.tolist()) if c in own]
    shared = done.sparkSession.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return done.join(F.broadcast(shared), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
