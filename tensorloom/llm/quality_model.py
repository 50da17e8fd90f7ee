"""Quality classifier: naive Bayes support vectors (NBSVM).

Indicators of byte n-grams, scaled by their class log-count ratios, feed a linear
classifier fitted with hinge loss by dual coordinate descent; its margin becomes a
probability by a fitted logistic curve. The model is fitted on a bounded, hash-chosen
sample of labelled rows (`per_class` of each class at most), is a vector of fixed size,
and then scores every whole text in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, map_batches, written

#: Labelled rows of each class that the model is fitted on, at most.
PER_CLASS = 2500
#: N-gram places of all rows that the model is fitted on, at most; rows go in by their hash until these are used up.
FIT_PLACES = 20_000_000
#: Byte pairs have places of their own, triples are hashed to as many places as these bits count.
TRIPLE_BITS = 18
#: Word pairs have one place for each share of pairs of a word with itself that a text reaches.
SAME_PAIRS = (0.02, 0.05, 0.1, 0.2, 0.4)
PLACES = (1 << 16) + (1 << TRIPLE_BITS) + len(SAME_PAIRS)
FOLDS = 5
THRESHOLD = 0.3


class Indicators:
    """The places of the n-grams that a text has, each once."""

    def __init__(self) -> None:
        self.seen = np.zeros(PLACES, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        words = raw.split()
        same = sum(map(eq, words, words[1:])) / (len(words) or 1)
        reached = [PLACES - 1 - k for k, share in enumerate(SAME_PAIRS) if same >= share]
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        pairs = (b[:-1] << 8) | b[1:]
        triples = ((pairs[:-1] << 8) | b[2:]) * np.uint32(2654435761)
        places = np.concatenate([pairs, (triples >> np.uint32(32 - TRIPLE_BITS)) + np.uint32(1 << 16), np.array(reached, np.uint32)])
        if len(places) < 4000:
            return np.unique(places)
        self.seen[places] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # log-count ratio of each place
    weight: np.ndarray  # of the scaled indicators
    bias: float
    slope: float  # of the logistic curve over the margin
    shift: float

    def margin(self, places: np.ndarray) -> float:
        scaled = self.ratio[places]
        norm = float(np.sqrt(scaled @ scaled))
        return self.bias + (float(scaled @ self.weight[places]) / norm if norm else 0.0)

    def score(self, places: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(places) + self.shift, -40, 40))))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 10.0, alpha: float = 1.0, beta: float = 0.75, epochs: int = 30, seed: int = 7) -> Model:
    """Fit on the indicators of labelled rows (labels 0 or 1).

    beta mixes each weight with their mean size, which keeps rare n-grams near naive
    Bayes. With no rows, or rows of one class, every score is that class's share
    (one half without rows).
    """
    zero = np.zeros(PLACES, np.float32)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1.0) / (len(labels) + 2.0)
        return Model(zero, zero, 0.0, 1.0, float(np.log(share / (1 - share))))
    counts = np.full((2, PLACES), alpha)
    for places, y in zip(rows, labels):
        counts[int(y)][places] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    ratio = np.log(counts[1] / counts[0])
    sign = np.where(labels > 0, 1.0, -1.0)
    scaled = [ratio[p] / max(1e-12, np.sqrt(ratio[p] @ ratio[p])) for p in rows]
    square = np.array([1.0 + x @ x for x in scaled])
    # the rarer class weighs as much as the other in all
    most = cost * len(rows) / 2.0 / np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum())
    weight, bias, dual = np.zeros(PLACES), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, p = scaled[i], rows[i]
            gradient = sign[i] * (x @ weight[p] + bias) - 1.0
            new = min(max(dual[i] - gradient / square[i], 0.0), most[i])
            if step := (new - dual[i]) * sign[i]:
                weight[p] += step * x
                bias += step
                moved = max(moved, abs(step))
                dual[i] = new
        if moved < 1e-3:
            break
    used = np.unique(np.concatenate(rows))
    mean = np.abs(weight[used]).mean()
    weight[used] = beta * weight[used] + (1 - beta) * mean
    margins = np.array([x @ weight[p] + bias for x, p in zip(scaled, rows)])
    slope, shift = _logistic(margins, labels.astype(float))
    return Model(ratio.astype(np.float32), weight.astype(np.float32), bias, slope, shift)


def _logistic(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with smoothed targets."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)])
    theta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -40, 40)))
        hess = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        theta = theta + np.clip(np.linalg.solve(hess, x @ (target - p)), -5, 5)
    return float(theta[0]), float(theta[1])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label is kept from training (a null identifier counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_places: int = FIT_PLACES) -> Model:
    """The model for the labels of rows that are not held out.

    Labels but 0 and 1 are passed over; an identifier with both labels is a row of each
    class. Of rows that repeat an identifier the one with the smallest hash of its text is
    learned from. A null text is empty. Without labelled rows every score is one half.
    Further columns of both tables, whatever their names, are not read.
    """
    usable = labels.filter(~held_out(id_col)).filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    chosen = [hash_sample(usable.filter(F.col("y") == y), per_class, "id") for y in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])  # at most 2 * per_class short rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Indicators()
        for b in batches:
            found = [places(t.as_py()).astype(np.int32) for t in b.column("text")]
            sizes = pa.array([len(f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), sizes, pa.array(found, pa.list_(pa.int32()))], ["h", "y", "size", "places"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    once = texts.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("id", "text").alias("h"), "text")).alias("s")).select("s.h", "y", "s.text")
    got = written(map_batches(once, run, "h long, y int, size long, places array<int>"), "quality-sample")
    order, used = got.select("h", "y", "size").orderBy("h", "y").collect(), 0  # at most 2 * per_class rows
    for row in order:
        used += row["size"]
        if used > fit_places:
            got = got.filter((F.col("h") < row["h"]) | ((F.col("h") == row["h"]) & (F.col("y") < row["y"])))
            break
    table = got.toArrow().sort_by([("h", "ascending"), ("y", "ascending")])  # the same model however rows arrive
    lists = table["places"].combine_chunks() if table.num_rows else []
    return fit([lists[k].values.to_numpy() for k in range(table.num_rows)], table["y"].to_numpy() if table.num_rows else np.zeros(0, int))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts get the score of the bias alone. Rows are scored each for itself;
    an empty table gives an empty result; no column but identifier and text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, m = Indicators(), shared.value
        for b in batches:
            scores = [m.score(places(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = map_batches(held, run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
