"""Factor algebra over tables: scaling, Gram matrices, MTTKRP, update steps, congruence.

A factor is a table (idx, row) with the row of R numbers as an array; a tensor is a table
of coordinates m0.. and x, or its blocks (blocks.py), over which products are taken.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BlockedTensor, packed, unpacked

EPS = float(np.finfo(float).eps)


def scale_columns(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """values with `value` divided by the L2 norm over the rows that agree in `by`; NULL where that is 0."""
    norms = values.groupBy(*by).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm"))
    return values.join(norms, by).withColumn(value, F.try_divide(F.col(value), F.col("_norm"))).drop("_norm")


def to_long(factor: DataFrame, *keys: str) -> DataFrame:
    """keys, idx, r, value of a packed factor."""
    return factor.select(*keys, "idx", F.posexplode("row").alias("r", "value"))


def to_packed(long: DataFrame, rank: int, *keys: str) -> DataFrame:
    """keys, idx, row of a long factor (idx, r, value)."""
    cells = [F.max(F.when(F.col("r") == r, F.col("value"))) for r in range(rank)]
    return long.groupBy(*keys, "idx").agg(F.array(*cells).alias("row"))


def gram(factor: DataFrame, rank: int) -> DataFrame:
    """r, s, value: the products of a factor's columns with each other."""
    cells = [F.struct(F.lit(r).alias("r"), F.lit(s).alias("s"), F.sum(F.get("row", F.lit(r)) * F.get("row", F.lit(s))).alias("value")) for r in range(rank) for s in range(rank)]
    return factor.agg(F.array(*cells).alias("g")).select(F.inline("g"))


def gram_matrix(factor: DataFrame, rank: int) -> np.ndarray:
    """The Gram matrix on the driver: R x R numbers, whatever the factor's length."""
    out = np.zeros((rank, rank))
    for r, s, v in gram(factor, rank).collect():
        out[r, s] = v or 0.0
    return out


def mttkrp(tensor: BlockedTensor | DataFrame, factors: list[DataFrame], mode: int, rank: int) -> DataFrame:
    """idx, row: the tensor unfolded along mode times the Khatri-Rao product of the other factors; indices without cells are left out or 0.

    A table of coordinates is dealt into blocks first, which costs a shuffle of its cells;
    a tensor that is passed over often is better given as blocks.
    """
    blocked = tensor if isinstance(tensor, BlockedTensor) else BlockedTensor.build(tensor)
    product = blocked.product(_slices(blocked, factors, rank, mode), mode, rank)
    return unpacked(product, blocked.sides[mode], rank, 0, rank)


def _slices(blocked: BlockedTensor, factors: list[DataFrame], rank: int, but: int | None = None) -> list[DataFrame]:
    return [f if k == but else packed(f, n, s, rank) for k, (f, n, s) in enumerate(zip(factors, blocked.shape, blocked.sides))]


def mu_step(factor: DataFrame, product: DataFrame, others: np.ndarray) -> DataFrame:
    """idx, row: the factor after one multiplicative update with its MTTKRP and the Hadamard product of the other Grams.

    Indices without a cell in the tensor have an MTTKRP of 0.
    """
    rank = len(others)
    number = lambda v: f"CAST('{float(v)!r}' AS DOUBLE)"
    eps, cells = number(EPS), []
    for r in range(rank):
        dot = " + ".join(f"get(row, {k}) * {number(others[k, r])}" for k in range(rank))
        cells.append(f"get(row, {r}) * greatest(coalesce(get(product, {r}), CAST(0 AS DOUBLE)), {eps}) / greatest({dot}, {eps})")
    held = factor.join(product.select("idx", F.col("row").alias("product")), "idx", "left")
    return held.select("idx", F.expr(f"array({', '.join(cells)})").alias("row"))


def relative_error(norm2: float, product: DataFrame, last: DataFrame, grams: list[np.ndarray]) -> float:
    """Relative error from the last mode's MTTKRP: sqrt(|X|^2 + |Y|^2 - 2 <X, Y>) / |X|."""
    both = product.select("idx", F.col("row").alias("_m")).join(last, "idx")
    dot = F.aggregate(F.zip_with("_m", "row", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    inner = both.agg(F.sum(dot)).first()[0] or 0.0
    model = float(reduce(np.multiply, grams).sum())
    return float(np.sqrt(abs(norm2 + model - 2 * inner)) / np.sqrt(norm2)) if norm2 else 0.0


def reconstruct(tensor: BlockedTensor | DataFrame, factors: list[DataFrame]) -> DataFrame:
    """m0 ..., x and x_hat, the model's value at each of the tensor's cells."""
    blocked = tensor if isinstance(tensor, BlockedTensor) else BlockedTensor.build(tensor)
    rank = factors[0].select(F.size("row")).first()  # one row of a factor
    columns = rank[0] if rank else 0
    return blocked.reconstructed(_slices(blocked, factors, columns), columns)


def gram_cells(factor: DataFrame) -> DataFrame:
    """r, s, value: the Gram of a factor (idx, row) of any number of columns, added up cell by cell before the shuffle."""
    cells = factor.select("row", F.posexplode("row").alias("r", "_a")).select("r", "_a", F.posexplode("row").alias("s", "_b"))
    return cells.groupBy("r", "s").agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))


def congruence(a: DataFrame, b: DataFrame, keys: list[str], rank: int) -> DataFrame:
    """keys, cosines: for rows (keys, idx, row) of two models, the R x R cosines of their columns.

    Only indices that both have count, also for the norms. A column of norm 0 has cosine 0.
    """
    both = a.select(*keys, "idx", F.col("row").alias("_a")).join(b.select(*keys, "idx", F.col("row").alias("_b")), [*keys, "idx"])
    cell = lambda c, r: F.get(c, F.lit(r))
    sums = [F.sum(cell("_a", r) * cell("_b", s)).alias(f"ab{r}_{s}") for r in range(rank) for s in range(rank)]
    sums += [F.sum(cell(c, r) * cell(c, r)).alias(f"{c[1]}{r}") for c in ("_a", "_b") for r in range(rank)]
    out = both.groupBy(*keys).agg(*sums)
    cos = [F.coalesce(F.try_divide(F.col(f"ab{r}_{s}"), F.sqrt(F.col(f"a{r}") * F.col(f"b{s}"))), F.lit(0.0)) for r in range(rank) for s in range(rank)]
    return out.select(*keys, F.array(*cos).alias("cosines"))


def first_position(df: DataFrame, category: str, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """by, distinct categories and pos, their rank by first appearance in the stated order (within `by`)."""
    seen = df.groupBy(*by, category).agg(F.min(F.struct(*order)).alias("_at"))
    return seen.select(*by, category, (F.row_number().over(Window.partitionBy(*by).orderBy("_at")) - 1).alias("pos"))
