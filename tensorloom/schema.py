"""Schemas of the engine's tables, and the edge between NaN and NULL.

Inside the engine a missing value is NULL; NaN is accepted on the way in and never
produced on the way out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "ints": T.ArrayType(T.IntegerType()), "doubles": T.ArrayType(T.DoubleType())}


def _table(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in columns.items()])


VOXELS = _table(volume_id="string", i="int", j="int", k="int", value="double")
VOLUMES = _table(volume_id="string", dim="ints", affine="doubles")
MANIFEST = _table(
    subject="string", time_point="int", baseline_path="string", post_injection_path="string", signal_type="string", mask_path="string", segmentation_path="string"
)
LONG = _table(labels="double", values="double", subject="string", time_point="int")
COO = _table(m0="int", m1="int", m2="int", x="double")
FACTORS = _table(task="string", seed="int", mode="int", idx="int", row="doubles")
FITS = _table(task="string", seed="int", status="string", n_iter="int", error="double")


class ConvergenceError(Exception):
    """No start of a decomposition was accepted."""


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or a ValueError that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def known(value: Column) -> Column:
    """value as a double with NaN as NULL."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)
