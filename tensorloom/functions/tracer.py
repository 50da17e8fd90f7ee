"""Scalar expressions: tracer signals, label tests, grid alignment, significance stars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import known

#: Magnitude below which a signal counts as zero.
TINY = 1e-6
SIGNALS = ("T1map", "T1w")


def tracer(baseline: Column, post: Column, signal_type: str) -> Column:
    """Tracer signal of a voxel, NULL where it is undefined.

    T1map: 1/post - 1/baseline, undefined where either is tiny. T1w: post/baseline,
    undefined where the baseline is tiny (a post of 0 gives 0). Missing operands (NULL or
    NaN) give NULL.
    """
    baseline, post = known(baseline), known(post)
    if signal_type == "T1map":
        return F.when((F.abs(post) >= TINY) & (F.abs(baseline) >= TINY), 1.0 / post - 1.0 / baseline)
    if signal_type == "T1w":
        return F.when(F.abs(baseline) >= TINY, post / baseline)
    raise ValueError(f"signal_type must be one of {SIGNALS}, not {signal_type!r}")


def valid_label(label: Column) -> Column:
    """A region label counts if it is a number above TINY (NaN sorts above all numbers in Spark)."""
    return F.coalesce(known(label) > TINY, F.lit(False))


def aligned(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether arrays agree element by element: |a - b| <= atol + rtol |b|; False for other lengths."""
    near = F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False)))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda ok: ok)


def stars(p: Column) -> Column:
    """Significance text of a p-value."""
    out = F.when(p.isNull(), None)
    for limit, text in ((1e-4, "****"), (1e-3, "***"), (1e-2, "**"), (0.05, "*")):
        out = out.when(p <= limit, text)
    return out.otherwise("ns")


def one_digit(x: Column) -> Column:
    """The text of a number >= 0 to one significant digit, as %.1g gives it (ties of the digit go up)."""
    text = F.format_string("%.0e", x)
    digit, power = F.substring(text, 1, 1), F.substring_index(text, "e", -1).cast("int")
    plain = F.when(power == 0, digit).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digit))
    return F.when(x.isNotNull(), F.when((power < -4) | (power > 0), text).otherwise(plain))


def fit_text(r2: Column, p: Column) -> Column:
    """The legend of a regression line; NULL without a test."""
    return F.when(r2.isNotNull() & p.isNotNull(), F.concat(F.format_string("$R^2=%.2f$, $p=", r2), one_digit(p), F.lit(" $")))


def rot90(a: Column, b: Column, height: int, width: int, flip: bool = False) -> tuple[Column, Column]:
    """Where pixel (a, b) of a height x width slice goes under a quarter turn (then mirrored if flip)."""
    return (F.lit(width - 1) - b).cast("int"), ((F.lit(height - 1) - a) if flip else a).cast("int")
