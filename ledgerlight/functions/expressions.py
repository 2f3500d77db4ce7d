"""Column expressions shared by every operator.

All of them stay inside Catalyst: no Python runs per row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LN2 = math.log(2.0)
PROBABILITY_FLOOR = 1e-6


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0; an unknown condition counts as 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def share_where(condition: Column) -> Column:
    """Share of *all* rows of the group for which the condition holds."""
    return F.count_if(condition) / F.count(F.lit(1))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is NULL for a zero or NULL denominator (ANSI-safe)."""
    return numerator / F.nullif(denominator, F.lit(0))


def positive_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient defined only for a denominator above zero."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double"))


def floor_zero(value: Column) -> Column:
    """``value`` clamped below at zero; NULL becomes zero because ``greatest`` skips NULLs."""
    return F.greatest(value, F.lit(0))


def half_life(age: Column, period: float) -> Column:
    """Weight that halves every ``period`` units of age."""
    return F.exp(F.lit(-LN2) * age / F.lit(float(period)))


def finite_or_null(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating columns."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.col(name).isNull() | F.isnan(name)
    return F.col(name).isNull()


def missing_count(df: DataFrame, names: Iterable[str]) -> Column:
    parts = [is_missing(df, name).cast("int") for name in names]
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0)


def clip_probability(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1.0 - PROBABILITY_FLOOR)), F.lit(PROBABILITY_FLOOR))


def logit(p: Column) -> Column:
    clipped = clip_probability(p)
    return F.log(clipped / (F.lit(1.0) - clipped))


def log_loss_term(target: Column, p: Column) -> Column:
    clipped = clip_probability(p)
    return -F.when(target == 1, F.log(clipped)).otherwise(F.log(F.lit(1.0) - clipped))


def credit_score(p: Column) -> Column:
    """Points scale: 600 at odds 50:1, 20 points per doubling, half-even rounding, 300-850."""
    points = F.bround(F.lit(600.0) + F.lit(20.0) * F.log2((F.lit(1.0) - p) / p / F.lit(50.0)), 0)
    return F.greatest(F.lit(300), F.least(F.lit(850), points.cast("int")))


# Upper edges (exclusive) of the risk grades.
GRADE_EDGES = (("A", 0.02), ("B", 0.05), ("C", 0.10), ("D", 0.20))


def ladder(value: Column, steps: Sequence[tuple[str, float]], last: str, inclusive: bool = False) -> Column:
    """First label whose upper edge is above ``value`` (or equal to it when ``inclusive``)."""
    out = None
    for label, edge in steps:
        test = value <= edge if inclusive else value < edge
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(last)


def risk_grade(p: Column) -> Column:
    return ladder(p, GRADE_EDGES, "E")


def right_closed_band(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins ``(edges[i], edges[i+1]]``; a value outside every bin gives NULL."""
    out = F.when(value <= edges[0], F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels, strict=True):
        out = out.when(value <= upper, label)
    return out


def poisson_one(u: Column, top: int = 18) -> Column:
    """Poisson(1) draw from a uniform number by inverting the distribution function.

    Beyond ``top`` nothing is left of it in double precision.
    """
    total, out = 0.0, None
    for k in range(top):
        total += math.exp(-1.0) / math.factorial(k)
        out = F.when(u < total, k) if out is None else out.when(u < total, k)
    return out.otherwise(top)


def uniform_hash(*parts: Column) -> Column:
    """Reproducible number in [0, 1) from the md5 of the parts (48 bits)."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def tidy(value: Column, digits: int = 6) -> Column:
    """Presentation rounding, the same for all sizes.  The half-way point sits a little below one half, so a mean
    that lands exactly on it does not flip with the order of addition.
    """
    scale = float(10**digits)
    return F.rint(value * F.lit(scale) + F.lit(0.0001)) / F.lit(scale)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Presentation helper: bigint / double columns only, doubles rounded as in :func:`tidy`."""
    scale = f"{10**digits}.0D"
    out = []
    for field in df.schema.fields:
        c = f"`{field.name}`"
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            v = c if isinstance(field.dataType, T.DoubleType) else f"CAST({c} AS DOUBLE)"
            c = f"rint({v} * {scale} + 0.0001D) / {scale} AS {c}"
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = f"CAST({c} AS BIGINT) AS {c}"
        out.append(c)
    return df.selectExpr(*out)
