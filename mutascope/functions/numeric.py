"""Numeric helpers: exact means of 6-dp values with half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000


def to_micro(c: Column) -> Column:
    """A value already rounded to 6 dp as an exact integer count of 1e-6."""
    return F.rint(c * F.lit(float(MICRO))).cast("long")


def half_even_div(num: Column, den: Column) -> Column:
    """Integer ``num / den`` rounded half-to-even, exactly (``den`` > 0)."""
    r = F.pmod(num, den)
    q = ((num - r) / den).cast("long")        # exact: num - r is a multiple of den
    twice = r * F.lit(2)
    up = (twice > den) | ((twice == den) & (F.pmod(q, F.lit(2)) == 1))
    return q + F.when(up, F.lit(1)).otherwise(F.lit(0))


def mean6(sum_micro: Column, n: Column) -> Column:
    """Mean of 6-dp values given their micro-unit sum, rounded half-even to 6 dp.

    Exact (integer) arithmetic, so the result does not depend on summation
    order, partitioning or engine.
    """
    return F.when(n > 0, half_even_div(sum_micro, n.cast("long")).cast("double") / F.lit(float(MICRO)))


def half_even_div_sql(num: str, den: str) -> str:
    r = f"((({num}) % ({den}) + ({den})) % ({den}))"
    q = f"((({num}) - {r}) // ({den}))"
    return (f"({q} + CASE WHEN 2 * {r} > ({den}) OR (2 * {r} = ({den}) AND "
            f"(({q}) % 2 + 2) % 2 = 1) THEN 1 ELSE 0 END)")


def mean6_sql(sum_micro: str, n: str) -> str:
    return f"(CAST({half_even_div_sql(sum_micro, n)} AS DOUBLE) / CAST({MICRO} AS DOUBLE))"


def to_micro_sql(x: str) -> str:
    return f"CAST(round(({x}) * CAST({MICRO} AS DOUBLE)) AS BIGINT)"
