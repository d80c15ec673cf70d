"""Exact decimal arithmetic.

Money stays DECIMAL from the adapter to the output.  Averages and ratios are
formed as ``sum / count`` (or ``a / b``) on decimals whose result keeps at
least 16 fractional digits, then rounded HALF_UP once to the output scale, so
a value never goes through a binary double and is not rounded twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_dec(c: Column | str, scale: int = 2, precision: int = 18) -> Column:
    """Cast to DECIMAL(precision, scale)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(f"decimal({precision},{scale})")


def money(c: Column | str, scale: int = 2) -> Column:
    """Round HALF_UP to ``scale`` and type as DECIMAL(38, scale): a total over
    the whole target size does not fit 18 digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, scale).cast(f"decimal(38,{scale})")


def div_round(num: Column | str, den: Column | str, scale: int = 2,
              factor: int = 1, in_scale: int = 4) -> Column:
    """``round(num * factor / den, scale)`` exactly; NULL when den is 0 or NULL.

    Both sides are typed DECIMAL(18 + in_scale, in_scale) first (``in_scale``
    must cover the inputs' fractional digits), so Spark's division keeps at
    least 14 fractional digits before the single HALF_UP rounding.
    """
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    t = f"decimal({18 + in_scale},{in_scale})"
    n = num.cast(t)
    if factor != 1:
        n = (n * F.lit(factor)).cast(t)
    d = F.nullif(den.cast(t), F.lit(0).cast(t))
    return F.round(n / d, scale).cast(f"decimal(18,{scale})")


def avg_exact(c: Column | str, scale: int = 2) -> Column:
    """Aggregate: HALF_UP-rounded exact mean of a decimal or integer column."""
    c = F.col(c) if isinstance(c, str) else c
    # DECIMAL(28,6) / BIGINT keeps 16 fractional digits in Spark's division.
    s = F.sum(c).cast("decimal(28,6)")
    n = F.nullif(F.count(c), F.lit(0))
    return F.round(s / n, scale).cast(f"decimal(18,{scale})")
