"""Date parsing (C6) and date parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The order-date formats found in the raw order files, in the
# order they are tried.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MMM d yyyy HH:mm",
)


def parse_dates(df: DataFrame, col: str, formats=DATE_FORMATS,
                out: str | None = None) -> DataFrame:
    """A column as TIMESTAMP_NTZ, from text in mixed formats or from a
    date or timestamp.

    Each format is tried with ``try_to_timestamp`` (NULL instead of an error
    under ANSI mode); the first that parses wins.
    """
    dtype = dict(df.dtypes).get(col, "string")
    if dtype != "string":
        return df.withColumn(out or col, F.col(col).cast("timestamp_ntz"))
    c = F.trim(F.col(col))
    parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])
    return df.withColumn(out or col, parsed.cast("timestamp_ntz"))


def known_date(c: Column, formats=DATE_FORMATS) -> Column:
    """Whether there is a date; for text, one that :func:`parse_dates` reads."""
    text = F.trim(c.cast("string"))
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    return F.when(F.typeof(c) == "string", parsed.isNotNull()).otherwise(c.isNotNull())


def add_date_parts(df: DataFrame, col: str, prefix: str = "order_") -> DataFrame:
    """Year, month, day and the ``yyyy-MM`` period of a date column."""
    c = F.col(col)
    return df.withColumns({
        f"{prefix}year": F.year(c),
        f"{prefix}month": F.month(c),
        f"{prefix}day": F.dayofmonth(c),
        f"{prefix}period": F.date_format(c, "yyyy-MM"),
    })


def month_index(c: Column) -> Column:
    """Months since year 0: difference of two gives whole months between dates."""
    return F.year(c) * 12 + F.month(c) - 1


def ts_lit(x) -> Column:
    """A TIMESTAMP_NTZ literal from a datetime (or ISO text), free of the
    Python process's local time zone."""
    if isinstance(x, Column):
        return x
    text = x.isoformat(sep=" ") if hasattr(x, "isoformat") else str(x)
    return F.lit(text).cast("timestamp_ntz")
