"""Text standardisation (C1) and status canonicalisation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Raw status text (Japanese and English) -> canonical status.
STATUS_MAP = {
    "完了": "completed",
    "発送済み": "shipped",
    "処理中": "processing",
    "キャンセル": "cancelled",
    "配送完了": "delivered",
    "completed": "completed",
    "shipped": "shipped",
    "processing": "processing",
    "cancelled": "cancelled",
    "delivered": "delivered",
}

_CASES = {
    "lower": lambda c: F.lower(F.trim(c)),
    "upper": lambda c: F.upper(F.trim(c)),
    "trim": F.trim,
}


def standardize(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``{"email": "lower", "customer_segment": "upper", "brand": "trim"}``."""
    return df.withColumns({c: _CASES[how](F.col(c)) for c, how in rules.items()})


def canonical_status(df: DataFrame, col: str, mapping: dict | None = None) -> DataFrame:
    """Map status text through a literal map; unknown text is kept lowered.

    The map is a ``create_map`` literal, so this is a projection inside the
    scan's codegen stage: no join, no shuffle.
    """
    mapping = mapping or STATUS_MAP
    m = F.create_map(*[F.lit(x) for x in chain(*mapping.items())])
    key = F.lower(F.trim(F.col(col)))
    return df.withColumn(col, F.coalesce(m[key], key))
