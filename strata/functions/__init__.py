"""Column-level helpers: exact decimal arithmetic, dates, text, row rules."""

from strata.functions.numeric import avg_exact, div_round, money, to_dec
from strata.functions.dates import add_date_parts, parse_dates, DATE_FORMATS
from strata.functions.text import canonical_status, standardize, STATUS_MAP

__all__ = [
    "avg_exact", "div_round", "money", "to_dec",
    "add_date_parts", "parse_dates", "DATE_FORMATS",
    "canonical_status", "standardize", "STATUS_MAP",
]
