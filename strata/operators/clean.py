"""Clean layer: projections, casts, filters and row rules.

Two cleaning profiles exist because the two mart families were specified
with different rules:

* ``profile="a"`` (marts M1-M3): trim / case text, canonical status, drop
  rows with NULL keys, ``quantity > 0``; add order date parts.
* ``profile="b"`` (marts M4-M7): drop exact duplicate rows first, then keep
  ``price > 0``, ``total_amount > 0``, ``unit_price > 0`` and derive
  ``line_total``.

All are narrow transformations (no shuffle) except ``dedupe``.  With
``order_tasks`` orders and their lines lose their copies in that many parts by
order, so that they can be written in these parts and joined without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.dates import add_date_parts, known_date, parse_dates
from strata.functions.text import canonical_status, standardize

# ---------------------------------------------------------------- C1-C4


def cast_to(df: DataFrame, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Project to ``schema`` and cast each column.

    With ``strict=False`` dirty values become NULL (``try_cast``) instead of
    failing the job under ANSI mode.
    """
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        cols.append((c.cast(f.dataType) if strict else c.try_cast(f.dataType)).alias(f.name))
    return df.select(*cols)


def not_null(*names: str) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).isNotNull()
    return cond


def dedupe(df: DataFrame, keys: list[str] | None = None, near: str | None = None, tasks: int | None = None) -> DataFrame:
    """C4: drop exact duplicate rows (or duplicates on ``keys``).

    One shuffle on the row (or key) hash with map-side partial dedupe, so a
    heavily duplicated row collapses before it is shuffled.  With ``near``, a
    key that few different rows share, rows are shuffled by it instead: equal
    rows meet as well, and a join on the key needs no shuffle of its own; to
    ``tasks`` parts, where their number must be known.
    """
    if near:
        df = df.repartition(tasks, near) if tasks else df.repartition(near)
    return df.dropDuplicates(keys) if keys else df.dropDuplicates()


def clean_customers(df: DataFrame, profile: str = "a", segment_case: str = "upper") -> DataFrame:
    if profile == "b":
        df = dedupe(df.where(not_null("customer_id")), near="customer_id")
        df = standardize(df, {"customer_name": "upper", "email": "lower", "phone": "trim",
                              "address": "trim", "city": "trim", "state": "trim",
                              "country": "trim", "customer_segment": "trim"})
    else:
        df = standardize(df, {"email": "lower", "customer_segment": segment_case})
    return df.where(not_null("customer_id"))


def clean_orders(df: DataFrame, profile: str = "a", order_tasks: int | None = None) -> DataFrame:
    if profile == "b":
        df = dedupe(df.where(not_null("order_id", "customer_id") & (F.col("total_amount") > 0)), near="order_id", tasks=order_tasks)
        if dict(df.dtypes)["order_date"] == "string":
            df = parse_dates(df, "order_date")
        return canonical_status(df, "order_status")
    df = canonical_status(df, "order_status")
    df = standardize(df, {"payment_method": "lower", "currency": "upper"})
    df = df.where(not_null("order_id", "customer_id"))
    if dict(df.dtypes)["order_date"] == "string":  # raw files: mixed formats
        df = parse_dates(df, "order_date")
    return add_date_parts(df, "order_date")


def line_total(df: DataFrame) -> DataFrame:
    """``quantity * unit_price * (1 - discount)``, exact DECIMAL."""
    lt = F.col("quantity") * F.col("unit_price") * (F.lit(1) - F.col("discount"))
    return df.withColumn("line_total", lt.cast("decimal(38,6)"))


def clean_order_items(df: DataFrame, profile: str = "a", order_tasks: int | None = None) -> DataFrame:
    if profile == "b":
        valid = not_null("order_id", "product_id") & (F.col("quantity") > 0) & (F.col("unit_price") > 0)
        df = dedupe(df.where(valid), near="order_id", tasks=order_tasks) if order_tasks else dedupe(df).where(valid)
        return line_total(df)
    df = canonical_status(df, "item_status")
    return df.where(not_null("order_id", "product_id") & (F.col("quantity") > 0))


def clean_products(df: DataFrame, profile: str = "a") -> DataFrame:
    if profile == "b":
        df = dedupe(df.where(not_null("product_id") & (F.col("price") > 0)), near="product_id")
        df = standardize(df, {"product_name": "trim", "category": "trim", "subcategory": "trim",
                              "supplier": "trim"})
        return df
    df = standardize(df, {"category": "trim", "subcategory": "trim", "brand": "trim"})
    return df.where(not_null("product_id"))


class CleanTables(Mapping):
    """The four cleaned commerce tables, each built on first access only, so
    a query that touches two tables does not pay to analyse four plans."""

    _NAMES = ("customers", "orders", "order_items", "products")

    def __init__(self, t, profile: str = "a", order_tasks: int | None = None):
        self._t, self._profile, self._order_tasks, self._memo = t, profile, order_tasks, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._memo:
            t, p = self._t, self._profile
            if name == "customers":
                df = clean_customers(t.customers, p)
            elif name == "orders":
                df = clean_orders(t.orders, p, self._order_tasks)
            elif name == "order_items":
                df = clean_order_items(t.priced_items if p == "b" else t.order_items, p, self._order_tasks)
            elif name == "products":
                df = clean_products(t.products, p)
            else:
                raise KeyError(name)
            self._memo[name] = df
        return self._memo[name]

    def __iter__(self):
        return iter(self._NAMES)

    def __len__(self):
        return len(self._NAMES)


def clean_all(t, profile: str = "a", order_tasks: int | None = None) -> CleanTables:
    """Clean the four commerce tables of a :class:`~strata.sources.adapters.Tables`."""
    return CleanTables(t, profile, order_tasks)


# ---------------------------------------------------------------- C8


def fill_measures(df: DataFrame, cols: list[str], value=0) -> DataFrame:
    """NULL measures -> 0 after an outer join.

    An integer literal widens to the column's own type under coalesce (BIGINT
    stays BIGINT, DECIMAL(p,s) stays DECIMAL(p,s)), so no schema lookup is
    needed here.
    """
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in cols})


# ---------------------------------------------------------------- C6 / C9 re-exported

normalize_dates = parse_dates
canonical = canonical_status

# ---------------------------------------------------------------- C10-C12

# The e-mail shape rule.
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def email_rule(col: str = "email") -> tuple[str, Column]:
    """C11: rule (name, passes) that an e-mail column has a valid shape."""
    return ("bad_email", F.coalesce(F.col(col).rlike(EMAIL_PATTERN), F.lit(False)))


def date_rule(col: str = "order_date") -> tuple[str, Column]:
    """Rule that a date is there and, as text, has a known format: what
    ``parse_dates`` would turn into NULL is rejected by name."""
    return (f"bad_{col}", known_date(F.col(col)))


def default_rules(table: str) -> list[tuple[str, Column]]:
    """Row rules per table: the clean filters, named, plus the e-mail shape."""
    if table == "customers":
        return [("null_customer_id", F.col("customer_id").isNotNull()), email_rule()]
    if table == "orders":
        return [("null_order_id", F.col("order_id").isNotNull()),
                ("null_customer_id", F.col("customer_id").isNotNull()),
                ("non_positive_amount", F.coalesce(F.col("total_amount") > 0, F.lit(False)))]
    if table == "order_items":
        return [("null_order_id", F.col("order_id").isNotNull()),
                ("null_product_id", F.col("product_id").isNotNull()),
                ("non_positive_quantity", F.coalesce(F.col("quantity") > 0, F.lit(False)))]
    if table == "products":
        return [("null_product_id", F.col("product_id").isNotNull()),
                ("non_positive_price", F.coalesce(F.col("price") > 0, F.lit(False)))]
    raise KeyError(table)


def with_violations(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add ``violations`` = names of the rules a row breaks (empty if none)."""
    arr = F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules])
    return df.withColumn("violations", F.array_compact(arr))


def split_by_rules(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their ``violations`` list)."""
    tagged = with_violations(df, rules)
    valid = tagged.where(F.size("violations") == 0).drop("violations")
    rejected = tagged.where(F.size("violations") > 0)
    return valid, rejected


def quarantine_summary(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """C10 as one aggregate: rows, valid rows and the count per broken rule."""
    aggs = [F.count(F.lit(1)).alias("total_rows"),
            F.count(F.when(_all_ok(rules), 1)).alias("valid_rows")]
    aggs += [F.count(F.when(~ok, 1)).alias(name) for name, ok in rules]
    return df.agg(*aggs)


def _all_ok(rules):
    cond = F.lit(True)
    for _, ok in rules:
        cond = cond & ok
    return cond


def missing_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column, how many values are missing (one pass, then unpivot)."""
    cols = cols or df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    long = wide.unpivot(["__rows"], cols, "column_name", "missing")
    return long.select("column_name", F.col("__rows").alias("total_rows"), "missing")


def fill_missing(df: DataFrame, defaults: dict) -> DataFrame:
    """Fill missing values per column (e.g. phone -> 'unknown')."""
    return df.fillna(defaults)
