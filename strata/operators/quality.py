"""Data quality: column profile (G1) and referential orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """G1: per column: rows, nulls, distinct values, min and max (as text).

    Nulls / min / max come from one typed aggregate.  Distinct counts come
    from an unpivot to (column, value) and two grouped aggregates, where
    map-side partial aggregation collapses repeated values before the
    shuffle; no per-column ``countDistinct`` (and no Expand) is planned.  Keys
    are counted like all others: finding out that one repeats is what a
    profile is for.
    """
    cols = cols or df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[
        x for c in cols for x in (
            F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}__nulls"),
            F.min(c).cast("string").alias(f"{c}__min"),
            F.max(c).cast("string").alias(f"{c}__max"))])
    stats = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col("__rows").alias("total_rows"),
                 F.col(f"{c}__nulls").alias("null_count"), F.col(f"{c}__min").alias("min_value"),
                 F.col(f"{c}__max").alias("max_value")) for c in cols])).alias("s")).select("s.*")
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in cols])).alias("p")
    ).select("p.*").where(F.col("v").isNotNull())
    distinct = (pairs.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
                .groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count")))
    return (stats.join(distinct, "column_name", "left")
            .select("column_name", "total_rows", "null_count",
                    F.coalesce("distinct_count", F.lit(0).cast("bigint")).alias("distinct_count"),
                    "min_value", "max_value"))


def _relation(one: DataFrame, many: DataFrame, key: str, many_without: str, one_without: str) -> DataFrame:
    """Orphans of a 1-N relation in both directions, from one pass over each
    side: the rows of ``many`` whose key ``one`` does not have, and the keys
    of ``one`` that ``many`` does not have.  A key is added up in each task
    before it is shuffled; a null key matches nothing."""
    side = lambda df, n, c: df.select(key, F.lit(n).alias("n"), F.lit(c).alias("c"))
    seen = side(one, 0, 1).unionByName(side(many, 1, 0)).groupBy(key).agg(F.sum("n").alias("n"), F.max("c").alias("c"))
    lost = F.when((F.col("c") == 0) | F.col(key).isNull(), F.col("n")).otherwise(0)
    idle = F.when((F.col("c") == 1) & ((F.col("n") == 0) | F.col(key).isNull()), 1).otherwise(0)
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return seen.agg(F.array(
        F.struct(F.lit(many_without).alias("check_name"), count(lost).alias("orphan_count")),
        F.struct(F.lit(one_without).alias("check_name"), count(idle).alias("orphan_count"))).alias("r")).select(
        F.explode("r").alias("r")).select("r.check_name", "r.orphan_count")


def orphans(T: dict) -> DataFrame:
    """Orphan keys along customers 1-N orders 1-N items N-1 products."""
    c, o, i, p = T["customers"], T["orders"], T["order_items"], T["products"]
    # Orders without items are counted as rows: an order id is its row's key.
    out = _relation(c, o, "customer_id", "orders_without_customer", "customers_without_orders")
    out = out.unionByName(_relation(o, i, "order_id", "items_without_order", "orders_without_items"))
    return out.unionByName(_relation(p, i, "product_id", "items_without_product", "products_without_sales"))
