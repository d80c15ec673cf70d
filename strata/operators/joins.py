"""Named join shapes.

The physical strategy is left to the planner: AQE picks broadcast when a
side's runtime size is under ``spark.sql.autoBroadcastJoinThreshold`` and a
sort-merge join otherwise, splitting skewed partitions.  Nothing here forces
a broadcast of a side whose size grows with the data.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Rows that one task sorts or hashes where rows are dealt out by count.
ROWS_PER_TASK = 250_000
# A shuffle of more parts costs more than it saves.
MAX_TASKS = 20_000


def tasks_for(spark: SparkSession, rows: float) -> int | None:
    """Tasks for so many rows, each with about ``ROWS_PER_TASK`` of them however
    many there are; None where the cores are as many, which is left to AQE."""
    n = min(ceil(rows / ROWS_PER_TASK), MAX_TASKS)
    return n if n > spark.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` to so many tasks (see ``tasks_for``)."""
    return df.repartition(tasks, *keys) if tasks else df.repartition(*keys)


def join_orders_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Inner equi-join on an aliased condition; both keys are kept
    (the item side's as ``item_order_id``)."""
    o, i = orders.alias("o"), items.alias("oi")
    return o.join(i, F.col("o.order_id") == F.col("oi.order_id"), "inner").select(
        "o.*", *[F.col(f"oi.{c}").alias("item_order_id" if c == "order_id" else c)
                 for c in items.columns if c not in set(orders.columns) - {"order_id"}])


def join_using(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Inner equi-join with USING semantics (one merged key column)."""
    return left.join(right, keys)


def star_join(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Items x orders x products, inner."""
    p = products.select("product_id", "product_name", "category", "brand", "price")
    return items.join(orders, "order_id").join(p, "product_id")


def dim_left_fact(dim: DataFrame, fact_agg: DataFrame, key: str, fill: list[str] | None = None) -> DataFrame:
    """Keep every dimension row; facts (already aggregated per key, so
    the join is 1:1) padded with 0."""
    out = dim.join(fact_agg, key, "left")
    if fill:
        types = dict(out.dtypes)
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(types[c])) for c in fill})
    return out


def customers_orders(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers with their orders, inner on customer_id."""
    return customers.join(orders, "customer_id")


def basket(items: DataFrame) -> DataFrame:
    """Distinct (order_id, product_id): one line per product of an order.

    Lines are dealt out by order, to tasks in proportion to their count (a scan
    of its own).  Copies fall away there: before the shuffle a task would hold
    nearly all lines of its split to find few.
    """
    lines = items.select("order_id", "product_id")
    return dealt(lines, tasks_for(items.sparkSession, lines.count()), "order_id").distinct()


def pair_tasks(lines: DataFrame) -> int | None:
    """Tasks for the pairs of ``basket`` lines, from the sizes of all orders."""
    n = F.col("n").cast("double")
    pairs = lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(n * (n + 1) / 2)).first()[0]
    return tasks_for(lines.sparkSession, pairs or 0)


def pairs_of(lines: DataFrame, block_lines: int = 1_000, tasks: int | None = None) -> DataFrame:
    """(product_a, product_b, pair_count), a < b, over ``basket`` lines.

    An order's lines are numbered into blocks by a hash of the product, as
    many as its own line count asks for; blocks i <= j meet as (order, i, j),
    so that each pair is built once and the pairs of an order with a great
    many lines are built by many tasks.  Nearly all orders have one block.

    Blocks and pairs go to ``tasks`` tasks (see ``pair_tasks``), so that none holds
    more of them when there are more.  Pairs are counted after their shuffle:
    nearly all that a task builds differ.  A pair of very many orders is one
    group of its task, which keeps a count and no rows.
    """
    sized = lines.groupBy("order_id").agg(F.ceil(F.count(F.lit(1)) / block_lines).cast("int").alias("blocks"))
    b = lines.join(sized, "order_id").withColumn("block", F.pmod(F.xxhash64("product_id"), "blocks").cast("int"))
    left = b.select("order_id", F.col("product_id").alias("x"), F.col("block").alias("i"),
                    F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = b.select("order_id", F.col("product_id").alias("y"), F.col("block").alias("j"),
                     F.explode(F.sequence(F.lit(0), "block")).alias("i"))
    keys = ["order_id", "i", "j"]
    met = dealt(left, tasks, *keys).join(dealt(right, tasks, *keys), keys).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    pairs = met.where("x != y").select(F.least("x", "y").alias("product_a"), F.greatest("x", "y").alias("product_b"))
    return dealt(pairs, tasks, "product_a", "product_b").groupBy("product_a", "product_b").agg(F.count(F.lit(1)).alias("pair_count"))


def basket_pairs(items: DataFrame, min_count: int = 1, block_lines: int = 1_000) -> DataFrame:
    """Product pairs (a < b) bought in the same order, counted; pairs
    found in fewer than ``min_count`` orders are left out if the caller says so.

    Pairs are never returned per order.
    """
    b = basket(items)
    out = pairs_of(b, block_lines, pair_tasks(b))
    return out.where(F.col("pair_count") >= min_count) if min_count > 1 else out
