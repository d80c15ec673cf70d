"""Storage inventory and lifecycle.

Objects: (bucket, key, size, storage_class, age_days, layer,
is_delete_marker).  Lifecycle rules are a table (layer, after_days, action,
target): each holds from its age up to that of its layer's next rule, and
objects meet the one rule whose layer and range of ages they are in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.dates import ts_lit

# Lifecycle rules per layer as (layer, after_days, action, target).
LIFECYCLE_RULES = (
    ("raw", 0, "transition", "INTELLIGENT_TIERING"),
    ("clean", 30, "transition", "STANDARD_IA"),
    ("clean", 90, "transition", "GLACIER"),
    ("analytics", 60, "transition", "STANDARD_IA"),
    ("analytics", 180, "transition", "GLACIER"),
    ("query-results", 30, "expire", "EXPIRED"),
)

# Log retention (whole days of age).
DELETE_AFTER_DAYS, COMPRESS_AFTER_DAYS = 7, 3


def storage_by_class(objects: DataFrame) -> DataFrame:
    """Objects and bytes per bucket and storage class (NULL = STANDARD)."""
    return objects.groupBy("bucket", F.coalesce("storage_class", F.lit("STANDARD")).alias("storage_class")).agg(
        F.count(F.lit(1)).alias("object_count"), F.sum("size").alias("total_size"))


def version_counts(objects: DataFrame) -> DataFrame:
    """Versions and delete markers per bucket; a marker is no version."""
    live = F.count(F.when(~F.col("is_delete_marker"), 1))
    return objects.groupBy("bucket").agg(
        live.alias("versions"), F.count(F.when(F.col("is_delete_marker"), 1)).alias("delete_markers"),
        live.alias("live_versions"))


def lifecycle_rules(spark: SparkSession, rules=LIFECYCLE_RULES) -> DataFrame:
    """Rules as a table (layer, after_days, action, target)."""
    return spark.createDataFrame(list(rules), "layer string, after_days int, action string, target string")


def due_rules(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """``objects`` with ``target_tier`` and ``action`` of the rule they are due
    for: STANDARD and none where no rule holds yet.

    A rule holds for the half-open range of ages from its own to the layer's
    next one; of rules of one age the last action and target, by name, counts.
    The planner broadcasts the rules where they are as small as usual.
    """
    one = rules.groupBy("layer", "after_days").agg(F.max(F.struct("action", "target")).alias("r"))
    until = F.lead("after_days").over(Window.partitionBy("layer").orderBy("after_days"))
    ranges = one.select(F.col("layer").alias("_layer"), F.col("after_days").alias("_from"), until.alias("_until"), "r.action", F.col("r.target").alias("target_tier"))
    age = F.col("age_days")
    out = objects.join(ranges, (F.col("layer") == F.col("_layer")) & (age >= F.col("_from")) & (F.col("_until").isNull() | (age < F.col("_until"))), "left")
    return out.select(*objects.columns, F.coalesce("target_tier", F.lit("STANDARD")).alias("target_tier"), F.coalesce("action", F.lit("none")).alias("action"))


def lifecycle_tier(objects: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The tier each object is due for under the layer's rules."""
    rules = lifecycle_rules(objects.sparkSession) if rules is None else rules
    return due_rules(objects, rules).select("bucket", "key", "layer", "age_days", "target_tier", "action")


def lifecycle_summary(objects: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """O18 rolled up: objects and bytes per layer and due tier.

    Objects are added up by layer and age before they meet the rules.
    """
    rules = lifecycle_rules(objects.sparkSession) if rules is None else rules
    ages = objects.groupBy("layer", "age_days").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    return due_rules(ages, rules).groupBy("layer", "target_tier", "action").agg(
        F.sum("n").alias("object_count"), F.sum("size").alias("total_size"))


def age_in_days(modified: str, as_of) -> Column:
    """Whole days from ``modified`` to ``as_of``."""
    return F.floor((F.unix_micros(ts_lit(as_of).cast("timestamp")) - F.unix_micros(F.col(modified).cast("timestamp")))
                   / F.lit(86_400_000_000)).cast("int")


def with_age(objects: DataFrame, as_of, modified: str = "modified") -> DataFrame:
    """``age_days`` from the time an object was modified to ``as_of``."""
    return objects.withColumn("age_days", age_in_days(modified, as_of))


def log_objects(objects: DataFrame, as_of, name: str = "name", modified: str = "modified") -> DataFrame:
    """O19 per object: logs (``.log``, ``.gz``) older than seven whole days
    are deleted, ``.log`` files older than three compressed; others stay."""
    plain, packed = F.col(name).endswith(".log"), F.col(name).endswith(".gz")
    age = age_in_days(modified, as_of)
    action = (F.when(~(plain | packed), "keep").when(age > DELETE_AFTER_DAYS, "delete")
              .when((age > COMPRESS_AFTER_DAYS) & plain, "compress").otherwise("keep"))
    return objects.select("bucket", name, age.alias("age_days"), action.alias("action"))


def log_action(age_days: str = "age_days") -> Column:
    a = F.col(age_days)
    return (F.when(a > DELETE_AFTER_DAYS, F.lit("delete"))
            .when(a > COMPRESS_AFTER_DAYS, F.lit("compress"))
            .otherwise(F.lit("keep")))


def log_retention(objects: DataFrame) -> DataFrame:
    """Objects and bytes per retention action (delete > 7 whole days,
    compress > 3, else keep)."""
    return objects.groupBy(log_action().alias("action")).agg(
        F.count(F.lit(1)).alias("object_count"), F.sum("size").alias("total_size"))
