"""Catalog operations (S5-S7): external tables, partition discovery, listing
and dropping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import checkpoint_dir
from strata.sources.io import schema_from_json


def _q(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def create_tables(spark: SparkSession, tables: dict, database: str = "strata") -> DataFrame:
    """Create the database and external tables, idempotently.

    ``tables`` maps name -> {"location": path, "format": "parquet",
    "schema": StructType, JSON column list or None, "options": {...} (such as
    ``sep`` and ``header`` of CSV), "partition_by": [...]}.  Returns one row
    per table with success flag and error text; a failing table does not stop
    the others.  The database lies in the shared folder.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_q(database)} LOCATION '{checkpoint_dir(spark).rstrip('/')}/{database}.db'")
    rows = []
    for name, spec in tables.items():
        fq = f"{database}.{name}"
        try:
            cols = ""
            schema = spec.get("schema")
            if isinstance(schema, (str, list)):
                schema = schema_from_json(schema)
            if schema is None and spec.get("partition_by"):
                # A partitioned table needs its column list: take it from the data.
                schema = spark.read.format(spec.get("format", "parquet")).load(spec["location"]).schema
            if schema is not None:
                cols = "(" + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ")"
            part = ""
            if spec.get("partition_by"):
                part = " PARTITIONED BY (" + ", ".join(f"`{c}`" for c in spec["partition_by"]) + ")"
            opts = ", ".join(f"'{k}' '{v}'" for k, v in spec.get("options", {}).items())
            spark.sql(f"CREATE TABLE IF NOT EXISTS {_q(fq)} {cols} USING {spec.get('format', 'parquet')}"
                      f"{f' OPTIONS ({opts})' if opts else ''}{part} LOCATION '{spec['location']}'")
            if spec.get("partition_by"):
                spark.catalog.recoverPartitions(fq)
            rows.append((name, True, None))
        except Exception as e:  # noqa: BLE001 - reported per table, as a result row
            rows.append((name, False, str(e)))
    return spark.createDataFrame(rows, "table_name string, success boolean, error string")


def counts(result: DataFrame) -> DataFrame:
    """One row (succeeded, failed) of what ``create_tables`` returned."""
    return result.agg(F.count(F.when(F.col("success"), 1)).alias("succeeded"), F.count(F.when(~F.col("success"), 1)).alias("failed"))


def repair_partitions(spark: SparkSession, table: str) -> DataFrame:
    """Discover Hive-style partition folders of a table and list them."""
    spark.catalog.recoverPartitions(table)
    return spark.sql(f"SHOW PARTITIONS {_q(table)}")


def list_tables(spark: SparkSession, database: str = "strata") -> DataFrame:
    """Tables of a database."""
    return spark.createDataFrame(
        [(t.name, t.tableType, bool(t.isTemporary)) for t in spark.catalog.listTables(database)],
        "table_name string, table_type string, is_temporary boolean")


def drop_table(spark: SparkSession, table: str) -> None:
    """Drop a table; a missing table is not an error."""
    spark.sql(f"DROP TABLE IF EXISTS {_q(table)}")
