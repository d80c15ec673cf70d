"""Crawler (S8): the tables of a folder tree, and a catalog that follows them.

A table is a folder right under the base, or a loose file there; a base that
holds only files or partition folders is one table itself.  A table's format is
that of most of its files, by their suffix.  ``crawl`` reports the schemas;
``crawl_update`` also writes them to the catalog: new tables are created, new
columns added (partitions inherit the table's schema), new partitions listed.
Columns that vanished or changed their type are only reported: what readers
rely on is not taken away.

Only folder names, formats and schemas come to the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources.catalog import _q, create_tables

# Formats by suffix, and what their readers need.
SUFFIXES = {"parquet": "parquet", "orc": "orc", "json": "json", "jsonl": "json", "ndjson": "json", "csv": "csv", "tsv": "csv", "txt": "text", "log": "text"}
OPTIONS = {"csv": {"header": "true"}, "parquet": {}, "orc": {}, "json": {}, "text": {}}
_REPORT = "table_name string, column_name string, data_type string, is_partition boolean, change string"


def found_tables(spark: SparkSession, base: str) -> DataFrame:
    """(table_name, location, format, files) of what lies under ``base``."""
    base = base.rstrip("/")
    under = re.escape(re.sub(r"^[A-Za-z0-9]+:/*", "/", base)) + "/(.*)$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select(F.regexp_extract("path", under, 1).alias("file"))
    suffix = F.lower(F.regexp_extract("file", r"\.([A-Za-z]+)(?:\.(?:gz|bz2|zst|lz4|snappy|deflate))?$", 1))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), suffix), F.lit("parquet"))
    head = F.regexp_extract("file", "^([^/]+)/", 1)
    files = files.select("file", kind.alias("format"), F.when(head.contains("="), "").otherwise(head).alias("folder"))
    # Loose files are tables beside folders; without folders they are parts of one table.
    folders = files.where("folder != ''").limit(1).count()
    loose = F.when(F.col("folder") != "", F.col("folder")).otherwise(F.col("file") if folders else F.lit(""))
    per = files.withColumn("place", loose).where("folder != '' OR NOT contains(file, '=') OR place = ''").groupBy("place", "format").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("place").agg(F.max_by("format", F.struct("n", "format")).alias("format"), F.sum("n").alias("files"))
    name = F.when(F.col("place") == "", F.lit(base.rsplit("/", 1)[-1])).otherwise(F.regexp_replace(F.regexp_replace("place", r"\.[A-Za-z.]+$", ""), "[^A-Za-z0-9_]", "_"))
    return per.select(name.alias("table_name"), F.concat(F.lit(base), F.when(F.col("place") == "", "").otherwise(F.concat(F.lit("/"), "place"))).alias("location"), "format", "files")


def _columns(spark: SparkSession, location: str, fmt: str) -> tuple[T.StructType, list[str]]:
    """The merged schema of a table's files, and its partition columns."""
    r = spark.read.format(fmt).options(**OPTIONS[fmt])
    if fmt in ("parquet", "orc"):
        r = r.option("mergeSchema", "true")
    if fmt == "csv":
        r = r.option("inferSchema", "true")
    whole = r.load(location).schema
    stored = set(r.option("recursiveFileLookup", "true").load(location).columns)
    return whole, [f.name for f in whole.fields if f.name not in stored]


def _changes(name: str, now: T.StructType, parts: list[str], past: T.StructType) -> list[tuple]:
    old, new = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (past, now))
    rows = [(name, c, t, c in parts, "new" if c not in old else "changed" if old[c] != t else "same") for c, t in new.items()]
    return rows + [(name, c, t, False, "vanished") for c, t in old.items() if c not in new]


def crawl(spark: SparkSession, base: str, known: dict[str, T.StructType] | T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    """The tables under ``base`` with their merged schemas and partition
    columns, and the difference from a known schema (by table, or of the one
    table): (table, column, type, is_partition, change) with change in new /
    changed / vanished / same."""
    rows = []
    for t in found_tables(spark, base).orderBy("table_name").collect():  # one row a table
        now, parts = _columns(spark, t["location"], fmt or t["format"])
        past = known if isinstance(known, T.StructType) else (known or {}).get(t["table_name"], T.StructType())
        rows += _changes(t["table_name"], now, parts, past)
    return spark.createDataFrame(rows, _REPORT)


def crawl_update(spark: SparkSession, base: str, database: str = "strata", prefix: str = "") -> DataFrame:
    """Bring the catalog in line with what lies under ``base``; the report of
    ``crawl`` against what the catalog had, with the format, and whether a
    change was applied.

    Columns are added where the table's own columns are still the first ones
    (CSV files are read by position) or are found by name (other formats).
    """
    rows = []
    for t in found_tables(spark, base).orderBy("table_name").collect():
        name, fmt, fq = prefix + t["table_name"], t["format"], f"{database}.{prefix}{t['table_name']}"
        now, parts = _columns(spark, t["location"], fmt)
        if not spark.catalog.databaseExists(database) or not spark.catalog.tableExists(fq):
            spec = {"location": t["location"], "format": fmt, "schema": now, "options": OPTIONS[fmt], "partition_by": parts}
            made = create_tables(spark, {name: spec}, database).first()["success"]
            rows += [(*r, fmt, made) for r in _changes(t["table_name"], now, parts, T.StructType())]
            continue
        past = spark.table(fq).schema
        changes = _changes(t["table_name"], now, parts, past)
        fresh = [f for f in now.fields if f.name not in past.names and f.name not in parts]
        own = [f.name for f in past.fields if f.name not in parts]
        can = bool(fresh) and fmt != "text" and (fmt != "csv" or [f.name for f in now.fields][:len(own)] == own)
        if can:
            spark.sql(f"ALTER TABLE {_q(fq)} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in fresh)})")
        if parts:
            spark.catalog.recoverPartitions(fq)
        spark.catalog.refreshTable(fq)
        rows += [(*r, fmt, r[4] == "new" and can) for r in changes]
    return spark.createDataFrame(rows, f"{_REPORT}, format string, applied boolean")
