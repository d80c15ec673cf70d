"""Readers and writers.

Readers are thin over ``spark.read``: caller options override the defaults
of a format.  Writers never funnel data into one task (no ``coalesce(1)``);
partitioned output is rebalanced on the partition columns first so each task
writes few files.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources.records import MAX_RECORD_LINES, header_error, records

# Reader defaults per format (caller options win).
READ_DEFAULTS = {
    "csv": {"header": "true", "inferSchema": "true"},
    "json": {},
    "parquet": {},
    "text": {},
}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Read one table.  ``csv`` defaults to header + inferred
    schema (S1); ``json`` and ``text`` cover log files (S11)."""
    opts = dict(READ_DEFAULTS.get(fmt, {}))
    opts.update({k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()})
    r = spark.read.format(fmt).options(**opts)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


_JSON_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(),
               "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(),
               "boolean": T.BooleanType()}


def _decimal(text: str) -> T.DecimalType:
    digits = [int(x) for x in re.findall(r"[0-9]+", text)] or [10]
    return T.DecimalType(digits[0], digits[1] if len(digits) > 1 else 0)


def schema_from_json(spec) -> T.StructType:
    """A StructType from ``[{"name": ..., "type": ...}, ...]`` (types as in a
    catalog: bigint, int, string, double, date, timestamp, boolean,
    decimal(p,s))."""
    if isinstance(spec, str):
        spec = json.loads(spec)
    fields = []
    for c in spec:
        t = c["type"].lower()
        dt = _decimal(t) if t.startswith("decimal") else _JSON_TYPES[t]
        fields.append(T.StructField(c["name"], dt, True))
    return T.StructType(fields)


def read_declared(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
                  corrupt_col: str = "_corrupt_record", max_lines: int = MAX_RECORD_LINES, escape: str = "\\") -> tuple[DataFrame, DataFrame]:
    """S3: text with declared columns; rows that do not fit go to quarantine.

    Returns (good rows, rejected rows: parsed fields plus the raw text).  A
    record may span lines inside quotes (see ``strata.sources.records``); what
    is no whole record is a reject.  Quotes inside quotes stand after ``escape``
    (``\"`` where they are doubled).  Each is parsed under the whole schema, so
    that the verdict on it does not depend on which columns a query reads.
    With ``header`` the line of column names is left out wherever it stands
    (each part file has its own); one that names the columns in another order
    is an error.
    """
    names = [f.name for f in schema.fields]
    s = T.StructType(schema.fields + [T.StructField(corrupt_col, T.StringType(), True)])
    texts = records(spark, path, max_lines, escape).where(F.length(F.trim("value")) > 0)
    if header:
        wrong_head = header_error(F.col("value"), names)
        texts = texts.where(F.regexp_replace("value", '[" ]', "") != ",".join(names)).where(F.coalesce(wrong_head.cast("boolean"), F.lit(True)))
    # All fields are needed for the verdict: none may be pruned from the parse.
    row = F.from_csv("value", s.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "),
                     {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt_col, "escape": escape})
    fields = texts.select(row.alias("r"), "value", "whole")
    wrong = F.col(f"r.{corrupt_col}").isNotNull() | ~F.col("whole")
    good = fields.where(~wrong).select(*[F.col(f"r.{f.name}") for f in schema.fields])
    return good, fields.where(wrong).select(*[F.col(f"r.{f.name}") for f in schema.fields], F.col("value").alias(corrupt_col))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, **options) -> None:
    """Write a mart (Parquet + Snappy by default), optionally partitioned.

    With partition columns the rows are rebalanced on them first: a value's
    rows come to few tasks, and a value with very many rows is split among
    several by the size of its partitions.
    """
    opts = {"compression": "snappy"} if fmt == "parquet" else {}
    opts.update(options)
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.format(fmt).mode(mode).options(**opts)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def validate_input(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """One row (path, has_rows): the input exists and has a row.

    A missing path raises (as the job must not start); an empty one gives
    ``has_rows = false``.  Only one row is ever read.
    """
    df = read_table(spark, path, fmt)
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_rows")).select(
        F.lit(path).alias("path"), "has_rows")
