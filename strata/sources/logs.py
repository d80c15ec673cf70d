"""Records of plain log files.

A record starts with a line that has a time, a logger and a level; the lines
below it (stack traces, dumps) belong to it.  Files are read line by line, by
as many tasks as they have splits.  A line's number in its file is its place in
its split after the lines of the splits before, so a record that reaches over
splits is put together from them.

Only a split's own lines are sorted together.  A record's lines are put
together in its split; the pieces of a record that reaches over splits then
meet, which are at most the first and last record of each.  A record of more
than ``max_lines`` lines is given in parts of that many, so that no row grows
without bound and no line is lost.

Defined results: lines above the first record of a file are the parts of record
-1, without time, logger and level; a start whose time is no time (month 13)
is a record without time; an empty file gives nothing; empty lines inside a
record are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Time - logger - level - message, the order in which the jobs log.
RECORD_START = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,6})?) - (\S+) - ([A-Z]+) - (.*)$"
MAX_RECORD_LINES = 1_000


def _time(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("timestamp_ntz")


def _numbered(spark: SparkSession, path: str, start: str) -> DataFrame:
    """(file, block, line, value, rec): each line, its number and its record's."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("id"))
    opens = F.when(F.col("value").rlike(start), F.col("id"))
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n"), F.max(opens).alias("last_start"))
    # One row per split from here to the join.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("lo"))
    splits = splits.withColumn("last_start", F.col("last_start") + F.col("offset"))
    splits = splits.withColumn("carried", F.coalesce(F.max("last_start").over(before), F.lit(-1)))
    placed = lines.join(splits.select("file", "block", "offset", "carried", "last_start"), ["file", "block"]).withColumn("line", F.col("id") + F.col("offset"))
    own = F.max(F.when(F.col("value").rlike(start), F.col("line"))).over(Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rec = F.coalesce(own, F.col("carried"))
    # The first and last record of a split may reach over its borders.
    return placed.withColumn("rec", rec).withColumn("border", own.isNull() | (own == F.col("last_start"))).drop("id", "offset", "carried", "last_start")


def log_records(spark: SparkSession, path: str, start: str = RECORD_START, max_lines: int = MAX_RECORD_LINES) -> DataFrame:
    """(file, record, part, log_time, logger, level, message, n_lines, text).

    ``record`` is the number of its first line in the file, ``message`` the
    first line's, ``text`` all lines of the part; time, logger, level and
    message are null in parts after the first.  ``start`` has these four as
    groups 1 to 4.
    """
    lines = _numbered(spark, path, start)
    first = F.greatest(F.col("rec"), F.lit(0))
    lines = lines.withColumn("part", F.floor((F.col("line") - first) / max_lines).cast("int"))
    piece = F.array_sort(F.collect_list(F.struct("line", "value"))).alias("lines")
    pieces = lines.groupBy("file", "block", "rec", "part", "border").agg(piece)
    whole = pieces.where("NOT border").select("file", "rec", "part", "lines")
    over = pieces.where("border").groupBy("file", "rec", "part").agg(F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines"))
    out = whole.unionByName(over)
    head = F.when(F.col("part") == 0, F.col("lines")[0]["value"])
    field = lambda k: F.when(F.col("rec") >= 0, F.regexp_extract(head, start, k))
    return out.select("file", F.col("rec").alias("record"), "part", _time(field(1)).alias("log_time"), field(2).alias("logger"), field(3).alias("level"), field(4).alias("message"),
                      F.size("lines").alias("n_lines"), F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("text"))
