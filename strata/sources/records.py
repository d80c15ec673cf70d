"""CSV records from lines (S3).

A quoted field may hold line feeds, so a record can be several lines.  Files
are still read line by line, by as many tasks as they have splits.  Lines with
an odd number of quotes open or close such a record, in turn; pairs of them
that lie no more than ``max_lines`` lines apart are put together with what lies
between.  Lines are numbered where they are read, by a small table of the
splits; the pairs are found on the numbers of odd lines alone, and the text is
shuffled once, to meet the numbers of the lines that pairs hold.

What is put together has to be a whole record; if not (a torn quote met
another quote by chance), its lines are judged one by one.  A line that is no
whole record by itself is a reject with its raw text, so every line of the
files is in a record or in a reject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_RECORD_LINES = 1_000


def is_record(text: Column, escape: str = "\\") -> Column:
    """Whether a text is one whole CSV record: fields are quoted, with quotes
    after ``escape`` inside, or start without a quote and end with the line."""
    inner = r'(?:""[^"]*+)*+' if escape == '"' else r'(?:\\(?s:.)[^"\\]*+)*+'
    plain = '[^"]*+' if escape == '"' else r'[^"\\]*+'
    field = rf'(?:"{plain}{inner}"|[^",\n][^,\n]*+|)'
    return ~text.contains('"') | text.rlike(rf"^{field}(?:,{field})*+$")


def records(spark: SparkSession, path: str, max_lines: int = MAX_RECORD_LINES, escape: str = "\\") -> DataFrame:
    """(value, whole): each record of the files, or line that is none."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("id"))
    bare = F.col("value") if escape == '"' else F.regexp_replace("value", r"\\.", "")
    quotes = F.length(F.regexp_replace(bare, '[^"]', ""))
    # The number of a line in its file: the lines of the splits before, and its place in its own.
    of_file = Window.partitionBy("file")
    before = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n"))
    # A file is known by its first line's id from here, which is shorter than its path.
    splits = splits.select("file", "block", F.min("lo").over(of_file).alias("f"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("lo")).alias("offset"))
    # One row per split of the text: small beside any task's share of it.
    placed = lines.join(F.broadcast(splits), ["file", "block"]).select("f", (F.col("id") + F.col("offset")).alias("line"), "value").where("f IS NOT NULL AND line IS NOT NULL")
    odd = placed.where(F.col("value").contains('"') & ((quotes % 2) == 1)).select("f", "line")
    at = Window.partitionBy("f").orderBy("line")
    near = F.col("line") - F.lag("line").over(at) <= max_lines
    runs = odd.withColumn("run", F.sum(F.when(near, 0).otherwise(1)).over(at))
    run = Window.partitionBy("f", "run").orderBy("line")
    turns = runs.withColumn("turn", F.row_number().over(run) % 2).withColumn("next", F.lead("line").over(run))
    pairs = turns.where("turn = 1 AND next IS NOT NULL")
    # The lines of a pair, max_lines + 1 at most.
    held = pairs.select("f", F.col("line").alias("of"), F.explode(F.sequence("line", "next")).alias("line"))
    marked = placed.join(held, ["f", "line"], "left")
    joined = marked.where("of IS NOT NULL").groupBy("f", "of").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("lines"))
    texts = marked.where("of IS NULL").select(F.array("value").alias("lines")).unionByName(joined.select(F.transform("lines", lambda x: x["value"]).alias("lines")))
    texts = texts.withColumn("text", F.array_join("lines", "\n"))
    texts = texts.withColumn("whole", is_record(F.col("text"), escape))
    # What is no whole record together is judged line by line.  Filters of a
    # caller stay above the explode, so that both branches read one shuffle.
    parts = texts.select("whole", F.explode(F.when(F.col("whole"), F.array("text")).otherwise(F.col("lines"))).alias("value"))
    return parts.select("value", (F.col("whole") | is_record(F.col("value"), escape)).alias("whole"))


def header_error(value: Column, names: list[str]) -> Column:
    """An error for a line that names the declared columns, but not as declared."""
    fields = F.split(F.regexp_replace(value, '[" ]', ""), ",")
    lit = F.array(*map(F.lit, names))
    other = (F.size(F.array_except(fields, lit)) == 0) & (F.size(F.array_distinct(fields)) == F.size(fields)) & (F.size(fields) > 1) & (fields != lit)
    return F.when(other, F.raise_error(F.concat(F.lit(f"declared columns are {','.join(names)}, a file is headed "), value)))
