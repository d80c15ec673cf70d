"""Structured Streaming versions of ingest and metric windows.

Sources are file streams (new files in a folder).  A job resumes where it
stopped when it is started again with the same sink and checkpoint folders,
which the caller names; a batch that is repeated replaces what it wrote.  The
transformations are the batch operators' column expressions, so a stream
over a set of files equals the batch job over the same files (up to
windows not yet closed by the watermark).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strata.operators.clean import with_violations
from strata.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def table_path(folder: str, table: str) -> str:
    """A table's files, whether it is one file or a folder of part files
    (file streams take a single file only by a pattern)."""
    return f"{folder}/{table}[.]parquet"


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(folder)


def first_arrivals(stream: DataFrame, key: list[str], within: str) -> DataFrame:
    """Of rows that come with the same key within a time, the first.

    The state store keeps the keys for that time after their arrival, over
    batches and restarts.  The time is that of arrival, not of the event: no
    row is ever late, so none is lost.
    """
    arrived = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within)
    return arrived.dropDuplicatesWithinWatermark(key).drop("_arrived")


def stream_ingest(stream: DataFrame, sink: str, checkpoint: str, rules, transform=None,
                  quarantine: str | None = None, key: list[str] | None = None, within: str = "7 days") -> StreamingQuery:
    """New raw files -> clean Parquet; rows that break a rule go to the
    quarantine folder (by default beside the sink) with their violations.

    Each batch has a folder of its own, ``batch=<number>``, which a repeated
    batch overwrites: no row is written twice.  With ``key``, a row whose key
    came before, ``within`` that time, is dropped.
    """
    df = transform(stream) if transform else stream
    if key:
        df = first_arrivals(df, key, within)
    rejected = quarantine or sink.rstrip("/") + "-rejected"

    def write(batch: DataFrame, epoch: int) -> None:
        tagged = with_violations(batch, rules).persist()
        tagged.where(F.size("violations") == 0).drop("violations").write.mode("overwrite").parquet(f"{sink}/batch={epoch}")
        tagged.where(F.size("violations") > 0).write.mode("overwrite").parquet(f"{rejected}/batch={epoch}")
        tagged.unpersist()

    return (df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def with_reasons(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("violations", T.ArrayType(T.StringType()))])


def read_sink(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches; a sink that no batch has reached is empty."""
    try:
        return spark.read.schema(schema).parquet(sink).select(*schema.names)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def metric_windows(metrics: DataFrame, watermark: str = "2 minutes", size: str = "1 minute") -> DataFrame:
    """R2 transformation: tumbling-window count and max per metric and
    dimensions (as sorted ``key=value`` text).  Rows later than the watermark
    are dropped from closed windows."""
    # Watermarks need TIMESTAMP (with zone); the session zone is UTC.
    dims = F.array_join(F.transform(F.array_sort(F.map_entries("dimensions")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return (metrics.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
            .withWatermark("timestamp", watermark)
            .groupBy(F.window("timestamp", size).alias("w"), "name", dims.alias("dimensions"))
            .agg(F.count(F.lit(1)).alias("samples"), F.max("value").alias("max_value"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "name", "dimensions", "samples", "max_value"))


def security_windows(events: DataFrame, names, watermark: str = "10 minutes") -> DataFrame:
    """R3 transformation: watched-name counts per hour."""
    return (events.where(F.col("eventName").isin(list(names)))
            .withColumn("eventTime", F.col("eventTime").cast("timestamp"))
            .withWatermark("eventTime", watermark)
            .groupBy(F.window("eventTime", "1 hour").alias("w"), "eventName")
            .agg(F.count(F.lit(1)).alias("event_count"))
            .select(F.col("w.start").alias("hour_start"), "eventName", "event_count"))


def event_log_rows(events: DataFrame) -> DataFrame:
    """R4 transformation: event rows with their service and hour bucket."""
    return events.select(
        "event_id", "ts", "event_type", "user_id", "value",
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service"),
        F.date_format("ts", "yyyy-MM-dd-HH").alias("hour"))


def append_to_parquet(df: DataFrame, sink: str, checkpoint: str, partition_by=None) -> StreamingQuery:
    """Append to Parquet; with partition columns, a batch's rows are rebalanced
    on them first, so that it writes few files and a value with very many rows
    is split."""
    if partition_by:
        return _rebalanced(df, sink, checkpoint, list(partition_by))
    w = (df.writeStream.format("parquet").outputMode("append").option("path", sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    return w.start()


def _rebalanced(df: DataFrame, sink: str, checkpoint: str, partition_by: list[str]) -> StreamingQuery:
    """Each batch has a folder of its own, which a repeated batch overwrites."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(f"{sink}/batch={epoch}")
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(spark: SparkSession, build, name: str, partition_by=None) -> DataFrame:
    """Run a stream over everything available now and read its sink back."""
    root, df = scratch(spark, name), build()
    q = append_to_parquet(df, f"{root}/out", f"{root}/checkpoint", partition_by)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_sink(spark, f"{root}/out", df.schema)
