"""Mixing sources to target weights by systematic sampling (operator 6).

Each source gets a target number of words: its weight's share of all words,
at most ``max_repeat`` times its own size, the excess reshared by weight.  A
source's rate (target / size) is the expected number of copies of each of its
documents.  Within the source the expected copies are prefix-summed over the
documents in order of size, one random offset per source is added, and a
document is emitted once per integer boundary that its interval crosses.  The
order by size makes every size class keep its share, so that the words taken
miss the target by no more than the size of one document.

The prefix sum is made in three levels, so that a source with a third of all
rows is spread: counts by (source, size), by (source, size, one of 4,096 hash
slices of the ids), and the row number inside a slice.  Only the level of
source and size is one window per source, over as many rows as there are
different sizes.

Defined results: a null text has size 0; null sources form one source, the
last; rows of size 0 take no words; repeated rows are documents of their own;
a source without words has target 0; an empty table gives an empty result.
Reruns agree: offsets and slices come from md5 of the source and of the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import fresh, read, words, written

#: Fixed values of the contract, and the seed of the offsets.
WEIGHTS, MAX_REPEAT, SEED = (5, 2, 1), 3, "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, size).

    A source is capped when the level that the sources not below it in
    size per weight share exceeds its cap.  The windows run over one row
    per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_code) - 1) % len(weights)
    per = per.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("long").alias("weight"))
    s, w = F.col("source_size").cast("decimal(38,0)"), F.col("weight").cast("decimal(38,0)")
    slack = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    per = per.select(
        "*", F.sum("source_size").over(everything).alias("total"),
        (F.sum(s).over(slack.rowsBetween(Window.unboundedPreceding, 0)) - s).alias("before"),
        F.sum(w).over(slack.rowsBetween(0, Window.unboundedFollowing)).alias("rest_weight"))
    level = (F.col("total") - max_repeat * F.col("before")).cast("decimal(38,0)")
    fits = max_repeat * s * F.col("rest_weight") >= w * level
    per = per.select("*", fits.alias("fits"), level.cast("double").alias("level"))
    best = F.max(F.when(F.col("fits"), F.struct(F.col("rest_weight"), F.col("level")))).over(everything)
    per = per.select("source", "source_size", "weight", "rest_weight", best.alias("best"))
    free = F.col("rest_weight") <= F.col("best.rest_weight")
    share = F.col("weight").cast("double") * F.col("best.level") / F.col("best.rest_weight").cast("double")
    return per.select("source", "source_size", F.when(
        free, share).otherwise((F.col("source_size") * max_repeat).cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, copies) of every
    row; rows of one slice and id are taken in the order of their texts' hashes."""
    d = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(F.col(text)).alias("text_hash"),
                            F.size(words(F.col(text))).cast("long").alias("size")), "sizes")
    d = d.withColumn("slice", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 3))
    targets = source_targets(d, weights, max_repeat)
    slices = d.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    sizes = slices.groupBy("source", "size").agg(F.sum("n").alias("n"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("source").alias("s1"), F.col("size").alias("z1"), F.coalesce(
        F.sum("n").over(upto(Window.partitionBy("source").orderBy("size"))), F.lit(0)).alias("by_size"))
    slices = slices.select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("slice").alias("c2"), F.coalesce(
        F.sum("n").over(upto(Window.partitionBy("source", "size").orderBy("slice"))), F.lit(0)).alias("by_slice"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit(":"), "source"), F.lit("")))), 1, 8), 16, 10)
    targets = targets.select(F.col("source").alias("s3"), "source_size", "target", (offset.cast("double") / 4294967296.0).alias("u"))
    base = slices.join(sizes, F.col("s1").eqNullSafe(F.col("s2")) & (F.col("z1") == F.col("z2"))).join(
        targets, F.col("s3").eqNullSafe(F.col("s2"))).select(
        "s2", "z2", "c2", (F.col("by_size") + F.col("by_slice")).alias("before"), "source_size", "target", "u")
    row = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("doc_id", "text_hash"))
    d = d.withColumn("row", row).join(
        base, F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")) & (F.col("slice") == F.col("c2")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    i = F.col("before") + F.col("row")
    copies = F.floor(F.col("u") + rate * i) - F.floor(F.col("u") + rate * (i - 1))
    return d.select("doc_id", "source", "text_hash", "size", "source_size", "target", F.least(copies, F.lit(max_repeat)).alias("copies"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each document as often as the mix takes it.

    Rows are known by id, source and text.  Rows that repeat all three are
    taken together: one of them stands for all, as often as they are taken.
    """
    key = ["doc_id", "source", "text_hash"]
    own = fresh(docs, "_id", "_source", "_text", "_copies", "_again")
    i, s, t, copies, again = own
    taken = mix(docs, **how).groupBy(*key).agg(F.sum("copies").alias(copies), (F.count("*") > 1).alias(again)).withColumnsRenamed(dict(zip(key, own))).where(F.col(copies) > 0)
    taken = written(taken, "copies")
    joined = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s)) & (F.xxhash64("text") == F.col(t)))
    if taken.where(again).limit(1).count():
        joined = joined.where(~F.col(again)).unionByName(joined.where(again).dropDuplicates([i, s, t]))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copies)).drop(copies)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 3) AS slice FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
weighted AS (
  SELECT *, [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight FROM per),
level AS (
  SELECT *, sum(weight) OVER o AS rest_weight,
         sum(source_size) OVER () - {MAX_REPEAT} * (sum(source_size) OVER p - source_size) AS level
  FROM weighted
  WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
         p AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
best AS (SELECT rest_weight AS w, level AS l FROM level
         WHERE {MAX_REPEAT} * source_size * rest_weight >= weight * level ORDER BY rest_weight DESC LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN rest_weight <= w THEN weight::DOUBLE * l::DOUBLE / w::DOUBLE
                                   ELSE ({MAX_REPEAT} * source_size)::DOUBLE END AS target,
         ('0x' || substr(md5('{SEED}' || coalesce(':' || source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM level, best),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, slice, doc_id NULLS FIRST) AS i FROM d),
c AS (
  SELECT n.doc_id, n.size, t.source_size, t.target, t.u, n.i,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM n JOIN targets t ON n.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       least((floor(u + rate * i) - floor(u + rate * (i - 1)))::BIGINT, {MAX_REPEAT}) * size AS taken,
       least((floor(u + rate * i) - floor(u + rate * (i - 1)))::BIGINT, {MAX_REPEAT}) AS copies
FROM c
"""
