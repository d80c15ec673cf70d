"""Quality rules: cross-document line frequency (operator 1, native).

Lines are normalised (lower case, runs of white space as one space, trimmed)
and hashed.  Per host the distinct documents that hold a line are counted; a
line found in more than ``min_docs`` documents and in more than
``max_share`` of the host's documents is boilerplate and is removed.  A
document that keeps less than ``min_kept`` of its words is depleted and
rejected.  Exact copies of a text count as one document, so that a page is
not taken for boilerplate of itself.  The query returns counts and a verdict;
``remove_frequent_lines`` returns the documents without their boilerplate.
With ``max_docs`` given, as in the query, a line in more than so many documents
is boilerplate whatever its share, for hosts with very many documents.

Beside that the fixed base rules of a document are measured.

The texts are scanned once; what follows works on a written table with one
narrow row per document (line hashes and word counts, no text).

Defined results: a null text has no words and no lines (base rules fail it);
null hosts form one host; null or repeated ids are allowed, every input row
is judged by itself; lines without a word are neither counted nor removed;
an empty table gives an empty result; columns other than the three named
ones are not read.  Hash collisions: line hashes have 64 bits, so that two
given lines meet with probability 2^-64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import SPACES, read, words, written

#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, SYMBOLS = 50, 50, r"[#*$%&|<>]"

#: Production parameters of the method.
MIN_DOCS, MAX_SHARE_PERCENT, MIN_KEPT_PERCENT, MAX_DOCS = 25, 1, 30, 5_000

_LINE = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.IntegerType())]))


def _repeat_words(spans: Column, ordered: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text.

    ``spans`` has the hash of each window by position; ``ordered`` has
    (hash, position) sorted, or null where no hash repeats.
    """
    same = lambda p, i, d: F.get(ordered, i + d)["h"] == p["h"]
    covered = F.flatten(F.transform(ordered, lambda p, i: F.when(
        F.coalesce(same(p, i, -1), F.lit(False)) | F.coalesce(same(p, i, 1), F.lit(False)),
        F.array(p["i"], p["i"] + 1, p["i"] + 2)).otherwise(F.array().cast("array<int>"))))
    return F.when(ordered.isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("long")


def line_table(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: the base measures, and its lines' hashes with
    their word counts.  Written, so that the row id is fixed."""
    t = F.col("t")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("t"))
    d = d.select("doc_id", "host", "t", words(t).alias("w"),
                 F.filter(F.split(F.coalesce(t, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    w = F.col("w")
    d = d.select(
        "doc_id", "host", F.xxhash64("t").alias("text_hash"),
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.coalesce(F.length("t") - F.length(F.regexp_replace(t, SYMBOLS, "")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(
            F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).alias("spans"),
        F.transform("l", lambda x: F.struct(
            F.xxhash64(F.trim(F.lower(F.regexp_replace(x, SPACES, " ")))).alias("h"),
            F.size(words(x)).alias("n"))).cast(_LINE).alias("lines"))
    d = d.select("*", F.when(F.size(F.array_distinct("spans")) < F.size("spans"), F.sort_array(F.transform(
        "spans", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("ordered"))
    d = d.select("doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                 _repeat_words(F.col("spans"), F.col("ordered")).alias("n_repeat_words"), "lines",
                 F.monotonically_increasing_id().alias("row_id"))
    return written(d, "lines")


def frequent_lines(table: DataFrame, min_docs: int, max_share_percent: int, max_docs: int | None = None) -> DataFrame:
    """(host, h, docs) of the lines above the limits.

    Both counts are over distinct texts; a very common line is reduced in
    each task before it meets in one place.
    """
    held = (table.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
            .distinct().groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > (min_docs if max_docs is None else min(min_docs, max_docs))))
    hosts = table.select("host", "text_hash").distinct().groupBy(F.col("host").alias("of")).agg(F.count("*").alias("host_docs"))
    above = F.col("docs") * 100 > F.col("host_docs") * max_share_percent
    if max_docs is not None:
        above = (above & (F.col("docs") > min_docs)) | (F.col("docs") > max_docs)
    return held.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(above).select("host", "h", "docs")


def line_frequency_rules(docs: DataFrame, min_docs: int = MIN_DOCS, max_share_percent: int = MAX_SHARE_PERCENT,
                         min_kept_percent: int = MIN_KEPT_PERCENT, max_docs: int | None = None, **columns: str) -> DataFrame:
    """Measures and verdict of every row of ``docs`` (see the module)."""
    table = line_table(docs, **columns)
    frequent = frequent_lines(table, min_docs, max_share_percent, max_docs).select(F.col("host").alias("of"), F.col("h").alias("is"))
    held = table.select("row_id", "host", F.explode("lines").alias("line")).select("row_id", "host", "line.h", "line.n")
    removed = (held.join(frequent, (F.col("h") == F.col("is")) & F.col("host").eqNullSafe(F.col("of")))
               .groupBy("row_id").agg(F.sum("n").cast("long").alias("gone"), F.count("*").alias("gone_lines")))
    out = table.drop("lines", "text_hash").join(removed, "row_id", "left")
    n, gone = F.col("n_words"), F.coalesce("gone", F.lit(0)).cast("long")
    base_failed = (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT)
    return out.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & ((n - gone) * 100 >= n * min_kept_percent)).alias("kept"),
        gone.alias("n_boilerplate_words"), F.coalesce("gone_lines", F.lit(0)).cast("long").alias("n_boilerplate_lines"))


def remove_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_share_percent: int = MAX_SHARE_PERCENT, max_docs: int | None = None,
                          text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the boilerplate lines cut out of the texts; texts without
    one stay as they are."""
    d = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    frequent = frequent_lines(line_table(d, text, host, doc_id), min_docs, max_share_percent, max_docs).select(F.col("host").alias("_of"), F.col("h").alias("_is"))
    split = F.split(F.col(text), "\n")
    held = d.select("_row", F.col(host).alias("_host"), F.posexplode(F.transform(split, lambda x: F.when(
        x.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(F.trim(F.lower(F.regexp_replace(x, SPACES, " "))))))).alias("_at", "_h"))
    gone = (held.join(frequent, (F.col("_h") == F.col("_is")) & F.col("_host").eqNullSafe(F.col("_of")))
            .groupBy("_row").agg(F.collect_set("_at").alias("_gone")))  # at most a text's own lines
    out = d.join(gone, "_row", "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "_gone")
    rest = F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n")
    return out.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(rest)).select(*docs.columns)


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency_rules(read(spark, sf_dir, "documents"), max_docs=MAX_DOCS).drop("host")


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (
  SELECT r, source, text, regexp_replace(unnest(string_split(t, chr(10))), '[\x20\x09-\x0D]+', ' ', 'g') AS shown,
         unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (
  SELECT r, source, text, line, trim(lower(shown)) AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
spans AS (
  SELECT r, unnest(range(0, len(w) - 2)) AS i,
         unnest([w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3] FOR k IN range(0, len(w) - 2)]) AS s FROM w WHERE len(w) >= 3),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM spans),
repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE c > 1) GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
frequent AS (
  SELECT a.source, a.norm FROM (SELECT source, norm, count(DISTINCT text) AS docs FROM lines GROUP BY 1, 2) a
  JOIN (SELECT source, count(DISTINCT text) AS docs FROM documents GROUP BY 1) b ON a.source IS NOT DISTINCT FROM b.source
  WHERE (a.docs > {MIN_DOCS} AND a.docs * 100 > b.docs * {MAX_SHARE_PERCENT}) OR a.docs > {MAX_DOCS}),
gone AS (
  SELECT r, sum(n) AS n, count(*) AS k FROM lines a
  JOIN frequent b ON a.norm = b.norm AND a.source IS NOT DISTINCT FROM b.source GROUP BY r),
m AS (
  SELECT w.r, w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
         length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
         coalesce(gone.n, 0)::BIGINT AS n_boilerplate_words, coalesce(gone.k, 0)::BIGINT AS n_boilerplate_lines
  FROM w JOIN d USING (r) LEFT JOIN dup USING (r) LEFT JOIN repeats USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND (n_words - n_boilerplate_words) * 100 >= n_words * {MIN_KEPT_PERCENT} AS kept,
       n_boilerplate_words, n_boilerplate_lines
FROM m
"""
