"""Benchmark decontamination (operator 9, native).

The windows of the benchmark items (``window`` consecutive normalised words;
a shorter item is one window) are hashed into a broadcast hash set.  The
token windows of all training texts are scanned against it; each hit is
verified word by word.  A document word inside a verified window is hit.

Only the benchmark side is broadcast, and only after its windows were
counted: up to ``broadcast_windows`` of them (a few hundred bytes each).
Beyond that places and hashes of the texts' windows are shuffled, without the
words, and hits are verified against the words of the texts that have any.

Defined results: null or empty texts have no words and no hits; a null
``doc_id`` is an id like any other; rows that repeat an id are answered with
the hits of all of its rows, but are removed each by its own text; items with
equal texts are all reported; a null item id is left out of the list of items,
its windows still hit; with an empty benchmark nothing is hit; other columns
are kept (spans, documents) or not read (hits).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import ALNUM, alnum_words, fresh, read

#: Production parameters.
WINDOW, BROADCAST_WINDOWS = 10, 1_000_000


def _hash_at(w: Column, i: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(w, i + k) for k in range(n)])


def _hash_of(w: Column, i: Column, lengths: list[int]) -> Column:
    """Hash of the ``n`` words from ``i``, n being one of ``lengths``; never null."""
    out = _hash_at(w, i, lengths[-1])
    return reduce(lambda rest, n: F.when(F.col("n") == n, _hash_at(w, i, n)).otherwise(rest), lengths[:-1], out)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(h, n, gram, items): each distinct window once, with the items that
    hold it (as sorted strings; bounded by the benchmark's size)."""
    w = F.col("w")
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), alnum_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size(w), F.lit(window))
    grams = items.select("item", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.slice(w, i, n))).alias("gram"))
    return grams.groupBy("gram").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("n", F.size("gram"))


def window_hits(docs: DataFrame, windows: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, n, items) of each verified occurrence of a window.

    The texts are scanned once, whatever the lengths of the windows.  A window
    set too large to broadcast meets places and hashes alone; only what it hits
    is joined back to its text's words.
    """
    sizes = windows.groupBy("n").agg(F.count("*").alias("c")).collect()  # at most ``window`` rows
    small, lengths = sum(r["c"] for r in sizes) <= broadcast_windows, sorted(r["n"] for r in sizes) or [window]
    w, pos = F.col("w"), F.col("pos")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), alnum_words(F.col(text)).alias("w"))
    # Positions are exploded, not hashes: hashing then is compiled code over the one array of words.
    at = d.select("doc_id", "text_hash", "w", F.explode(F.when(
        F.size(w) >= lengths[0], F.sequence(F.lit(0), F.size(w) - lengths[0]))).alias("pos"))
    if len(lengths) > 1:
        at = at.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("n")).where(pos + F.col("n") <= F.size(w))
    else:
        at = at.withColumn("n", F.lit(lengths[0]))
    at, b = at.withColumn("h", _hash_of(w, pos, lengths)), windows.select(
        F.col("n").alias("bn"), _hash_of(F.col("gram"), F.lit(0), lengths).alias("bh"), "gram", "items")
    # As an equality of both sides the words would be a join key, built for every position.
    met, same = (F.col("h") == F.col("bh")) & (F.col("n") == F.col("bn")), F.array_contains(F.array("gram"), F.slice(w, pos + 1, F.col("n")))
    if small:
        hits = at.join(F.broadcast(b), met & same)
    else:
        asked = at.select("doc_id", "text_hash", "pos", "n", "h").join(b, met)
        texts = d.select("text_hash", "w").join(asked.select("text_hash").distinct(), "text_hash", "left_semi").dropDuplicates(["text_hash"])
        hits = asked.join(texts, "text_hash").where(same)
    return hits.select("doc_id", "pos", "n", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per row: doc_id, text_hash, n_words, hit word positions and item ids.

    Hits are a text's, known by its 64-bit hash: rows without an id, or that
    share one, each have those of their own text.
    """
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    hits = window_hits(texts, benchmark_windows(benchmark, window), window, broadcast_windows)
    per_text = hits.groupBy(F.col("doc_id").alias("hash")).agg(
        F.collect_set(F.struct("pos", "n")).alias("found"), F.collect_set("items").alias("items"))
    per_text = per_text.select(
        "hash", F.array_distinct(F.flatten(F.transform("found", lambda x: F.sequence(x["pos"], x["pos"] + x["n"] - 1)))).alias("hit"),
        F.array_distinct(F.flatten("items")).alias("items"))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return base.join(per_text, F.col("text_hash") == F.col("hash"), "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("hit", F.array().cast("array<int>")).alias("hit"), F.coalesce("items", none).alias("items"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window; rows are
    known by their text's 64-bit hash, whatever other rows have their id."""
    (name,) = fresh(docs, "_hit")
    text = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    hit = window_hits(text, benchmark_windows(benchmark, how.get("window", WINDOW)), **how).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, F.xxhash64("text") == F.col(name), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` with the hit words cut out of the texts: whatever is no hit
    word stays as it was, letters, punctuation and spaces alike."""
    hash_, hit = fresh(docs, "_text", "_hit")
    found = contamination(docs.select("doc_id", "text"), benchmark, **how).where(F.size("hit") > 0).select(
        F.col("text_hash").alias(hash_), F.col("hit").alias(hit)).dropDuplicates([hash_])
    joined = docs.join(found, F.xxhash64("text") == F.col(hash_), "left")
    words, between = F.regexp_extract_all("text", F.lit(ALNUM), F.lit(0)), F.split("text", ALNUM, -1)
    kept = F.transform(words, lambda w, i: F.concat(F.when(F.array_contains(F.col(hit), i), F.lit("")).otherwise(w), F.get(between, i + 1)))
    cut = F.concat(F.get(between, F.lit(0)), F.array_join(kept, ""))
    return joined.withColumn("text", F.when(F.col(hit).isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return c.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, unnest([array_to_string(w[k:k + least(len(w), {WINDOW}) - 1], ' ')
         FOR k IN range(1, len(w) - least(len(w), {WINDOW}) + 2)]) AS gram FROM b WHERE len(w) > 0),
spots AS (
  SELECT r, s.n, unnest(range(1, len(w) - s.n + 2)) AS p,
         unnest([array_to_string(w[k:k + s.n - 1], ' ') FOR k IN range(1, len(w) - s.n + 2)]) AS gram
  FROM d, (SELECT DISTINCT n FROM g) s WHERE len(w) >= s.n),
hit AS (SELECT r, p, n, item_id FROM spots JOIN g USING (n, gram)),
words_hit AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
items AS (
  SELECT r, count(*) AS n, string_agg(i, ',' ORDER BY i) AS l
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(words_hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.l, '')) AS items_sha256, coalesce(words_hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (r) LEFT JOIN items USING (r)
"""
