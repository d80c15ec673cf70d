"""Line deduplication by winnowing over line hashes (operator 3).

The lines of a document that hold a word are normalised (lower case, runs of
white space as one space, trimmed) and hashed.  From every ``window``
consecutive line hashes the smallest (the last of equal ones) is selected, so
that two runs of ``window`` equal lines always select the same line: a
guaranteed fingerprint.  Positions are joined by fingerprint; around each
position whose fingerprint is found elsewhere too, the windows that selected it
are compared as whole sequences, which extends the match line by line both
ways.  A window that occurs earlier is repeated, and the lines of later
repeated runs are deleted.  Earlier means a smaller id, or the same document
and a smaller line number.  Lines without a word belong to no run and stay.

So a line goes if it lies in ``window`` or more consecutive lines that occur, as
a sequence, at an earlier place.  With ``min_words`` given, as in the query, two
more matches count, which have less than ``window`` lines: a run of lines that
together have ``min_words`` words or more and occur, as a sequence, at an
earlier place, and a whole document that is equal to an earlier whole document.
Such runs are their own fingerprints.  Repeats of one or two lines with fewer
words are kept: a short line that many pages hold is no passage.

Fingerprints and sequences are counted and reduced to their first place in
each task before they meet; the joins that bring places back are left to the
engine's skew handling, so a line that a third of all documents hold is split.

Defined results: a null text stays null and has no lines; a null id comes
after all others; of rows that repeat an id and a text the one read first is
the earlier one; an empty table gives an empty result; other columns are not
read.  Lines and sequences are compared by 64-bit hashes: two given ones meet
by chance with probability 2^-64.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import SPACES, read, words, written

#: Production parameters: lines in a window, the shortest run that is found
#: whatever its words; words of a shorter run.
WINDOW, MIN_WORDS = 3, 50


def _line_hashes(lines: Column, counted: bool = False) -> Column:
    """(line number, hash, and if ``counted`` words) of the lines that hold a word."""
    hashed = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.when(
        x.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(F.trim(F.lower(F.regexp_replace(x, SPACES, " "))))).alias("h"),
        *([F.size(words(x)).alias("n")] if counted else [])))
    return F.filter(hashed, lambda x: x["h"].isNotNull())


def winnowed(table: DataFrame, window: int) -> DataFrame:
    """(row_id, first, mark, print, run): every window of a row by the place
    (among the row's lines) where it starts, the place it selects, the
    fingerprint there, and the hash of its sequence."""
    h = lambda i: F.get("lines", i)["h"]
    starts = F.sequence(F.lit(0), F.size("lines") - window)
    w = F.transform(starts, lambda i: F.struct(
        i.alias("first"),
        # Smallest hash; of equal ones the last place.
        F.least(*[F.struct(h(i + k).alias("print"), (-(i + k)).alias("at")) for k in range(window)]).alias("low"),
        F.xxhash64(*[h(i + k) for k in range(window)]).alias("run")))
    w = table.where(F.size("lines") >= window).select("row_id", "doc_id", F.explode(w).alias("w"))
    return w.select("row_id", "doc_id", "w.first", (-F.col("w.low.at")).alias("mark"), F.col("w.low.print").alias("print"), "w.run")


def short_runs(table: DataFrame, window: int, min_words: int) -> DataFrame:
    """(row_id, doc_id, first, size, run): the runs of less than ``window``
    lines that have ``min_words`` words, and the whole rows of so few lines.

    A run whose lines all have ``min_words`` words by themselves is left out:
    where it is repeated, so is each of them.
    """
    line = lambda i: F.get("lines", i)
    few = lambda i: line(i)["n"] < min_words

    def of(k: int) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size("lines") - k), lambda i: F.struct(
            i.alias("first"), F.lit(k).alias("size"), sum((line(i + j)["n"] for j in range(1, k)), line(i)["n"]).alias("n"),
            (F.lit(k == 1) | functools.reduce(operator.or_, (few(i + j) for j in range(k)))).alias("needed"),
            F.xxhash64(F.lit(k), *[line(i + j)["h"] for j in range(k)]).alias("run")))
        return F.when(F.size("lines") >= k, F.filter(runs, lambda x: (x["n"] >= min_words) & x["needed"]))
    whole = F.when((F.size("lines") < window) & F.exists("lines", lambda x: x["n"] < min_words), F.array(F.struct(
        F.lit(0).alias("first"), F.size("lines").alias("size"), F.lit(0).alias("n"), F.lit(True).alias("needed"),
        F.xxhash64(F.lit(0), F.transform("lines", lambda x: x["h"])).alias("run"))))
    none = F.array().cast("array<struct<first:int,size:int,n:int,needed:boolean,run:bigint>>")
    r = table.where(F.size("lines") > 0).select("row_id", "doc_id", F.explode(F.concat(*[F.coalesce(x, none) for x in (*map(of, range(1, window)), whole)])).alias("r"))
    return r.select("row_id", "doc_id", "r.first", "r.size", "r.run")


def repeated_lines(table: DataFrame, window: int = WINDOW, min_words: int | None = None) -> DataFrame:
    """(row_id, covered): line numbers that later repeated runs cover."""
    w = winnowed(table, window)
    places = w.select("print", "row_id", "mark").distinct().groupBy("print").agg(F.count("*").alias("c")).where("c > 1")
    near = w.join(places.select("print"), "print")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id", "first")
    known = near.groupBy("run").agg(F.min(place).alias("earliest"), F.count("*").alias("c")).where("c > 1")
    later = near.join(known.select("run", "earliest"), "run").where(place != F.col("earliest"))
    starts = later.groupBy("row_id").agg(F.collect_set("first").alias("starts"))  # at most a row's own lines
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + window - 1))))
    starts = starts.select("row_id", covered.alias("covered"))
    if min_words is None:
        return starts
    runs = short_runs(table, window, min_words)
    known = runs.groupBy("run").agg(F.min(place).alias("earliest"), F.count("*").alias("c")).where("c > 1")
    later = runs.join(known.select("run", "earliest"), "run").where(place != F.col("earliest"))
    both = starts.unionByName(later.select("row_id", F.sequence(F.col("first"), F.col("first") + F.col("size") - 1).alias("covered")))
    return both.groupBy("row_id").agg(F.array_distinct(F.flatten(F.collect_set("covered"))).alias("covered"))


def dedupe_lines(docs: DataFrame, window: int = WINDOW, min_words: int | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, n_runs) of every row of ``docs``."""
    t = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_id"))
    t = written(t.select("*", _line_hashes(F.split(F.coalesce("text", F.lit("")), "\n"), min_words is not None).alias("lines")), "line-hashes")
    gone = repeated_lines(t.select("row_id", "doc_id", "lines"), window, min_words)
    out = t.join(gone, "row_id", "left").withColumn("covered", F.array_sort("covered"))
    # Places among the lines with a word, to line numbers.
    cut = F.transform("covered", lambda k: F.get("lines", k)["i"])
    out = out.select("doc_id", "text", F.size("lines").cast("long").alias("n_lines"), cut.alias("cut"), "covered",
                     F.when(F.col("covered").isNotNull(), F.split("text", "\n")).alias("shown"))
    left = F.array_except(F.sequence(F.lit(0), F.size("shown") - 1), "cut")
    kept = F.array_join(F.transform(left, lambda i: F.get("shown", i)), "\n")
    breaks = F.size(F.filter("covered", lambda k, i: F.coalesce(F.get("covered", i - 1) != k - 1, F.lit(True))))
    return out.select(
        "doc_id", F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept).alias("text"), "n_lines",
        F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut")).cast("long").alias("n_removed"),
        F.when(F.col("cut").isNull(), 0).otherwise(breaks).cast("long").alias("n_runs"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_lines(read(spark, sf_dir, "documents"), min_words=MIN_WORDS).select(
        "doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (
  SELECT r, doc_id, i, x, regexp_matches(x, '[^\x20\x09-\x0D]') AS word,
         trim(lower(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
  FROM (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS x, unnest(range(0, len(string_split(t, chr(10))))) AS i FROM d)),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) AS p, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM l WHERE word),
w AS (
  SELECT r, doc_id, p, [norm, {', '.join(f'lead(norm, {k}) OVER o' for k in range(1, WINDOW))}] AS run, lead(p, {WINDOW - 1}) OVER o IS NOT NULL AS whole
  FROM n WINDOW o AS (PARTITION BY r ORDER BY p)),
o AS (SELECT r, p, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS LAST, r, p) AS k FROM w WHERE whole),
short AS (
  SELECT r, doc_id, p, 1 AS size, 'run' AS kind, [norm] AS run FROM n WHERE words >= {MIN_WORDS}
  UNION ALL SELECT r, doc_id, p, 2, 'run', [norm, norm2] FROM (
    SELECT *, lead(norm) OVER q AS norm2, words + lead(words) OVER q AS together FROM n WINDOW q AS (PARTITION BY r ORDER BY p)) WHERE together >= {MIN_WORDS}
  UNION ALL SELECT r, any_value(doc_id), 1, count(*), 'row', list(norm ORDER BY p) FROM n GROUP BY r HAVING count(*) < {WINDOW}),
s AS (SELECT r, p, size, row_number() OVER (PARTITION BY kind, run ORDER BY doc_id NULLS LAST, r, p) AS k FROM short),
gone AS (SELECT DISTINCT r, unnest(range(p, p + {WINDOW})) AS p FROM o WHERE k > 1
         UNION SELECT r, unnest(range(p, p + size)) FROM s WHERE k > 1),
runs AS (SELECT r, count(*) AS n, count(*) FILTER (b IS NULL OR p - b > 1) AS k FROM (
  SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS b FROM gone) GROUP BY r),
kept AS (
  SELECT l.r, string_agg(l.x, chr(10) ORDER BY l.i) AS t FROM l LEFT JOIN n ON n.r = l.r AND n.i = l.i
  LEFT JOIN gone ON gone.r = n.r AND gone.p = n.p WHERE gone.p IS NULL GROUP BY l.r),
c AS (SELECT r, count(*) AS n FROM n GROUP BY r)
SELECT doc_id, coalesce(c.n, 0)::BIGINT AS n_lines, coalesce(runs.n, 0)::BIGINT AS n_removed, coalesce(runs.k, 0)::BIGINT AS n_runs,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN c USING (r) LEFT JOIN runs USING (r) LEFT JOIN kept USING (r)
"""
