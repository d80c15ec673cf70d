"""Secret scans with character Markov models (operator 5, native).

Three fixed patterns give the base spans.  Beside them, two first-order
Markov models of characters are trained from labelled samples: random
strings and ordinary identifiers.  A run of identifier characters is a secret
when the log-likelihood ratio of the two models, summed over its characters,
exceeds ``min_llr``; it must mix letters and digits.  The spans that this adds
have the kind ``markov`` and overlap no base span.

Samples: (text, random) rows given by the caller, or, as in the query, drawn
from the whole corpus: values that the patterns found are random, runs of
words in lower case (a first capital and single ``_ . / -`` between words are
allowed) are ordinary.  Each distinct string counts once, so that a secret
that was copied a million times teaches no more than one.

The probability of a character after another is drawn towards its probability
anywhere, so that few samples do.  Ratios are kept as whole thousandths, so that their sums are exact.  The
texts are scanned once; the matches are written with the lengths of the
pieces between them, and the rest works on those few rows.  The counts of
pairs of characters, at most 66 x 65 rows, are joined, not collected.

Defined results: null and empty texts have no spans; null or repeated ids are
allowed, every row is scanned by itself; without samples no span is added; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import read, written

#: Fixed patterns of the base spans, in the order of the kinds; a match of
#: fewer characters than the number (of the group named) is dropped.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Runs that the models judge, and the shape of ordinary identifiers.
RUN, ORDINARY = r"[A-Za-z0-9+/_.=-]{16,}", r"^[A-Z]?[a-z]+([_./-][a-z]+)*$"

#: Production parameters: thousandths of a nat, and symbols (65 and the start).
MIN_LLR, SYMBOLS = 7_000, 66


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Matches by place: length of the text before it (since the match before
    it), the match and the group; one more element has the rest."""
    return F.when(text.rlike(pattern), F.arrays_zip(
        F.transform(F.split(text, pattern), F.length).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value")))


def match_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the matches of each kind.  Written, so that the
    row id is fixed and the texts are scanned once."""
    t = F.col("t")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # Maximal runs shorter than the limits can't be matches that are kept.
    return written(d.select(
        "doc_id", F.monotonically_increasing_id().alias("row_id"), _matches(t, ASSIGN, 2).alias("assign"),
        _matches(t, r"AKIA[A-Z0-9]{16,}", 0).alias("access"), _matches(t, r"[0-9a-f]{24,}", 0).alias("hex"),
        _matches(t, RUN, 0).alias("markov")), "matches")


def spans_of(table: DataFrame, kind: str) -> DataFrame:
    """(row_id, rank, start, stop, found, value) of one kind."""
    found = table.where(F.col(kind).isNotNull()).select("row_id", F.posexplode(kind).alias("i", "m")).where("m.found IS NOT NULL").select(
        "row_id", "i", "m.gap", "m.found", "m.value", F.length("m.found").alias("n"))
    upto = Window.partitionBy("row_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap").cast("long") + F.col("n")).over(upto)
    out = found.select("row_id", F.lit(KINDS.index(kind)).alias("rank"), (stop - F.col("n")).alias("start"), stop.alias("stop"), "found", "value")
    return out.where(F.length("value") >= LEAST[kind]) if kind in LEAST else out


def corpus_samples(base: DataFrame, runs: DataFrame) -> DataFrame:
    """(text, random): labelled samples that the corpus gives by itself."""
    return base.select(F.col("value").alias("text"), F.lit(True).alias("random")).unionByName(
        runs.where(F.col("found").rlike(ORDINARY)).select(F.col("found").alias("text"), F.lit(False).alias("random"))).distinct()


def _pairs(strings: DataFrame) -> DataFrame:
    """The neighbouring characters of column ``text``; the first follows ''."""
    chars = strings.withColumn("c", F.split("text", ""))
    return chars.select(*strings.columns, F.explode(F.arrays_zip(
        F.concat(F.array(F.lit("")), F.slice("c", 1, F.size("c") - 1)).alias("a"), F.col("c").alias("b"))).alias("p")).select(
        *strings.columns, "p.a", "p.b")


def ratios(runs: DataFrame, samples: DataFrame) -> DataFrame:
    """(text, llr) of the distinct strings ``text``, in thousandths."""
    counts = _pairs(samples.where(F.length("text") > 0)).groupBy("a", "b").agg(
        F.sum(F.col("random").cast("long")).alias("r"), F.sum((~F.col("random")).cast("long")).alias("o"))
    after = counts.groupBy("a").agg(F.sum("r").alias("ar"), F.sum("o").alias("ao"))
    alone = counts.groupBy("b").agg(F.sum("r").alias("br"), F.sum("o").alias("bo"))
    both = counts.agg(F.sum("r"), F.sum("o")).first()
    at = lambda c: F.coalesce(F.col(c), F.lit(0))
    v = float(SYMBOLS)

    def p(c: str, k: int) -> Column:
        """log P(b after a), drawn towards P(b) where there are few samples."""
        base = (at("b" + c) + 1.0) / ((both[k] or 0) + v)
        return F.log((at(c) + base * v) / (at("a" + c) + v))

    return (_pairs(runs).join(counts, ["a", "b"], "left").join(after, "a", "left").join(alone, "b", "left")
            .groupBy("text").agg(F.sum(F.round((p("r", 0) - p("o", 1)) * 1000).cast("long")).alias("llr")))


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, min_llr: int = MIN_LLR, **columns: str) -> DataFrame:
    """(doc_id, base, added): spans (rank, start, stop) of every row, sorted."""
    table = match_table(docs, **columns)
    base = reduce(DataFrame.unionByName, (spans_of(table, k) for k in KINDS[:3]))
    runs = spans_of(table, "markov")
    samples = corpus_samples(base, runs) if samples is None else samples.select("text", "random").distinct()
    judged = runs.where(F.col("found").rlike("[A-Za-z]") & F.col("found").rlike("[0-9]"))
    secret = ratios(judged.select(F.col("found").alias("text")).distinct(), samples).where(F.col("llr") > min_llr)
    added = judged.join(secret, judged["found"] == secret["text"]).select("row_id", "rank", "start", "stop")
    spans = base.select("row_id", "rank", "start", "stop").unionByName(added).groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "rank", "stop"))).alias("spans"))
    # A row's spans come from its own text alone.
    spans = spans.select("row_id", F.filter("spans", lambda x: x["rank"] < 3).alias("base"), F.filter("spans", lambda x: x["rank"] == 3).alias("more"))
    free = F.filter("more", lambda x: ~F.exists("base", lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"])))
    none = F.array().cast("array<struct<start:bigint,rank:int,stop:bigint>>")
    return table.select("doc_id", "row_id").join(spans.select("row_id", "base", free.alias("added")), "row_id", "left").select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def _shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["stop"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with the base patterns' values replaced by ``mark``."""
    text = F.regexp_replace("text", r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", mark)
    return docs.withColumn("text", F.regexp_replace(text, ASSIGN.replace("]+)", "]{6,})"), "$1=" + mark))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda x: x["rank"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_shown(F.col("base")), 256).alias("base_sha256"),
        _shown(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_markov"))


def _sql_kind(kind: str, pattern: str, group: int, flags: str = "") -> str:
    p = pattern.replace("'", "''")
    options = f", '{flags}'" if flags else ""
    return rf"""
{kind}_m AS (
  SELECT r, regexp_extract_all(t, '{p}', 0{options}) AS m, regexp_extract_all(t, '{p}', {group}{options}) AS g,
         string_split_regex(t, '{p}'{options}) AS s FROM d),
{kind}_s AS (
  SELECT r, {KINDS.index(kind)} AS rank, found, value, stop - length(found) AS start, stop FROM (
    SELECT r, i, m[i] AS found, g[i] AS value, sum(length(s[i]) + length(m[i])) OVER (PARTITION BY r ORDER BY i) AS stop
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {kind}_m))
  WHERE length(value) >= {LEAST.get(kind, 0)})"""


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{_sql_kind("assign", ASSIGN, 2)},
{_sql_kind("access", ACCESS, 0)},
{_sql_kind("hex", HEX, 0)},
{_sql_kind("markov", RUN, 0)},
base AS (SELECT * FROM assign_s UNION ALL SELECT * FROM access_s UNION ALL SELECT * FROM hex_s),
samples AS (
  SELECT DISTINCT value AS text, true AS random FROM base
  UNION SELECT DISTINCT found, false FROM markov_s WHERE regexp_matches(found, '{ORDINARY}')),
pairs AS (SELECT random, CASE WHEN i = 1 THEN '' ELSE text[i - 1] END AS a, text[i] AS b
          FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM samples)),
counts AS (SELECT a, b, count(*) FILTER (random) AS r, count(*) FILTER (NOT random) AS o FROM pairs GROUP BY 1, 2),
after AS (SELECT a, sum(r) AS ar, sum(o) AS ao FROM counts GROUP BY 1),
alone AS (SELECT b, sum(r) AS br, sum(o) AS bo FROM counts GROUP BY 1),
total AS (SELECT coalesce(sum(r), 0) AS tr, coalesce(sum(o), 0) AS tot FROM counts),
judged AS (SELECT * FROM markov_s WHERE regexp_matches(found, '[A-Za-z]') AND regexp_matches(found, '[0-9]')),
steps AS (SELECT text, CASE WHEN i = 1 THEN '' ELSE text[i - 1] END AS a, text[i] AS b
          FROM (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM (SELECT DISTINCT found AS text FROM judged))),
llr AS (
  SELECT text, sum(round((
    ln((coalesce(r, 0) + (coalesce(br, 0) + 1.0::DOUBLE) / (tr + {SYMBOLS}.0::DOUBLE) * {SYMBOLS}.0::DOUBLE) / (coalesce(ar, 0) + {SYMBOLS}.0::DOUBLE))
    - ln((coalesce(o, 0) + (coalesce(bo, 0) + 1.0::DOUBLE) / (tot + {SYMBOLS}.0::DOUBLE) * {SYMBOLS}.0::DOUBLE) / (coalesce(ao, 0) + {SYMBOLS}.0::DOUBLE))) * 1000)::BIGINT) AS llr
  FROM steps LEFT JOIN counts USING (a, b) LEFT JOIN after USING (a) LEFT JOIN alone USING (b), total GROUP BY 1),
added AS (
  SELECT j.* FROM judged j JOIN llr ON j.found = llr.text AND llr.llr > {MIN_LLR}
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = j.r AND b.start < j.stop AND j.start < b.stop)),
spans AS (
  SELECT r, rank, start, ['{"', '".join(KINDS)}'][rank + 1] || ':' || start || ':' || stop AS s
  FROM (SELECT r, rank, start, stop FROM base UNION ALL SELECT r, rank, start, stop FROM added))
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
       count(*) FILTER (rank = 2) AS n_hex, sha256(coalesce(string_agg(s, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(s, ',' ORDER BY start, rank), '') AS spans, count(*) FILTER (rank = 3) AS n_markov
FROM d LEFT JOIN spans USING (r) GROUP BY d.r
"""
