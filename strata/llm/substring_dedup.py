"""Substring deduplication by an index of phrases (operator 2).

Phrases are windows of ``window`` words.  Each phrase of a document is answered
with the smallest id that has it; neighbouring phrases with the same, earlier
id become a factor.  Where one factor ends, the phrases that reach over its end
are looked up like all others, so that no repeat is lost at a factor boundary.
Factors have ``window`` words at least; their words are removed.

This stands in place of relative Lempel-Ziv parsing.  The words removed are
those of every phrase that an earlier document holds, but factors are not the
longest matches: there is no position in the earlier document, a passage from
one document gives several factors where smaller ids hold parts of it, and a
factor's phrases need not be neighbours in the earlier document.

The reference, all documents, is not scanned block by block for every
document, which would grow with the square of the corpus.  It is cut into
index blocks by the phrases' fingerprints, so that a phrase has to be looked
up in one block alone, and every block is asked by every document group:

1. Documents are dealt into groups by a hash of the id; a group sends each
   block the fingerprints of its phrases and the smallest id that has each.
2. A block merges the rows of all groups and answers each group with the
   fingerprints that more than one id has, and the smallest of all ids.
3. A group's documents, from the same shuffle as in 1, meet its answers and
   are factored.

Sizes: ``group_bytes`` of text and ``block_phrases`` bound what a task holds;
the numbers of groups and blocks follow from the size of the input.  Phrases
are compared by 64-bit fingerprints: two given phrases meet by chance with
probability 2^-64.

Defined results: null and empty texts have no words; a text shorter than a
window keeps its words; rows with a null id are kept whole and are nobody's
reference; rows that repeat an id are not earlier than each other; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import read
from strata.llm.packed_index import ANSWER_SCHEMA, INDEX_SCHEMA, answer, index_rows, lookup

#: Production parameters.
WINDOW, GROUP_BYTES, BLOCK_PHRASES = 13, 8 << 20, 1_500_000

_MULTIPLIERS = np.random.default_rng(13).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def phrases(texts: list[str | None], window: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, first word of each text, fingerprint of each
    phrase, its first word), words counted over all texts.

    ASCII white space, what ``bytes.split`` splits at, is what separates words.
    """
    words = [(t or "").encode("utf-8", "replace").split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate(([0], np.cumsum(counts)))
    n = int(first[-1])
    if n < window:
        return words, first, np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter((xxhash.xxh64_intdigest(w) for t in words for w in t), np.uint64, n)
    prints = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        prints += h[k:n - window + 1 + k] * _MULTIPLIERS[k]
    prints ^= prints >> np.uint64(31)
    prints *= np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero(np.arange(n - window + 1) + window <= np.repeat(first[1:], counts)[:n - window + 1])
    return words, first, prints[at], at


def _index(window: int, blocks: int) -> Callable[[pa.Table], pa.Table]:
    """A group's rows to one packed row for each block."""
    def run(group: pa.Table) -> pa.Table:
        part, group = group["part"][0].as_py(), group.filter(pc.is_valid(group["doc_id"]))
        _, first, prints, at = phrases(group["text"].to_pylist(), window)
        return index_rows(part, prints, group["doc_id"].to_numpy()[np.searchsorted(first, at, "right") - 1], blocks)
    return run


def factors(starts: np.ndarray, sources: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(first word, words, id of the earlier document) of each factor, from
    the first words of a document's repeated phrases, ascending."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.concatenate(([True], (np.diff(starts) != 1) | (np.diff(sources) != 0))))
    last = np.append(new[1:], len(starts)) - 1
    return [(int(starts[a]), int(starts[b] - starts[a]) + window, int(sources[a])) for a, b in zip(new, last)]


_OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept string, factors array<struct<start:bigint,words:bigint,earlier:bigint>>"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
                        ("factors", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("earlier", pa.int64())])))])


def _parse(window: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        ids = group["doc_id"].to_pylist()
        words, first, prints, at = phrases(group["text"].to_pylist(), window)
        hit, earlier = lookup(answers, prints)
        own = np.array([np.iinfo(np.int64).min if i is None else i for i in ids], np.int64)
        row = np.searchsorted(first, at[hit], "right") - 1
        later = earlier < own[row]
        at, source, row = at[hit][later], earlier[later], row[later]
        edges = np.searchsorted(row, np.arange(len(ids) + 1))
        out = []
        for k, doc in enumerate(ids):
            mine = slice(edges[k], edges[k + 1])
            cut = factors(at[mine] - first[k], source[mine], window)
            keep = words[k]
            if cut:
                gone = np.zeros(len(keep), bool)
                for start, n, _ in cut:
                    gone[start:start + n] = True
                keep = [w for w, g in zip(keep, gone.tolist()) if not g]
            out.append((doc, len(words[k]), len(words[k]) - len(keep), b" ".join(keep).decode("utf-8", "replace"),
                        [{"start": a, "words": n, "earlier": e} for a, n, e in cut]))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT_ARROW)], schema=_OUT_ARROW) if out else _OUT_ARROW.empty_table()
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, factors) of every row of ``docs``."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, blocks = int(size // group_bytes) + 1, int(size // (6 * block_phrases)) + 1
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(groups)).cast("int")
    d = d.select(part.alias("part"), "doc_id", "text")
    index = d.groupBy("part").applyInArrow(_index(window, blocks), INDEX_SCHEMA)
    answers = index.groupBy("block").applyInArrow(answer, ANSWER_SCHEMA)
    return d.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_parse(window), _OUT)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("factors").cast("long").alias("n_factors"))


#: n_factors follows from the references' ids: a factor ends where the phrases
#: end or the earlier document changes.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (
  SELECT r, doc_id, unnest(range(1, len(w) - {WINDOW} + 2)) AS p,
         unnest([array_to_string(w[k:k + {WINDOW} - 1], ' ') FOR k IN range(1, len(w) - {WINDOW} + 2)]) AS g
  FROM d WHERE len(w) >= {WINDOW}),
low AS (SELECT r, doc_id, p, min(doc_id) OVER (PARTITION BY g) AS e FROM spots),
hit AS (SELECT r, p, e FROM low WHERE e < doc_id),
starts AS (SELECT r, count(*) AS n FROM (
  SELECT r, p - lag(p) OVER o AS dp, e = lag(e) OVER o AS same FROM hit WINDOW o AS (PARTITION BY r ORDER BY p)) WHERE dp IS NULL OR dp > 1 OR NOT same GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(p, p + {WINDOW})) AS q FROM hit),
kept AS (
  SELECT w.r, string_agg(w.x, ' ' ORDER BY w.q) AS t FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d) w
  LEFT JOIN gone ON gone.r = w.r AND gone.q = w.q WHERE gone.q IS NULL GROUP BY w.r),
cut AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cut.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256,
       coalesce(starts.n, 0)::BIGINT AS n_factors
FROM d LEFT JOIN kept USING (r) LEFT JOIN cut USING (r) LEFT JOIN starts USING (r)
"""
