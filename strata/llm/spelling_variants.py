"""Spelling variant grouping by reduced alphabets (operator 12).

Words are near if they differ by one inserted, deleted or replaced code point.
Letters are hashed to a few symbols.  Near words have reduced words that are
equal or near, so the one-edit neighbourhood of a word's reduced word is
joined with the vocabulary's reduced words, and what meets is verified on the
words themselves.

Neighbourhoods.  Of two reduced words that differ by an inserted symbol the
longer one gives its deletions; of two that differ by a replaced symbol the one
with the higher symbol there gives the replacement.  So the two words of a
pair cover the full neighbourhood between them, and each pair meets once.  A
neighbour is a 64-bit polynomial hash, made from the sums before and after the
edit: no neighbour is spelled out, and a word of 30,000 letters costs as many
hashes, not as many copies.  Hashes that meet by chance are verified away.

The number of symbols follows from the vocabulary, V ** 0.15 and 4 at least:
the words of a reduced word stay few as the vocabulary grows, and a word has
about length * (1 + symbols / 2) neighbours.

Keys.  A word travels as a 64-bit key; its upper half is the parity of the
word's letters, hashed to 32 bits.  Near words differ in two of these bits at
most, which drops most pairs that meet by their reduced words alone.  Words
that share a key are only candidates more.

Counts.  Tasks count words in a table of ``flush`` words at most before they
shuffle, so that a frequent word is one row of a task; ``written`` tables
between the steps are what a lost executor costs.  A word has no more near
words than its one-edit neighbourhood, so no group grows with the table.

Defined results: null and empty texts have no words; a null id deletes no code
point (it has no text to hash); repeated rows count each time; of forms with
the same n the smallest in code-point order counts; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import read, written

#: Fixed values of the query contract.
LETTERS, SHORTEST, LEAST_N, RATIO, DELETE_AT = "A-Za-zÀ-ÿ", 7, 2, 10, 31
#: Production parameter: words that a task's table of counts holds.
FLUSH = 400_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_SYMBOLS = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_counts(ids: list[str | None], texts: list[bytes | None], counts: Counter, shortest: int = SHORTEST) -> None:
    """Add the words of texts with these ids to ``counts``."""
    runs = re.compile(rf"[{LETTERS}]{{{shortest},}}")
    for i, t in zip(ids, texts):
        found = runs.findall((t or b"").translate(_LOWER).decode("utf-8", "replace"))
        if i is None:
            counts.update(found)
            continue
        start = zlib.crc32(f"{i}:".encode())
        for run, n in Counter(found).items():
            h = zlib.crc32(run.encode(), start)
            if h % DELETE_AT == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1:]
                if len(run) < shortest:
                    continue
            counts[run] += n


def _count(shortest: int, flush: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                word_counts(part.column(0).to_pylist(), part.column(1).to_pylist(), counts, shortest)
                if len(counts) >= flush:
                    yield out()
                    counts.clear()
        yield out()
    return run


def by_length(words: list[str], cells: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points as a row each) of words of one length, in chunks."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else ():
        length = int(sizes[at[0]])
        step = max(1, cells // max(1, length))
        for k in range(0, len(at), step):
            some = at[k:k + step]
            yield some, np.frombuffer("".join(words[j] for j in some).encode("utf-32-le"), "<u4").reshape(len(some), length).astype(np.uint64)


def hashed(sums: np.ndarray, length: int) -> np.ndarray:
    x = (sums ^ (sums >> np.uint64(29))) * _ODD + np.uint64(length)
    return (x ^ (x >> np.uint64(32))) * _ODD


def powers(length: int) -> np.ndarray:
    p = np.full(length, _BASE, np.uint64)
    p[:1] = 1
    return np.cumprod(p)


def keys(words: list[str]) -> np.ndarray:
    """The key of each word: letter parities above, a hash below."""
    out = np.empty(len(words), np.uint64)
    for at, cp in by_length(words):
        bit = np.uint64(1) << ((cp * _ODD) >> np.uint64(59))
        h = hashed((cp * powers(cp.shape[1])).sum(1, dtype=np.uint64), cp.shape[1])
        out[at] = np.bitwise_xor.reduce(bit, 1) << np.uint64(32) | h >> np.uint64(32)
    return out.view(np.int64)


def reduced(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places, symbols, powers, terms, sums up to each letter), a row a word."""
    for at, cp in by_length(words):
        s = ((cp * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) * np.uint64(symbols) >> np.uint64(32)).astype(np.int64)
        p = powers(cp.shape[1])
        terms = _SYMBOLS[s] * p
        yield at, s, p, terms, np.cumsum(terms, axis=1, dtype=np.uint64)


def own_hashes(words: list[str], symbols: int) -> np.ndarray:
    """The hash of each word's reduced word."""
    out = np.empty(len(words), np.uint64)
    for at, s, _, _, sums in reduced(words, symbols):
        out[at] = hashed(sums[:, -1], s.shape[1])
    return out


def neighbours(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, hashes): the deletions of the reduced words, and the
    replacements by lower symbols."""
    for at, s, p, terms, sums in reduced(words, symbols):
        whole, length = sums[:, -1:], s.shape[1]
        gone = hashed(sums - terms + (whole - sums) * _BACK, length - 1)
        # Deleting any symbol of a run gives the same word: the last stands for all.
        row, col = np.nonzero(np.concatenate((s[:, 1:] != s[:, :-1], np.ones((len(s), 1), bool)), 1))
        yield at[row], gone[row, col]
        for t in range(symbols - 1):
            row, col = np.nonzero(s > t)
            yield at[row], hashed(whole[row, 0] + _SYMBOLS[t] * p[col] - terms[row, col], length)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys(b.column(0).to_pylist()))], names=["word", "n", "key"])


def _hashes(symbols: int, own: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, key = b.column(0).to_pylist(), b.column(1).to_numpy()
            rows = [(np.arange(len(words)), own_hashes(words, symbols))] if own else neighbours(words, symbols)
            for at, h in rows:
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key[at])], names=["h", "key"])
    return run


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least_n: int = LEAST_N, flush: int = FLUSH) -> DataFrame:
    """(word, n, key) of the words with ``least_n`` occurrences or more."""
    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    counted = d.mapInArrow(_count(shortest, flush), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)
    return written(counted.mapInArrow(_keyed, "word string, n bigint, key bigint"), "words")


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of near words of ``vocabulary`` once."""
    symbols = min(len(_SYMBOLS), max(4, int(np.ceil(vocab.count() ** 0.15))))
    w = vocab.select("word", "key")
    own = w.mapInArrow(_hashes(symbols, True), "h bigint, key bigint")
    asked = w.mapInArrow(_hashes(symbols, False), "h bigint, key bigint").select("h", F.col("key").alias("a"), F.lit(False).alias("same"))
    asked = asked.unionByName(own.select("h", F.col("key").alias("a"), F.lit(True).alias("same")))
    letters = F.bit_count(F.shiftrightunsigned(F.col("a").bitwiseXOR(F.col("b")), 32))
    # Words that share a key have no order by it; their pairs are in both orders.
    met = asked.join(own.select("h", F.col("key").alias("b")), "h").where((~F.col("same") | (F.col("a") <= F.col("b"))) & (letters <= 2)).select("a", "b")
    side = lambda k: vocab.select(F.col("key").alias(k), F.col("word").alias(f"{k}_word"), F.col("n").alias(f"{k}_n"))
    spelled = met.join(side("a"), "a").join(side("b"), "b").where(F.levenshtein("a_word", "b_word", 1) == 1)
    low, high = F.least("a_word", "b_word"), F.greatest("a_word", "b_word")
    first = F.col("a_word") < F.col("b_word")
    return spelled.select(low.alias("a"), F.when(first, F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"),
                          high.alias("b"), F.when(first, F.col("b_n")).otherwise(F.col("a_n")).alias("b_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last.

    Each round doubles the steps followed.  A form is ``ratio`` times as
    frequent as its word, so that chains are short and have no rings.
    """
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        step = written(at.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return at


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, least_n: int = LEAST_N, ratio: int = RATIO, flush: int = FLUSH) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``."""
    vocab = vocabulary(docs, shortest, least_n, flush)
    pairs = near_pairs(vocab)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
                              F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))))
    near = pairs.select(sides.alias("s")).select("s.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus_n"), "other")).alias("best"))
    is_form = -F.col("best.minus_n") >= ratio * F.col("n")
    table = written(vocab.select("word", "n").join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, -F.col("best.minus_n")).alias("form_n")), "near")
    last = roots(table.where("form IS NOT NULL"))
    return table.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


#: The crc32 is computed bit by bit for its table, then byte by byte; near
#: words are found by what is left when one code point is deleted.
SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]),
                          lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tbl
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
grouped AS (SELECT doc_id, run, count(*) AS m FROM runs WHERE length(run) >= {SHORTEST} GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, m, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''),
         lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192 + (unicode(ch)::BIGINT >> 6), 128 + (unicode(ch)::BIGINT & 63)] END)) AS bs FROM grouped),
prints AS (
  SELECT doc_id, run, m, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
spelled AS (
  SELECT m, CASE WHEN h % {DELETE_AT} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM prints),
vocab AS (SELECT word, sum(m)::BIGINT AS n FROM spelled WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(m) >= {LEAST_N}),
dels AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM dels a JOIN dels b USING (i, rest) WHERE a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT d.word, v.word FROM dels d JOIN vocab v ON d.rest = v.word
  UNION SELECT v.word, d.word FROM dels d JOIN vocab v ON d.rest = v.word),
near AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY v.n DESC, b) AS other, max(v.n) AS other_n FROM pairs JOIN vocab v ON v.word = pairs.b GROUP BY a),
formed AS (
  SELECT word, CASE WHEN other_n >= {RATIO} * n THEN other END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN other_n >= {RATIO} * n THEN other_n END::BIGINT AS form_n FROM vocab LEFT JOIN near USING (word)),
walk AS (
  SELECT word, coalesce(form, word) AS stop, form IS NOT NULL AS more FROM formed
  UNION ALL SELECT w.word, coalesce(f.form, w.stop), f.form IS NOT NULL FROM walk w JOIN formed f ON f.word = w.stop WHERE w.more)
SELECT word, form, stop AS root, n, n_near, form_n FROM formed JOIN (SELECT word, stop FROM walk WHERE NOT more) USING (word)
"""
