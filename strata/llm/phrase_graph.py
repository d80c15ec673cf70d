"""Phrase collocation mining on a weighted de Bruijn graph (operator 13).

The graph of a language: nodes are the three-word sequences inside pieces of
text, edges the four-word sequences, weighted by how often they occur; an edge
leads from its first three words to its last three.

Counts.  Every word of a text starts one window: the edge there or, at a
piece's end, the three, two or one words that are left.  Only windows are
counted.  The count of a node is the flow out of it plus the pieces that end
there (windows of three words); so a three-word count is the sum over the edges
that begin with it and a correction, a two-word count the sum over nodes, and a
word's count the sum over pairs.

Unary paths.  Where a node's only edge in and only edge out carry its whole
count, no piece starts, ends or branches there, and the edges are one path.
``phrase_paths`` compacts such edges by pointer doubling; a path is a longer
phrase with one count.  (Rings can't occur: a piece that enters one has to
start or leave somewhere.)

Pruning.  A first pass over the texts adds up hashed counters of words and word
pairs, ``bits`` by the size of the input and at most 2 ** MOST_BITS bytes, and
keeps one bit of each: whether it reaches ``least``.  A counter is never below
the counts of what hashes to it.  A window ends early at a pair that can't
reach ``least``, like at a piece's end: no phrase that reaches ``least`` holds
that pair, and neither do its parts, so their counts stay exact.  The bits are
the only thing that is broadcast, 8 MB at most; where the input outgrows them
they prune less and change nothing.

Tasks count the windows of ``flush`` tokens before they shuffle, so a frequent
window is one row of a batch.  The first ``top`` phrases of a language are
taken in slices by phrase first, so that no task sorts all its phrases.

Defined results: null and empty texts have no words; a null language is
``und``; repeated rows count each time; other columns, ids among them, are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import read, written

#: Fixed values of the query contract.
LEAST, TOP, SCALE, INSIDE = 30, 2_000, 2_000_000, 80
#: Production parameters: tokens of a task's batch, counters, slices of the
#: counters, tasks merged at once, slices of a language's ranking.
FLUSH, LEAST_BITS, MOST_BITS, SLICES, FAN_IN, RANK_SLICES = 2_000_000, 16, 26, 64, 64, 64

_STOP = b"\xff"  # no byte of UTF-8: marks the end of a piece
_MAP = bytes(c + 32 if 65 <= c <= 90 else 0xFF if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text, and ``_STOP`` where a piece ends."""
    t = text or b""
    if not t.isascii():
        t = t.decode("utf-8", "replace").encode()
    return t.translate(_MAP).replace(_STOP, b" \xff ").split()


def hashed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


class _Ids(dict):
    """Numbers words as they come; the end of a piece is 0."""

    def __init__(self) -> None:
        super().__init__({_STOP: 0})

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        return k


class Batch:
    """The tokens of one language, up to the next flush."""

    def __init__(self, lang: str) -> None:
        self.lang, self.known, self.parts, self.size = lang, _Ids(), [], 0

    def add(self, text: bytes | None) -> int:
        t = tokens(text)
        t.append(_STOP)
        self.parts.append(np.fromiter(map(self.known.__getitem__, t), np.int64, len(t)))
        self.size += len(t)
        return len(t)

    def ids(self) -> np.ndarray:
        """Three ends follow the last token, so that windows need no bounds."""
        return np.concatenate([*self.parts, np.zeros(3, np.int64)])

    def prints(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(counter of each known word, counter of each pair of neighbours)."""
        seed = xxhash.xxh64_intdigest(self.lang.encode())
        h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.known), np.uint64, len(self.known))
        of, down = h[self.ids()], np.uint64(64 - bits)
        return hashed(h) >> down, hashed(of[:-1] * np.uint64(3) + hashed(of[1:])) >> down


def batches_of(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[list[Batch]]:
    """Rows (lang, text) to batches by language, ``flush`` tokens at a time."""
    open_, size = {}, 0
    for b in batches:
        for k in range(0, b.num_rows, 64):
            some = b.slice(k, 64)
            for lang, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                if lang not in open_:
                    open_[lang] = Batch(lang)
                size += open_[lang].add(text)
                if size >= flush:
                    yield list(open_.values())
                    open_, size = {}, 0
    yield list(open_.values())


def _counters(bits: int, least: int, flush: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's counters, capped at what matters, as one row a slice."""
    top = min(least, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint8)
        for group in batches_of(batches, flush):
            for b in group:
                ids = b.ids()
                words, pairs = b.prints(bits)
                seen = np.concatenate((words[ids[ids > 0]], pairs[(ids[:-1] > 0) & (ids[1:] > 0)]))
                at, n = np.unique(seen, return_counts=True)
                total[at] = np.minimum(total[at] + n, top)
        yield _packed(np.split(total, SLICES), TaskContext.get().partitionId())
    return run


def _packed(slices: list[np.ndarray], task: int, first: int = 0) -> pa.RecordBatch:
    z = zstandard.ZstdCompressor(level=1)
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(slices)), pa.int32()), pa.array([task] * len(slices), pa.int64()),
                                       pa.array([z.compress(s.tobytes()) for s in slices], pa.binary())], names=["slice", "task", "packed"])


def _merge(top: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        total = 0
        for p in rows["packed"]:
            total = np.minimum(total + np.frombuffer(zstandard.decompress(p.as_py()), np.uint8).astype(np.uint16), top)
        return pa.Table.from_batches([_packed([total.astype(np.uint8)], rows["task"][0].as_py() // FAN_IN, rows["slice"][0].as_py())])
    return run


def frequent_bits(docs: DataFrame, bits: int, least: int = LEAST, flush: int = FLUSH) -> bytes:
    """One bit a counter: whether it reaches ``least``."""
    schema, top = "slice int, task bigint, packed binary", min(least, 255)
    rows = docs.mapInArrow(_counters(bits, least, flush), schema)
    tasks = docs.rdd.getNumPartitions()
    while True:
        rows = rows.groupBy("slice", F.floor(F.col("task") / FAN_IN).alias("to")).applyInArrow(_merge(top), schema)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    slices = {r["slice"]: np.frombuffer(zstandard.decompress(r["packed"]), np.uint8) >= top for r in rows.toLocalIterator()}
    return np.packbits(np.concatenate([slices.get(k, np.zeros((1 << bits) // SLICES, bool)) for k in range(SLICES)]), bitorder="little").tobytes()


def windows(b: Batch, frequent: np.ndarray, bits: int) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """(words, windows, their counts) of a batch, by the windows' length."""
    ids = b.ids()
    words, pairs = b.prints(bits)

    def reached(x: np.ndarray) -> np.ndarray:
        return (frequent[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    goes_on = reached(pairs) & (ids[:-1] > 0) & (ids[1:] > 0)
    n = len(ids) - 3
    two, three, four = goes_on[:n], goes_on[:n] & goes_on[1:n + 1], goes_on[:n] & goes_on[1:n + 1] & goes_on[2:n + 2]
    own = ids[:n] > 0
    own[own] = reached(words[ids[:n][own]])
    at = np.flatnonzero(own | two)
    # Word ids stay under 2^31, as a batch has fewer tokens.
    hi = ids[at] << 32 | np.where(two[at], ids[at + 1], 0)
    lo = np.where(three[at], ids[at + 2], 0) << 32 | np.where(four[at], ids[at + 3], 0)
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(hi)), bool), (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))
    counts, hi, lo = np.diff(np.append(starts, len(hi))), hi[starts], lo[starts]
    columns = [hi >> 32, hi & 0xFFFFFFFF, lo >> 32, lo & 0xFFFFFFFF]
    length = sum((c > 0).astype(np.int64) for c in columns)
    spelled = pa.array(["" if w == _STOP else w.decode() for w in b.known], pa.string())
    for k in range(1, 5):
        own = np.flatnonzero(length == k)
        if len(own):
            yield k, pc.binary_join_element_wise(*(spelled.take(pa.array(c[own])) for c in columns[:k]), " "), pa.array(counts[own])


def _windows(frequent: Broadcast, bits: int, flush: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (lang, words, gram, n); all word occurrences as a gram of 0 words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(frequent.value, np.uint8)
        for group in batches_of(batches, flush):
            for b in group:
                total = pa.array([sum(int((p > 0).sum()) for p in b.parts)], pa.int64())
                for k, gram, n in ((0, pa.array([""]), total), *windows(b, known, bits)):
                    yield pa.RecordBatch.from_arrays([pa.array([b.lang] * len(n)), pa.array([k] * len(n), pa.int32()), gram, n], names=["lang", "k", "gram", "n"])
    return run


def phrase_windows(docs: DataFrame, least: int = LEAST, flush: int = FLUSH) -> DataFrame:
    """(lang, k, gram, n): the edges of the graph (k = 4), the windows that
    pieces end in (k below 4), and all words of a language (k = 0)."""
    d = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(size // 48).bit_length() - 1))  # one counter for about eight words
    frequent = d.sparkSession.sparkContext.broadcast(frequent_bits(d, bits, least, flush))
    rows = d.mapInArrow(_windows(frequent, bits, flush), "lang string, k int, gram string, n bigint")
    return written(rows.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")), "windows")


def phrase_counts(edges: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, k, gram, f): sequences of one to four words, f >= ``least``."""
    level = {4: edges.where("k = 4").select("lang", "gram", F.col("n").alias("f"))}
    for k in (3, 2, 1):
        ends = edges.where(F.col("k") == k).select("lang", "gram", F.col("n").alias("f"))
        flow = level[k + 1].select("lang", F.substring_index("gram", " ", k).alias("gram"), "f")
        level[k] = flow.unionByName(ends).groupBy("lang", "gram").agg(F.sum("f").alias("f"))
    out = None
    for k, d in level.items():
        part = d.where(F.col("f") >= least).select("lang", F.lit(k).alias("k"), "gram", "f")
        out = out.unionByName(part) if out else part
    return written(out, "phrases")


def path_places(counts: DataFrame) -> DataFrame:
    """(lang, gram, head, dist): each edge's unary path, by the path's first
    edge, and the edge's place on it."""
    nodes = counts.where("k = 3").select("lang", F.col("gram").alias("node"), F.col("f").alias("flow"))
    edge = counts.where("k = 4").select("lang", "gram", "f", F.substring_index("gram", " ", 3).alias("node"))
    into = counts.where("k = 4").select("lang", F.col("gram").alias("before"), F.col("f").alias("flow"), F.substring_index("gram", " ", -3).alias("node"))
    whole = edge.join(nodes, ["lang", "node"]).where("f = flow").drop("flow")
    before = whole.join(into, ["lang", "node"]).where("f = flow").select("lang", "gram", "before")
    at = counts.where("k = 4").select("lang", "gram").join(before, ["lang", "gram"], "left")
    at = written(at.select("lang", "gram", F.coalesce("before", "gram").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("bigint").alias("dist")), "paths")
    while True:
        up = at.select("lang", F.col("gram").alias("head"), F.col("head").alias("next"), F.col("dist").alias("more"))
        step = written(at.join(up, ["lang", "head"]).select("lang", "gram", F.col("next").alias("head"), (F.col("dist") + F.col("more")).alias("dist"),
                                                           (F.col("more") > 0).alias("moved")), "paths")
        at = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return at


def phrase_paths(counts: DataFrame) -> DataFrame:
    """(lang, path, n_words, f): the compacted unary paths, as phrases.

    A path is no longer than the longest piece.
    """
    last = F.struct("dist", F.substring_index("gram", " ", -1).alias("w"))
    joined = path_places(counts).join(counts.where("k = 4").select("lang", "gram", "f"), ["lang", "gram"]).groupBy("lang", "head").agg(
        F.array_sort(F.collect_list(last)).alias("tail"), F.max("f").alias("f"))
    words = F.concat_ws(" ", F.substring_index("head", " ", 3), F.transform("tail", lambda x: x["w"]))
    return joined.select("lang", words.alias("path"), (F.size("tail") + 3).cast("bigint").alias("n_words"), "f")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE, flush: int = FLUSH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, path_words): the first ``top``
    phrases of each language; ``path_words`` is the length of the unary path
    that a phrase of four words is on, or of the phrase."""
    edges = phrase_windows(docs, least, flush)
    counts = phrase_counts(edges, least)
    whole = counts.where("k > 1").withColumnRenamed("f", "a")
    cut = whole.select("lang", "k", "gram", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).withColumn(
        "first", F.expr("substring_index(gram, ' ', cut)")).withColumn("rest", F.expr("substring_index(gram, ' ', cut - k)"))
    part = lambda g, f: counts.select("lang", F.col("gram").alias(g), F.col("f").alias(f))
    scored = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).withColumn(
        "score", F.expr(f"CAST({SCALE} AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))"))
    best = scored.groupBy("lang", "gram").agg(F.max("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    # What lies inside a longer candidate that is nearly as frequent goes.
    inner = F.expr("flatten(transform(sequence(2, k - 1), n -> transform(sequence(1, k - n + 1), i -> array_join(slice(split(gram, ' '), i, n), ' '))))")
    held = whole.where("k > 2").select("lang", F.explode(inner).alias("gram"), F.col("a").alias("f")).groupBy("lang", "gram").agg(F.max("f").alias("f"))
    left = best.join(held, ["lang", "gram"], "left").where(
        f"f IS NULL OR CAST(f AS DECIMAL(19, 0)) * 100 < CAST(a AS DECIMAL(19, 0)) * {inside}").select("lang", "gram", "a", "b.score", "b.l", "b.r")
    order = "ORDER BY score DESC, a DESC, gram"
    sliced = left.withColumn("slice", F.pmod(F.xxhash64("gram"), F.lit(RANK_SLICES)))
    sliced = sliced.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, slice {order})")).where(F.col("rank") <= top)
    ranked = sliced.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})")).where(F.col("rank") <= top)
    places = path_places(counts)
    length = places.groupBy("lang", "head").agg((F.count("*") + 3).alias("path_words"))
    on = places.join(length, ["lang", "head"]).select("lang", "gram", "path_words")
    n = edges.where("k = 0").select("lang", F.col("n").alias("n"))
    return ranked.join(n, "lang").join(on, ["lang", "gram"], "left").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), F.col("gram").alias("phrase"), "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"),
        F.coalesce("path_words", F.size(F.split("gram", " "))).cast("bigint").alias("path_words"))


def op13_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


#: Every sequence of one to four words is counted by itself.
SQL = rf"""
WITH RECURSIVE pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                     '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM split WHERE len(w) > 0),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
grams AS (
  SELECT lang, k::BIGINT AS k, array_to_string(w[p:p + k - 1], ' ') AS gram, count(*) AS f
  FROM places, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE p + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {LEAST}),
whole AS (SELECT lang, k, gram, string_split(gram, ' ') AS w, f AS a FROM grams WHERE k > 1),
cut AS (
  SELECT lang, gram, a, i AS cut, array_to_string(w[1:i], ' ') AS one, array_to_string(w[i + 1:], ' ') AS two
  FROM (SELECT *, unnest(range(1, k)) AS i FROM whole)),
scored AS (
  SELECT c.lang, c.gram, c.a, cut, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cut c JOIN grams x ON x.lang = c.lang AND x.gram = c.one JOIN grams y ON y.lang = c.lang AND y.gram = c.two),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1),
inner_grams AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS gram, max(a) AS f
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM whole WHERE k > 2)) GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.gram) AS rank
  FROM best b LEFT JOIN inner_grams i ON i.lang = b.lang AND i.gram = b.gram WHERE i.f IS NULL OR 100::HUGEINT * i.f < {INSIDE}::HUGEINT * a),
edge AS (SELECT lang, gram, f, array_to_string(string_split(gram, ' ')[1:3], ' ') AS src, array_to_string(string_split(gram, ' ')[2:4], ' ') AS dst FROM grams WHERE k = 4),
link AS (
  SELECT e.lang, b.gram AS up, e.gram AS down FROM edge e JOIN grams g ON g.k = 3 AND g.lang = e.lang AND g.gram = e.src AND g.f = e.f
  JOIN edge b ON b.lang = e.lang AND b.dst = e.src AND b.f = g.f),
walk AS (
  SELECT lang, gram AS head, gram AS spot FROM edge WHERE NOT EXISTS (FROM link WHERE link.lang = edge.lang AND link.down = edge.gram)
  UNION ALL SELECT w.lang, w.head, l.down FROM walk w JOIN link l ON l.lang = w.lang AND l.up = w.spot),
sized AS (SELECT lang, spot, count(*) OVER (PARTITION BY lang, head) + 3 AS path_words FROM walk)
SELECT r.lang, r.rank::BIGINT AS rank, r.gram AS phrase, a, l, r, t.n, score::BIGINT AS score,
       coalesce(s.path_words, len(string_split(r.gram, ' ')))::BIGINT AS path_words
FROM ranked r JOIN totals t ON t.lang = r.lang LEFT JOIN sized s ON s.lang = r.lang AND s.spot = r.gram WHERE r.rank <= {TOP}
"""
