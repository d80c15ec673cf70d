"""MinHash near-duplicates with tensored banding (operator 11).

Documents link when their sets of distinct word shingles have a Jaccard
similarity of ``percent`` / 100 or more.

Tables.  Two collections of ``m`` hashes each take ``r`` minhashes of a set to
one half key.  A table is a pair of half keys, one of each collection: ``m * m``
tables of ``2 * r`` minhashes cost ``2 * m * r`` minhashes, where tables made
one by one would cost ``2 * r * m * m``.  Sets at similarity s share a table
with probability (1 - (1 - s^r)^m)^2: at 0.8, with r = 2 and m = 14, all but
1.3 in a million pairs; at 0.85 all but 3 in a hundred million.

Which tables are formed.  Only half keys that several sets have can be part of
a table key that several sets have.  So the half keys are counted first, and a
set forms the pairs of those that it shares: a set that shares none forms none.

Candidates are verified on full sets, as sorted arrays of 64-bit hashes:

1. Hubs.  A bucket's hub is its smallest key.  Each set is compared with the one
   hub that it meets in most buckets; links found this way join sets to groups.
   That is one comparison a set, also in a group of a million near copies.
2. Rest.  Buckets whose sets lie in different groups are still open.  Sets that
   open buckets connect are a family.  A family is cut into blocks of at most
   about ``CELL`` sets, blocks of one group or of several small groups; each
   pair of blocks is a cell of its own, but for two blocks of one group.  In a
   cell all pairs that share a half key of both collections and lie in
   different groups are compared; what leaves it is a forest of their links.

So every pair that shares a table was compared, or is connected anyway; no pair
is written that is not a link, and pages of one template that lie close but do
not link cost comparisons in many cells, not rows.  Shared half keys and
buckets are joined on single values with one row on one side, which the
engine splits where a value is hot.

Sets are known by a 64-bit key (a sum of mixed shingle hashes) and shingles by
64-bit hashes: two given ones meet by chance with probability 2^-64.  Equal
sets are one class and are compared once.

Defined results: null and empty texts have no shingles and link with nothing;
a text with fewer words than a shingle is one shingle; a null id is never the
smallest id of a component, unless it is the only one; repeated rows are
documents of the same class, rows that repeat the kept id are kept; a null id is
kept where its component has no other id; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import read, written
from strata.llm.jaccard_join import components, key_of, linked, mixed, shingles

#: Production parameters: words of a shingle, percent, minhashes of a half key,
#: half keys of a collection, sets of a block, rows of sets in a task.
N, PERCENT, R, M, CELL, CELL_ROWS = 5, 80, 2, 14, 500, 1_000

_SEEDS = np.random.default_rng(11).integers(1, 2**63, (2, 1024), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def half_keys(s: np.ndarray, r: int, m: int) -> np.ndarray:
    """The ``2 * m`` half keys of a set of shingle hashes, first those of the
    first collection."""
    n = 2 * m * r
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 4_096):
        x = (s[k:k + 4_096, None] ^ _SEEDS[0, :n]) * _SEEDS[1, :n]
        low = np.minimum(low, (x ^ (x >> np.uint64(31))).min(0))
    out = np.arange(2 * m, dtype=np.uint64)
    for k in range(r):
        out = mixed(out + low[k::r], 0)
    return out


_TABLE = "doc_id bigint, text_hash bigint, key bigint, n bigint, halves array<bigint>"


def _describe(n: int, r: int, m: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(key_of(s), len(s), half_keys(s, r, m).view(np.int64) if len(s) else None) for s in (shingles(t.as_py(), n) for t in b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()),
                 pa.array([x[2] for x in rows], pa.list_(pa.int64()))], names=["doc_id", "text_hash", "key", "n", "halves"])
    return run


def _sets(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, n, halves, text) with the shingles in the text's place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                packed = pa.array([shingles(t.as_py(), n).tobytes() for t in b.column(3)], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], packed], names=["key", "n", "halves", "shingles"])
    return run


def buckets(sets: DataFrame, m: int = M) -> DataFrame:
    """(bucket, key): the table keys that several sets have, and these sets."""
    half = sets.select("key", F.posexplode("halves").alias("place", "half")).select("key", (F.col("place") < m).alias("first"), "half")
    common = half.groupBy("half").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("half")
    own = half.join(common, "half").groupBy("key").agg(
        F.collect_list(F.when(F.col("first"), F.col("half"))).alias("one"), F.collect_list(F.when(~F.col("first"), F.col("half"))).alias("two"))
    pair = own.select("key", F.explode("one").alias("a"), "two").select("key", "a", F.explode("two").alias("b"))
    rows = written(pair.select(F.xxhash64("a", "b").alias("bucket"), "key"), "buckets")
    shared = rows.groupBy("bucket").agg(F.min("key").alias("hub"), F.max("key").alias("hi")).where("hub < hi").select("bucket", "hub")
    return written(rows.join(shared, "bucket").select("bucket", "hub", "key"), "shared")


def _verify(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, second = (b.column(k).to_pylist() for k in (2, 3))
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(first, second)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))
    return run


def hub_links(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of the sets with the hub that each meets most often."""
    most = met.where("hub < key").groupBy("key", "hub").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.max(F.struct("c", (-F.col("hub")).alias("minus_hub"))).alias("best"))
    pairs = most.select(F.col("key").alias("a"), (-F.col("best.minus_hub")).alias("b"))
    side = lambda k: sets.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("shingles").alias(f"s_{k}"))
    # Sets are read once for the pairs and once for the hubs, of which there are fewer.
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(
        100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "s_a", "s_b")
    return both.mapInArrow(_verify(percent), "a bigint, b bigint")


def cell_links(rows: pa.Table, m: int, percent: int) -> pa.Table:
    """Members (cell, block, key, root, halves, shingles) of cells to a forest
    of the links between their roots: within a block, or of two blocks."""
    left, right = [], []
    cells = rows["cell"].to_numpy()
    order = np.lexsort((rows["key"].to_numpy(), cells))
    rows, cells = rows.take(pa.array(order)), cells[order]
    key, root, block = (rows[c].to_numpy() for c in ("key", "root", "block"))
    edges = np.append(np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))), len(cells))
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a < 2:
            continue
        halves = np.array(rows["halves"].slice(a, b - a).to_pylist(), np.int64)
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"].slice(a, b - a).to_pylist()]
        size = np.fromiter(map(len, sets), np.int64, b - a)
        names, of = np.unique(root[a:b], return_inverse=True)
        top, which = np.arange(len(names)), block[a:b]  # the group of each root, joined as links are found
        two = which.min() != which.max()
        for i in range(b - a - 1):
            others = np.arange(i + 1, b - a)
            others = others[(top[of[others]] != top[of[i]]) & ((which[others] != which[i]) | (not two))]
            others = others[100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])]
            same = halves[others] == halves[i]
            for j in others[same[:, :m].any(1) & same[:, m:].any(1)].tolist():
                if top[of[i]] != top[of[j]] and linked(sets[i], sets[j], percent):
                    top[top == top[of[j]]] = top[of[i]]
                    left.append(key[a + i])
                    right.append(key[a + j])
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _cell(m: int, percent: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        return cell_links(rows, m, percent)
    return run


def rest_links(met: DataFrame, links: DataFrame, sets: DataFrame, m: int, percent: int, cell: int) -> DataFrame:
    """(a, b): links between sets that ``links`` leaves apart in a bucket."""
    placed = met.join(components(links), "key", "left").withColumn("root", F.coalesce("root", "key"))
    placed = written(placed.select("bucket", "key", "root"), "placed")
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("key").alias("hub")).where("lo < hi").select("bucket", "hub")
    apart = written(placed.join(open_, "bucket").select("hub", "key", "root").distinct(), "apart")
    family = components(apart.select(F.col("hub").alias("a"), F.col("key").alias("b")))
    named = family.withColumnRenamed("root", "family")
    members = written(apart.select("key", "root").distinct().join(named, "key", "left").select(
        F.coalesce("family", "key").alias("family"), "key", "root"), "members")
    # Blocks: a large group's own, or shared by small groups.
    groups = members.groupBy("family", "root").agg(F.count("*").alias("c"))
    small = groups.where(F.col("c") < cell).groupBy("family").agg(F.ceil(F.sum("c") / cell).cast("int").alias("pools"))
    groups = groups.join(small, "family", "left")
    own = F.col("c") >= cell
    member = members.join(groups, ["family", "root"]).select(
        "family", "key", "root",
        F.when(own, F.xxhash64("root", F.pmod(F.xxhash64("key"), F.ceil(F.col("c") / cell)))).otherwise(F.xxhash64(F.pmod(F.xxhash64("root"), F.col("pools")))).alias("block"),
        F.when(own, F.col("root")).alias("only"))
    member = written(member, "blocks")
    blocks = member.groupBy("family", "block").agg(F.min("only").alias("only"))
    other = blocks.select("family", F.col("block").alias("other"), F.col("only").alias("other_only"))
    cells = blocks.join(other, "family").where("block <= other AND NOT (only <=> other_only AND only IS NOT NULL)")
    one = cells.select(F.xxhash64("family", "block", "other").alias("cell"), "family", F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    tasks = int(member.count() // CELL_ROWS) + 1
    # Cells of few sets share a task.
    rows = one.join(member, ["family", "block"]).join(sets.select("key", "halves", "shingles"), "key").select(
        F.pmod("cell", F.lit(64 * tasks)).alias("task"), "cell", "block", "key", "root", "halves", "shingles")
    return rows.groupBy("task").applyInArrow(_cell(m, percent), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT, r: int = R, m: int = M, cell: int = CELL) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept, class_id) of every row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = written(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_describe(n, r, m), _TABLE), "sets")
    whole = table.where("n > 0")
    # One row stands for the rows of an equal set: ids and hashes say which.
    one = whole.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n", "halves")).alias("r")).select("key", "r.*")
    one = written(one, "nodes")
    met = buckets(one, m)
    asked = met.select("key").distinct().join(one, "key").withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(
        asked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).select("key", "n", "halves", "text")
    sets = written(texts.dropDuplicates(["key"]).mapInArrow(_sets(n), "key bigint, n bigint, halves array<bigint>, shingles binary"), "candidates")
    first = written(hub_links(met, sets, percent), "links")
    more = written(rest_links(met, first, sets, m, percent, cell), "links")
    roots = components(first.unionByName(more))
    rooted = whole.select("doc_id", "text_hash", "n", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rooted.join(ids, "root").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", F.col("key").alias("class_id"))
    alone = table.where("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("class_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_minhash_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), n=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")
