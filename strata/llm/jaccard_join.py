"""N-gram Jaccard join on size-banded tiles (operator 10).

Two documents link when their sets of distinct word shingles have a Jaccard
similarity of ``percent`` / 100 or more.  All links between different sets are
found; equal sets are one class and are not expanded into pairs.

Tiles.  Sizes are cut into bands a factor ``BAND`` wide.  Linked sets in a
band differ in at most k shingles, k following from the band's top; so when
shingles are hashed into parts, at most k parts differ, and of a set's parts
that are not empty at least one is equal if there are more than k of them.  A
tile is (band, part, hash of the part's shingles): linked sets share one.  A
set goes to its band, and to the next one if it can link there.  A set with k
parts or fewer that are not empty also goes to the tiles of its empty parts;
the number of parts makes that rare.

Bounds.  Each set has a bitmap, the parity of the shingles that hash to a bit;
its width follows from the band.  Bits that differ between two sets count at
most once per shingle that only one of them has, so that their number bounds
the overlap from above.  The bitmaps of a tile's sets are compared where the
tile is; only pairs that pass leave it, and are compared exactly, as sorted
arrays made from the texts.

Pairs.  A group of near copies has more links than can be written down.  First
a tile gives a forest: of the pairs that pass only those that connect what is
not connected yet.  The links found are joined into components.  Then all
pairs that pass and still lie in different components are compared; as nearly
all pairs that pass are links, these are few.  So every pair that shares a tile
was bounded away, was compared, or is connected anyway, and the components are
those of all links.

Finding the tiles that are shared.  Documents are dealt into groups; groups
and index blocks exchange packed rows (see ``packed_index``), in which a tile
is one entry per group, however many sets of the group are in it.  A tile of
more than ``CELL`` sets is cut into blocks, and each pair of blocks is a cell
of its own, in a task of its own.  A key with many partners is compared in
slices of ``slice_rows``; joins on a tile or key are left to the engine's skew
handling.

Sets are known by a 64-bit key (a sum of mixed shingle hashes) and shingles by
64-bit hashes: two given ones meet by chance with probability 2^-64.

Defined results: null and empty texts have no shingles and link with nothing;
a text with fewer words than a shingle is one shingle; a null id is never the
smallest id of a component, unless it is the only one; repeated rows are
documents of the same class; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import fresh, read, written
from strata.llm.packed_index import ANSWER_SCHEMA, INDEX_SCHEMA, answer, index_rows, lookup

#: Production parameters.
N, PERCENT, SLICE_ROWS = 5, 80, 400
BAND, CELL, CELL_ROWS, GROUP_BYTES, BLOCK_TILES = 1.3, 2_000, 20_000, 3 << 20, 1_500_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[k]
    x = (x ^ (x >> np.uint64(29))) * _ODD[(k + 1) % 5]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    w = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    k = min(n, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = mixed(s + h[i:len(h) - k + 1 + i], 0)
    return np.unique(s)


def band_of(size: int) -> int:
    return int(np.floor(np.log(size) / np.log(BAND) + 1e-9))


def band_top(band: int) -> int:
    """The largest size in a band."""
    top = int(BAND ** (band + 1)) + 2
    while band_of(top) > band:
        top -= 1
    return top


def most_different(band: int, percent: int) -> int:
    """In how many shingles linked sets of a band differ at most: a share of
    (100 - p) / (100 + p) of both sizes."""
    return 2 * band_top(band) * (100 - percent) // (100 + percent)


_PARTS: dict[tuple[int, int], tuple[int, int]] = {}


def band_parts(band: int, percent: int) -> tuple[int, int]:
    """(most_different, number of parts) of a band.

    The fewest parts with which the smallest set of the band has more than
    ``most_different`` that are not empty, but for five standard deviations.
    """
    if (band, percent) in _PARTS:
        return _PARTS[band, percent]
    k = most_different(band, percent)
    n = max(1, -(-(band_top(band - 1) + 1) * percent // 100)) if band else 1
    m = k + 1
    while True:
        empty = m * (1 - 1 / m) ** n
        spread = m * (m - 1) * max(0.0, 1 - 2 / m) ** n + empty - empty * empty
        if m - empty - 5 * max(0.0, spread) ** 0.5 >= k + 1 or m >= 4 * n + k:
            return _PARTS.setdefault((band, percent), (k, m))
        m += max(1, m // 100)


def tiles(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the tiles that a set goes to."""
    if not len(s):
        return np.empty(0, np.uint64)
    own, out = band_of(len(s)), []
    # The next band's smallest size, times percent, is the smallest that links there.
    for band in (own, own + 1) if len(s) * 100 >= (band_top(own) + 1) * percent else (own,):
        k, m = band_parts(band, percent)
        if not k:
            continue  # only equal sets link: a class
        h = mixed(s, 1)
        part = ((h >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, h = part[order], mixed(h[order], 2)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums, used = np.add.reduceat(h, starts), part[starts]
        if len(used) <= k:
            full = np.zeros(m, np.uint64)
            full[used] = sums
            sums, used = full, np.arange(m)
        out.append(mixed(sums + mixed(used.astype(np.uint64) + (np.uint64(band + 1) << np.uint64(40)), 3), 4))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def bitmap(s: np.ndarray, percent: int) -> np.ndarray:
    """Parity of the shingles that hash to each bit, as 64-bit words: the
    power of two of at least 512 bits and four times what linked sets differ in."""
    bits = 512
    while len(s) and bits < 4 * most_different(band_of(len(s)), percent):
        bits *= 2
    odd = np.bincount((mixed(s, 3) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of fewer words."""
    while len(bits) > words:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


_TABLE = "doc_id bigint, text_hash bigint, key bigint, n bigint, bits array<bigint>"
_TABLE_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("bits", pa.list_(pa.int64()))])


def key_of(s: np.ndarray) -> int:
    return int(mixed(s, 0).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0


def _describe(n: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(key_of(s), len(s), bitmap(s, percent)) for s in (shingles(t.as_py(), n) for t in b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(_TABLE_ARROW)[2:]))], schema=_TABLE_ARROW)
    return run


def _group_tiles(texts: list[str | None], n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(tile, key) of the distinct sets of a group."""
    sets = {key_of(s): tiles(s, percent) for s in (shingles(t, n) for t in dict.fromkeys(texts))}
    held = [t for t in sets.values() if len(t)]
    return (np.concatenate(held) if held else np.empty(0, np.uint64)), np.repeat(
        np.array(list(sets), np.int64), np.array([len(t) for t in sets.values()], np.int64))


def _index(n: int, percent: int, blocks: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        return index_rows(group["part"][0].as_py(), *_group_tiles(group["text"].to_pylist(), n, percent), blocks)
    return run


def _shared(n: int, percent: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        tile, key = _group_tiles(group["text"].to_pylist(), n, percent) if answers.num_rows else (np.empty(0, np.uint64), np.empty(0, np.int64))
        hit, _ = lookup(answers, tile)
        return pa.table({"tile": pa.array(tile[hit].view(np.int64)), "key": pa.array(key[hit])})
    return run


def shared_tiles(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(tile, key): the tiles that hold several sets, and their sets."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, blocks = int(size // GROUP_BYTES) + 1, int(size // (10 * BLOCK_TILES)) + 1
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(groups)).cast("int")
    d = docs.select(part.alias("part"), "text")
    answers = d.groupBy("part").applyInArrow(_index(n, percent, blocks), INDEX_SCHEMA).groupBy("block").applyInArrow(answer, ANSWER_SCHEMA)
    return d.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_shared(n, percent), "tile bigint, key bigint").distinct()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compare(n: int, percent: int) -> Callable[[pa.Table], pa.Table]:
    """Rows (a, b, key, text) of one slice of a's partners to its links."""
    def run(rows: pa.Table) -> pa.Table:
        hub, texts = rows["a"][0].as_py(), dict(zip(rows["key"].to_pylist(), rows["text"].to_pylist()))
        first = shingles(texts[hub], n)
        other = sorted(k for k in texts if k != hub and linked(first, shingles(texts[k], n), percent))
        return pa.table({"a": pa.array([hub] * len(other), pa.int64()), "b": pa.array(other, pa.int64())})
    return run


def passing(n: np.ndarray, bits: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of the others can link with set i, by sizes and bitmaps."""
    total = n[others] + n[i]
    most = (total - np.bitwise_count(bits[others] ^ bits[i]).sum(1, dtype=np.int64)) // 2  # the overlap is at most this
    return others[(100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])) & (100 * most >= percent * (total - most))]


def _cell(percent: int, forest: bool) -> Callable[[pa.Table], pa.Table]:
    """Members (tile, block, key, root, n, bits) of tiles to the pairs that
    pass: of different roots, and in a forest only what connects roots anew."""
    def run(rows: pa.Table) -> pa.Table:
        tile, key, block, n = (rows[c].to_numpy() for c in ("tile", "key", "block", "n"))
        order = np.lexsort((key, tile))
        tile, key, block, n = tile[order], key[order], block[order], n[order]
        roots, maps = rows["root"].to_numpy()[order], rows["bits"].combine_chunks()
        flat, offsets = maps.values.to_numpy(), maps.offsets.to_numpy()
        left, right = [], []
        edges = np.append(np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1]))), len(tile))
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a < 2:
                continue
            own = [flat[offsets[k]:offsets[k + 1]] for k in order[a:b]]
            words = min(map(len, own))
            bits = np.array([folded(x, words) for x in own]).view(np.uint64)
            size, of, which, parent = n[a:b], roots[a:b], block[a:b], {}

            def find(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x
            two = which.min() != which.max()
            for i in range(b - a - 1):
                others = np.arange(i + 1, b - a)
                others = others[(of[others] != of[i]) & ((which[others] != which[i]) | (not two))]
                for j in passing(size, bits, i, others, percent).tolist() if len(others) else ():
                    if forest:
                        x, y = find(of[i].item()), find(of[j].item())
                        if x == y:
                            continue
                        parent[max(x, y)] = min(x, y)
                    left.append(key[a + i])
                    right.append(key[a + j])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})
    return run


def tile_pairs(members: DataFrame, nodes: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(a, b), a < b: pairs of the tiles' members (tile, key, root) that pass."""
    counts = members.groupBy("tile").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    buckets = int(members.count() // CELL_ROWS) + 1
    m = members.join(counts, "tile").join(nodes.select("key", "n", "bits"), "key")
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("key"), "blocks")).otherwise(0).cast("int")
    m = m.select("tile", "key", "root", "n", "bits", "blocks", block.alias("block"))
    # A tile of one block shares a task with other tiles; else each pair of blocks is a cell.
    m = m.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    single = F.col("blocks") == 1
    m = m.select(F.when(single, F.pmod("tile", F.lit(buckets))).otherwise(F.col("tile")).alias("cell"), single.alias("single"),
                 F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "tile", "block", "key", "root", "n", "bits")
    return m.groupBy("cell", "single", "lo", "hi").applyInArrow(_cell(percent, forest), "a bigint, b bigint").distinct()


def exact_links(p: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int, slice_rows: int) -> DataFrame:
    """(a, b) of the pairs of keys (a, b) that link: the partners of a key are
    compared in slices, each with a copy of the key's text."""
    slices = p.groupBy("a").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("slices"))
    members = p.join(slices, "a").select("a", F.pmod("b", "slices").cast("int").alias("slice"), F.col("b").alias("key"))
    hubs = slices.select("a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("a").alias("key"))
    asked = members.unionByName(hubs).join(nodes.select("key", F.col("id").alias("_id"), F.col("hash").alias("_hash")), "key")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(
        asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("a", "slice", "key", "text")
    return texts.groupBy("a", "slice").applyInArrow(_compare(n, percent), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(key, root) for the keys of ``links`` (a, b): the smallest key that is
    reachable, by alternating large and small stars until nothing changes."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    state = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if seen == state or not seen[0]:
            return edges.groupBy(F.col("u").alias("key")).agg(F.min("v").alias("root"))
        state = seen
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = written(small.select("e.u", F.col("e.m").alias("v")).where("u != v").distinct(), "edges")


def linked_rows(docs: DataFrame, n: int = N, percent: int = PERCENT, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, class_id, root) of every
    row; ``root`` names a component also where ids repeat or are null."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = written(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_describe(n, percent), _TABLE), "sets")
    whole = table.where("n > 0")
    nodes = written(whole.groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n", "bits")).alias("r")).select(
        "key", F.col("r.doc_id").alias("id"), F.col("r.text_hash").alias("hash"), "r.n", "r.bits"), "nodes")
    shared = written(shared_tiles(docs, n, percent), "tiles")
    first = written(tile_pairs(shared.withColumn("root", F.col("key")), nodes, percent, forest=True), "pairs")
    links = written(exact_links(first, nodes, docs, n, percent, slice_rows), "links")
    # What passes and the forest's links leave apart.
    placed = written(shared.join(components(links), "key", "left").select("tile", "key", F.coalesce("root", "key").alias("root")), "placed")
    apart = placed.groupBy("tile").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("tile")
    rest = tile_pairs(placed.join(apart, "tile"), nodes, percent, forest=False).join(first, ["a", "b"], "left_anti")
    more = exact_links(written(rest, "pairs"), nodes, docs, n, percent, slice_rows)
    roots = components(links.unionByName(more))
    rooted = whole.select("doc_id", "text_hash", "n", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rooted.join(ids, "root").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", F.col("key").alias("class_id"), "root")
    alone = table.where("n = 0").select("doc_id", "text_hash", F.lit(0).cast("bigint").alias("n_shingles"),
                                        F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("class_id"), F.lit(None).cast("bigint").alias("root"))
    return out.unionByName(alone)


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, class_id) of every row."""
    return linked_rows(docs, n, percent, slice_rows).drop("root")


def keep_one_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each component: the one with its smallest id.

    Rows are told apart by id and text, so that a component keeps its row
    whatever other components have the same id or none.  Rows without shingles
    stay, all of them.
    """
    rows, (i, t, again) = linked_rows(docs, **how), fresh(docs, "_id", "_text", "_again")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "c")
    first = rows.where("root IS NOT NULL").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("c")).groupBy("root").agg(F.min(place).alias("r"))
    alone = rows.where("root IS NULL").select("doc_id", "text_hash").distinct()
    keep = written(first.select("r.doc_id", "r.text_hash", (F.col("r.c") > 1).alias(again)).unionByName(
        alone.withColumn(again, F.lit(False))).withColumnsRenamed({"doc_id": i, "text_hash": t}), "kept")
    out = docs.join(keep, F.col("doc_id").cast("bigint").eqNullSafe(F.col(i)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t)))
    if keep.where(again).limit(1).count():  # copies that repeat the id too
        out = out.where(~F.col(again)).unionByName(out.where(again).dropDuplicates([i, t]))
    return out.select(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")
