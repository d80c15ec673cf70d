"""Token-ID / binary output with Re-Pair grammar compression (operator 4).

Documents are range-partitioned and sorted by id, encoded, and cut into
shards.  Within a shard the most frequent pairs of neighbouring symbols are
replaced by nonterminals, round after round: a round counts all pairs, takes
the frequent ones, and replaces a pair wherever it is more frequent than the
pairs that overlap it.  Rounds go on until no pair occurs ``min_count`` times
or there are ``max_rules`` nonterminals.  A pair never reaches over the end of a document, so
that each document can be decoded by itself.

File format: Parquet, one row per shard, in ascending order of ids:

=========== ===============================================================
part, seq   place of the shard in the order of all shards
doc_ids     ids of the documents, ascending (null ids first)
offsets     uint32 LE, first symbol of each document, and the total
rules       left and right symbol of each nonterminal, ``base`` + its place
lengths     uint32 LE, number of ids that each nonterminal expands to
symbols     the compressed ids; the largest symbol stands for the end id
n_tokens    ids in the shard, end ids included
base, width ids below ``base`` are tokens; bytes per symbol (2 or 4)
=========== ===============================================================

Encoding: the texts of some 2 MB are cut at once where the vocabulary's
pre-tokenizer always starts a token: before words, numbers, punctuation and
white space of ASCII and Latin letters (not after an apostrophe, beside other
scripts or in the neighbourhood of a special token's string), so that the
pieces' ids put together are the texts' ids.  Distinct pieces are looked up in
a table per Python worker, of ``kept`` pieces at most (some 160 bytes each);
its size changes no id, only how often the tokenizer encodes a piece again.
The string of a special token in a text becomes its id, as the tokenizer's file
has it.

Defined results: a null text is empty and becomes the end id alone; repeated
rows and ids are documents of their own, in the order of their texts' hashes;
null ids come first; an empty table writes no shard and returns no row; other
columns are not read.
"""

from __future__ import annotations

import itertools
import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import read, written

#: Production parameters.
TOKENIZER, END_ID = "byte_bpe_50k.json", 2
SHARD_TOKENS, MIN_COUNT, MAX_RULES, KEPT_PIECES = 1_000_000, 8, 12_000, 1_000_000

SHARD_SCHEMA = ("part int, seq int, doc_ids array<bigint>, offsets binary, rules binary, lengths binary, "
                "symbols binary, n_tokens bigint, base int, width int")
CHUNK_BYTES = 2 << 20  # text encoded at once
#: ASCII pieces that are one pre-token.
_ONE = re.compile(rb" ?(?:[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9'\x1c-\x1f\x80-\xff]+)|\s+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary, as the library's
    pre-tokenizer gives it (for all bytes that occur in UTF-8)."""
    from tokenizers import pre_tokenizers

    level, letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), {}
    for char in map(chr, [*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x10000, 0x400), *range(0x10000, 0x110000, 0x8000)]):
        letters.update(zip(char.encode(), level.pre_tokenize_str(char)[0][0]))
    return letters


def _classes() -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(class of each byte, UTF-8 of white space beyond ASCII, whether a piece
    starts at a byte by the classes of the byte before, itself and the next).

    The cuts are those that the pre-tokenizer makes whatever stands further off;
    where it might not, as after an apostrophe or next to other scripts, there
    is none, and the library takes the longer piece apart.
    """
    of = np.full(256, _OTHER, np.uint8)
    of[:128] = [_ODD if 0x1C <= c <= 0x1F else _SPACE if c == 32 else _WHITE if chr(c).isspace() else _APOSTROPHE if c == 39
                else _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _MARK for c in range(128)]
    odd = [chr(c).encode() for c in range(0x80, 0x10000) if chr(c).isspace()]
    cut = np.zeros((8, 8, 8), bool)
    signs = {_LETTER: 0, _DIGIT: 1, _MARK: 2, _APOSTROPHE: 2}
    for before, at, after in np.ndindex(8, 8, 8):
        white, shown, follows = before >= _SPACE, at < _SPACE, after < _SPACE
        if at in (_SPACE, _WHITE):  # white space starts a token, and so does the last of several before a word
            cut[before, at, after] = not white or follows
        elif before == _WHITE:
            cut[before, at, after] = shown
        elif before in signs and at in signs:
            cut[before, at, after] = signs[before] != signs[at] and (before, at) != (_APOSTROPHE, _LETTER)
    return of, odd, cut.ravel()


_LETTER, _DIGIT, _MARK, _APOSTROPHE, _OTHER, _SPACE, _WHITE, _ODD = range(8)
_CLASS, _ODD_SPACES, _CUT = _classes()
_ODD_LEAD = np.isin(np.arange(256), [x[0] for x in _ODD_SPACES])


def starts_of_pieces(data: np.ndarray, offsets: np.ndarray, whole: list[tuple[int, int]]) -> np.ndarray:
    """Ascending places in ``data`` (bytes of all texts, UTF-8) where pieces
    start; ``offsets`` are the texts' starts and the end.  ``whole``: ascending
    ranges that stay in one piece, with all up to a space between words."""
    kind = _CLASS[data]
    if data.max(initial=0) >= 128:
        latin = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))  # U+00C0 to U+027F: letters but × and ÷
        latin = latin[(data[latin] != 0xC3) | (data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
        kind[latin] = kind[latin + 1] = _LETTER
        leads = np.flatnonzero(_ODD_LEAD[data])
        for odd in _ODD_SPACES if len(leads) else ():
            at = leads[leads <= len(data) - len(odd)]
            for k, byte in enumerate(odd):
                at = at[data[at + k] == byte]
            for k in range(len(odd)):
                kind[at + k] = _ODD
    near = np.zeros(len(data), np.uint16)
    near[1:] = kind[:-1]
    near <<= 3
    near |= kind
    near <<= 3
    near[:-1] |= kind[1:]
    some = np.diff(offsets) > 0
    first, last = offsets[:-1][some], offsets[1:][some] - 1
    near[last] = near[last] & 0o770 | _SPACE  # no text follows
    cut = _CUT[near]
    cut[first] = True
    if whole:
        safe = near >> 3 & 7 == _SPACE
        safe &= (near >> 6 < _SPACE) & (near & 7 < _SPACE)
        safe[first] = True
        safe, done = np.append(np.flatnonzero(safe), len(data)), 0
        for begin, end in whole:
            if end > done:
                done = safe[np.searchsorted(safe, end)]
                cut[safe[np.searchsorted(safe, begin, "right") - 1] + 1:done] = False
    return np.flatnonzero(cut)


class Pieces(dict):
    """Ids of known pieces (UTF-8).  A table that would hold more than ``kept``
    starts anew."""

    def __init__(self, kept: int):
        self.kept = kept

    def learn(self, pieces: list[bytes], ids: list[bytes]) -> None:
        if len(self) + len(pieces) > self.kept:
            self.clear()
        self.update(zip(pieces[:self.kept], ids))


class Encoder:
    """Ids of texts by a ``tokenizers`` file, with a table of known pieces.

    The pieces of many texts are found and made distinct at once.  Most are
    words with the space before them, numbers or punctuation, which are one
    pre-token and go to the library's model directly.
    """

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.base = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.base + MAX_RULES < 2**16 - 1 else np.dtype("<u4")
        self.code, self.model, self.letters = "H" if self.dtype.itemsize == 2 else "I", self.tokenizer.model, byte_letters()
        self.byte_letters = np.zeros(256, "<u2")
        self.byte_letters[list(self.letters)] = list(map(ord, self.letters.values()))
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.has_special = re.compile(b"|".join(map(re.escape, self.special)) or b"(?!)").search
        self.later = Pieces(kept)

    def one(self, piece: bytes) -> bool:
        """Is the piece one pre-token for sure?"""
        text = piece.decode()
        return bool(text.isalpha() or text[1:].isalpha() and text[0] == " " or _ONE.fullmatch(piece)) and not self.has_special(piece)

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces."""
        known = list(map(self.later.get, pieces))
        new = [k for k, ids in enumerate(known) if ids is None]
        if new:
            missed = [pieces[k] for k in new]
            # The letters of all bytes; 0xFF, which UTF-8 doesn't have, parts the pieces.
            spelt = self.byte_letters[np.frombuffer(b"\xff".join(missed), np.uint8)].tobytes().decode("utf-16-le").split("\0")
            one, model, whole = self.one, self.model.tokenize, self.tokenizer.encode
            ids = [[t.id for t in model(word)] if one(piece) else whole(piece.decode(), add_special_tokens=False).ids
                   for piece, word in zip(missed, spelt)]
            flat = array(self.code, itertools.chain.from_iterable(ids)).tobytes()
            bounds = itertools.accumulate((len(x) * self.dtype.itemsize for x in ids), initial=0)
            found = [flat[i:j] for i, j in itertools.pairwise(bounds)]
            for k, x in zip(new, found):
                known[k] = x
            self.later.learn(missed, found)
        return known

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text (null: none), as bytes of ``dtype``."""
        texts = (pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        begin = starts_of_pieces(data, offsets, self.specials(data.tobytes(), offsets))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data)]).dictionary_encode()
        known = self.pieces(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        flat, at, place = np.frombuffer(b"".join(known), self.dtype), np.cumsum(size) - size, pieces.indices.to_numpy()
        size, at = size[place], at[place]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = flat[np.repeat(at - total[:-1], size) + np.arange(total[-1])].tobytes()
        bounds = (total[np.searchsorted(begin, offsets)] * self.dtype.itemsize).tolist()
        return [ids[i:j] for i, j in itertools.pairwise(bounds)]

    def specials(self, data: bytes, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where special tokens stand in the texts."""
        found = [(m.start(), m.start() + len(x)) for x in self.special if x in data for m in re.finditer(b"(?=%s)" % re.escape(x), data)]
        return sorted((i, j) for i, j in found if np.searchsorted(offsets, i, "right") == np.searchsorted(offsets, j))


def encoder(path: str, kept: int = KEPT_PIECES) -> Encoder:
    """One encoder per Python worker and file: it outlives the task.  One with a
    table of another size takes its place."""
    known = sys.modules.setdefault("strata_encoders", ModuleType("strata_encoders")).__dict__
    if path not in known or known[path].later.kept != kept:
        known[path] = Encoder(path, kept)
    return known[path]


def re_pair(symbols: np.ndarray, base: int, end: int, min_count: int = MIN_COUNT, max_rules: int = MAX_RULES) -> tuple[np.ndarray, np.ndarray]:
    """(compressed symbols, rules): rule k is the pair that ``base`` + k replaces."""
    seq, rules = symbols.astype(np.uint32), np.empty((0, 2), np.uint32)
    # Places of the pairs that can be frequent: a pair that is rare in a round
    # stays so, so that later ones look at frequent pairs and new symbols alone.
    at = np.arange(max(len(seq) - 1, 0))
    while (room := max_rules - len(rules)) > 0 and len(at):
        left, right = seq[at], seq[at + 1]
        key = left.astype(np.uint64) << np.uint64(32) | right if base + max_rules >= 2**16 else left << np.uint32(16) | right
        half = key.dtype.type(4 * key.itemsize)
        beside = at[1:] - at[:-1] == 1
        # In a run of equal pairs (a a a a) every other one can be replaced.
        equal = np.flatnonzero((key[1:] == key[:-1]) & beside) + 1
        if len(equal):
            opens = np.concatenate(([True], np.diff(equal) != 1))
            place = np.arange(len(equal))
            equal = equal[(place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0]
        order = np.sort(np.delete(key, equal) if len(equal) else key)
        starts = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
        counts = np.diff(np.append(starts, len(order)))
        often = np.flatnonzero(counts >= min_count)
        counts, found = counts[often], order[starts[often]]
        low = (key.dtype.type(1) << half) - key.dtype.type(1)
        frequent = np.flatnonzero((found >> half != end) & (found & low != end))
        if not len(frequent):
            break
        spread, down = (np.uint32(0x9E3779B1), np.uint32(14)) if key.itemsize == 4 else (np.uint64(0x9E3779B97F4A7C15), np.uint64(46))
        slot, heard = key * spread >> down, np.zeros(1 << 18, bool)
        heard[found[frequent] * spread >> down] = True
        frequent = frequent[np.argsort(-counts[frequent], kind="stable")][:max(1, room // 2) if room > 64 else room]
        pairs = found[frequent]  # by falling count: the place is the rank
        # A small table finds the rank of a key; of keys that share a slot the most frequent stays.
        last = (np.int16 if len(pairs) < 2**15 else np.int32)(len(pairs))
        table = np.full(1 << 18, last)
        table[(pairs * spread >> down)[::-1]] = np.arange(len(pairs), dtype=table.dtype)[::-1]
        rank = table[slot]
        met = np.flatnonzero(rank < last)
        rank[met[pairs[rank[met]] != key[met]]] = last
        rank[equal] = last
        chosen = rank < last
        chosen[1:] &= (rank[1:] < rank[:-1]) | ~beside
        chosen[:-1] &= (rank[:-1] <= rank[1:]) | ~beside
        where = np.flatnonzero(chosen)
        used = np.bincount(rank[where], minlength=len(pairs))
        where = where[used[rank[where]] >= 2]  # the first pair's places at least
        ids = np.cumsum(used >= 2) - 1 + base + len(rules)
        live = np.zeros(len(seq), bool)
        live[at[heard[slot]]] = True
        places = at[where]
        seq[places], live[places] = ids[rank[where]], True
        keep = np.ones(len(seq), bool)
        keep[places + 1] = False
        seq, live = seq[keep], live[keep]
        places = places - np.arange(len(places))
        live[places[places > 0] - 1] = True
        at = np.flatnonzero(live[:-1])
        kept = pairs[used >= 2]
        rules = np.concatenate((rules, np.stack((kept >> half, kept & low), 1).astype(np.uint32)))
    return seq, rules


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all nonterminals one after the other, where each starts)."""
    out: list[list[int]] = []
    for left, right in rules.tolist():
        out.append((out[left - base] if left >= base else [left]) + (out[right - base] if right >= base else [right]))
    starts = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)
    return np.fromiter(itertools.chain.from_iterable(out), np.uint32, int(starts[-1])), starts


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, end_symbol: int, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each symbol)."""
    flat, starts = expansions(rules, base)
    flat = np.concatenate((flat, np.zeros(1, np.uint32)))
    s = symbols.astype(np.int64)
    grown = (s >= base) & (s != end_symbol)
    length = np.ones(len(s), np.int64)
    length[grown] = np.diff(starts)[s[grown] - base]
    begin = np.concatenate(([0], np.cumsum(length)))
    ids = np.repeat(np.where(s == end_symbol, end_id, s).astype(np.uint32), length)
    big = np.flatnonzero(grown)
    if len(big):
        n = length[big]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ids[np.repeat(begin[big], n) + inside] = flat[np.repeat(starts[s[big] - base], n) + inside]
    return ids, length


def _shard(part: int, seq: int, ids: list, docs: list[bytes], enc: Encoder, how: dict) -> dict:
    end = int(np.iinfo(enc.dtype).max)
    tail = np.array([end], enc.dtype).tobytes()
    symbols, rules = re_pair(np.frombuffer(tail.join(docs) + tail, enc.dtype), enc.base, end, **how)
    ends = np.flatnonzero(symbols == end)
    lengths: list[int] = []
    for left, right in rules.tolist():
        lengths.append(sum(lengths[x - enc.base] if x >= enc.base else 1 for x in (left, right)))
    return {"part": part, "seq": seq, "doc_ids": ids, "offsets": np.concatenate(([0], ends + 1)).astype("<u4").tobytes(),
            "rules": rules.astype(enc.dtype).tobytes(), "lengths": np.array(lengths, "<u4").tobytes(),
            "symbols": symbols.astype(enc.dtype).tobytes(), "n_tokens": sum(map(len, docs)) // enc.dtype.itemsize + len(docs),
            "base": enc.base, "width": enc.dtype.itemsize}


_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.binary()),
                    ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()), ("n_tokens", pa.int64()),
                    ("base", pa.int32()), ("width", pa.int32())])


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of slices of some ``CHUNK_BYTES``, of whole texts."""
    chunk = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) // CHUNK_BYTES
    begin = np.flatnonzero(np.diff(chunk, prepend=-1))
    return zip(begin.tolist(), np.diff(np.append(begin, len(texts))).tolist())


def encode_shards(path: str, shard_tokens: int = SHARD_TOKENS, kept: int = KEPT_PIECES, **how) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted (doc_id, text) batches of one partition to its shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, ids, docs, size = encoder(path, kept), TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for i, n in _chunks(batch.column(1)):
                b = batch.slice(i, n)
                for doc, new in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
                    ids.append(doc)
                    docs.append(new)
                    size += len(new) // enc.dtype.itemsize + 1
                    if size >= shard_tokens:
                        yield pa.RecordBatch.from_pylist([_shard(part, seq, ids, docs, enc, how)], _ARROW)
                        seq, ids, docs, size = seq + 1, [], [], 0
                        pa.default_memory_pool().release_unused()
        if ids:
            yield pa.RecordBatch.from_pylist([_shard(part, seq, ids, docs, enc, how)], _ARROW)
    return run


def decode_shard(row: dict, end_id: int = END_ID) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids with the end id) of each document of a shard."""
    dtype = np.dtype(f"<u{row['width']}")
    symbols, rules = np.frombuffer(row["symbols"], dtype), np.frombuffer(row["rules"], dtype).reshape(-1, 2)
    ids, length = expand(symbols, rules, row["base"], int(np.iinfo(dtype).max), end_id)
    begin = np.concatenate(([0], np.cumsum(length)))[np.frombuffer(row["offsets"], "<u4")]
    for k, doc in enumerate(row["doc_ids"]):
        yield doc, ids[begin[k]:begin[k + 1]]


def decode_document(row: dict, k: int, end_id: int = END_ID) -> np.ndarray:
    """Random access: the ids of the k-th document of a shard alone."""
    dtype, offsets = np.dtype(f"<u{row['width']}"), np.frombuffer(row["offsets"], "<u4")
    symbols = np.frombuffer(row["symbols"], dtype)[offsets[k]:offsets[k + 1]]
    rules = np.frombuffer(row["rules"], dtype).reshape(-1, 2)
    return expand(symbols, rules, row["base"], int(np.iinfo(dtype).max), end_id)[0]


def _digests(end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, at, out = batch.slice(i, 1).to_pylist()[0], 0, []
                for doc, ids in decode_shard(row, end_id):
                    out.append((row["part"], row["seq"], doc, at, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    return run


def write_token_files(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Encode ``docs`` and write the shards; the written table.  ``how``: what
    ``encode_shards`` and ``re_pair`` take."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    return written(d.mapInArrow(encode_shards(tokenizer, **how), SHARD_SCHEMA), "tokens")


def token_digests(shards: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    Starts are summed over parts, then over the shards of a part, then inside
    the shard; only the first of these is one task, over one row per part.
    """
    docs = shards.mapInArrow(_digests(end_id), "part int, seq int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = shards.select("part", "seq", F.col("n_tokens").alias("n"))
    parts = n.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("a"))
    starts = n.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("b")).join(parts, "part")
    return docs.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("a") + F.col("b") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(write_token_files(read(spark, sf_dir, "documents"), tokenizer_path()))
