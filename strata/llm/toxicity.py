"""Toxicity: FTRL-proximal logistic regression on hashed n-grams (operator 8).

Features of a text are the distinct hashed words, pairs of neighbouring words
and pairs with one word between them (skip-grams); words are lower-cased
ASCII letters, digits and all other characters beyond ASCII.  The model is fit
by FTRL-proximal with a learning rate per coordinate and L1 (a constant, and
a part that grows with the noise expected in the coordinate): coordinates that
few examples speak for stay exactly zero, so that the weights are a short
list, which is broadcast (at most ``2 ** BITS`` entries, in fact hundreds).
Both classes weigh the same in the fit.

The training rows are a bounded sample of the labelled rows
(``max_train``, those with the smallest hashes of their ids), dealt into
shards of at most ``shard_rows`` rows; each shard is fit in a task of its own
and the shards' weights are averaged.  Every document is scored, over its
whole text.

Defined results: a null text is scored as an empty one; labels that are null
or whose id is null or not among the documents are ignored; repeated labels
or rows count as often as they are there; a null id belongs to no held-out
part; without any usable label every score is 0.5 (predicted 0); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import fresh, read

#: Production parameters.
BITS, ALPHA, BETA, L1, L1_NOISE, PASSES = 20, 4.0, 1.0, 10.0, 1.0, 8
MAX_TRAIN, SHARD_ROWS, THRESHOLD, SEND_ROWS = 20_000, 10_000, 0.7, 256

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a text, as places below 2 ** BITS."""
    w = (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    a = h * _MIX[0]
    pairs = (h[:-1] * _MIX[1] + h[1:]) * _MIX[0] if len(h) > 1 else h[:0]
    skips = (h[:-2] * _MIX[2] + h[2:] + _MIX[3]) * _MIX[0] if len(h) > 2 else h[:0]
    return np.unique((np.concatenate((a, pairs, skips)) >> np.uint64(64 - BITS)).astype(np.int32))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, passes: int = PASSES, alpha: float = ALPHA, beta: float = BETA,
         l1: float = L1, l1_noise: float = L1_NOISE) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that are not zero; place 2 ** BITS is the bias.

    A feature of a single example is left out: it can't be told from chance.
    """
    size, share = 2**BITS + 1, labels.mean()
    if not 0 < share < 1:
        return np.array([size - 1]), np.array([35.0 if share else -35.0])
    # The features of all rows lie in one array, each row's bias after them.
    ends = np.cumsum([len(x) + 1 for x in rows])
    flat = np.full(ends[-1], size - 1, np.int32)
    for x, end in zip(rows, ends):
        flat[end - 1 - len(x):end - 1] = x
    often = np.bincount(flat, minlength=size) > 1
    often[-1] = True
    left = np.concatenate(([0], np.cumsum(often[flat])))[np.concatenate(([0], ends))]
    flat = flat[often[flat]]
    rows = [flat[a:b] for a, b in zip(left[:-1], left[1:])]
    z, n = np.zeros(size), np.zeros(size)
    l1s, noise = np.full(size, l1), np.full(size, l1_noise)
    l1s[-1] = noise[-1] = 0.0
    importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(passes):
        for i, y, k in zip(rows, labels, importance):
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = -np.sign(zi) * np.maximum(np.abs(zi) - l1s[i] - noise[i] * root, 0.0) * alpha / (beta + root)
            g = k * (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - y)
            z[i] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[i] = ni + g * g
    root = np.sqrt(n)
    w = -np.sign(z) * np.maximum(np.abs(z) - l1s - noise * root, 0.0) * alpha / (beta + root)
    at = np.flatnonzero(w)
    return at, w[at]


def _fit(how: dict) -> Callable[[pa.Table], pa.Table]:
    def run(shard: pa.Table) -> pa.Table:
        order = np.argsort(shard["turn"].to_numpy(), kind="stable")
        rows = [features(t.as_py()) for t in shard["text"]]
        at, w = ftrl([rows[i] for i in order], shard["label"].to_numpy()[order], **how)
        return pa.table({"place": pa.array(at, pa.int32()), "weight": pa.array(w, pa.float64())})
    return run


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_train: int = MAX_TRAIN,
        shard_rows: int = SHARD_ROWS, **how) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) learnt from the labelled rows that are ``usable``."""
    turn = F.xxhash64(F.lit("train"), F.col("doc_id"))
    rows = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
            .select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("label"), turn.alias("turn"))
            .orderBy("turn", "label").limit(max_train))
    n = rows.count()
    if not n:
        return np.empty(0, np.int32), np.empty(0)
    shards = -(-n // shard_rows)
    # max_train bounds what is broadcast.
    train = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("id")).select(
        "text", "label", "turn", F.pmod("turn", F.lit(shards)).alias("shard"))
    fits = train.groupBy("shard").applyInArrow(_fit(how), "place int, weight double")
    mean = fits.groupBy("place").agg((F.sum("weight") / shards).alias("weight")).toPandas()  # at most 2 ** BITS + 1 rows
    mean = mean.sort_values("place")
    return mean["place"].to_numpy(np.int32), mean["weight"].to_numpy()


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], name: str = "score") -> DataFrame:
    """``docs`` with the score of every row's ``text`` as one more column."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(2**BITS + 1)
        weights[sent.value[0]] = sent.value[1]
        for b in batches:
            total = np.array([weights[features(t.as_py())].sum() + weights[-1] for t in b.column(at)], float)
            scores = np.round(1.0 / (1.0 + np.exp(-np.clip(total, -35.0, 35.0))), 6)
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], names=[*b.schema.names, name])
            # Whole rows go back in small pieces: what the executor holds of them stays small.
            yield from (out.slice(k, SEND_ROWS) for k in range(0, max(1, out.num_rows), SEND_ROWS))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(parts: int, part: int) -> Column:
    """Whether crc32 of the id as text, modulo ``parts``, is ``part``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    out = held_out(3, 1)
    model = fit(docs, labels, "toxic", ~out, **how)
    return scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows that the model rejects.  Rows are scored and
    filtered where they are: no join brings the texts together."""
    model, (name,) = fit(docs, labels, "toxic", ~held_out(3, 1), **how), fresh(docs, "_toxicity")
    return scored(docs, model, name).where(F.col(name) < THRESHOLD).drop(name)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
