"""Quality classifier: random Fourier features and ridge (operator 7).

Every document is described by statistics of its whole text (shares of kinds
of characters, repetition, lengths).  ``dims`` random Fourier features
approximate a Gaussian kernel over the standardised statistics; ridge weights
come from normal equations whose sums are made per task and added up by
Spark, so that all labelled rows are learnt from.  Isotonic regression on
out-of-fold scores turns the linear score into a probability.

What reaches the driver has a fixed size: means, ``dims`` squared sums for
each of ``folds`` folds, and ``bins`` counts.

Defined results: a null text is scored as an empty one; labels that are null
or whose id is null or not among the documents are ignored; repeated labels
or rows count as often as they are there; a null id belongs to no held-out
part; without any usable label every score is 0.5 (predicted 0); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import read, written
from strata.llm.toxicity import held_out

#: Production parameters.
DIMS, WIDTH, RIDGE, FOLDS, BINS, SEED, THRESHOLD = 192, 3.0, 1.0, 3, 512, 7, 0.7

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS, _ENDS, _SYMBOLS = b"0123456789", b".?!", b"#*$%&|<>{}[]\\/@^~_=+"
_SPACE = b" \t\n\r\x0b\f"
NAMES = ("log_words", "word_length", "upper", "digits", "symbols", "bars", "exclaims", "stops", "commas", "beyond_ascii",
         "lines", "distinct", "top_word", "repeat_next", "distinct_pairs", "title", "short", "ends")


def statistics(text: str | None) -> list[float]:
    """Values of NAMES for a text."""
    t = text or ""
    b = t.encode("utf-8", "replace")
    w = b.split()
    n = len(w)
    if not n:
        return [0.0] * len(NAMES)
    size = len(b) - len(b) + len(b.translate(None, _SPACE))
    of = lambda chars: (len(b) - len(b.translate(None, chars))) / size
    counts = Counter(w)
    pairs = set(zip(w, w[1:]))
    same = sum(map(eq, w, w[1:]))
    return [
        np.log1p(n), size / n / 10, of(_UPPER), of(_DIGITS), of(_SYMBOLS), b.count(b"|") / n, b.count(b"!") / n,
        (b.count(b".") + b.count(b"?")) / n, b.count(b",") / n, of(bytes(range(128, 256))), b.count(b"\n") / n, len(counts) / n,
        max(counts.values()) / n, same / n, len(pairs) / n, sum(map(bytes.istitle, counts)) / len(counts),
        sum(c for x, c in counts.items() if len(x) < 4) / n, sum(c for x, c in counts.items() if x[-1:] in (b".", b"!", b"?", b"|")) / n]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column(0), x], names=["doc_id", "x"])


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x), written: the texts are scanned once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        _statistics, f"doc_id {kind}, x array<double>"), "statistics")


class Fourier:
    """Random Fourier features of standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, dims: int = DIMS, width: float = WIDTH, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.mean, self.scale, self.dims = mean, np.where(scale > 1e-9, scale, 1.0), dims
        self.w, self.b = r.normal(0, 1 / width, (len(mean), dims)), r.uniform(0, 2 * np.pi, dims)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack((np.sqrt(2 / self.dims) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(f: Fourier, folds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Normal equations of a task's rows: (place, fold, value)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = f.dims + 1
        total = np.zeros((folds, d, d + 1))
        for b in batches:
            z, y, fold = f(_matrix(b.column(0), len(f.mean))), b.column(1).to_numpy(), b.column(2).to_numpy()
            for k in range(folds):
                zk = z[fold == k]
                total[k] += zk.T @ np.hstack((zk, y[fold == k, None]))
        for k in range(folds):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * (d + 1)), pa.int32()), pa.array(np.full(d * (d + 1), k), pa.int32()),
                                              pa.array(total[k].ravel())], names=["place", "fold", "v"])
    return run


def isotonic(x: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, fitted mean), pooling adjacent violators; x ascending."""
    blocks: list[list[float]] = []
    for xi, ni, si in zip(x, n, s):
        blocks.append([xi, xi, ni, si])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    ends = [(at, b[3] / b[2]) for b in blocks for at in dict.fromkeys(b[:2])]
    return np.array([e[0] for e in ends]), np.array([e[1] for e in ends])


def _linear(f: Fourier, betas: np.ndarray, scores: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """Rows (key, x, which) to (key, score by betas[which])."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = f(_matrix(b.column(1), len(f.mean))) @ betas.T
            picked = raw[np.arange(len(raw)), b.column(2).to_numpy()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(picked), pa.float64())], names=["k", "score"])
    return run


def quality(docs: DataFrame, labels: DataFrame, dims: int = DIMS, width: float = WIDTH, ridge: float = RIDGE,
            folds: int = FOLDS, bins: int = BINS, seed: int = SEED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    out = held_out(4, 2)
    table = statistics_table(docs)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~out).select(
        F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y"))
    train = table.join(usable, F.col("doc_id") == F.col("id")).select(
        "doc_id", "x", "y", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds)).cast("int").alias("fold"))
    train = written(train, "quality-train")
    m = len(NAMES)
    at = [F.get("x", F.lit(i)) for i in range(m)]
    seen = train.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(at)]).first()
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not seen["n"]:
        return table.select("doc_id", out.alias("held_out"), F.lit(0.5).alias("score"), F.lit(0).alias("predicted"))
    f = Fourier(np.array([seen[f"m{i}"] for i in range(m)]), np.array([seen[f"s{i}"] for i in range(m)]), dims, width, seed)
    sums = (train.select("x", "y", "fold").mapInArrow(_sums(f, folds), "place int, fold int, v double")
            .groupBy("place", "fold").agg(F.sum("v").alias("v")).toPandas())  # folds * (dims + 1) * (dims + 2) rows
    d = f.dims + 1
    total = np.zeros((folds, d * (d + 1)))
    total[sums["fold"], sums["place"]] = sums["v"]
    total = total.reshape(folds, d, d + 1)
    solve = lambda s: np.linalg.solve(s[:, :d] + ridge * np.diag([1.0] * (d - 1) + [1e-6]), s[:, d])
    betas = np.array([*(solve(total.sum(0) - total[k]) for k in range(folds)), solve(total.sum(0))])
    place = lambda raw: np.clip(np.floor((np.nan_to_num(raw) + 0.5) / 2 * bins), 0, bins - 1)
    counts = (train.select("y", "x", "fold").mapInArrow(_linear(f, betas, place), "k double, score double")
              .groupBy("score").agg(F.count("*").alias("n"), F.sum("k").alias("s")).orderBy("score").toPandas())  # at most ``bins`` rows
    x, fitted = isotonic((counts["score"].to_numpy() + 0.5) / bins * 2 - 0.5, counts["n"].to_numpy(float), counts["s"].to_numpy())
    final = lambda raw: np.round(np.interp(raw, x, fitted), 6)
    scored = table.select(F.col("doc_id").alias("k"), "x", F.lit(folds).alias("which")).mapInArrow(
        _linear(f, betas, final), f"k {kind}, score double").withColumnRenamed("k", "doc_id")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
