"""The fitted operators (7 and 8) against plain computations over all rows."""

import math
import random
import zlib

import numpy as np
import pytest
from test_operators import LABELS, prose, table

from strata.llm import quality_model, toxicity


def labelled(spark, n):
    """Documents of two kinds and their labels, some rows without either."""
    r = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.6
        text = prose(i, 30 + i % 40) if good else " ".join(r.choice(("BUY", "now!!", "$$$", "win")) for _ in range(10 + i % 30))
        if i % 11 == 0:
            text = f"{prose(i, 10)} insult{i % 3} slur"
        rows.append((i, None if i % 53 == 0 else text, "ab"[i % 2]))
        if i % 7:
            labels.append((i, int(good), int(i % 11 == 0)))
    return table(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (n + 5, 1, 0)], LABELS), rows, labels


def test_quality_equals_one_solve(spark):
    """Partition sums, folds and calibration: the scores are those of plain
    normal equations over all learnt rows."""
    docs, labels, rows, marks = labelled(spark, 400)
    dims, width, ridge, folds, bins, seed = 24, 3.0, 0.1, 4, 200, 5
    got = {r["doc_id"]: r["score"] for r in quality_model.quality(docs.repartition(7), labels, dims, width, ridge, folds, bins, seed).collect()}
    marks = {i: q for i, q, _ in marks if zlib.crc32(str(i).encode()) % 4 != 2}
    at = [i for i, _, _ in rows if i in marks]
    x = np.array([quality_model.statistics(t) for _, t, _ in rows])
    y = np.array([marks[i] for i in at], float)
    f = quality_model.Fourier(x[at].mean(0), x[at].std(0), dims, width, seed)
    z, shrink = f(x), ridge * np.diag([1.0] * dims + [1e-6])
    keys = spark.createDataFrame([(i,) for i in at], "doc_id bigint").selectExpr("doc_id", f"pmod(xxhash64('fold', doc_id), {folds}) AS fold").collect()
    fold = np.array([k["fold"] for k in sorted(keys)])

    def solve(rows_):
        a = z[rows_]
        return np.linalg.solve(a.T @ a + shrink, a.T @ np.array([marks[i] for i in rows_], float))

    # Out-of-fold scores by bins, pooled until they ascend, by the plain definition of isotonic means.
    at = np.array(at)
    raw = np.array([z[i] @ solve(at[fold != k].tolist()) for i, k in zip(at, fold)])
    bin_of = np.clip(np.floor((raw + 0.5) / 2 * bins), 0, bins - 1)
    used = np.unique(bin_of)
    n, s = (np.array([v[bin_of == b].sum() for b in used]) for v in (np.ones(len(y)), y))
    fitted = [max(min(s[a:b + 1].sum() / n[a:b + 1].sum() for b in range(k, len(used))) for a in range(k + 1)) for k in range(len(used))]
    want = np.interp(z @ solve(at.tolist()), (used + 0.5) / bins * 2 - 0.5, fitted)
    for i, _, _ in rows:
        assert got[i] == pytest.approx(want[i], abs=2e-5)


def scalar_ftrl(rows, labels, passes, alpha, beta, l1, noise, bias):
    """FTRL-proximal with dictionaries, one number at a time."""
    count = {}
    for row in rows:
        for f in row:
            count[f] = count.get(f, 0) + 1
    share, z, n = sum(labels) / len(labels), {}, {}

    def weight(f):
        zf, nf = z.get(f, 0.0), n.get(f, 0.0)
        cut = 0.0 if f == bias else l1 + noise * math.sqrt(nf)
        return 0.0 if abs(zf) <= cut else -math.copysign(abs(zf) - cut, zf) * alpha / (beta + math.sqrt(nf))

    for _ in range(passes):
        for row, y in zip(rows, labels):
            own = [f for f in row if count[f] > 1] + [bias]
            w = {f: weight(f) for f in own}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values())))))
            g = (0.5 / share if y else 0.5 / (1 - share)) * (p - y)
            for f in own:
                nf = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(nf + g * g) - math.sqrt(nf)) / alpha * w[f]
                n[f] = nf + g * g
    return {f: weight(f) for f in z if weight(f)}


@pytest.mark.parametrize("passes,l1", [(1, 0.0), (3, 0.3)])
def test_ftrl_equals_one_number_at_a_time(passes, l1):
    r = np.random.default_rng(9)
    labels = (r.random(150) < 0.3).astype(float)
    rows = [np.unique(np.append(r.integers(0, 300, 25), [301] if y else [])).astype(np.int32) for y in labels]
    at, w = toxicity.ftrl(rows, labels, passes, 0.1, 1.0, l1, 0.05)
    want = scalar_ftrl([x.tolist() for x in rows], labels.tolist(), passes, 0.1, 1.0, l1, 0.05, 2**toxicity.BITS)
    got = dict(zip(at.tolist(), w.tolist()))
    assert set(got) == set(want)
    assert all(got[f] == pytest.approx(want[f], rel=1e-9, abs=1e-12) for f in want)


def test_toxicity_scores_equal_scalar_model(spark):
    """The query's scores from the scalar model over the rows it may learn from."""
    docs, labels, rows, marks = labelled(spark, 200)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    texts = {i: t for i, t, _ in rows}
    learn = [(i, t) for i, _, t in marks if zlib.crc32(str(i).encode()) % 3 != 1]
    turn = {r["doc_id"]: r["t"] for r in spark.createDataFrame([(i,) for i, _ in learn], "doc_id bigint").selectExpr(
        "doc_id", "xxhash64('train', doc_id) AS t").collect()}
    learn.sort(key=lambda p: turn[p[0]])
    want = scalar_ftrl([toxicity.features(texts[i]).tolist() for i, _ in learn], [float(t) for _, t in learn],
                       toxicity.PASSES, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L1_NOISE, 2**toxicity.BITS)
    for i, t in texts.items():
        total = sum(want.get(f, 0.0) for f in toxicity.features(t).tolist()) + want.get(2**toxicity.BITS, 0.0)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-35.0, min(35.0, total)))), abs=2e-6)
