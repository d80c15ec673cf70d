"""Operators 11 to 13 against brute force, and on awkward tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strata.llm import minhash_tensor, phrase_graph, spelling_variants
from test_operators import AWKWARD, linked_groups, prose, table


def edited(text, seed, n):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("cell", [500, 3])
def test_near_duplicates_brute_force(spark, cell):
    """Copies, near copies at both sides of the limit, a chain, a template
    family that lies close but does not link, and short texts."""
    rows, i = [], 0
    for k in range(12):
        base = prose(k, 120)
        for e in (0, 0, 1, 2, 3, 4, 5, 6):
            rows.append((i, edited(base, i, e), "a"))
            i += 1
    chain = prose(77, 150).split()
    for k in range(8):  # each links with its neighbours alone
        rows.append((i, " ".join([f"c{j}" if j < 12 * k else x for j, x in enumerate(chain)]), "a"))
        i += 1
    template = prose(78, 100)
    rows += [(i + k, template + " " + prose(9000 + k, 14), "a") for k in range(30)]
    rows += [(1000, "one", "a"), (1001, "One", "a"), (1002, "one two three", "a"), (1003, "one two four", "a"), (1004, None, "a"), (1005, " ", "a")]
    want = linked_groups(rows, 4, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_tensor.near_duplicates(table(spark, rows), n=4, cell=cell).collect()}
    assert got == {d: (n, c, d == c) for d, (n, c) in want.items()}


def test_tables_are_pairs_of_half_keys():
    """Sets at similarity s share a half key of either collection as often as
    the docstring says."""
    r = np.random.default_rng(1)
    both, trials = 0, 400
    for _ in range(trials):
        common = r.integers(1, 2**63, 80, dtype=np.uint64)
        a, b = (minhash_tensor.half_keys(np.concatenate((common, r.integers(1, 2**63, 60, dtype=np.uint64))), 2, 4) for _ in range(2))
        both += bool((a[:4] == b[:4]).any() and (a[4:] == b[4:]).any())
    s = 80 / 200
    assert abs(both / trials - (1 - (1 - s**2) ** 4) ** 2) < 0.08


def test_awkward_near_duplicates(spark):
    rows = minhash_tensor.near_duplicates(table(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] in (1, 2, 3, 8, 9, 11, None)} == {
        (1, 1, True), (2, 1, False), (3, 3, True), (8, 8, True), (9, 8, False), (11, 11, True), (None, None, True)}
    assert minhash_tensor.near_duplicates(table(spark, AWKWARD).limit(0)).collect() == []


def variants(rows):
    """Brute force of operator 12, all pairs of words."""
    counts, low = Counter(), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))
    out = {}
    for w in n:
        close = [v for v in n if v != w and near(v, w)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best and n[best] >= 10 * n[w] else None, n[w], len(close))

    def root(w):
        return root(out[w][0]) if out[w][0] else w
    return {w: (f, root(w), c, k, n[f] if f else None) for w, (f, c, k) in out.items()}


@pytest.mark.parametrize("flush", [400_000, 5])
def test_spelling_variants_brute_force(spark, flush):
    r, words = random.Random(3), ["international", "mississippi", "bookkeeper", "straßenbahn", "éléphants"]
    text = []
    for k, w in enumerate(words):
        text += [w] * 2000
        for _ in range(12):
            p, how = r.randrange(len(w)), r.randrange(3)
            v = w[:p] + (r.choice("abcdeéß") if how else "") + w[p + (how != 2):]
            text += [v] * r.choice([1, 2, 15, 60]) + [v + "x"] * r.choice([2, 3]) + [v[1:] * (k == 0)] * 2
    text += ["AAAAAAAA", "aaaaaaaaa"] * 2 + ["x" * 3000] * 2 + ["x" * 1500 + "y" + "x" * 1499] * 30 + ["x×x÷xxx"] * 2
    r.shuffle(text)
    rows = [(k if k % 9 else None, " ".join(text[j:j + 37])) for k, j in enumerate(range(0, len(text), 37))] + [(-1, None), (-2, "")]
    got = {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in
           spelling_variants.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string"), flush=flush).collect()}
    want = variants(rows)
    assert got == want and any(v[0] and v[0] != v[1] for v in want.values())


def test_forms_are_followed_to_the_last(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(11)] + [("a", "b")]
    got = {r["word"]: r["root"] for r in spelling_variants.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {f"w{k}": "w11" for k in range(11)} | {"a": "b"}


def test_neighbours_of_reduced_words():
    """Of near reduced words exactly one side gives the other's hash."""
    r = random.Random(5)
    words = ["".join(r.choice("abcd") for _ in range(r.choice([7, 8, 9]))) for _ in range(300)]
    own = spelling_variants.own_hashes(words, 4)
    asked = [set() for _ in words]
    for at, h in spelling_variants.neighbours(words, 4):
        for i, x in zip(at.tolist(), h.tolist()):
            assert x not in asked[i]
            asked[i].add(x)
    symbol = ["".join(chr(97 + ((ord(c) * 0x9E3779B1 & 0xFFFFFFFF) * 4 >> 32)) for c in w) for w in words]

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))
    for i in range(len(words)):
        for j in range(i):
            assert (int(own[i]) in asked[j]) + (int(own[j]) in asked[i]) == near(symbol[i], symbol[j])


def phrases(rows, least):
    """Brute force of operator 13."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n, out = {}, Counter(), {}
    for lang, t in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (t or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        own = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        gone = {g[i:i + k] for g, a in own.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= 80 * c[g[i:i + k]]}
        rows_ = []
        for g, a in own.items():
            if g not in gone:
                score, k = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
                rows_.append((-score, -a, " ".join(g).encode(), a, c[g[:k]], c[g[k:]]))
        for rank, (s, _, g, a, left, right) in enumerate(sorted(rows_)[:2000], 1):
            out[lang, rank] = (g.decode(), a, left, right, n[lang], -s)
    return out


@pytest.mark.parametrize("flush", [2_000_000, 50])
def test_phrases_brute_force(spark, flush):
    r = random.Random(9)
    vocab = [f"w{k}" for k in range(25)] + ["Été", "日本", "it's", "a\x00b"]
    fixed = ["new york city hall", "to be or not to be that is", "a a a a a a", "Été 日本"]
    rows = []
    for k in range(400):
        parts = [r.choice(fixed) if r.random() < 0.3 else r.choice(vocab) + r.choice(" \t") + r.choice(vocab) + r.choice(["", ".", ", ", "\n", "!?"]) for _ in range(12)]
        rows.append((r.choice(["en", "en", "fr", None, "und"]), " ".join(parts)))
    rows += [("en", None), ("de", ""), (None, " . ")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = {(x["lang"], x["rank"]): (x["phrase"], x["a"], x["l"], x["r"], x["n"], x["score"]) for x in phrase_graph.collocations(docs, flush=flush).collect()}
    assert got == phrases(rows, 30) and len(got) > 25
    assert phrase_graph.collocations(docs.limit(0)).collect() == []


def test_ranks_beyond_the_slices(spark):
    """More phrases than the first ``top`` of a language, ranked in slices."""
    rows = [("en", " . ".join(f"x{k} y{k}" for k in range(300) for _ in range(2 + k % 3)))]
    got = phrase_graph.collocations(spark.createDataFrame(rows, "lang string, text string"), least=2, top=150).collect()
    order = sorted((f"x{k} y{k}" for k in range(300)), key=lambda p: (-(2 + int(p.split()[0][1:]) % 3), p))
    assert [r["phrase"] for r in sorted(got, key=lambda r: r["rank"])] == order[:150]


def test_unary_paths(spark):
    """A passage of 40 words that is always whole is one path; what branches
    ends a path."""
    whole = " ".join(f"p{k}" for k in range(40))
    rows = [("en", whole)] * 30 + [("en", f"q1 q2 q3 q4 {x}") for x in ("left end", "right end") for _ in range(30)]
    counts = phrase_graph.phrase_counts(phrase_graph.phrase_windows(spark.createDataFrame(rows, "lang string, text string")))
    got = {r["path"]: (r["n_words"], r["f"]) for r in phrase_graph.phrase_paths(counts).collect()}
    assert got == {whole: (40, 30), "q1 q2 q3 q4": (4, 60), "q2 q3 q4 left end": (5, 30), "q2 q3 q4 right end": (5, 30)}
