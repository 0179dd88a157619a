import random
from collections import Counter

import numpy as np
import pyarrow as pa

from spectraframe.llm import _common as C
from spectraframe.llm import icws_minhash as M


def brute(docs):
    """Classes by all pairs; docs: distinct (doc_id, text)."""
    words = C.Words()
    sets = {}
    for d, t in docs:
        x, _ = C.shingles(*words(pa.array([t], pa.string())), M.SHINGLE)
        sets[d] = Counter(x.tolist())
    df = Counter(s & ((1 << M.IDF_BITS) - 1) for c in sets.values() for s in c)
    idf = {k: max(np.log((len(docs) + 1) / (v + 1)), 0) + 0.1 for k, v in df.items()}
    weight = {d: {s: n * idf[s & ((1 << M.IDF_BITS) - 1)] for s, n in c.items()} for d, c in sets.items()}
    up = {d: d for d in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    near = 0
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and weight[i] and weight[j]:
                low = sum(min(v, weight[j].get(s, 0)) for s, v in weight[i].items())
                sim = low / (sum(weight[i].values()) + sum(weight[j].values()) - low)
                near += M.THRESHOLD <= sim < 0.9
                if sim >= M.THRESHOLD:
                    up[max(root(i), root(j))] = min(root(i), root(j))
    return {d: root(d) for d in ids}, near


def corpus():
    rnd = random.Random(11)
    vocab = ["w%d" % i for i in range(500)]
    common = " ".join(rnd.choice(vocab) for _ in range(60))
    docs, n = [], 0
    for _ in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randrange(60, 300))]
        for _ in range(rnd.choice([1, 1, 3, 12])):
            x = list(base)
            for _ in range(int(len(x) * rnd.choice([0, 0.005, 0.01, 0.02, 0.04]))):
                x[rnd.randrange(len(x))] = rnd.choice(vocab)
            docs.append((n, " ".join(x) + (" " + common if rnd.random() < 0.2 else "")))
            n += 1
    return docs + [(900, None), (901, ""), (902, "..."), (903, "one two"), (904, "One, TWO!"), (905, "a " * 30000), (906, "a " * 30000 + "b")]


def test_classes_equal_brute_force(spark):
    docs = corpus()
    want, near = brute(docs)
    assert near > 10
    rows = [(*d, "x") for d in docs] + [(0, docs[0][1], "y"), (None, docs[0][1], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, same string")
    got = M.near_duplicates(df).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = M.keep_one(df)
    assert kept.columns == df.columns
    # One row of each class: neither the repeated row nor the row without an id that repeats its text stays.
    assert sorted(((r.doc_id, r.same) for r in kept.collect() if r.doc_id), key=str) == sorted([(d, "x") for d, c in want.items() if d == c and d], key=str)
    assert sum(r.text == docs[0][1] for r in kept.collect()) == 1


def test_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(C, "SMALL_BUCKET", 3)
    docs = corpus()
    got = M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(docs)[0]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert M.near_duplicates(none).count() == 0 and M.keep_one(none).count() == 0


def test_samples_estimate_similarity():
    rng = np.random.default_rng(3)
    x = np.sort(rng.integers(0, 1 << 62, 300).astype(C.U64))
    total = want = 0
    for i in range(60):
        v, w = rng.gamma(2, 1, 300), rng.gamma(2, 1, 300)
        w = np.where(rng.random(300) < 0.7, v, w)
        y = C.mix(x, i)
        y, order = np.sort(y), np.argsort(y)
        v, w = v[order], w[order]
        s = M.samples(np.concatenate([y, y]), np.concatenate([v, w]), np.array([0, 300, 600]))
        total += (s[0] == s[1]).mean() / 60
        want += C.jaccard(y, v, y, w) / 60
    assert abs(total - want) < 0.03


def test_matrix_of_similarities():
    rng = np.random.default_rng(7)
    pool = np.unique(rng.integers(0, 1 << 62, 60).astype(C.U64))
    sets = []
    for n in [0, 1, 5, *rng.integers(10, 60, 30)]:
        x = np.sort(rng.choice(pool, min(n, len(pool)), replace=False))
        sets.append((x, rng.choice([1.0, 1.5, 3.0, 0.25], len(x))))
    got = C.jaccard_matrix(sets, dense=4, width=7)
    want = [[C.jaccard(*a, *b) for b in sets] for a in sets]
    assert np.allclose(got, want)


def test_measured_recall():
    """Of pairs of documents just above the threshold nearly all share a band."""
    rnd = random.Random(21)
    vocab = ["v%d" % i for i in range(3000)]
    words, idf = C.Words(), np.log(np.random.default_rng(2).uniform(2, 500, 1 << M.IDF_BITS))
    met = n = 0
    while n < 1500:
        x = [rnd.choice(vocab) for _ in range(rnd.randrange(150, 400))]
        y = list(x)
        for _ in range(max(1, round(len(x) * rnd.uniform(0.015, 0.03)))):
            y[rnd.randrange(len(y))] = rnd.choice(vocab)
        h, w, at = M.weighted_sets(*words(pa.array([" ".join(x), " ".join(y)])), idf)
        s = C.jaccard(h[: at[1]], w[: at[1]], h[at[1] :], w[at[1] :])
        if 0.8 <= s < 0.86:
            a, b = M.bands(M.samples(h, w, at))
            met += bool((a == b).any())
            n += 1
    assert met / n > 0.998, met / n
