import random
import zlib

import numpy as np
import pyarrow as pa

from spectraframe.llm import crf_language as L
from spectraframe.llm import gam_quality as Q

SF = "/root/testdata/sf0.01"


def test_chain_equals_plain_forward_backward():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 50, 333):
        score = rng.normal(size=(n, 3)).astype(np.float32)
        step, start = np.exp(rng.normal(size=(3, 3))).astype(np.float32), np.exp(rng.normal(size=3)).astype(np.float32)
        first = rng.random(n) < 0.15
        first[0] = True
        p, _, _ = L.forward_backward(score, step, start, first)
        begins = [*np.flatnonzero(first), n]
        for a, b in zip(begins, begins[1:]):
            f, g = [start * np.exp(score[a])], [np.ones(3)]
            for t in range(a + 1, b):
                f.append(f[-1] @ step * np.exp(score[t]))
            for t in range(b - 1, a, -1):
                g.append(step @ (np.exp(score[t]) * g[-1]))
            want = np.array(f) * np.array(g[::-1])
            assert np.allclose(p[a:b], want / want.sum(1, keepdims=True), atol=1e-4)


def test_words_of_mixed_text():
    rnd = random.Random(1)
    langs = {"aa": "ba ce di fo gu".split(), "bb": "xor zuk wim vop tys".split()}
    say = lambda lang, n: " ".join("".join(rnd.choices(langs[lang], k=2)) for _ in range(n))
    texts = [(say(lang, 30), lang) for lang in langs for _ in range(40)]
    model = L.fit([t for t, _ in texts], [x for _, x in texts])
    p, at = model.predict(pa.array([say("aa", 40) + " " + say("bb", 60), None, "", "!!"]), L.WordFeatures())
    label = np.array(model.labels)[p.argmax(1)]
    assert at.tolist() == [0, 100, 100, 100, 100]
    assert (label[:40] == "aa").mean() > 0.95 and (label[40:] == "bb").mean() > 0.95


def test_language_accuracy_and_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(docs)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = L.predict(docs, model, runs=True).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and (not r.runs or sum(int(x.split(":")[1]) for x in r.runs.split(",")) == r.n_words) for r in got)
    assert all(r.n_switches == max(len(r.runs.split(",")) - 1, 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 ...", "x"), (None, "the of and with", "x"), (3, "123 ...", "x")], "doc_id long, text string, score string")
    rows = [(r.doc_id, r.lang_pred) for r in L.predict(odd, model).collect()]
    assert sorted(rows, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (3, "und"), (None, "en")], key=str)
    assert L.predict(odd.limit(0), model).count() == 0
    nothing = L.train(docs.limit(0))
    assert [r.lang_pred for r in L.predict(odd, nothing).collect()] == ["und"] * 5


def test_quality_accuracy_and_contract(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.train(docs, labels)
    assert model.pairs
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in Q.score(docs, model).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    held = [d for d in truth if got[d].held_out]
    assert np.mean([got[d].predicted == truth[d] for d in held]) > 0.95
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b c", "x"), (2, "", "x"), (5, "word " * 60000, "x")], "doc_id long, text string, score string")
    assert len(Q.score(odd, model).collect()) == 5
    assert Q.keep_good(odd, model).columns == odd.columns and Q.keep_good(odd.limit(0), model).count() == 0
    blank = Q.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in Q.score(odd, blank).collect()} == {0.5}


def test_tables_add_up():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, len(Q.FEATURES))).astype(np.float32)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(4000) < 0.02)).astype(float)  # only a pair tells
    model = Q.fit(x[:3000], y[:3000], rounds=20)
    assert {0, 1} in [{a, b} for a, b, _ in model.pairs]
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85
