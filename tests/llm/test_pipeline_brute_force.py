"""The whole pipeline, and the score of its first stage, against plain loops."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import test_fuzzy_lines
import test_icws_minhash
import tiktoken

import corpus_pipeline as pipeline
from spectraframe.llm import byte_bpe as B
from spectraframe.llm import gam_quality as Q
from spectraframe.llm import spaced_seeds as S

SF = "/root/testdata/sf0.01"


def plain_score(model, x):
    """The model's score of one row of features, table by table."""
    margin = model.bias
    place = lambda edges, v: sum(1 for e in edges.tolist() if e <= v)
    for j, (edges, table) in enumerate(zip(model.edges, model.tables)):
        margin += table[place(edges, x[j])]
    for a, b, table in model.pairs:
        margin += table[place(model.coarse[a], x[a]), place(model.coarse[b], x[b])]
    return 1 / (1 + np.exp(-margin))


def leaks(text, items):
    """Whether any alignment of any item has a stretch of words that is tolerated."""
    tok = lambda s: re.findall(r"\w+", (s or "").lower())
    w = tok(text)
    for item in items:
        x = tok(item)
        least = min(S.WORDS, len(x))
        if len(x) < S.SHORTEST:
            continue
        for begin in range(-len(x) + least, len(w) - least + 1):
            lo, hi = max(0, begin), min(len(w), begin + len(x))
            gone = [w[k] != x[k - begin] for k in range(lo, hi)]
            if any(sum(gone[k : k + least]) <= least // 5 for k in range(len(gone) - least + 1)):
                return True
    return False


def corpus():
    rnd = random.Random(8)
    vocab = "the of and to in is it that was for on are with as his they at be this have from or had by not but what all were when we there can an your which their said if".split() + ["w" + "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randrange(3, 8))) for _ in range(300)]
    sentence = lambda n: " ".join(rnd.choice(vocab) for _ in range(n)).capitalize() + "."
    items = [sentence(n).rstrip(".") for n in (4, 6, 13, 25)]
    docs = []
    for i in range(40):
        lines = [sentence(rnd.randrange(12, 30)) for _ in range(rnd.randrange(3, 7))]
        if i % 9 == 4:
            lines.insert(1, "Before it. " + items[rnd.randrange(1, 4)] + " and behind it, more words to come.")
        docs.append((i, "\n".join(lines)))
    base = docs[0][1].split()
    base[7] = "changed"
    docs += [(50, " ".join(base)), (51, docs[1][1]), (52, docs[2][1].split("\n")[0] + "\n" + sentence(40)), (53, "$$$ ### BUY!!! " * 40), (54, None), (55, "")]
    return docs, items


def test_scores_equal_plain_tables(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model, features = Q.train(docs, labels), Q.Features()
    rows = docs.select("doc_id", "text").limit(150).collect()
    x = features(pa.array([r.text for r in rows], pa.string()))
    got = {r.doc_id: r.score for r in Q.score(docs.where(docs.doc_id.isin([r.doc_id for r in rows])), model).collect()}
    assert all(abs(got[r.doc_id] - plain_score(model, v)) < 1e-9 for r, v in zip(rows, x))


def test_the_pipeline_equals_plain_loops(spark, tmp_path, monkeypatch):
    docs, items = corpus()
    folder = str(tmp_path)
    trained = Q.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    monkeypatch.setattr(Q, "train", lambda *a, **b: trained)  # the labels of these texts are those of other texts
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    x = Q.Features()(pa.array([t for _, t in docs], pa.string()))
    good = [(d, t) for (d, t), v in zip(docs, x) if plain_score(trained, v) >= Q.THRESHOLD]
    assert 20 < len(good) < len(docs)
    lines = list(test_fuzzy_lines.brute(good).items())
    classes, _ = test_icws_minhash.brute(lines)
    kept = [(d, t) for d, t in lines if classes[d] == d]
    safe = [(d, t) for d, t in kept if not leaks(t, items)]
    assert len(good) >= len(kept) > len(safe) > 10
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(B.default_path()), special_tokens={})
    want = set()
    for d, t in safe:
        ids = enc.encode_ordinary(t or "")
        want.add((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert len(got) == len(want) and set(got) == want
