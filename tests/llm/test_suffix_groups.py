import hashlib
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from spectraframe.llm import suffix_groups as S


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(text):
    order = S.suffix_array(text)
    assert order == sorted(range(len(text)), key=lambda i: text[i:])
    same = S.common_prefixes(text, order)
    for k in range(1, len(order)):
        a, b = text[order[k - 1] :], text[order[k] :]
        assert same[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_suffix_array_of_words():
    rnd = random.Random(1)
    for text in ([0] * 500, [1, 0] * 300, [rnd.randrange(256) for _ in range(3000)], [int(c) for c in "01101001100101101001011001101001" * 20]):
        assert S.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(docs, length):
    """(doc_id, text) rows -> (n_bytes, n_removed, n_spans, sha) of each row."""
    data = [(t or "").encode() for _, t in docs]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((len(x), len(x) - len(kept), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcdefgh éü\n") for _ in range(n))
    pool = [text(rnd.choice([380, 399, 400, 401, 430, 700, 1500])) for _ in range(8)]
    docs = []
    for i in range(40):
        parts = []
        for _ in range(rnd.randrange(1, 4)):
            x = rnd.choice(pool) if rnd.random() < 0.6 else text(rnd.randrange(0, 900))
            if rnd.random() < 0.5 and len(x) > 450:
                a = rnd.randrange(len(x) - 420)
                x = x[a : a + rnd.randrange(390, 900)]
            if rnd.random() < 0.4:
                p = rnd.randrange(len(x) + 1)
                x = x[:p] + rnd.choice(["Z", "ZZ", ""]) + x[p + 1 :]
            parts.append(x)
        docs.append((i, text(rnd.randrange(3)).join(parts)))
    return docs + [(90, None), (91, ""), (92, "de " * 400), (93, "x" * 3000), (94, "ab" * 199), (95, docs[0][1]), (96, docs[1][1][7:])]


def check(spark, docs):
    rows = docs + [docs[2], (None, docs[3][1])]
    got = S.remove_repeats(spark.createDataFrame([(*d, "q") for d in rows], "doc_id long, text string, runs string")).collect()
    want = sorted(((d[0], *w) for d, w in zip(rows, brute(rows, S.LENGTH))), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == want
    assert any(0 < w[2] < w[1] for w in want)


def test_equals_brute_force(spark):
    check(spark, corpus(1))


def test_hot_cores_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 1)
    monkeypatch.setattr(S, "PART", 1000)
    check(spark, corpus(2))


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
