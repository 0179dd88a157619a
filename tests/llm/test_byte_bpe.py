import hashlib

import numpy as np
import public_tokenizers as P
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from spectraframe.llm import byte_bpe as B

PATTERN = regex.compile(P.PATTERN)
SPLIT = B.Splitter(B.class_runs())


def split(texts):
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, at = SPLIT(points, offsets)
    ends = [*starts[1:].tolist(), len(joined)]
    words = [joined[a:b] for a, b in zip(starts.tolist(), ends)]
    return [words[a:b] for a, b in zip(at[:-1], at[1:])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("ab s'tremvld  \n\t19é.!' 　Ω²", max_size=25), max_size=4))
def test_splits_as_the_pattern(texts):
    assert split(texts) == [PATTERN.findall(t) for t in texts]


TEXTS = [
    None, "", " ", "Hello world, it's a test: don't we'll they've I'm!  ", "naïve façade Ωmega ½ 123abc\n\n\nx", "'s 't''re", "　 a",
    "antidisestablishmentarianism xqzvkjw " * 40, "😀 emoji 👩‍👩‍👧 text", "a" * 3000, "\x00\x01 control", "the " * 2000, "' s", "x'",
]


def test_equals_tiktoken_and_round_trips(spark):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(B.default_path()), special_tokens={})
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1), (None, TEXTS[4], 1)]
    got = B.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, codes int"), full=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[4 if r.doc_id is None else r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    assert B.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_cache_changes_nothing(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = sorted(map(tuple, B.encode_documents(df).collect()))
    monkeypatch.setattr(B, "CACHE_WORDS", 20)
    assert sorted(map(tuple, B.encode_documents(df).collect())) == want
    monkeypatch.setattr(B, "CACHE_DOCS", 0)
    assert sorted(map(tuple, B.encode_documents(df).collect())) == want


def test_long_words(spark, monkeypatch):
    """Words of many blocks; blocks of few bytes, so that windows grow and the last way out is taken too."""
    rng = np.random.default_rng(3)
    letters = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    texts = ["a" * 1000, "abc" * 333, "ab" * 129 + "a", letters("ab", 500), letters("etaoin", 700), letters("abcdefghijklmnopqrstuvwxyz", 700), "thing" * 60, "-" * 257, letters("=-*/", 300), "é" * 100, " " * 300]
    texts += [letters("the ñandwigrs", 90).replace(" ", "e") for _ in range(40)]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(B.default_path()), special_tokens={})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for long in (B.LONG, 7, 3):
        monkeypatch.setattr(B, "LONG", long)
        for r in B.encode_documents(df, full=True).collect():
            assert r.ids == enc.encode_ordinary(texts[r.doc_id]), (long, texts[r.doc_id][:20])


def test_a_word_of_100000_letters(spark):
    text = "".join(np.random.default_rng(4).choice(list("abcdefghijklmnopqrstuvwxyz"), 100_000))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(B.default_path()), special_tokens={})
    (r,) = B.encode_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), full=True).collect()
    assert r.ids == enc.encode_ordinary(text)
