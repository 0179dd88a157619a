import itertools
import random
import re
import time

from spectraframe.llm import spaced_seeds as S


def test_masks_hit_every_stretch():
    for gone in itertools.combinations(range(S.WORDS), 2):
        assert any(all(p + j not in gone for j, c in enumerate(m) if c == "1") for m in S.MASKS for p in range(S.WORDS - len(m) + 1))
    for n in range(S.SHORTEST, S.WORDS):
        for gone in itertools.combinations(range(n), n // 5):
            assert any(all(p + j not in gone for j, c in enumerate(m) if c == "1") for m in S.SHORT_MASKS for p in range(n - len(m) + 1))


def brute(docs, items):
    tok = lambda s: re.findall(r"\w+", (s or "").lower())
    out = set()
    for i, d in docs:
        w = tok(d)
        for j, t in items:
            x = tok(t)
            if len(x) < S.SHORTEST:
                continue
            for begin in range(-len(x) + 1, len(w)):
                lo, hi = max(0, begin), min(len(w), begin + len(x))
                best = (0, 0)
                for a in range(lo, hi):
                    total = 0
                    for b in range(a, hi):
                        total += 1 if w[b] == x[b - begin] else -S.PENALTY
                        best = max(best, (total, b + 1 - a))
                if best[0] > 0 and best[1] >= min(S.WORDS, len(x)):
                    out.add((i, j))
    return out


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["the", "of"]) if rnd.random() < 0.3 else "w" + str(rnd.randrange(400))
    items = [(j, " ".join(word() for _ in range(n))) for j, n in enumerate([3, 5, 6, 9, 12, 13, 20, 40, 40])] + [(100, None), (101, "")]
    docs = [(0, None), (1, ""), (2, "the of the of"), (3, items[7][1])]
    for i in range(60):
        x = items[rnd.randrange(9)][1].split()
        x = x[rnd.randrange(3) :] if rnd.random() < 0.4 else x
        x = [word() if rnd.random() < rnd.choice([0, 0.1, 0.2, 0.4]) else y.upper() for y in x]
        docs.append((10 + i, " ".join([word() for _ in range(rnd.randrange(40))] + x + [word() for _ in range(rnd.randrange(40))])))
    got = S.overlaps(spark.createDataFrame(docs + [docs[3]], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert sum(r.doc_id == 3 for r in got) == 2
    kept = S.drop_leaks(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int"), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "n"]
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {r.doc_id for r in got}


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert S.overlaps(one, bench).count() == 0 and S.drop_leaks(one, bench).count() == 1
    assert S.overlaps(none, one.toDF("item_id", "text")).count() == 0


def test_repeated_words_and_many_items(spark, monkeypatch):
    docs = [(1, "no " * 20_000), (2, "yes no " * 3_000), (3, "no " * 4 + "else"), (4, "other words " * 10)]
    items = [(j, "no " * 400) for j in range(3)] + [(9, "yes no " * 40), (10, "so " * 30)]
    t = time.time()
    for most in (S.ITEMS, 2):
        monkeypatch.setattr(S, "ITEMS", most)
        got = S.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), any_stretch=True).collect()
        assert sorted((r.doc_id, r.item_id, r.n_words) for r in got) == [(1, 0, 400), (1, 1, 400), (1, 2, 400), (2, 9, 80)]
    assert time.time() - t < 60


def test_columns_with_names_of_its_own(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, 6, 7, 8), (None, None, 1, 2, 3, 4)], "doc_id long, text string, doc int, `row` int, m int, item int")
    bench = spark.createDataFrame([(1, "a b c d e", 1, 2)], "item_id long, text string, doc int, m int")
    kept = S.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(None, None, 1, 2, 3, 4)]
    assert S.overlaps(docs, bench).count() == 1
