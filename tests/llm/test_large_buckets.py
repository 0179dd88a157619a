import random

import numpy as np
import pytest

from spectraframe.llm import _common as C
from spectraframe.llm import fuzzy_lines as L
from spectraframe.llm import icws_minhash as M


def classes(links, ids):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("small", [4, 64])
def test_drifting_chain_stays_whole(spark, monkeypatch, small):
    monkeypatch.setattr(C, "SMALL_BUCKET", small)

    def sets(column):
        """A text is a number, its set a window of 30 that moves by 3: only next ones reach 0.8."""
        return [(np.arange(3 * int(t), 3 * int(t) + 30, dtype=C.U64), np.ones(30)) for t in column.to_pylist()]

    rnd = random.Random(5)
    place = [*range(120), *range(1000, 1060), *range(5000, 5200, 10)]  # two chains, and 20 that match nothing
    ids = list(range(len(place)))
    rnd.shuffle(ids)
    texts = spark.createDataFrame([(i, str(p)) for i, p in zip(ids, place)], "id long, text string")
    rows = spark.createDataFrame([(7, i, 30) for i in ids], "key long, id long, size int")
    got = [(r.a, r.b) for r in C.bucket_links(rows, lambda wanted: texts.join(wanted, "id", "left_semi"), sets, 0.8).collect()]
    at = dict(zip(ids, place))
    want = [(i, j) for i in ids for j in ids if i < j and abs(at[i] - at[j]) == 1]
    assert {frozenset(x) for x in got} and classes(got, ids) == classes(want, ids)


def test_drifting_lines_leave_one(spark, monkeypatch):
    monkeypatch.setattr(C, "SMALL_BUCKET", 4)
    rnd = random.Random(9)
    line = [rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)]
    docs = []
    for i in range(80):  # each line rewrites a part of the one before
        line = line[10:] + [rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10)]
        docs.append("".join(line))
    assert all(L.jaccard(x, y) >= L.THRESHOLD for x, y in zip(docs, docs[1:])) and L.jaccard(docs[0], docs[10]) < L.THRESHOLD
    order = list(range(80))
    rnd.shuffle(order)
    df = spark.createDataFrame([(n, docs[i]) for n, i in enumerate(order)], "doc_id long, text string")
    assert sum(bool(r.text) for r in L.dedup_lines(df).collect()) == 1


def test_buckets_of_large_sets_are_cut(spark, monkeypatch):
    """Few ids with many members: cut by the members, with the same result."""
    monkeypatch.setattr(C, "SMALL_SETS", 2000)
    rnd = random.Random(3)
    base = ["w%d" % i for i in range(700)]
    docs = []
    for i in range(40):
        x = list(base) if i % 2 else [w + "x" for w in base]
        x[rnd.randrange(700)] = "new"
        docs.append((i, " ".join(x)))
    got = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i % 2 for i in range(40)}


def test_columns_with_names_of_its_own(spark):
    line = "a line of words that is long enough to be told apart from all the others, again and again"
    names = "doc_id long, text string, cut int, row_key int, line_nos int, gone_id int, doc int, `row` int, id int, same int, part int, said int"
    rows = [(1, line, *range(10)), (2, line, *range(10)), (2, line, *range(10)), (None, line, *range(10)), (None, None, *range(10))]
    df = spark.createDataFrame(rows, names)
    out = L.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    got = out.collect()
    assert sorted((r.doc_id or 0, r.text or "", *tuple(r)[2:12]) for r in got) == sorted([(1, line, *range(10)), (2, "", *range(10)), (2, "", *range(10)), (0, "", *range(10)), (0, "", *range(10))])
    kept = M.keep_one(df)
    assert kept.columns == df.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, line), (None, None)], key=str)
