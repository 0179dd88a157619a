import random

import numpy as np
import pyarrow as pa

from spectraframe.llm import _common as C
from spectraframe.llm import fuzzy_lines as L


def brute(docs):
    """Rows (doc_id, text) -> texts without removed lines; rows are distinct."""
    places, texts = [], sorted({line.strip() for _, t in docs for line in (t or "").split("\n") if line.strip()})
    number = {t: i for i, t in enumerate(texts)}
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if L.jaccard(texts[i], texts[j]) >= L.THRESHOLD:
                up[root(i)] = root(j)
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            out[d] = None
            continue
        keep = []
        for line in t.split("\n"):
            if line.strip():
                c = root(number[line.strip()])
                if c in seen:
                    continue
                seen.add(c)
            keep.append(line)
        out[d] = "\n".join(keep)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    line = lambda: "".join(rnd.choice("abcdefghij é") for _ in range(rnd.randrange(1, 90)))
    pool = [line() for _ in range(40)] + ["", "  ", "x", "short"]
    docs = []
    for i in range(60):
        rows = []
        for _ in range(rnd.randrange(0, 8)):
            x = rnd.choice(pool)
            if rnd.random() < 0.4 and len(x) > 40:
                p = rnd.randrange(len(x))
                x = x[:p] + rnd.choice("XYZ") + x[p + 1 :]
            rows.append(rnd.choice(["", " ", "\t"]) + x + rnd.choice(["", "  "]))
        docs.append((i, "\n".join(rows)))
    return docs + [(100, None), (101, ""), (102, "\n\n"), (103, "q" * 20000 + "\n" + "q" * 20000)]


def test_equals_brute_force(spark, monkeypatch):
    for seed, small in ((1, C.SMALL_BUCKET), (2, 2)):
        monkeypatch.setattr(C, "SMALL_BUCKET", small)
        docs = corpus(seed)
        df = spark.createDataFrame([(*d, 7, "z") for d in docs], "doc_id long, text string, id int, n_lines string")
        out = L.dedup_lines(df)
        assert out.columns == ["doc_id", "text", "id", "n_lines", "n_removed"]
        got = {r.doc_id: r for r in out.collect()}
        assert {d: r.text for d, r in got.items()} == brute(docs)
        assert all(r.n_removed == (r.n_lines - len(r.text.split("\n")) if r.text else r.n_removed) for r in got.values())
        assert got[100].n_lines == got[101].n_lines == 0 and got[103].n_removed == 1


def test_repeated_rows_null_ids_and_empty(spark):
    text = "this is a line of some length\nand another line here"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "-") for r in L.dedup_lines(df).collect()))
    assert got == [(False, 1, text), (False, 1, text), (False, 2, "-"), (True, 0, "-")]
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_batches():
    lines = L.Lines()
    texts = ["a b\n  c  \n", "", None, " x \ny"]
    text, _, a, b, name, doc, number = lines(pa.array(texts, pa.string()))
    got = [(text[s:e], d, n) for s, e, d, n in zip(a, b, doc, number)]
    assert [(x[0], int(x[1]), int(x[2])) for x in got] == [("a b", 0, 0), ("c", 0, 1), ("", 0, 2), ("", 1, 0), ("", 2, 0), ("x", 3, 0), ("y", 3, 1)]
    assert [bool(n) for n in name] == [True, True, False, False, False, True, True]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for x, y in edges:
        up[max(root(x), root(y))] = min(root(x), root(y))
    want = {i: root(i) for x, y in edges if x != y for i in (x, y)}
    assert {r.id: r.component_id for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hashes_of_spans():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 500).astype(C.U64)
    starts = np.sort(rng.integers(0, 400, 200))
    ends = np.maximum.accumulate(starts + rng.integers(1, 60, 200))
    h = C.hash_spans(values, starts, ends, C.Powers())
    again = [C.hash_spans(values[s:e], np.array([0]), np.array([e - s]), C.Powers())[0] for s, e in zip(starts, ends)]
    assert (h == np.array(again)).all()


def test_measured_recall():
    """Of pairs of lines just above the threshold nearly all share a band."""
    rnd = random.Random(22)
    lines, pairs = L.Lines(), []
    while len(pairs) < 1500:
        x = "".join(rnd.choice("abcdefghij klmnop") for _ in range(rnd.randrange(80, 400)))
        y = list(x)
        for _ in range(max(1, round(len(x) * 0.012))):
            y[rnd.randrange(len(y))] = rnd.choice("xyz")
        if 0.8 <= L.jaccard(x, "".join(y)) < 0.86:
            pairs += [x, "".join(y)]
    _, values, a, b, _, _, _ = lines(pa.array(["\n".join(pairs)]))
    assert len(a) == len(pairs)
    keys = L.signatures(lines, values, a, b)
    met = (keys[::2] == keys[1::2]).any(1).mean()
    assert met > 0.997, met
