import math

import numpy as np

from spectraframe.llm import cross_polytope as X

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def brute(rows):
    """n_links and component by all pairs; rows (vec_id, list)."""
    units = []
    for i, v in rows:
        ok = i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v, float))
        units.append(np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None)
    n = len(rows)
    links, up = [0] * n, list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= X.THRESHOLD:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted(((r[0], links[i], least.get(root(i))) for i, r in enumerate(rows)), key=str)


def corpus():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(40):
        base = rng.normal(size=24)
        for _ in range(int(rng.choice([1, 2, 6, 30]))):
            rows.append((len(rows), np.float32(base + rng.normal(size=24) * rng.choice([0, 0.1, 0.3])).tolist()))
    one = rows[3][1]
    return rows + [(900, None), (901, []), (902, [0.0] * 24), (903, [math.nan] * 24), (904, [1.0, None] + [0.0] * 22), (None, one), (905, one[:10]), (3, one), (906, [math.inf] + [0.0] * 23), (907, [3e38] * 24), (908, [1e38] * 24)]


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    for block, live in ((X.BLOCK, X.LIVE), (16, X.LIVE), (16, 1)):  # one block, many blocks, more functions
        monkeypatch.setattr(X, "BLOCK", block)
        monkeypatch.setattr(X, "LIVE", live)
        got = X.near_vectors(df).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty(spark):
    assert X.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(2).normal(size=(20, 64))
    y = X.rotate(x, 5)
    assert np.allclose(x @ x.T, y @ y.T)


def pairs(n, dim, rng):
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, n, dim)))
    b -= (a * b).sum(1, keepdims=True) * a
    return a, 0.9 * a + math.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)


def test_recall():
    """Pairs at cosine 0.9, the hardest ones, meet in some table."""
    rng = np.random.default_rng(0)
    for dim, functions in ((16, 1), (16, 3), (16, 4), (64, 1), (64, 2), (64, 3), (64, 4), (100, 2), (300, 1), (300, 2)):
        a, b = pairs(2000, dim, rng)
        tables = X.n_tables(dim, functions)
        p, q = X.codes(a, functions, tables), X.codes(b, functions, tables)
        met = (p[:, :, 0] == q[:, :, 0]) | (p[:, :, 1:] == q[:, :, :1]).any(2) | (q[:, :, 1:] == p[:, :, :1]).any(2)
        assert met.any(1).mean() > 0.996, (dim, functions, tables)


def test_links_near_the_threshold(spark):
    """Pairs within a hundred-thousandth of the threshold on either side, which rounding leaves open, are settled."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for i in range(300):
        c = 0.9 + (-1) ** i * 10.0 ** -rng.integers(5, 12)
        a, b = (x / np.linalg.norm(x) for x in rng.normal(size=(2, 32)))
        b -= (a @ b) * a
        b = c * a + math.sqrt(1 - c * c) * b / np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, b.tolist())]
        want[2 * i] = want[2 * i + 1] = int(c > 0.9)
    got = {r.vec_id: r.n_links for r in X.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[i] != want[i] for i in got) == 0
