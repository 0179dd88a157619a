"""Embedding near-duplicates by cross-polytope hashing.

A vector, padded to a power of two, goes through fast pseudo-random rotations (three rounds of random signs and a
Walsh-Hadamard transform each); a hash function is the signed coordinate of largest size, and a bucket of a table
joins the functions' values. Multiprobe: a vector also looks into the buckets it nearly fell into. All vectors
that look into a bucket are compared with those that live in it, by cosine in double precision.

- Identical vectors become one first, with a count.
- Buckets get vectors rounded to 16 bits a component, with the size of the rounding error. That settles all pairs but
  those within the errors' bound of the threshold, whose full vectors are fetched.
- Buckets are dealt with in blocks of at most BLOCK vectors a side, so that no task gets an unbounded bucket.
- A pair that meets in several buckets is counted in the first only, which follows from the two vectors' codes, so
  links are summed without listing pairs; each block gives a spanning forest of its links for the components.
- The number of functions to a bucket grows with the logarithm of the number of vectors; buckets keep their size. The
  number of tables follows from the share of simulated pairs at the threshold that meet in one table, so that a share
  of MISSED of all pairs, at most, meets in none, in any dimension and with any number of functions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

THRESHOLD = 0.9
PROBES = 4
BLOCK = 2048
#: Vectors that live in a bucket, about.
LIVE = 500
#: Share of the pairs at the threshold that meet in no table.
MISSED = 1e-3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two; normalised."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """A fast pseudo-random rotation of the rows."""
    d = x.shape[1]
    for r in range(3):
        sign = np.where(C.mix(np.arange(d, dtype=C.U64), seed * 3 + r) >> C.U64(63), 1.0, -1.0)
        x = hadamard(x * sign)
    return x


@lru_cache(maxsize=64)
def n_tables(dim: int, functions: int, threshold: float = THRESHOLD, pairs: int = 4000) -> int:
    """Tables that pairs at the threshold need, from `pairs` simulated ones."""
    rng = np.random.default_rng(7)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, pairs, max(dim, 2))))
    y -= (x * y).sum(1, keepdims=True) * x
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * y / np.linalg.norm(y, axis=1, keepdims=True)
    a, b = codes(x, functions, 2), codes(y, functions, 2)
    home_a, home_b = a[:, :, 0], b[:, :, 0]
    meet = (home_a == home_b) | (a[:, :, 1:] == home_b[:, :, None]).any(2) | (b[:, :, 1:] == home_a[:, :, None]).any(2)
    share = min(max(float(meet.mean()) - 0.01, 0.01), 0.95)
    return max(3, math.ceil(math.log(MISSED) / math.log(1 - share)))


def code_type(dim: int, functions: int) -> np.dtype:
    """The least type that tells the buckets of a table apart, or has 32 bits of a hash."""
    n = (2 << max(dim - 1, 0).bit_length()) ** functions
    return np.dtype(np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32)


def codes(x: np.ndarray, functions: int, tables: int, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, 1 + probes): the bucket a row lives in, and those it nearly fell into."""
    n, d = x.shape
    size = 1 << max(d - 1, 0).bit_length()
    kind = code_type(d, functions)
    x = np.concatenate([x, np.zeros((n, size - d))], axis=1)
    out = np.empty((n, tables, 1 + probes), kind)
    alone = min(probes + 1, 2 * size)
    for t in range(tables):
        tops, gaps = [], []
        for f in range(functions):
            y = rotate(x, 1 + t * functions + f)
            both = np.concatenate([y, -y], axis=1)
            top = np.argpartition(-both, alone - 1, axis=1)[:, :alone] if alone < 2 * size else np.tile(np.arange(2 * size), (n, 1))
            value = np.take_along_axis(both, top, 1)
            order = np.lexsort((top, -value), axis=1)
            top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
            tops.append(top.astype(C.U64))
            gaps.append(value[:, :1] - value)
        home = [top[:, 0] for top in tops]

        def bucket(parts: list[np.ndarray]) -> np.ndarray:
            acc = np.zeros(n, C.U64)
            for p in parts:
                acc = acc * C.U64(2 * size) + p
            return (C.mix(acc, 50) >> C.U64(32)).astype(kind) if (2 * size) ** functions > 1 << 16 else acc.astype(kind)

        out[:, t, 0] = bucket(home)
        # Every one-step change of the home bucket, by its gap.
        gap = np.concatenate([g[:, 1:] for g in gaps], axis=1)
        near = [bucket([*home[:f], tops[f][:, k], *home[f + 1 :]]) for f in range(functions) for k in range(1, alone)]
        order = np.argsort(gap, axis=1, kind="stable")[:, :probes] if near else np.zeros((n, 0), int)
        picked = np.take_along_axis(np.column_stack(near), order, 1) if near else np.zeros((n, 0), kind)
        out[:, t, 1 : 1 + picked.shape[1]] = picked
        out[:, t, 1 + picked.shape[1] :] = out[:, t, :1]
    return out


def first_meeting(a: np.ndarray, b: np.ndarray, a_id: np.ndarray, b_id: np.ndarray, table: int) -> np.ndarray:
    """Whether pairs (a looks into b's home) meet first here: codes of the pairs' sides, (pairs, tables, 1 + probes)."""
    home_a, home_b = a[:, :, 0], b[:, :, 0]
    lives = home_a == home_b
    looks = (a[:, :, 1:] == home_b[:, :, None]).any(2)
    seen = (b[:, :, 1:] == home_a[:, :, None]).any(2)
    before = (lives | looks | seen)[:, :table].any(1)
    # In this table: neighbours in one home are counted from the lesser id; of two that see each other, likewise.
    mutual = lives[:, table] | (looks[:, table] & seen[:, table])
    return ~before & (~mutual | (a_id < b_id))


def rounded(unit: np.ndarray) -> tuple[np.ndarray, float, float]:
    """A unit vector's components as 16-bit numbers, their step, and the length of what rounding took away."""
    step = float(np.abs(unit).max()) / 32767
    low = np.rint(unit / step).astype("<i2")
    return low, step, float(np.sqrt(((unit - low * step) ** 2).sum()))


def _link_block(threshold: float, functions: int):
    """Links within a block: sums of links by node, a spanning forest, and the pairs that rounding leaves open."""

    def run(key, table):
        t, dim = key[0].as_py(), key[1].as_py()
        lives = table["lives"].to_numpy()
        node, count, lost = (table[c].to_numpy() for c in ("node", "n", "lost"))
        unit = np.frombuffer(b"".join(table["low"].to_pylist()), "<i2").reshape(-1, dim) * table["step"].to_numpy()[:, None]
        code = np.frombuffer(b"".join(table["code"].to_pylist()), code_type(dim, functions)).reshape(len(node), -1, 1 + PROBES)
        nodes, number = np.unique(node, return_inverse=True)
        own, lookers = np.flatnonzero(lives), np.flatnonzero(table["looks"].to_numpy())
        links, at, to, open_ = np.zeros(len(nodes), np.int64), [], [], []
        for lo in range(0, len(lookers), 512):
            rows = lookers[lo : lo + 512]
            near = unit[rows] @ unit[own].T
            slack = lost[rows][:, None] + lost[own][None, :] + lost[rows][:, None] * lost[own][None, :] + 1e-12
            i, j = np.nonzero((near + slack >= threshold) & (node[rows][:, None] != node[own][None, :]))
            sure = (near - slack)[i, j] >= threshold
            i, j = rows[i], own[j]
            for cut in range(0, len(i), 1 << 16):
                part = slice(cut, cut + (1 << 16))
                ok = first_meeting(code[i[part]], code[j[part]], node[i[part]], node[j[part]], t)
                a, b = i[part][ok & sure[part]], j[part][ok & sure[part]]
                links += np.bincount(number[a], count[b], len(nodes)).astype(np.int64) + np.bincount(number[b], count[a], len(nodes)).astype(np.int64)
                a, b = i[part][ok & ~sure[part]], j[part][ok & ~sure[part]]
                open_.append(np.column_stack([node[a], node[b]]))
            at.append(i[sure])
            to.append(j[sure])
        i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (at, to))
        lab = C.minima(number[i], number[j], len(nodes))
        some = np.flatnonzero((links > 0) | (lab != np.arange(len(nodes))))
        left = np.concatenate([np.zeros((0, 2), np.int64), *open_])
        return pa.table({
            "node": np.append(nodes[some], left[:, 0]), "links": np.append(links[some], np.zeros(len(left), np.int64)),
            "to": np.append(nodes[lab[some]], left[:, 1]), "open": np.append(np.zeros(len(some), bool), np.ones(len(left), bool)),
        })

    return run


def _settle(threshold: float):
    """Links of the pairs that rounding left open, from their full vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("unit_a", "unit_b"))
            ok = pa.array([bool(np.dot(np.frombuffer(u, np.float64), np.frombuffer(v, np.float64)) >= threshold) for u, v in zip(x, y)], pa.bool_())
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(ok)

    return run


SCHEMA = "node long, vec_id long, unit binary, dim int"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision, and a 64-bit name of the vector; null for vectors that link with nothing."""
    for batch in batches:
        names, units, dims = [], [], []
        for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
            x = None if v is None or vec_id is None or None in v else np.array(v, np.float64)
            if x is not None and len(x) and np.isfinite(x).all():
                top = np.abs(x).max()
                x = x / top if top > 0 else x
                norm = float(np.sqrt((x * x).sum()))
                if norm > 0:
                    raw = (x / norm).tobytes()
                    names.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True))
                    units.append(raw)
                    dims.append(len(x))
                    continue
            names.append(None)
            units.append(None)
            dims.append(None)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch.column("vec_id"), pa.array(units, pa.binary()), pa.array(dims, pa.int32())], names=["node", "vec_id", "unit", "dim"])


def _coded(functions: int, threshold: float):
    """What buckets get of each vector: rounded components, codes, and the buckets, those it lives in first of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                dims = batch.column("dim").to_numpy(zero_copy_only=False)
                for dim in np.unique(dims).tolist():
                    part = batch.filter(pa.array(dims == dim))
                    x = np.frombuffer(b"".join(part.column("unit").to_pylist()), np.float64).reshape(-1, dim)
                    code = codes(x, functions, n_tables(dim, functions, threshold))
                    low, step, lost = zip(*map(rounded, x))
                    cols = [part.column(c) for c in ("node", "n", "dim")]
                    buckets = pa.array(code.reshape(len(x), -1).astype(np.int64).tolist(), pa.list_(pa.int64()))
                    more = [pa.array([v.tobytes() for v in low], pa.binary()), pa.array(step), pa.array(lost), pa.array([c.tobytes() for c in code], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*cols, *more, buckets], names=["node", "n", "dim", "low", "step", "lost", "code", "buckets"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of vectors(vec_id, embedding): one row per input row.

    Null vectors and ids, empty and zero vectors, and vectors with null or non-finite components link with
    nothing; vectors of different lengths are not compared. n_links counts the other rows at or above the
    threshold, repeated rows included; component_id is the least vec_id reachable. Repeated ids with different
    vectors are each compared on their own. A row with a null id has a null component and is kept. Other columns
    are ignored; an empty table gives an empty result.
    """
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = C.materialize(plain.mapInArrow(_units, SCHEMA), "vectors")
    sets = C.materialize(rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.min("unit").alias("unit"), F.min("dim").alias("dim")), "nodes")
    total, dim = sets.agg(F.count("*"), F.max("dim")).first()
    width = 2 << max((dim or 1) - 1, 1).bit_length()
    functions = max(1, math.ceil(math.log(max(total / LIVE, 1)) / math.log(width) - 0.2))
    coded = sets.select("node", "unit", "n", "dim").mapInArrow(_coded(functions, threshold), "node long, n long, dim int, low binary, step double, lost double, code binary, buckets array<long>")
    coded = C.materialize(coded, "codes")
    spread = coded.select("*", F.posexplode("buckets").alias("at", "bucket")).drop("buckets")
    spread = spread.withColumn("t", F.floor(F.col("at") / (1 + PROBES)).cast("int")).withColumn("lives", F.col("at") % (1 + PROBES) == 0).drop("at")
    # Rows of a home, and of all that look into it, decide into how many blocks either side is cut.
    size = spread.groupBy("t", "dim", "bucket").agg(F.count_if("lives").alias("homes"), F.count("*").alias("looks")).where("homes > 0 and looks > 1")
    size = size.select("t", "dim", "bucket", F.ceil(F.col("homes") / BLOCK).cast("int").alias("hb"), F.ceil(F.col("looks") / (2 * BLOCK)).cast("int").alias("qb"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("hb")).cast("int")
    look = F.pmod(F.xxhash64("node", F.lit(2)), F.col("qb")).cast("int")
    placed = spread.join(size, ["t", "dim", "bucket"]).withColumns({"own": own, "look": look})
    what = ("node", "n", "low", "step", "lost", "code")
    # Where there is one block on either side, a row goes there once; else homes go to each block of lookers, and lookers to each block of homes.
    one = placed.where("hb = 1 and qb = 1").select("t", "dim", "bucket", F.lit(0).alias("h"), F.lit(0).alias("q"), "lives", F.lit(True).alias("looks"), *what)
    many = placed.where("hb > 1 or qb > 1")
    homes = many.where("lives").select("t", "dim", "bucket", F.col("own").alias("h"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), F.lit(True).alias("lives"), F.lit(False).alias("looks"), *what)
    looks = many.select("t", "dim", "bucket", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("h"), F.col("look").alias("q"), F.lit(False).alias("lives"), F.lit(True).alias("looks"), *what)
    blocks = one.unionByName(homes).unionByName(looks)
    schema = "node long, links long, to long, open boolean"
    found = C.materialize(blocks.groupBy("t", "dim", "bucket", "h", "q").applyInArrow(_link_block(threshold, functions), schema), "found")
    sides = [sets.select(F.col("node").alias(x), F.col("unit").alias(f"unit_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab"]
    left = found.where("open").select(F.col("node").alias("a"), F.col("to").alias("b")).join(sides[0], "a").join(sides[1], "b")
    left = C.materialize(left.select("a", "b", "unit_a", "unit_b", "n_a", "n_b").mapInArrow(_settle(threshold), "a long, b long, n_a long, n_b long"), "settled")
    sure = found.where("not open")
    links = sure.select("node", "links").union(left.select("a", "n_b")).union(left.select("b", "n_a")).groupBy("node").agg(F.sum("links").alias("links"))
    edges = sure.select(F.col("node").alias("a"), F.col("to").alias("b")).union(left.select("a", "b"))
    parts = C.components(edges).withColumnRenamed("id", "node")
    named = sets.select("node", "least", "n").join(parts, "node", "left").join(links, "node", "left").withColumn("component_id", F.coalesce("component_id", "node"))
    least = named.groupBy("component_id").agg(F.min("least").alias("c"))
    named = named.join(least, "component_id").select("node", "c", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.select("node", "vec_id").join(named, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
