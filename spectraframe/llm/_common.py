"""Shared helpers of the text operators: vectorised words and hashes, shared folders, components."""

from __future__ import annotations

import atexit
import re
import unicodedata
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised passes hold at once, so that their arrays stay in the processor's cache; a longer
#: single text is one slice.
SLICE_BYTES = 1 << 18
#: Bytes of a batch that goes to Python, and the setting that bounds it.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Ids of a bucket that one task compares by itself, and members of all their sets.
SMALL_BUCKET, SMALL_SETS = 1024, 1 << 19
#: Ids of a larger bucket that go to all of its blocks, about.
COMMON = 16
U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_MASK = (1 << 64) - 1


# --- hashing -----------------------------------------------------------------------------------


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser of x + seed; a new array."""
    x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_table() -> np.ndarray:
    return mix(np.arange(256, dtype=U64), 77)


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _P), ("down", _P_INV)):
                a = np.full(max(n, 1 << 16), U64(base))
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of values[start:end] (values: uint64 of the symbols), by prefix sums."""
    out = np.empty(len(starts), U64)
    lo = 0
    while lo < len(starts):  # blocks, so that the powers stay short
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SLICE_BYTES, "right")))
        a, b = int(starts[lo]), int(ends[lo:hi].max())
        up, down = powers.upto(b - a + 1)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum(values[a:b] * up[: b - a], out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        lo = hi
    return out


# --- text batches ------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column one after the other, and n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Runs of rows of a batch with at most `most` bytes of text, or one row."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _word_table() -> np.ndarray:
    """1 for the bytes of words: ASCII letters and digits, the underscore, and all beyond ASCII."""
    t = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (95, 96), (97, 123), (128, 256)):
        t[a:b] = True
    return t


#: Code points of scripts that are written without spaces (South-East Asian, CJK, kana, bopomofo, Yi).
UNSPACED = (
    (0xE00, 0xF00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x1950, 0x19E0), (0x1A20, 0x1AB0), (0x1B00, 0x1B80), (0x2E80, 0x2FE0),
    (0x3000, 0x3130), (0x31A0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA4D0), (0xA980, 0xAA00), (0xAA60, 0xAA80), (0xF900, 0xFB00),
    (0xFF66, 0xFFA0), (0x16FE0, 0x18D80), (0x1AFF0, 0x1B170), (0x20000, 0x32400),
)


@lru_cache(maxsize=1)
def word_kinds() -> np.ndarray:
    """For all code points: 1 for letters, marks, digits and the underscore, 2 for those that are words of their own."""
    kinds = np.fromiter((unicodedata.category(chr(i))[0] in "LMN" or i == 95 for i in range(0x110000)), np.uint8, 0x110000)
    for a, b in UNSPACED:
        kinds[a:b] *= 2
    return kinds


def beyond_ascii(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and code points of the characters beyond ASCII in UTF-8 bytes."""
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at].astype(np.int64)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    point = lead & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        point[more] = point[more] << 6 | data[at[more] + k] & 0x3F
    return at, size, point


def spans_where(flags: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true flags that stay within a document and between cuts: starts, ends, document numbers."""
    n = len(flags)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if cuts is not None:
        cut[cuts] = True
    first = flags.copy()
    first[1:] &= ~flags[:-1] | cut[1:n]
    last = flags.copy()
    last[:-1] &= ~flags[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class Words:
    """Words of text batches as hashes: lower case, runs of letters, marks, digits and underscores.

    In scripts that are written without spaces each character is a word. is_word flags bytes: all beyond ASCII.
    """

    def __init__(self) -> None:
        self.is_word, self.table, self.powers = _word_table(), _byte_table(), Powers()

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words in order, and offsets of the documents among them."""
        h, _, _, offsets = self.spans(column)
        return h, offsets

    def spans(self, column: pa.Array):
        """Hashes, byte starts and ends in the lowered bytes, and offsets of the documents."""
        data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(column.cast(pa.string()), "")))
        flags, cuts = self.is_word[data], None
        at, size, point = beyond_ascii(data)
        if len(at):
            kind = word_kinds()[point]
            for k in range(4):
                flags[(at + k)[(kind == 0) & (size > k)]] = False
            alone = kind == 2
            cuts = np.concatenate([at[alone], (at + size)[alone]])
        starts, ends, doc = spans_where(flags, offsets, cuts)
        h = hash_spans(self.table[data], starts, ends, self.powers)
        return h, starts, ends, np.searchsorted(doc, np.arange(len(offsets)), "left")


def shingles(h: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words, and the document of each; a text of fewer words is one shingle."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    if len(h) >= k:
        acc = np.zeros(len(h) - k + 1, U64)
        for j in range(k):
            acc *= U64(0xD6E8FEB86659FD93)
            acc += h[j : len(h) - k + 1 + j]
        ok = doc[: len(acc)] == doc[k - 1 :]
        out, at = mix(acc[ok], 5), doc[: len(acc)][ok]
    else:
        out, at = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.empty(len(short), U64)
        for i, d in enumerate(short):
            acc = U64(0)
            with np.errstate(over="ignore"):
                for x in h[offsets[d] : offsets[d + 1]]:
                    acc = acc * U64(0xD6E8FEB86659FD93) + x
            extra[i] = acc
        out, at = np.concatenate([out, mix(extra, 6)]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


# --- sessions, shared tables, components ---------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode one is made where it is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spectraframe-")
        sc.setCheckpointDir(folder)
    return folder


#: Folders with tables, by application, that are removed when the driver ends.
_FOLDERS: dict[str, str] = {}


def release(spark: SparkSession) -> None:
    """Removes the tables that operators wrote in this session; results that are not written yet can't be read any more."""
    folder = _FOLDERS.pop(spark.sparkContext.applicationId, None)
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _release_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None and spark.sparkContext._gateway is not None:
        try:
            release(spark)
        except Exception:  # noqa: BLE001  the session may be gone; its folder is not worth an error then
            pass


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """df written once as Parquet to the shared folder and read again: cut lineage that survives executors.

    The tables of a session go when its driver ends, or with `release`.
    """
    spark = df.sparkSession
    bound_batches(spark)
    own = spark.sparkContext.applicationId
    if own not in _FOLDERS:
        _FOLDERS[own] = f"{shared_folder(spark).rstrip('/')}/tables-{own}-{uuid.uuid4().hex[:8]}"
        atexit.register(_release_at_exit, spark)
    path = f"{_FOLDERS[own]}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python by bytes, unless the session says how large they are.

    By rows alone a batch of long texts can be as large as they like, in the JVM's native memory and in the worker's.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (id, component_id = smallest reachable id), for ids with an edge.

    Alternating large-star and small-star steps; each is a grouped minimum (combined before its shuffle) and an
    equi-join, so no node's neighbours are gathered in one task. The number of rounds is logarithmic in the
    length of the longest chain. No edges give no rows.
    """
    spark = edges.sparkSession
    cur = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(cur)
    while before[0]:
        both = cur.union(cur.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = materialize(small.union(least.select("u", "m")).where("u <> v").distinct(), "edges")
        after = mark(cur)
        if after == before:
            break
        before = after
    low = cur.groupBy("u").agg(F.min("v").alias("component_id"))
    roots = cur.select(F.col("v").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return low.withColumnRenamed("u", "id").union(roots).groupBy("id").agg(F.min("component_id").alias("component_id"))


def _cuts(n, size, most: int):
    """Blocks for n ids whose sets have `size` members in all, each with half of what one task takes."""
    return F.ceil(F.greatest(n / max(most // 2, 1), size / (SMALL_SETS // 2))).cast("int")


def rest_blocks(sized: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """Blocks of ids, (key, id), that hold each pair which links leave apart in a bucket: sized(key, id, size).

    The largest component of a bucket needs no comparison within itself; the other ids, the rest, are to be compared
    with all of the bucket. Both are cut into blocks by hash, and each block of the rest meets each other block.
    Buckets in one component give no rows.
    """
    parts = components(links).withColumnRenamed("component_id", "part")
    cur = materialize(sized.select("key", "id", "size").join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")), "parts")
    sizes = cur.groupBy("key", "part").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    top = sizes.groupBy("key").agg(F.max(F.struct("m", "part", "s")).alias("top"), F.sum("m").alias("n"), F.sum("s").alias("all")).where("top.m < n")
    rb, mb = _cuts(F.col("n") - F.col("top.m"), F.col("all") - F.col("top.s"), most), _cuts(F.col("top.m"), F.col("top.s"), most)
    blocks = top.select("key", F.col("top.part").alias("main"), rb.alias("rb"), mb.alias("mb"))
    cur = cur.select("key", "id", "part").join(blocks, "key")
    rest = F.col("part") != F.col("main")
    by_hash = F.xxhash64("id", F.lit(3))
    cur = cur.withColumn("x", F.when(rest, F.pmod(by_hash, F.col("rb"))).otherwise(F.col("rb") + F.pmod(by_hash, F.col("mb"))).cast("int"))
    last = F.when(rest, F.col("rb") + F.col("mb")).otherwise(F.col("rb")) - 1
    cur = cur.select("key", "id", "x", F.explode(F.sequence(F.lit(0), last)).alias("y")).where("x <> y")
    return cur.select(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("key"), "id")


def jaccard(x: np.ndarray, v: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets, each sorted by hash."""
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    low = np.minimum(v[same], w[at[same]]).sum()
    return float(low / (v.sum() + w.sum() - low))


def jaccard_matrix(sets: list[tuple[np.ndarray, np.ndarray]], dense: int = 8, width: int = 256) -> np.ndarray:
    """Weighted Jaccard similarities of all sets (hashes, weights) with each other.

    A weight is a stack of steps between the weights that its hash has in these sets, so a minimum is the sum of
    the steps that both have. Steps of `dense` sets or more are multiplied as matrices, the others pair by pair.
    """
    n = len(sets)
    low = np.zeros((n, n))
    x = np.concatenate([s[0] for s in sets])
    w = np.concatenate([s[1] for s in sets]).astype(np.float64)
    of = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    order = np.lexsort((w, x)) if len(w) and w.min() != w.max() else np.argsort(x, kind="stable")
    x, w, of = x[order], w[order], of[order]
    first = np.append(True, x[1:] != x[:-1])
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(x)))
    keep = np.repeat(size > 1, size)
    x, w, of, first = x[keep], w[keep], of[keep], first[keep]
    if len(x):
        group = np.cumsum(first) - 1
        ends = np.append(np.flatnonzero(first)[1:], len(x))[group]
        # Within a hash weights rise; a step up to weight w belongs to this row and all after it.
        step = w - np.where(first, 0.0, np.append(0.0, w[:-1]))
        new = np.flatnonzero(step > 0)
        height, lo, hi = step[new], new, ends[new]
        many = hi - lo >= dense
        for at in range(0, int(many.sum()), width):
            a, b, h = (v[many][at : at + width] for v in (lo, hi, height))
            m = b - a
            rows = of[np.repeat(a - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(int(m.sum()))]
            block = np.zeros((n, len(a)))
            block[rows, np.repeat(np.arange(len(a)), m)] = np.repeat(np.sqrt(h), m)
            low += block @ block.T
        a, b, h = lo[~many], hi[~many], height[~many]
        for i in range(dense):
            for j in range(i, dense):
                some = b - a > j
                np.add.at(low, (of[a[some] + i], of[a[some] + j]), h[some])
                if i != j:
                    np.add.at(low, (of[a[some] + j], of[a[some] + i]), h[some])
    total = np.array([s[1].sum() for s in sets], np.float64)
    return low / np.maximum(total[:, None] + total[None, :] - low, 1e-300)


def minima(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of n nodes, for links a[i] - b[i]."""
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        old = lab.copy()
        np.minimum.at(lab, a, low)
        np.minimum.at(lab, b, low)
        lab = lab[lab]
        if (lab == old).all():
            break
    return lab


def bucket_links(rows: DataFrame, texts, prepare, threshold: float) -> DataFrame:
    """Links (a, b) between ids of rows(key, id, size) that join, in each bucket, what links of all its pairs would join.

    Ids are linked at a weighted Jaccard similarity of `threshold` or more; size: of an id's set. Buckets of up to
    SMALL_BUCKET ids with up to SMALL_SETS members are dealt with where they are: their texts come sorted by bucket,
    all similarities are worked out as one matrix, and one link for each further id of a component goes out. Larger
    buckets are cut into blocks by hash, with a few ids that go to all blocks and so join them, and then each pair
    that is still apart is compared (`rest_blocks`): no task gets an unbounded bucket, and no pair is left out.
    texts(ids) gives (id, text) of ids(id); prepare(column) gives (sorted hashes, weights) of each text of a column.
    """
    most = SMALL_BUCKET
    rows = materialize(rows.groupBy("key", "id").agg(F.max("size").alias("size")), "rows")
    # Bands that put the same ids together make equal buckets, of which one is enough.
    name = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("all"), *name).where("n > 1")
    buckets = buckets.groupBy("n", "h1", "h2").agg(F.min("key").alias("key"), F.max("all").alias("all"))
    near = materialize(rows.join(buckets.select("key", "n", "all"), "key"), "near")
    held = materialize(texts(near.select("id").distinct()), "texts")
    edge = threshold - 1e-9  # sums of the matrix are rounded; pairs at the edge are worked out one by one

    def local(batches):
        key, ids, objects = None, [], []

        def done():
            if len(ids) <= 8:
                up = list(range(len(ids)))
                for i in range(len(ids)):
                    for j in range(i + 1, len(ids)):
                        if up[i] != up[j] and jaccard(*objects[i], *objects[j]) >= threshold:
                            a, b = sorted((up[i], up[j]))
                            up = [a if u == b else u for u in up]
                return [(ids[u], ids[k]) for k, u in enumerate(up) if u != k]
            sim = jaccard_matrix(objects)
            i, j = np.nonzero(np.triu(sim >= edge, 1))
            close = sim[i, j] < threshold + 1e-9
            ok = ~close
            ok[close] = [jaccard(*objects[a], *objects[b]) >= threshold for a, b in zip(i[close], j[close])]
            lab = minima(i[ok], j[ok], len(ids))
            return [(ids[m], ids[k]) for k, m in enumerate(lab.tolist()) if m != k]

        for batch in (part for whole in batches for part in slices(whole, "text", 1 << 22)):
            found = []
            coded = batch.column("text").dictionary_encode()
            made = prepare(coded.dictionary)
            for k, i, c in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist(), coded.indices.to_pylist()):
                if k != key:
                    if len(ids) > 1:
                        found += done()
                    key, ids, objects = k, [], []
                ids.append(i)
                objects.append(made[c])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])
        if len(ids) > 1 and (found := done()):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    def linked(sets: DataFrame) -> DataFrame:
        full = sets.join(held, "id").select("key", "id", "text")
        return full.repartition("key").sortWithinPartitions("key", "id").mapInArrow(local, "a long, b long")

    small = (F.col("n") <= most) & ((F.col("all") <= SMALL_SETS) | (F.col("n") == 2))
    links = linked(near.where(small).select("key", "id"))
    large = near.where(~small)
    if not large.isEmpty():
        cut = _cuts(F.col("n"), F.col("all"), most)
        common = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.ceil(F.col("n") / COMMON), F.ceil(F.col("all") / (SMALL_SETS // 4)))) == 0
        own = F.pmod(F.xxhash64("id", F.lit(2)), cut).cast("int")
        block = F.explode(F.when(common, F.sequence(F.lit(0), cut - 1)).otherwise(F.array(own)))
        links = materialize(links.union(linked(large.select("key", "id", block.alias("x")).select(F.xxhash64("key", "x").alias("key"), "id"))), "links")
        links = links.union(linked(rest_blocks(large, links, most)))
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def repeated_keys(table: DataFrame, keys: str, most: int = 1 << 19) -> DataFrame:
    """(key) that occur with two ids or more in table(keys array<long>, id long).

    Keys are hashes. Each task sorts its keys, keeps the least and the largest id of each, and cuts them by range
    into parts, one row each; a range has about `most` keys in all, and a frequent key adds no more than two ids
    from each task. So few rows are shuffled, and none of them is large.
    """
    total = table.agg(F.sum(F.size(keys))).first()[0] or 0
    bits = max(4, int(total / most).bit_length())

    def least(key: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        order = np.argsort(key, kind="stable")
        key, lo, hi = key[order], lo[order], hi[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        return (key[at], np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)) if len(at) else (key, lo, hi)

    def cut(batches):
        held: list = []

        def rows():
            key, lo, hi = least(*(np.concatenate(x) for x in zip(*held)))
            ends = np.searchsorted(key, np.arange(1, 1 << bits).astype(U64) << U64(64 - bits))
            # Differences of sorted keys, and of the two ids, have zero bytes that shuffles compress.
            parts = [[np.diff(x, prepend=U64(0)).tobytes() for x in np.split(key, ends)], *([x.tobytes() for x in np.split(v, ends)] for v in (lo, lo ^ hi))]
            some = [i for i, x in enumerate(parts[0]) if x]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([p[i] for i in some], pa.binary()) for p in parts)], names=["part", "key", "lo", "hi"])

        n = 0
        for batch in batches:
            lists = batch.column(keys)
            key = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
            ids = np.repeat(batch.column("id").to_numpy(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            held.append((key, ids, ids))
            n += len(key)
            if n > 1 << 21:
                yield rows()
                held, n = [], 0
        if n:
            yield rows()

    def join(key, table):
        k = np.concatenate([np.cumsum(np.frombuffer(x, U64), dtype=U64) for x in table["key"].to_pylist()])
        lo, both = (np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in ("lo", "hi"))
        k, lo, hi = least(k, lo, lo ^ both)
        return pa.table({"key": k[lo < hi].view(np.int64)})

    return table.select(keys, "id").mapInArrow(cut, "part int, key binary, lo binary, hi binary").groupBy("part").applyInArrow(join, "key long")


def key_filter(keys: DataFrame, bits: int = 24) -> np.ndarray:
    """2**bits flags, those set that the leading bits of hashes in the first column give: of fixed size."""
    at = keys.toDF("k").select(F.shiftrightunsigned("k", 64 - bits).alias("at"))
    words = at.selectExpr("shiftright(at, 5) AS w", "shiftleft(1L, CAST(at & 31L AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))
    got = words.toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.uint32)
    return out


def passes(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets through: all of its keys, and a few others."""
    at = hashes.view(U64) >> U64(64 - 5 - (len(flags) - 1).bit_length())
    return (flags[(at >> U64(5)).astype(np.int64)] >> (at & U64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)


def bucket_rows(table: DataFrame, keys: str) -> DataFrame:
    """(key, id, size) rows of keys that occur with two ids or more in table(keys array<long>, id long, size int)."""
    multi = materialize(repeated_keys(table, keys), "keys")
    flags = key_filter(multi)

    def run(batches):
        for batch in batches:
            lists = batch.column(keys)
            key = lists.flatten().to_numpy(zero_copy_only=False)
            ok = passes(flags, key)
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))[ok]
            yield pa.RecordBatch.from_arrays([pa.array(key[ok]), *(batch.column(c).take(pa.array(row)) for c in ("id", "size"))], names=["key", "id", "size"])

    return table.select(keys, "id", "size").mapInArrow(run, "key long, id long, size int").join(multi, "key", "left_semi")
