"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its shingles of five words (a text of fewer words is one shingle, one without
words has none and is never a duplicate). A shingle's weight is its count in the document times its inverse
document frequency, counted over all documents in a hashed space of 2**IDF_BITS entries, so that what every task
needs has a fixed size. Documents are linked if the weighted Jaccard similarity (sum of minima over sum of
maxima) is THRESHOLD or more; classes are connected components of links.

1. One pass counts document frequencies.
2. A second pass draws HASHES consistent samples of each document (the same shingle and weight give the same
   sample everywhere) and cuts them into BANDS bands. Documents with equal weighted sets become one first.
3. Documents in one bucket are linked by their exact similarities (`bucket_links`), without lists of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 8, 2
HASHES = BANDS * ROWS
IDF_BITS = 18


def weighted_sets(h: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of documents in order of document and hash: hashes, weights, offsets."""
    x, doc = C.shingles(h, offsets, SHINGLE)
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(x)))
    x, doc = x[at], doc[at]
    return x, count * idf[(x & C.U64(len(idf) - 1)).astype(np.int64)], np.searchsorted(doc, np.arange(len(offsets)))


def samples(x: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Improved consistent weighted sampling: HASHES sample hashes for each nonempty set.

    For shingle and hash function: r, c ~ Gamma(2, 1) and b ~ U(0, 1) from the shingle's hash; t = floor(ln w / r
    + b), ln y = r (t - b); the shingle with the least ln a = ln c - ln y - r is the sample, with its t.
    """
    starts = offsets[:-1]
    n = len(starts)
    out = np.empty((n, HASHES), C.U64)
    if not len(x):
        return out
    log_w = np.log(weights).astype(np.float32)
    unit = np.float32(2.0**-32)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    part = lambda z: ((z & C.U64(0xFFFFFFFF)).astype(np.uint32).astype(np.float32) + np.float32(0.5)) * unit
    for k in range(HASHES):
        z1, z2 = C.mix(x, 1000 + 2 * k), C.mix(x, 1001 + 2 * k)
        z3 = (z1 ^ (z2 >> C.U64(17))) * C.U64(0x9FB21C651E98DF25)
        r = -np.log(part(z1) * part(z1 >> C.U64(32)))
        log_c = np.log(-np.log(part(z2) * part(z2 >> C.U64(32))))
        b = part(z3 >> C.U64(32))
        t = np.floor(log_w / r + b)
        a = log_c - r * (t - b) - r
        least = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == least[doc])
        first = hit[np.searchsorted(doc[hit], np.arange(n))]  # ties go to the lesser hash
        out[:, k] = C.mix(x[first] + t[first].astype(np.int64).astype(C.U64) * C.U64(0x9E3779B97F4A7C15), 7)
    return out


def bands(sample: np.ndarray) -> np.ndarray:
    out = np.empty((len(sample), BANDS), C.U64)
    for i in range(BANDS):
        acc = np.full(len(sample), C.U64(i + 1))
        for j in range(ROWS):
            acc = C.mix(acc * C.U64(0xD6E8FEB86659FD93) + sample[:, i * ROWS + j], 8)
        out[:, i] = acc
    return out


# --- on DataFrames -----------------------------------------------------------------------------------------


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """ln((n + 1) / (df + 1)) + 0.1 of the hashed shingles, over all documents: 2**IDF_BITS numbers.

    The offset keeps weights positive. df of an entry counts documents' distinct shingles that hash to it.
    """
    size = 1 << IDF_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total, docs_seen = C.Words(), np.zeros(size, np.int64), 0
        ones = np.ones(size)
        for whole in batches:
            for batch in C.slices(whole):
                x, _, _ = weighted_sets(*words(batch.column("text")), ones)
                total += np.bincount((x & C.U64(size - 1)).astype(np.int64), minlength=size)
                docs_seen += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs_seen))], names=["at", "n"])

    got = _plain(docs).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = got["at"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(size)
    df[at[at >= 0]] = n[at >= 0]
    return np.maximum(np.log((float(n[at < 0].sum()) + 1) / (df + 1)), 0) + 0.1


SCHEMA = "doc long, doc_id long, same long, bands array<long>, size int"


def _names(x: np.ndarray, w: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit names of weighted sets: hashes of sums over their mixed shingles and weights."""
    mixed = C.mix(x + np.asarray(w, np.float64).view(C.U64) * C.U64(0xD6E8FEB86659FD93), 9)
    sums = np.zeros(len(x) + 1, C.U64)
    np.cumsum(mixed, out=sums[1:])
    return C.mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(C.U64), 10).view(np.int64)


def _sketch(idf: np.ndarray):
    """doc, doc_id, the name of the weighted set (null: no words), the keys of the bands and the size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = C.Words()
        for whole in batches:
            for batch in C.slices(whole):
                x, w, offsets = weighted_sets(*words(batch.column("text")), idf)
                some = np.diff(offsets) > 0
                own = np.append(offsets[:-1][some], offsets[-1])
                keys = bands(samples(x, w, own)).view(np.int64)
                where = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), batch.column("doc_id"), pa.array(_names(x, w, offsets), mask=~some), pa.ListArray.from_arrays(pa.array(where), pa.array(keys.ravel())), pa.array(np.diff(offsets).astype(np.int32))],
                    names=["doc", "doc_id", "same", "bands", "size"],
                )

    return run


def _named(idf: np.ndarray):
    """The texts with the names of their weighted sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = C.Words()
        for whole in batches:
            for batch in C.slices(whole):
                yield pa.RecordBatch.from_arrays([pa.array(_names(*weighted_sets(*words(batch.column("text")), idf))), batch.column("text")], names=["same", "text"])

    return run


def _sets(idf: np.ndarray):
    """Weighted sets of each text."""

    def run(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        words, out = C.Words(), []
        for part in C.slices(pa.RecordBatch.from_arrays([column], names=["text"])):
            x, w, at = weighted_sets(*words(part.column("text")), idf)
            out += [(x[a:b], w[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return out

    return run


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc, doc_id, same) of each row of docs, and (same, part) of its weighted sets: the class that each belongs to.

    doc is a hash of id and text that tells rows apart; same is null for a text without words.
    """
    plain = _plain(docs).withColumn("doc", F.xxhash64("doc_id", "text"))
    idf = inverse_frequencies(plain)
    made = C.materialize(plain.mapInArrow(_sketch(idf), SCHEMA), "sketches")
    # From here on a set stands for all documents that have it.
    heads = made.where("same is not null").groupBy("same").agg(F.min("doc").alias("doc"))

    def texts(ids: DataFrame) -> DataFrame:
        ids = C.materialize(ids.toDF("same"), "ids")
        own = heads.join(ids, "same", "left_semi").select("doc")
        out = plain.join(own, "doc", "left_semi").mapInArrow(_named(idf), "same long, text string")
        return out.join(ids, "same", "left_semi").groupBy("same").agg(F.min("text").alias("text")).toDF("id", "text")

    rows = C.bucket_rows(made.where("same is not null").select("bands", F.col("same").alias("id"), "size"), "bands")
    links = C.materialize(C.bucket_links(rows, texts, _sets(idf), threshold), "links")
    parts = C.components(links).toDF("same", "part")
    sets = heads.select("same").join(parts, "same", "left").withColumn("part", F.coalesce("part", "same"))
    return made.select("doc", "doc_id", "same"), C.materialize(sets, "classes")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, component_id and kept of docs(doc_id, text): one row per distinct non-null id.

    component_id is the least doc_id of the class, kept tells whether it is the document's own. Null ids have no
    class and are left out; of repeated ids with different texts each joins classes and the id has the least of
    them; null, empty and word-less texts are alone; other columns are ignored; an empty table gives
    an empty result.
    """
    made, sets = _classes(docs.where("doc_id is not null"), threshold)
    least = made.join(sets, "same").groupBy("part").agg(F.min("doc_id").alias("c"))
    of_set = C.materialize(sets.join(least, "part").select("same", "c"), "least")
    out = made.select("doc_id", "same").join(of_set, "same", "left").groupBy("doc_id")
    out = out.agg(F.min(F.coalesce("c", "doc_id")).alias("component_id"))
    return out.select("doc_id", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, with their columns, with one row of each class: the one with the least id (nulls last), of equals one.

    Texts without words are alone, and all stay. Repeated rows are of one class, so one stays.
    """
    made, sets = _classes(docs, threshold)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "doc")
    classed = made.join(sets, "same").select("doc", "part", order.alias("o"))
    # Written, so that the join has its own exchange of either side: a class of very many documents can be split then.
    first = C.materialize(classed.groupBy("part").agg(F.min("o").alias("first")), "first")
    gone = C.materialize(classed.join(first, "part").where(F.col("o.doc") != F.col("first.doc")).select("doc").distinct(), "gone")
    again = C.materialize(made.where("same is not null").groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "again")
    row = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("doc"))
    row = row.join(gone, "doc", "left_anti")
    one = row.join(again, "doc", "left_semi").dropDuplicates(["doc"])
    return row.join(again, "doc", "left_anti").unionByName(one).select("row.*")


def op5_icws_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir))
