"""Benchmark decontamination by spaced seeds.

Fixed masks over runs of eight words keep six positions and ignore two, so that a run still meets its source
when ignored words were substituted. Hashes of the kept words of every run of the benchmark are looked up from
every run of the documents. Each hit fixes an alignment of a document with an item; the whole alignment is then
compared word by word, where matches score 1 and substitutions -4. In the query and the pipeline an alignment
counts if any stretch of 13 words (of a shorter item: all of it) has at least four matches for each substitution,
wherever these are; the functions' default counts it only if its best-scoring stretch is so long. The two masks
together hit every stretch of 13 words with up to two substitutions. Items of fewer than 13 words also use masks
of four kept words.

Both sides give hashes of their seeds, and these are joined:

1. Items become lists of word hashes, and rows (seed, item, places).
2. One pass over the documents gives rows (seed, document, places) of the seeds that pass a filter of the items'
   seeds, a bitmap of at most 2**FILTER_BITS bits. Equal seeds of a document are one row, so a text that says one
   word again and again joins no more rows than any other.
3. The join on the seed gives candidate pairs; documents that have any are read again, and each alignment that the
   places allow is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

MASKS = ("11101011", "11001111")
SHORT_MASKS = ("1111", "10111", "11011", "11101")
#: An overlap spans so many words, or the whole item if that is shorter, and at least SHORTEST.
WORDS, SHORTEST = 13, 5
PENALTY = 4.0
#: Bits of the filter of seeds, at most.
FILTER_BITS = 27
#: Candidate items of a document that are dealt with at once.
ITEMS = 256


def _seeds(h: np.ndarray, doc: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the masked runs of words, and where they begin; runs stay within a document."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, C.U64), np.zeros(0, np.int64)
    acc = np.zeros(n, C.U64)
    for j, c in enumerate(mask):
        if c == "1":
            acc *= C.U64(0xD6E8FEB86659FD93)
            acc += h[j : j + n]
    ok = np.flatnonzero(doc[:n] == doc[len(mask) - 1 :])
    return C.mix(acc[ok], 100 + number), ok


def best_stretch(same: np.ndarray, least: int = 0) -> tuple[int, int, int]:
    """Begin, end and matches of the stretch of `least` words or more with the best sum of 1 for a match and -PENALTY otherwise.

    Of several the longest, and of those the first.
    """
    sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -PENALTY))])
    low = np.minimum.accumulate(sums)[: len(sums) - least]
    gain = sums[least:] - low
    ends = np.flatnonzero(gain == gain.max())
    begins = np.searchsorted(-low, -low[ends])  # the first place with that low
    ends = ends + least
    k = int(np.argmax(ends - begins))
    return int(begins[k]), int(ends[k]), int(same[begins[k] : ends[k]].sum())


def tolerated(same: np.ndarray, size: int) -> bool:
    """Whether any stretch of `size` words has PENALTY matches or more for each substitution."""
    gone = np.concatenate([[0], np.cumsum(~same)])
    return len(same) >= size and int((gone[size:] - gone[:-size]).min()) <= size // (1 + PENALTY)


SCHEMA = "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_matches long"


def _lists(rows: pa.Array, key: np.ndarray, at: np.ndarray, owner: np.ndarray, name: str, first: np.ndarray) -> pa.RecordBatch:
    """Rows (seed, owner, places): of each owner's equal seeds the places, from the owner's first word."""
    order = np.lexsort((at, key, owner))
    key, at, owner = key[order], at[order], owner[order]
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))) if len(key) else np.zeros(0, np.int64)
    places = pa.ListArray.from_arrays(pa.array(np.append(new, len(key)).astype(np.int32)), pa.array((at - first[owner]).astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), rows.take(pa.array(owner[new])), places], names=["seed", name, f"{name}_at"])


def _every_seed(h: np.ndarray, doc: np.ndarray, masks: int, keep) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the seeds of all masks that keep(hashes, places, number of the mask) leaves."""
    found = []
    for i, mask in enumerate((MASKS + SHORT_MASKS)[:masks]):
        k, at = _seeds(h, doc, mask, i)
        ok = keep(k, at, i)
        found.append((k[ok], at[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = C.Words()
    for whole in batches:
        for batch in C.slices(whole):
            h, offsets = words(batch.column("text"))
            said = pa.array([h[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("item", "item_id", "m")), said, pa.array(np.diff(offsets).astype(np.int32))], names=["item", "item_id", "m", "words", "size"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = batch.column("size").to_numpy()
        h = np.frombuffer(b"".join(batch.column("words").to_pylist()), C.U64)
        doc = np.repeat(np.arange(len(size)), size)
        k, at = _every_seed(h, doc, len(MASKS + SHORT_MASKS), lambda _, at, i: (i < len(MASKS)) | (size[doc[at]] < WORDS))  # noqa: B023
        yield _lists(batch.column("item"), k, at, doc[at], "item", np.cumsum(size) - size)


def _doc_seeds(flags: np.ndarray, masks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = C.Words()
        for whole in batches:
            for batch in C.slices(whole):
                h, offsets = words(batch.column("text"))
                doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                k, at = _every_seed(h, doc, masks, lambda k, *_: C.passes(flags, k))
                if len(k):
                    yield _lists(batch.column("doc"), k, at, doc[at], "doc", offsets)

    return run


def _begins(seeds: list[dict], size: int, n: int) -> np.ndarray:
    """Places in a document of n words where the first word of an item of `size` words lies, by pairs of equal seeds."""
    marks = np.zeros(n + size + 1, bool)
    for s in seeds:
        doc, item = (np.array(s[c], np.int64) for c in ("doc_at", "item_at"))
        short, long = sorted((doc, item), key=len)
        for x in short.tolist():  # as many passes as the rarer side has places
            marks[(long - x if long is doc else x - long) + size] = True
    return np.flatnonzero(marks) - size


def _verify(any_stretch: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = C.Words()
        names = ["doc", *(x.split()[0] for x in SCHEMA.split(", ")[1:]), "m"]
        for whole in batches:
            for batch in C.slices(whole):
                h, offsets = words(batch.column("text"))
                rows: list[tuple] = []
                for i, (key, found) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("found").to_pylist())):
                    own = h[offsets[i] : offsets[i + 1]]
                    for x in found:
                        item = np.frombuffer(x["words"], C.U64)
                        least, best = min(WORDS, len(item)), None
                        for begin in _begins(x["seeds"], len(item), len(own)).tolist():
                            lo, hi = max(begin, 0), min(begin + len(item), len(own))
                            equal = own[lo:hi] == item[lo - begin : hi - begin]
                            if hi - lo < least or (any_stretch and not tolerated(equal, least)):
                                continue
                            s, e, same = best_stretch(equal, least if any_stretch else 0)
                            if e - s >= least and (best is None or (same, -(lo + s)) > best[0]):
                                best = ((same, -(lo + s)), lo + s, lo + s - begin, e - s, same)
                        if best:
                            rows.append((key, x["item_id"], *best[1:], x["m"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (a hash of both that tells rows apart; repeated rows are one), doc_id and text."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.select(F.xxhash64("doc_id", "text").alias("doc"), "doc_id", "text")


def _found(docs: DataFrame, benchmark: DataFrame, any_stretch: bool) -> DataFrame:
    """Overlaps of keyed docs, by doc; m: how often the item is in the benchmark."""
    plain = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and length(text) > 0")
    plain = plain.groupBy("item_id", "text").agg(F.count("*").alias("m")).withColumn("item", F.xxhash64("item_id", "text"))
    items = plain.mapInArrow(_item_words, "item long, item_id long, m long, words binary, size int").where(F.col("size") >= SHORTEST)
    items = C.materialize(items, "items")
    seeds = C.materialize(items.mapInArrow(_item_seeds, "seed long, item long, item_at array<int>"), "seeds")
    n, least = seeds.count(), items.agg(F.min("size")).first()[0]
    # The masks of short items are only of use if there are any.
    masks = len(MASKS) if least is None or least >= WORDS else len(MASKS + SHORT_MASKS)
    flags = C.key_filter(seeds.select("seed"), min(FILTER_BITS, max(22, n.bit_length() + 4)))
    found = docs.select("doc", "text").mapInArrow(_doc_seeds(flags, masks), "seed long, doc long, doc_at array<int>")
    pairs = found.join(seeds, "seed").groupBy("doc", "item").agg(F.collect_set(F.struct("doc_at", "item_at")).alias("seeds"))
    pairs = C.materialize(pairs, "pairs")
    sizes = pairs.groupBy("doc").agg(F.ceil(F.count("*") / ITEMS).alias("parts"))
    pairs = pairs.join(sizes, "doc").join(items, "item").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")))
    cases = pairs.groupBy("doc", "part").agg(F.collect_list(F.struct("item_id", "m", "words", "seeds")).alias("found"))
    cases = C.materialize(cases, "cases")
    some = C.materialize(cases.select("doc").distinct(), "docs")
    texts = docs.select("doc", "text").join(some, "doc", "left_semi").dropDuplicates(["doc"])
    return texts.join(cases, "doc").select("doc", "text", "found").mapInArrow(_verify(any_stretch), SCHEMA.replace("doc_id", "doc", 1) + ", m long")


def overlaps(docs: DataFrame, benchmark: DataFrame, any_stretch: bool = False) -> DataFrame:
    """Overlaps of docs(doc_id, text) with benchmark(item_id, text): the best one of each pair of rows.

    Columns doc_id, item_id, first word in the document and in the item (from 0), words, matching words. Null and
    empty texts and items, and items of under five words, overlap with nothing; repeated rows each give their
    own; ties go to the earlier place; an empty table on either side gives no rows; other columns are ignored.
    any_stretch: any stretch of WORDS words (or the whole shorter item) with enough matches makes an overlap, which
    the seeds are sure to meet; otherwise the stretch with the best sum has to be so long.
    """
    keyed = _keyed(docs)
    out = keyed.select("doc", "doc_id").join(_found(keyed, benchmark, any_stretch), "doc")
    out = out.withColumn("m", F.explode(F.array_repeat("m", F.col("m").cast("int"))))
    return out.select(*(x.split()[0] for x in SCHEMA.split(", ")))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, any_stretch: bool = False) -> DataFrame:
    """The rows of docs, with their columns, that overlap with no item; any_stretch as in `overlaps`."""
    gone = C.materialize(_found(_keyed(docs), benchmark, any_stretch).select("doc").distinct(), "leaks")
    row = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("doc"))
    return row.join(gone, "doc", "left_anti").select("row.*")


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), any_stretch=True)
