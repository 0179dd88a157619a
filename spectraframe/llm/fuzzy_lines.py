"""Line deduplication of fuzzy lines by MinHash.

A line is a run of characters between newlines, compared without the white space at its ends; a blank line is
never removed. Two lines are linked if the Jaccard similarity of their sets of shingles of SHINGLE characters
(a shorter line is one shingle) is THRESHOLD or more. Of the lines of a connected component the first stays, by
document id, then place; all others go.

1. Each task reduces its lines to distinct ones and gives a MinHash signature of each, cut into BANDS bands of
   ROWS values (vectorised over characters).
2. In each band bucket lines are linked by the exact Jaccard similarity of their texts (`bucket_links`), which are
   fetched for lines in buckets of two or more only.
3. Alternating star steps join the links to components; grouped minima find each component's first line.

Lines are named by 64-bit hashes of their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

SHINGLE, THRESHOLD = 8, 0.8
BANDS, ROWS = 10, 3
#: Bytes of text, and characters of lines, in a vectorised pass.
SLICE, BLOCK = 1 << 19, 1 << 16
PAD = 16


def _multipliers() -> np.ndarray:
    """Odd numbers: multiplied by one, the shingles' hashes, which are mixed already, come in another order."""
    return (C.mix(np.arange(BANDS * ROWS, dtype=C.U64), 41) >> C.U64(32)).astype(np.uint32) | np.uint32(1)


class Lines:
    """Lines of string columns, vectorised over code points."""

    def __init__(self) -> None:
        self.powers, self.salt = C.Powers(), C.mix(np.arange(256, dtype=C.U64), 4)
        self.blank = np.zeros(0x3001, bool)
        self.blank[[i for i in range(0x3001) if chr(i).isspace()]] = True

    def __call__(self, column: pa.Array):
        """Text, values of its code points, stripped spans of all lines, 64-bit names (0: blank), document, number in it."""
        column = pc.fill_null(column, "")
        lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        # A newline after each text ends its last line.
        text = "\n".join([*column.to_pylist(), ""])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.flatnonzero(points == 10)
        starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
        doc_ends = np.cumsum(lengths + 1)
        doc = np.searchsorted(doc_ends, starts, "right")
        first = np.searchsorted(doc, np.arange(len(lengths)), "left")
        number = np.arange(len(starts)) - first[doc]
        ink = np.flatnonzero(~self.blank[np.minimum(points, 0x3000)] | (points > 0x3000))
        if len(ink):
            lo, hi = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
            some = lo < hi
            a = np.where(some, ink[np.minimum(lo, len(ink) - 1)], starts)
            b = np.where(some, ink[np.maximum(hi - 1, 0)] + 1, starts)
        else:
            a = b = starts
        values = self.values(points)
        name = C.hash_spans(values, a, b, self.powers) | C.U64(1)
        name[a == b] = 0
        return text, values, a, b, name.view(np.int64), doc, number

    def values(self, points: np.ndarray) -> np.ndarray:
        return self.salt[points & 255] + (points >> np.uint32(8)).astype(C.U64) * C.U64(0xA0761D6478BD642F)

    def shingles(self, values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of the shingles of spans, and offsets of the spans among them."""
        n = np.maximum(b - a - SHINGLE + 1, 1)
        offsets = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(a - offsets[:-1], n) + np.arange(offsets[-1])
        return C.hash_spans(values, at, np.minimum(at + SHINGLE, np.repeat(b, n)), self.powers), offsets


def signatures(lines: Lines, values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of the bands, BANDS for each span."""
    if not len(a):
        return np.empty((0, BANDS), C.U64)
    if len(a) > 1 and int((b - a).sum()) > 2 * BLOCK:  # small enough for the processor's cache
        cut = np.searchsorted(np.cumsum(b - a), np.arange(BLOCK, int((b - a).sum()), BLOCK))
        edges = np.unique([0, *cut.tolist(), len(a)])
        return np.concatenate([signatures(lines, values, a[i:j], b[i:j]) if j - i < len(a) else _keys(lines, values, a, b) for i, j in zip(edges[:-1], edges[1:])])
    return _keys(lines, values, a, b)


def _keys(lines: Lines, values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), BANDS), C.U64)
    h, offsets = lines.shingles(values, a, b)
    # Shingles in columns of PAD, each line's last column filled up with its first shingle: minima of columns are
    # vectorised, and only these are then reduced line by line.
    n = np.diff(offsets)
    columns = -(-n // PAD)
    begin = np.concatenate([[0], np.cumsum(columns)])
    place = np.arange(int(begin[-1]) * PAD) - np.repeat(begin[:-1] * PAD, columns * PAD)
    place = np.where(place < np.repeat(n, columns * PAD), place, 0) + np.repeat(offsets[:-1], columns * PAD)
    x = np.ascontiguousarray((h >> C.U64(32)).astype(np.uint32)[place].reshape(-1, PAD).T)
    mul, y = _multipliers(), np.empty_like(x)
    for band in range(BANDS):
        acc = np.full(len(a), C.U64(band))
        for r in range(ROWS):
            k = band * ROWS + r
            least = np.minimum.reduceat(np.multiply(x, mul[k], out=y).min(axis=0), begin[:-1])
            acc = C.mix(acc * C.U64(0xD6E8FEB86659FD93) + least, 43)
        out[:, band] = acc
    return out


def jaccard(x: str, y: str) -> float:
    """Similarity of two lines' sets of shingles."""
    cut = lambda s: {s[i : i + SHINGLE] for i in range(max(len(s) - SHINGLE + 1, 1))}
    p, q = cut(x), cut(y)
    both = len(p & q)
    return both / (len(p) + len(q) - both)


# --- on DataFrames -----------------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of both that tells rows apart (repeated rows are one document)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.withColumn("row_key", F.xxhash64("doc_id", "text"))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each line that isn't blank; the band keys come with the first of each line in the task."""
    lines, seen = Lines(), set()
    for whole in batches:
        for batch in C.slices(whole, "text", SLICE):
            _, values, a, b, name, doc, number = lines(batch.column("text"))
            ink = np.flatnonzero(name)
            distinct, first = np.unique(name[ink], return_index=True)
            new = np.array([x not in seen for x in distinct.tolist()], bool)
            seen.update(distinct.tolist())
            first = np.sort(ink[first[new]]) if len(new) else first
            keys = signatures(lines, values, a[first], b[first]).view(np.int64)
            sizes = np.zeros(len(name), np.int64)
            sizes[first] = BANDS
            offsets = np.concatenate([[0], np.cumsum(sizes[ink])]).astype(np.int32)
            own = pa.array(doc[ink])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(own), batch.column("row_key").take(own), pa.array(number[ink].astype(np.int32)), pa.array(name[ink]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())), pa.array((b - a)[ink].astype(np.int32))],
                names=["doc_id", "row_key", "line_no", "id", "bands", "size"],
            )


def _texts(wanted: np.ndarray):
    """The texts of lines whose name passes a filter; the filter lets some others through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, seen = Lines(), set()
        for whole in batches:
            for batch in C.slices(whole, "text", SLICE):
                text, _, a, b, name, _, _ = lines(batch.column("text"))
                hit = np.flatnonzero((name != 0) & C.passes(wanted, name))
                rows = []
                for i, x in zip(hit.tolist(), name[hit].tolist()):
                    if x not in seen:
                        seen.add(x)
                        rows.append((x, text[a[i] : b[i]]))
                if rows:
                    ids, said = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(said, pa.string())], names=["id", "line"])

    return run


def _sets(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes of the shingles of each line, of weight 1."""
    lines, said = Lines(), column.to_pylist()
    values = lines.values(np.frombuffer("".join(said).encode("utf-32-le"), np.uint32))
    ends = np.cumsum([len(t) for t in said])
    if not len(ends):
        return []
    h, offsets = lines.shingles(values, ends - [len(t) for t in said], ends)
    ones, out = np.ones(int(np.diff(offsets).max())), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        x = h[a:b]
        x.sort()
        new = x[1:] != x[:-1]
        x = x.copy() if new.all() else x[np.append(True, new)]
        out.append((x, ones[: len(x)]))
    return out


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, line_nos: numbers from 0 of the lines to remove) of documents that lose lines."""
    keyed = _keyed(docs)
    schema = "doc_id long, row_key long, line_no int, id long, bands array<long>, size int"
    found = C.materialize(keyed.mapInArrow(_occurrences, schema), "lines")
    rows = C.bucket_rows(found.where(F.size("bands") > 0), "bands")

    def texts(ids: DataFrame) -> DataFrame:
        ids = C.materialize(ids, "ids")
        out = keyed.select("text").mapInArrow(_texts(C.key_filter(ids)), "id long, line string")
        return out.join(ids, "id", "left_semi").groupBy("id").agg(F.min("line").alias("text"))

    links = C.materialize(C.bucket_links(rows, texts, _sets, THRESHOLD), "links")
    parts = C.components(links)
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key", "line_no")
    first = found.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # Lines that occur once and have no link stay; only the others are followed up.
    named = first.join(parts.withColumnRenamed("component_id", "c"), "id", "left").where("n > 1 or c is not null").withColumn("c", F.coalesce("c", "id"))
    named = C.materialize(named.select("id", "c", "first"), "named")
    # Written, so that the join has its own exchange of either side: a component of very many lines can be split then.
    kept = C.materialize(named.groupBy("c").agg(F.min("first").alias("kept")), "kept")
    follow = named.select("id", "c").join(kept, "c").select("id", "kept")
    gone = found.select("id", "doc_id", "row_key", "line_no").join(follow, "id").where(place != F.col("kept"))
    return gone.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("line_no")).alias("line_nos"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without the removed lines, with their columns and the columns n_lines and n_removed.

    Kept lines stay as they are, in order. A null text stays null, an empty text stays empty (no lines); a text
    that loses all lines is empty. Rows with null ids come last in the order of what stays. Rows with the same id
    and text are one document, and lose the same lines. Columns of docs named like the added ones are replaced;
    an empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = removed_lines(docs).select("row_key", F.col("doc_id").alias("gone_id"), "line_nos")
    text = F.col("text").cast("string")
    # The rows go along as one column, so no name of theirs meets a name here.
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("own_id"), text.alias("said"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row_key"))
    rows = rows.join(gone, (rows["row_key"] == gone["row_key"]) & rows["own_id"].eqNullSafe(gone["gone_id"]), "left").select("row", "said", "line_nos")
    lines = F.split(F.coalesce("said", F.lit("")), "\n", -1)
    # Few lines are looked up one by one; many go by a set difference, which is linear.
    few = F.filter(lines, lambda x, i: ~F.array_contains("line_nos", i))
    many = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "line_nos"), lambda i: F.get(lines, i))
    kept = F.when(F.size("line_nos") <= 64, few).otherwise(many)
    n = F.when(F.coalesce(F.length("said"), F.lit(0)) == 0, 0).otherwise(F.size(lines))
    cut = F.when(F.col("line_nos").isNull(), F.col("said")).otherwise(F.array_join(kept, "\n"))
    out = rows.select("row", cut.alias("cut"), n.cast("long").alias("n"), F.coalesce(F.size("line_nos"), F.lit(0)).cast("long").alias("m"))
    return out.select(*(F.col("cut").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names), F.col("n").alias("n_lines"), F.col("m").alias("n_removed"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(C.documents(spark, sf_dir).select("doc_id", "text"))
