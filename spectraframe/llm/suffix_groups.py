"""Removal of repeated byte strings with suffix arrays built by linear grouping.

Every byte covered by a string of LENGTH bytes that also starts anywhere else in the corpus is removed. The steps
are exact but for 64-bit hashes:

1. Runs. The anchor of a window of LENGTH bytes is its run of GRAM bytes with the least hash (the first of equals).
   Equal windows have equal anchors at the same place, so all windows of one anchor, a run, are compared with runs
   of the same anchor bytes only. Runs with the same bytes become one, with a count: of two or more, all windows
   are repeated. Runs whose anchor occurs in other runs go on.
2. Blocks. A run's windows are cut, relative to the anchor, into blocks of STEP windows. All windows of a block
   share a core of LENGTH - STEP + 1 bytes; the block is the short string of the bytes before the core, the core as
   one symbol, and the bytes after it.
3. Suffix arrays. The distinct strings of the same cores are joined and their suffix array is built: groups of
   suffixes by Lyndon prefix are processed in descending order with previous-smaller pointers, then each group's
   order is emitted in one pass, without renaming. Neighbours with a common prefix of STEP symbols around a core are
   repeated windows. A core with more than HOT strings is done by grouped counts of its windows instead, so that
   no task gets an unbounded group.
4. Covered ranges come back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

LENGTH, GRAM, STEP = 400, 64, 16
HOT = 4096
#: Bytes in a vectorised pass; windows of a longer text are taken in parts of this many starts.
PART = 1 << 18
_PLACE = 24  # low bits of a window value that hold the place

# --- suffix arrays -----------------------------------------------------------------------------------


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a list of non-negative integers, by linear grouping."""
    n = len(text)
    if not n:
        return []
    # Suffixes in groups, at first by their first symbol; a group is a range of `order`, named by its begin.
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    begin = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            begin = k
        place[i], group[i] = k, begin
        size[begin] += 1
    previous = [-1] * n  # the nearest suffix before that is in a lower group
    end = n
    while end:
        begin = group[order[end - 1]]
        pointers: dict[int, int] = {}
        for i in sorted(order[begin:end]) if end - begin > 1 else order[begin:end]:
            j = i - 1
            while j >= 0 and group[j] >= begin:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        if pointers:
            # Suffixes that more pointers lead to go right behind their group first, the others between.
            by_count: dict[int, list[int]] = {}
            for j, c in pointers.items():
                by_count.setdefault(c, []).append(j)
            for c in sorted(by_count, reverse=True):
                moved: dict[int, int] = {}
                for j in by_count[c]:
                    g = group[j]
                    m = moved.get(g, 0) + 1
                    moved[g] = m
                    last = g + size[g] - m
                    other, at = order[last], place[j]
                    order[at], order[last] = other, j
                    place[other], place[j] = at, last
                for g, m in moved.items():
                    if m < size[g]:
                        size[g] -= m
                        new = g + size[g]
                        size[new] = m
                        for k in range(new, new + m):
                            group[order[k]] = new
        end = begin
    # Emit: a suffix follows the one where its Lyndon prefix ends; ranks of those order its group.
    out, done, front = [-1] * n, [False] * n, list(range(n))
    p, k = n, -1  # the empty suffix comes first
    while True:
        j = p - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            done[j] = True
            j = previous[j]
        k += 1
        if k == n:
            return out
        p = out[k]


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """Lengths of the common prefixes of neighbours: out[k] of order[k - 1] and order[k]."""
    n = len(text)
    rank, out, h = [0] * n, [0] * n, 0
    for k, i in enumerate(order):
        rank[i] = k
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            top = n - max(i, j)
            while h < top and text[i + h] == text[j + h]:
                h += 1
            out[rank[i]] = h
            h -= h > 0
        else:
            h = 0
    return out


def repeated_windows(strings: list[tuple[int, bytes, bytes]]) -> list[int]:
    """For distinct strings (core, left, right): bits d of windows, d left bytes and the core and STEP - 1 - d right
    ones, that occur in another string too."""
    text, begins = [], []
    names: dict[int, int] = {}
    for core, left, right in strings:
        begins.append(len(text))
        text += [*left, 256 + names.setdefault(core, len(names)), *right, 0]
    mark = 256 + len(names)
    for k, b in enumerate(begins):  # an end mark of its own for each string
        text[(begins[k + 1] if k + 1 < len(begins) else len(text)) - 1] = mark + k
    order = suffix_array(text)
    same = common_prefixes(text, order)
    n = len(order)
    longest = [0] * n
    for k, i in enumerate(order):
        longest[i] = max(same[k], same[k + 1] if k + 1 < n else 0)
    out = []
    for (_, left, right), b in zip(strings, begins):
        bits = 0
        for d in range(max(0, STEP - 1 - len(right)), len(left) + 1):
            bits |= (longest[b + len(left) - d] >= STEP) << d
        out.append(bits)
    return out


# --- runs ---------------------------------------------------------------------------------------------


class Runs:
    """Runs of windows with the same anchor in texts of a batch."""

    def __init__(self) -> None:
        self.table, self.powers = C._byte_table(), C.Powers()

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """Document, first byte, bytes, place of the anchor in them, hashes of the anchor and of the run."""
        parts = []
        n = len(offsets) - 1
        if n == 1 and len(data) > 2 * PART:
            for at in range(0, len(data) - LENGTH + 1, PART):
                piece = data[at : at + PART + LENGTH - 1]
                doc, start, *rest = self.part(piece, np.array([0, len(piece)]))
                parts.append((doc, start + at, *rest))
        else:
            parts.append(self.part(data, offsets))
        return [np.concatenate(x) for x in zip(*parts)]

    def part(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        if n < LENGTH:
            z = np.zeros(0, np.int64)
            return z, z, z, z, z, z
        up, down = self.powers.upto(n + 1)
        sums = np.zeros(n + 1, C.U64)
        np.cumsum(self.table[data] * up[:n], out=sums[1:])
        gram = C.mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        width = LENGTH - GRAM + 1
        m = len(gram)
        value = (gram >> C.U64(_PLACE) << C.U64(_PLACE)) | np.arange(m, dtype=C.U64)
        rows = np.append(value, np.full(-m % width, ~C.U64(0))).reshape(-1, width)
        head = np.minimum.accumulate(rows, axis=1).ravel()
        tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(tail[: m - width + 1], head[width - 1 : m]) & C.U64((1 << _PLACE) - 1)).astype(np.int64)
        w = len(anchor)
        inside = np.zeros(w, bool)
        new = np.ones(w, bool)
        new[1:] = anchor[1:] != anchor[:-1]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if b - a >= LENGTH:
                inside[a : b - LENGTH + 1] = True
                new[a] = True
        cut = np.append(np.flatnonzero(new | ~inside), w)
        begin = np.flatnonzero(new & inside)
        end = cut[np.searchsorted(cut, begin, "right")] - 1 + LENGTH
        at = anchor[begin]
        run = C.mix((sums[end] - sums[begin]) * down[begin] + C.mix(((at - begin) << 32 | (end - begin)).astype(C.U64), 2), 3)
        doc = np.searchsorted(offsets, begin, "right") - 1
        return doc, begin - offsets[doc], end - begin, at - begin, gram[at].view(np.int64), run.view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = Runs()
    for whole in batches:
        for batch in C.slices(whole, "text", PART):
            doc, start, size, at, gram, run = find(*C.text_bytes(batch.column("text")))
            if len(doc):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_key").take(pa.array(doc)), *(pa.array(x.astype(np.int32)) for x in (start, size, at)), pa.array(gram), pa.array(run)],
                    names=["row_key", "start", "size", "at", "gram", "run"],
                )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of the blocks of the listed runs of each text."""
    names = ["core", "left", "right", "row_key", "place", "weight"]
    for batch in batches:
        rows: list[tuple] = []
        for key, text, runs in zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            data = text.encode()
            for r in runs:
                start, anchor = r["start"], r["start"] + r["at"]
                last = start + r["size"] - LENGTH  # the last window
                for j in range((anchor - last) // STEP, (anchor - start) // STEP + 1):
                    place = anchor - STEP * j  # where the core begins
                    a, b = max(start, place - STEP + 1), min(last, place)
                    core = data[place : place + LENGTH - STEP + 1]
                    name = hashlib.blake2b(core + j.to_bytes(4, "big"), digest_size=8).digest()
                    rows.append((int.from_bytes(name, "big", signed=True), data[a:place], data[place + len(core) : b + LENGTH], key, place, 2 if r["whole"] else 1))
            if len(rows) > 20_000:
                yield _table(rows, names)
                rows = []
        if rows:
            yield _table(rows, names)


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"core": pa.int64(), "left": pa.binary(), "right": pa.binary(), "row_key": pa.int64(), "place": pa.int32(), "weight": pa.int32(), "bits": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(x, types[n]) for n, x in zip(names, zip(*rows))], names=names)


def _sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of repeated windows of strings, which come ordered by core."""
    held: list[tuple[int, bytes, bytes]] = []

    def done(strings: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        return _table([(*s, bits) for s, bits in zip(strings, repeated_windows(strings))], ["core", "left", "right", "bits"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("core", "left", "right"))):
            if len(held) >= 2000 and row[0] != held[-1][0]:
                yield done(held)
                held = []
            held.append(row)
    if held:
        yield done(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
            data = (text or "").encode()
            spans: list[list[int]] = []
            for r in sorted((r["a"], r["b"]) for r in ranges or ()):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            left = b"".join([*kept, data[at:]])
            rows.append((len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [x for s in spans for x in s]))
        cols = list(zip(*rows)) if rows else [[]] * 5
        types = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


# --- on DataFrames -------------------------------------------------------------------------------------


def repeated_ranges(keyed: DataFrame) -> DataFrame:
    """(row_key, a, b): byte ranges of keyed(row_key, text), whose union is what is to be removed."""
    runs = C.materialize(keyed.select("row_key", "text").mapInArrow(_runs, "row_key long, start int, size int, at int, gram long, run long"), "runs")
    kinds = runs.groupBy("gram", "run").agg(F.count("*").alias("n"))
    shared = kinds.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram", F.lit(True).alias("shared"))
    kinds = kinds.join(shared, "gram", "left").where("n > 1 or shared")
    kinds = C.materialize(kinds.select("run", (F.col("n") > 1).alias("whole"), F.coalesce("shared", F.lit(False)).alias("shared")), "kinds")
    hits = C.materialize(runs.select("row_key", "start", "size", "at", "run").join(kinds, "run"), "hits")
    whole = hits.where("whole").select("row_key", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    # Of runs that are repeated as a whole one stands for all, as a partner of others.
    alone = hits.where("shared and not whole").select("row_key", "start", "size", "at", "whole")
    one = hits.where("shared and whole").groupBy("run").agg(F.min(F.struct("row_key", "start", "size", "at")).alias("r"))
    some = alone.union(one.select("r.row_key", "r.start", "r.size", "r.at", F.lit(True)))
    some = some.groupBy("row_key").agg(F.collect_set(F.struct("start", "size", "at", "whole")).alias("runs"))
    texts = keyed.select("row_key", "text").join(some, "row_key")
    blocks = C.materialize(texts.mapInArrow(_blocks, "core long, left binary, right binary, row_key long, place int, weight int"), "blocks")
    strings = blocks.groupBy("core", "left", "right").agg(F.sum("weight").alias("w"))
    cores = strings.groupBy("core").agg(F.count("*").alias("m"), F.max("w").alias("most")).where("m > 1 or most > 1").select("core", "m")
    strings = C.materialize(strings.join(cores, "core"), "strings")
    plain = strings.where("m > 1")
    sorted_ = plain.where(F.col("m") <= HOT).select("core", "left", "right").repartition("core").sortWithinPartitions("core")
    by_suffix = sorted_.mapInArrow(_sort_suffixes, "core long, left binary, right binary, bits int")
    d = F.explode(F.sequence(F.greatest(F.lit(0), F.lit(STEP - 1) - F.length("right")), F.length("left")))
    windows = plain.where(F.col("m") > HOT).select("core", "left", "right", d.alias("d"))
    window = F.concat(F.expr("substring(left, length(left) - d + 1, d)"), F.expr(f"substring(right, 1, {STEP - 1} - d)"))
    windows = windows.withColumn("window", window)
    again = windows.groupBy("core", "d", "window").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    by_count = windows.join(again, ["core", "d", "window"]).groupBy("core", "left", "right").agg(F.expr("CAST(bit_or(shiftleft(1, d)) AS INT)").alias("bits"))
    full = strings.where("w > 1").select("core", "left", "right", F.expr(f"shiftleft(1, length(left) + 1) - shiftleft(1, greatest(0, {STEP - 1} - length(right)))").alias("bits"))
    bits = by_suffix.union(by_count).union(full).where("bits > 0").groupBy("core", "left", "right").agg(F.bit_or("bits").alias("bits"))
    found = blocks.where("weight = 1").join(bits, ["core", "left", "right"])
    high = F.floor(F.log2(F.col("bits"))).cast("int")
    low = F.floor(F.log2(F.col("bits").bitwiseAND(-F.col("bits")))).cast("int")
    part = found.select("row_key", (F.col("place") - high).alias("a"), (F.col("place") - low + LENGTH).alias("b"), "bits")
    return whole.union(part.select("row_key", "a", "b"))


def remove_repeats(docs: DataFrame, spans: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and has_repeats of docs(doc_id, text): one row per input row.

    has_repeats tells whether anything is removed. With spans also the removed ranges, begins and ends in turn. Null and empty texts have no bytes; matches stay
    within a document; repeated rows are occurrences of their own, and so go as a whole if they are long enough;
    null ids are kept; other columns are ignored; an empty table gives an empty result.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("row_key", F.xxhash64("doc_id", "text"))
    ranges = repeated_ranges(keyed).groupBy("row_key").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    out = keyed.join(ranges, "row_key", "left").select("doc_id", "text", "ranges")
    out = out.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    out = out.withColumn("has_repeats", F.col("n_removed") > 0)
    return out if spans else out.drop("spans")


def op3_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.documents(spark, sf_dir))
