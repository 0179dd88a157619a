"""Byte-level BPE: Spark higher-order functions fold ranked merges over the bytes of distinct words.

Texts are dealt with in chunks of whole documents, without a shuffle:

0. The words of a bounded sample of documents are encoded once, as in step 2, and their ids are kept in a cache
   of at most CACHE_WORDS words that every task has. It saves work on frequent words and changes no result.
1. `_chunker` (Arrow) splits the texts of a chunk into words by the pattern, vectorised over code points, and
   gives one row: the chunk's distinct words, as byte arrays of two-byte ids of their bytes, those in the cache
   as their final ids, and the numbers of the words of every document.
2. Spark encodes each distinct word: `aggregate` folds merges over its byte array, always the leftmost pair of
   least rank. Ranks come from a literal map in one byte array, laid out by perfect hashing (CRC-32 with
   displacements): a lookup takes two slices of it, where a literal of map type would be searched from its start
   and would be built again, object by object, in each task. As a merged pair's rank is its id, ranks and ids are
   the same two bytes, and byte order is rank order. Decoding joins the binary pieces that a literal array holds.
3. `_assemble` (Arrow) lays the words' ids and pieces side by side for each document.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Bytes of text in a chunk (a longer single text is a chunk of its own).
CHUNK_BYTES = 3 << 20
#: Bytes of text in a vectorised pass.
SLICE = 1 << 18
#: Words in the cache, at most, and documents of the sample that they come from, on average.
CACHE_WORDS, CACHE_DOCS = 1 << 19, 40_000
#: Ids of a word that are folded at once.
LONG = 64

# --- words -----------------------------------------------------------------------------------------

_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3
_CONTRACTED = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """The classes of all code points, as the pattern's own engine sees them: classes of runs, and their lengths."""
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for lo in range(0, 0x110000, 1 << 14):
        at = np.arange(lo, lo + (1 << 14))
        at = at[(at < 0xD800) | (at >= 0xE000)]  # no surrogates
        block = "".join(map(chr, at.tolist()))
        for kind, expr in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(expr, block):
                kinds[at[m.start() : m.end()]] = kind
    begins = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
    return kinds[begins], np.diff(np.append(begins, len(kinds)))


class Splitter:
    """Splits texts as public_tokenizers.PATTERN does, vectorised; words come as spans of code points."""

    def __init__(self, runs: tuple[np.ndarray, np.ndarray]) -> None:
        self.classes = np.repeat(*runs)

    def __call__(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the words, ascending (each ends where the next begins), and offsets of documents among them."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        kind = self.classes[points]
        edge = np.zeros(n + 1, bool)  # begins of documents, and the end
        edge[offsets] = True
        run = edge[:n].copy()  # begins of runs of one class
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        white = kind == _SPACE
        # The last white space before something else: on its own, or with what follows if it is a blank.
        ends = np.zeros(n, bool)
        ends[:-1] = white[:-1] & ~white[1:] & ~edge[1:n]
        start[ends] = True
        blank = ends & (points == 32)
        start[np.flatnonzero(blank) + 1] = False
        # Contractions: a lone apostrophe where a word begins, then s, t, re, ve, m, ll or d.
        at = np.flatnonzero((points == 39) & start & run)
        at = at[(at + 1 < n)]
        at = at[run[at + 1] & (kind[at + 1] == _LETTER) & ~edge[at + 1]]
        for p in at.tolist():
            for c in _CONTRACTED:
                q = p + 1 + len(c)
                if q <= n and all(points[p + 1 + j] == ord(x) for j, x in enumerate(c)) and not edge[p + 1 : q].any():
                    start[p + 1] = False
                    if q < n:
                        start[q] = True
                    break
        starts = np.flatnonzero(start)
        return starts, np.searchsorted(starts, offsets)


class _Words:
    """Words of batches of texts: UTF-8 bytes, where words begin in them, 64-bit hashes, offsets of the documents."""

    def __init__(self, runs: tuple[np.ndarray, np.ndarray]) -> None:
        self.split, self.powers, self.salt = Splitter(runs), C.Powers(), C.mix(np.arange(256, dtype=C.U64), 3)

    def __call__(self, column: pa.Array):
        column = pc.fill_null(column, "")
        lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        data, _ = C.text_bytes(column)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        starts, at = self.split(points, np.concatenate([[0], np.cumsum(lengths)]))
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        values = self.salt[points & 255] + (points >> np.uint32(8)).astype(C.U64) * C.U64(0xA0761D6478BD642F)
        h = C.hash_spans(values, starts, ends, self.powers)
        if len(points) < len(data):  # places of bytes, not of code points
            size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            starts = (np.cumsum(size) - size)[starts]
        return data, starts, at, h


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Byte strings that lie one after the other."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class Starts:
    """What words begin as: pieces that are words themselves are final, of the others each byte is a piece."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.pieces = pa.array(ranks, pa.binary())
        self.ids = pa.array([i.to_bytes(2, "big") for i in ranks.values()], pa.binary())
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.uint16)
        self.pairs = np.array([[ranks.get(bytes([i, j]), 0xFFFF) for j in range(256)] for i in range(256)], np.uint16)

    def final(self, words: pa.Array) -> pa.Array:
        """Numbers of the words among the pieces, or null."""
        return pc.index_in(words, value_set=self.pieces)

    def states(self, words: pa.Array) -> pa.Array:
        """Of each word, for each byte, its id and the rank of the pair that it begins, two bytes each."""
        data, offsets = C.text_bytes(words)
        out = np.full((len(data), 2), 0xFFFF, ">u2")
        out[:, 0] = self.single[data]
        out[:-1, 1] = self.pairs[data[:-1], data[1:]]
        out[offsets[1:][np.diff(offsets) > 0] - 1, 1] = 0xFFFF
        return _binary(out.view(np.uint8).ravel(), offsets * 4)


@dataclass
class Cache:
    """Words that are encoded already: sorted hashes, the words and their final ids."""

    hashes: np.ndarray
    words: pa.Array
    ids: pa.Array

    def find(self, h: np.ndarray, words: pa.Array) -> np.ndarray:
        """Places of words with these hashes, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        some = np.flatnonzero(self.hashes[at] == h)
        same = pc.equal(self.words.take(pa.array(at[some])), words.take(pa.array(some))).to_numpy(zero_copy_only=False)
        out = np.full(len(h), -1)
        out[some[same]] = at[some[same]]
        return out


class _Chunk:
    """Documents gathered so far. Words with final ids are numbered downwards from -1, the others upwards from 0."""

    def __init__(self) -> None:
        self.ids, self.data, self.starts, self.hashes, self.counts, self.size = [], [], [], [], [], 0

    def add(self, ids: pa.Array, data: np.ndarray, starts: np.ndarray, at: np.ndarray, h: np.ndarray) -> None:
        self.ids.append(ids)
        self.data.append(data)
        self.starts.append(starts.astype(np.int32))
        self.hashes.append(h)
        self.counts.append(np.diff(at).astype(np.int64))
        self.size += len(data)

    def clear(self) -> None:
        self.__init__()

    def distinct(self):
        """Hashes of the distinct words, the words, the numbers of all words among them, and counts."""
        distinct, where, back, n = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(where)
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        where, lo, parts = where[order], 0, []
        for data, starts in zip(self.data, self.starts):
            a, b = np.searchsorted(where, [lo, lo + len(starts)])
            every = _binary(data, np.append(starts, len(data)))
            parts.append(every.take(pa.array(where[a:b] - lo)))
            lo += len(starts)
        return distinct[order], pa.concat_arrays(parts), number[back], n[order]

    def row(self, start: Starts, cache: Cache) -> pa.RecordBatch:
        h, words, codes, _ = self.distinct()
        piece = start.final(words)
        is_piece = piece.is_valid().to_numpy(zero_copy_only=False)
        place = cache.find(h, words)
        known = is_piece | (place >= 0)
        name = np.empty(len(known), np.int32)
        name[~known] = np.arange(int((~known).sum()))
        name[known] = -1 - np.arange(int(known.sum()))
        both = pa.concat_arrays([start.ids, cache.ids])
        at = np.where(is_piece, pc.fill_null(piece, 0).to_numpy(zero_copy_only=False), len(start.ids) + place)[known]
        coded, fresh = both.take(pa.array(at)), start.states(words.filter(pa.array(~known)))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        data = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(
            [one(pa.concat_arrays(self.ids)), data(np.concatenate(self.counts)), data(name[codes]), one(fresh), one(coded)],
            names=["doc_ids", "counts", "codes", "words", "coded"],
        )


_CHUNK_SCHEMA = "doc_ids array<long>, counts binary, codes binary, words array<binary>, coded array<binary>"


def _gather(batches: Iterator[pa.RecordBatch], runs, most: int) -> Iterator[_Chunk]:
    split, chunk = _Words(runs), _Chunk()
    for whole in batches:
        for batch in C.slices(whole, "text", SLICE):
            parts = split(batch.column("text"))
            if chunk.size and chunk.size + len(parts[0]) > most:
                yield chunk
                chunk = _Chunk()
            chunk.add(batch.column("doc_id"), *parts)
    if chunk.ids:
        yield chunk


def _chunker(start: Starts, cache: Cache, runs):
    """The Arrow function of step 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _gather(batches, runs, CHUNK_BYTES):
            row = chunk.row(start, cache)
            chunk.clear()
            yield row

    return run


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _cache(docs: DataFrame, start: Starts, rank: RankMap, runs) -> Cache:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _gather(batches, runs, CHUNK_BYTES):
            h, words, _, n = chunk.distinct()
            out = pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), words, pa.array(n.astype(np.int64))], names=["h", "word", "n"])
            chunk.clear()
            yield out.filter(start.final(words).is_null())

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, start.states(batch.column("word"))], names=["h", "word", "start"])

    few = _plain(docs).where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, CACHE_DOCS / max(1, docs.count()))))
    words = C.materialize(few.mapInArrow(count, "h long, word binary, n long").groupBy("h", "word").agg(F.sum("n").alias("n")), "words")
    sizes = sorted(((r["n"], r["count"]) for r in words.groupBy("n").count().collect()), reverse=True)
    least, total = 1, 0
    for n, count_ in sizes:  # the most frequent words, as many as fit
        total += count_
        if total > CACHE_WORDS:
            least = n + 1
            break
    frequent = words.where(F.col("n") >= least).select("h", "word").mapInArrow(begin, "h long, word binary, start binary")
    got = encode_words(frequent.select("h", "word", F.array("start").alias("start")), "start", "ids", rank)
    got = got.select("h", "word", F.get("ids", F.lit(0)).alias("ids")).toArrow()
    order = np.argsort(got["h"].to_numpy().view(C.U64)) if got.num_rows else np.zeros(0, np.int64)
    # Copied out of the result, whose buffers would otherwise stay and go to all tasks.
    h, words_of, ids_of = (got[c].combine_chunks().take(pa.array(order)) for c in ("h", "word", "ids"))
    return Cache(h.to_numpy().view(C.U64), words_of, ids_of)


# --- merges as higher-order functions -----------------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_NONE = b"\xff\xff"  # above every rank


class RankMap:
    """A literal map from pairs of ids (four bytes) to ranks (two bytes), without collisions."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if max(ranks.values()) >= 0xFFFF:
            raise ValueError("ids must fit in two bytes")
        pairs = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
                if a is not None and b is not None:
                    pairs[a.to_bytes(2, "big") + b.to_bytes(2, "big")] = rank.to_bytes(2, "big")
        self.groups, self.slots = len(pairs) // 3 + 1, int(len(pairs) * 1.3) + 1
        groups: dict[int, list[bytes]] = {}
        for k in pairs:
            groups.setdefault(zlib.crc32(k) % self.groups, []).append(k)
        used, moves, table = bytearray(self.slots), bytearray(2 * self.groups), bytearray(_NONE * (3 * self.slots))
        for g, keys in sorted(groups.items(), key=lambda x: -len(x[1])):
            for d in range(1 << 16):
                move = d.to_bytes(2, "big")
                to = [zlib.crc32(k + move) % self.slots for k in keys]
                if len(set(to)) == len(to) and not any(used[x] for x in to):
                    break
            else:
                raise ValueError("no perfect hash")  # not met below a load of 0.8
            moves[2 * g : 2 * g + 2] = move
            for k, x in zip(keys, to):
                used[x] = 1
                table[6 * x : 6 * x + 6] = k + pairs[k]
        self.moves, self.table = moves, table
        #: Bytes of the pieces by id, two bytes each.
        self.lengths = bytearray(2 * (max(ranks.values()) + 1))
        for piece, i in ranks.items():
            self.lengths[2 * i : 2 * i + 2] = len(piece).to_bytes(2, "big")

    def bind(self, body) -> Column:
        """body of a function from pairs to their ranks, or _NONE. The literals are named once, however often it is used."""

        def of(moves: Column, table: Column) -> Column:
            none, sub = F.lit(bytearray(_NONE)), F.substring

            def find(key: Column) -> Column:
                move = sub(moves, (F.pmod(F.crc32(key), F.lit(self.groups)) * 2 + 1).cast("int"), F.lit(2))
                entry = sub(table, (F.pmod(F.crc32(F.overlay(key, move, 5)), F.lit(self.slots)) * 6 + 1).cast("int"), F.lit(6))
                return _let(entry, lambda e: F.when(sub(e, F.lit(1), F.lit(4)) == key, sub(e, F.lit(5), F.lit(2))).otherwise(none))

            return body(lambda pair: _let(pair, find))

        return _let(F.lit(self.moves), lambda moves: _let(F.lit(self.table), lambda table: of(moves, table)))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array_repeat(value, 1), body), F.lit(0))


class Merges:
    """Folds over words as byte arrays (states); rank: a function from pairs of two-byte ids to ranks."""

    def __init__(self, rank) -> None:
        self.rank, self.none = rank, F.lit(bytearray(_NONE))

    def fold(self, state: Column) -> Column:
        """The ids, two bytes each, after all merges of a word or a part of one.

        The state is one byte array, four bytes for each piece: its id, and the rank of the pair that it begins. A
        merge overlays the merged pair and the two ranks beside it. (Binary functions on one value: slices and
        concatenations of arrays take several times as long.)
        """
        sub, nothing = F.substring, F.lit(bytearray())
        count = lambda x: (F.length(x) / 4).cast("int")
        start = F.overlay(state, self.none, F.length(state) - 1, 2)  # the last piece begins no pair
        ids = lambda acc: F.aggregate(F.sequence(F.lit(1), count(acc)), nothing, lambda out, j: F.concat(out, sub(acc, 4 * j - 3, F.lit(2))))
        several = F.aggregate(F.sequence(F.lit(2), count(state)), start, self.merge, ids)
        return F.when(F.length(state) <= 4, sub(state, F.lit(1), F.lit(2))).otherwise(several)

    def merge(self, acc: Column, _: Column) -> Column:
        """One merge, of the leftmost pair of least rank, if there is any."""
        sub, none = F.substring, self.none

        def at(i: Column, low: Column) -> Column:  # i: 1-based place of the pair; its rank is the id of what it becomes
            right = F.when(4 * i + 4 < F.length(acc), self.rank(F.overlay(sub(acc, 4 * i + 3, F.lit(4)), low, 1, 2))).otherwise(none)
            left = self.rank(F.overlay(sub(acc, 4 * i - 7, F.lit(4)), low, 3, 2))
            return F.when(i == 1, F.overlay(acc, F.concat(low, right), 1, 8)).otherwise(F.overlay(acc, F.concat(left, low, right), 4 * i - 5, 10))

        def step(ranks: Column) -> Column:
            found = lambda low: F.when(low == none, acc).otherwise(_let(F.array_position(ranks, low).cast("int"), lambda i: at(i, low)))
            return _let(F.array_min(ranks), found)

        ranks = F.transform(F.sequence(F.lit(1), (F.length(acc) / 4).cast("int") - 1), lambda j: sub(acc, 4 * j - 1, F.lit(2)))
        return F.when(F.length(acc) <= 4, acc).otherwise(_let(ranks, step))

    def blocks(self, word: Column) -> Column:
        """The word's blocks of LONG ids, each after its own merges."""
        every = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(word) / (4 * LONG)).cast("int"), F.lit(1)) - 1)
        return F.transform(every, lambda i: self.fold(F.substring(word, 4 * LONG * i + 1, F.lit(4 * LONG))))

    def joined(self, word: Column, parts: Column, lengths: Column) -> Column:
        """The ids of a word of several blocks.

        A sequence of pieces is what a word is encoded to if and only if each two neighbours are what their own bytes
        are encoded to (the merges in a part of a word are the same as long as none crosses its ends). So, at a border
        of blocks, it is enough to fold a window around it anew, if that leaves the pieces at the window's ends as
        they are; else the window grows, in the end to all there is.
        """
        sub, one = F.substring, F.lit(1)
        number = lambda two: F.conv(F.hex(two), 16, 10).cast("int")
        size = lambda ids, j: number(sub(lengths, 2 * number(sub(ids, 2 * j - 1, F.lit(2))) + 1, F.lit(2)))
        n_bytes = lambda ids: F.aggregate(F.sequence(one, (F.length(ids) / 2).cast("int")), F.lit(0), lambda acc, j: acc + size(ids, j))

        def join(done: Column, block: Column, border: Column) -> Column:
            """The ids of what `done` and the next block encode; border: the bytes of the former."""

            def window(k: Column) -> Column:
                """The same, from a window of k bytes of ids on either side; null if it reaches further."""
                left, right = sub(done, F.greatest(F.length(done) - k, F.lit(0)) + 1, k), sub(block, one, k)

                def both(sides: Column) -> Column:
                    x, y = sides["x"], sides["y"]

                    def told(new: Column) -> Column:
                        ok = (F.length(x) == F.length(done)) | (sub(new, one, F.lit(2)) == sub(x, one, F.lit(2)))
                        ok &= (F.length(y) == F.length(block)) | (sub(new, F.length(new) - 1, F.lit(2)) == sub(y, F.length(y) - 1, F.lit(2)))
                        return F.when(ok, F.concat(sub(done, one, F.length(done) - F.length(x)), new, sub(block, F.length(y) + 1, F.length(block))))

                    a = border - n_bytes(x)
                    return _let(self.fold(sub(word, 4 * a + 1, 4 * (border + n_bytes(y) - a))), told)

                return _let(F.struct(left.alias("x"), right.alias("y")), both)

            sizes = F.array(F.lit(16), F.lit(2 * LONG), F.lit(1 << 30))
            return F.aggregate(sizes, F.lit(None).cast("binary"), lambda got, k: F.when(got.isNotNull(), got).otherwise(window(k)))

        return F.aggregate(F.sequence(F.lit(2), F.size(parts)), F.get(parts, F.lit(0)), lambda acc, i: join(acc, F.get(parts, i - 1), LONG * (i - 1)))


def encode_words(df: DataFrame, words: str, out: str, rank: RankMap) -> DataFrame:
    """df with a column of array<binary>: for words as states of their bytes, their two-byte ids after all merges.

    A fold over a word of n ids takes n steps of up to n operations, so a word of over LONG ids is folded in blocks.
    """
    parts = rank.bind(lambda f: F.transform(words, Merges(f).blocks))

    def whole(f, lengths: Column) -> Column:
        one = lambda word, own: F.when(F.size(own) == 1, F.get(own, F.lit(0))).otherwise(Merges(f).joined(word, own, lengths))
        return F.zip_with(words, "_parts", one)

    joined = _let(F.lit(rank.lengths), lambda lengths: rank.bind(lambda f: whole(f, lengths)))
    return df.withColumn("_parts", parts).withColumn(out, joined).drop("_parts")


def decode_words(coded: Column, pieces: str) -> Column:
    """array<binary>: the bytes of each word, its ids' pieces one after the other. pieces: JSON, as _pieces gives it."""

    def one(ids: Column, table: Column) -> Column:
        piece = lambda j: F.get(table, F.shiftright(F.crc32(F.substring(ids, 2 * j - 1, F.lit(2))), 16).cast("int"))
        return F.aggregate(F.sequence(F.lit(1), (F.length(ids) / 2).cast("int")), F.lit(bytearray()), lambda acc, j: F.concat(acc, piece(j)))

    # The array is made from its literal in the row, not in the plan: plans are written out, again and again, with all their literals.
    table = _let(F.lit(pieces), lambda s: F.from_json(s, "array<binary>"))
    return _let(table, lambda by_place: F.transform(coded, lambda ids: one(ids, by_place)))


def _pieces(ranks: dict[bytes, int]) -> str:
    """The pieces by the high half of the CRC-32 of their ids' two bytes, which is different for each."""
    out = [""] * (1 << 16)
    for k, v in ranks.items():
        out[zlib.crc32(v.to_bytes(2, "big")) >> 16] = base64.b64encode(k).decode()
    return json.dumps(out, separators=(",", ":"))


def _assemble(full: bool):
    """The Arrow function of step 3. Words are laid side by side for all documents of a chunk at once."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    more = [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.binary())]

    def side_by_side(words: pa.Array, codes: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The words' bytes in the order of codes, and where each document's end; ends: of the documents' words."""
        data, offsets = C.text_bytes(words.cast(pa.large_binary()).take(pa.array(codes)))
        return memoryview(np.ascontiguousarray(data)), offsets[ends]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([f"{i} ".encode() for i in range(1 << 16)], pa.binary())
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                doc_ids, fresh = row.column("doc_ids").flatten(), row.column("ids").flatten()
                ends = np.cumsum(np.frombuffer(row.column("counts")[0].as_py(), np.int64))
                codes = np.frombuffer(row.column("codes")[0].as_py(), np.int32).astype(np.int64)
                codes = np.where(codes >= 0, codes, len(fresh) - 1 - codes)
                ids = pa.concat_arrays([fresh, row.column("coded").flatten()])
                data, offsets = C.text_bytes(ids)
                flat = np.frombuffer(data.tobytes(), ">u2").astype(np.int32)
                # The words' ids in decimal, each with a blank behind it.
                text, at = C.text_bytes(names.take(pa.array(flat)))
                said, said_ends = side_by_side(_binary(text, at[offsets // 2]), codes, ends)
                decoded, decoded_ends = side_by_side(row.column("pieces").flatten(), codes, ends)
                total = np.append(0, np.cumsum((np.diff(offsets) // 2)[codes]))[ends]
                raw = side_by_side(ids, codes, ends)[0] if full else None
                out, last = [], (0, 0, 0)
                for n, s, d in zip(total.tolist(), said_ends.tolist(), decoded_ends.tolist()):
                    one = (n - last[0], hashlib.sha256(said[last[1] : max(s - 1, last[1])]).hexdigest(), hashlib.sha256(decoded[last[2] : d]).hexdigest())
                    if full:
                        one += (np.frombuffer(raw[2 * last[0] : 2 * n], ">u2").astype(np.int32), bytes(decoded[last[2] : d]))
                    out.append(one)
                    last = (n, s, d)
                step = 1000 if full else 100_000
                fields = [*schema, *more] if full else [*schema]
                for lo in range(0, len(out), step):
                    cols = [doc_ids.slice(lo, step), *zip(*out[lo : lo + step])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], names=[f.name for f in fields])

    return run


def encode_documents(docs: DataFrame, path: str | None = None, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of docs(doc_id, text); with full also ids and decoded.

    One row per input row. A null or empty text has no tokens (the digests are those of nothing); repeated rows
    and null ids are kept; other columns are ignored; an empty table gives an empty result. path: a rank file of
    the public tokenizers, byte_bpe_50k.tiktoken by default.
    """
    ranks, runs = read_ranks(path or default_path()), class_runs()
    rank, start, pieces = RankMap(ranks), Starts(ranks), _pieces(ranks)
    chunks = _plain(docs).mapInArrow(_chunker(start, _cache(docs, start, rank, runs), runs), _CHUNK_SCHEMA)
    # A written table between the two Arrow functions: each stage then runs one Python worker for a task, not two.
    coded = C.materialize(encode_words(chunks, "words", "ids", rank).drop("words"), "chunks")
    coded = coded.withColumn("pieces", decode_words(F.concat("ids", "coded"), pieces))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return coded.mapInArrow(_assemble(full), schema + ", ids array<int>, decoded binary" * full)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(C.documents(spark, sf_dir))
