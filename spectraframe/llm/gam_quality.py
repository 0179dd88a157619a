"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn, round after round; each visit fits a tree of few leaves to the
current gradients over the feature's bins and adds it, shrunk, to the feature's lookup table. Pairs of features
with the most remaining signal then get small two-dimensional tables in the same way. A score is the logistic
of a sum of table entries, added up by vectorised bin lookups.

Features are counted over whole texts, vectorised over bytes. Training takes at most MAX_TRAIN labelled rows,
those with the least hash of their id; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Labelled rows that a model is fitted on, at most.
MAX_TRAIN = 20_000
THRESHOLD = 0.7

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "blanks", "beyond_ascii", "stops", "commas", "marks", "symbols", "pipes",
    "short_words", "long_words", "distinct_words", "repeats", "pair_repeats", "lines", "line_repeats", "title_words", "upper_words", "mark_runs",
)


class Features:
    """A matrix of len(FEATURES) columns from a string column; an empty text gives zeros."""

    def __init__(self) -> None:
        self.words = C.Words()
        kinds = np.zeros((8, 256), bool)
        kinds[0, 65:91] = True  # upper
        kinds[1, 48:58] = True  # digits
        kinds[2, [9, 10, 11, 12, 13, 32]] = True  # blanks
        kinds[3, 128:] = True  # beyond ASCII
        kinds[4, [ord(c) for c in ".!?"]] = True  # stops
        kinds[5, [ord(c) for c in ",;:"]] = True  # commas
        kinds[6, [ord(c) for c in "!\"'()-?"]] = True  # marks
        symbols = set(range(33, 127)) - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123)) - set(map(ord, ".,;:!?\"'()-"))
        kinds[7, sorted(symbols)] = True
        self.kinds = kinds

    def __call__(self, column: pa.Array) -> np.ndarray:
        column = pc.fill_null(column, "")
        data, offsets = C.text_bytes(column)
        n = len(offsets) - 1
        size = np.diff(offsets).astype(float)

        def per(flags: np.ndarray, at: np.ndarray = offsets) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return (sums[at[1:]] - sums[at[:-1]]).astype(float)

        byte = [per(k[data]) for k in self.kinds]
        symbol = (self.kinds[6] | self.kinds[7])[data]
        run = per(symbol & np.append(symbol[1:], False)) if len(data) else np.zeros(n)
        h, starts, ends, at = self.words.spans(column)
        count = np.diff(at).astype(float)
        doc = np.repeat(np.arange(n), np.diff(at))
        long = ends - starts

        def repeated(x: np.ndarray, of: np.ndarray) -> np.ndarray:
            """Per document, the values that occurred in it before."""
            if not len(x):
                return np.zeros(n)
            order = np.lexsort((x, of))
            again = (x[order][1:] == x[order][:-1]) & (of[order][1:] == of[order][:-1])
            return np.bincount(of[order][1:][again], minlength=n).astype(float)

        again = np.zeros(len(h), bool)
        if len(h) > 1:
            again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
            pairs, of = C.shingles(h, at, 2)
        else:
            pairs, of = h, doc
        lines, line_ends, line_doc = C.spans_where(data != 10, offsets)
        line_hash = C.hash_spans(self.words.table[data], lines, line_ends, self.words.powers)
        n_lines = np.bincount(line_doc, minlength=n).astype(float)
        # Case is read from the bytes as they are; lower-casing may change lengths beyond ASCII.
        s, e, d = C.spans_where(self.words.is_word[data], offsets)
        title_n = upper_n = np.zeros(n)
        if len(s):
            first = self.kinds[0][data[s]]
            second = self.kinds[0][data[np.minimum(s + 1, len(data) - 1)]] & (e - s > 1)
            title_n, upper_n = (np.bincount(d[x], minlength=n).astype(float) for x in (first & ~second, first & second))
        share = lambda a, b: a / np.maximum(b, 1)
        pipes = per(data == 124) if len(data) else np.zeros(n)
        cols = [
            np.log1p(size), np.log1p(count), share(per(long, at), count), share(byte[0], size), share(byte[1], size), share(byte[2], size), share(byte[3], size),
            share(byte[4], count), share(byte[5], count), share(byte[6], count), share(byte[7], size), share(pipes, count),
            share(per(long <= 2, at), count), share(per(long >= 14, at), count), 1 - share(repeated(h, doc), count), share(per(again, at), count),
            share(repeated(pairs, of), count), share(n_lines, count), share(repeated(line_hash, line_doc), n_lines), share(title_n, count), share(upper_n, count), share(run, count),
        ]
        return np.column_stack(cols).astype(np.float32)


# --- the model -----------------------------------------------------------------------------------------


@dataclass
class Model:
    """score = logistic(bias + sum of tables at the features' bins + sum of pair tables)."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for j, (edge, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edge, x[:, j], "right")]
        bins = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for a, b, _ in self.pairs for j in (a, b)}
        for a, b, table in self.pairs:
            out += table[bins[a], bins[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32))


def _split(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """The best gain over no split, and its place: bins below it go left."""
    gs, hs = np.cumsum(g), np.cumsum(h)
    left, right = gs[:-1] ** 2 / (hs[:-1] + l2), (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + l2)
    if not len(left):
        return 0.0, 0
    k = int(np.argmax(left + right))
    return float(left[k] + right[k] - gs[-1] ** 2 / (hs[-1] + l2)), k + 1


def _tree(g: np.ndarray, h: np.ndarray, l2: float, leaves: int = 3) -> np.ndarray:
    """Leaf values of a shallow tree over the bins, grown best first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_split(g[a:b], h[a:b], l2), a, b) for a, b in parts if b - a > 1), default=(0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        _, k, a, b = best
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """A tree over two features: a cut of one, then a cut of the other in each half; and its gain."""
    best = (0.0, None)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        ga, ha = np.cumsum(a, 0), np.cumsum(b, 0)
        for k in range(1, len(a)):
            gain, out = 0.0, np.zeros_like(a)
            for rows, gg, hh in ((slice(0, k), ga[k - 1], ha[k - 1]), (slice(k, None), ga[-1] - ga[k - 1], ha[-1] - ha[k - 1])):
                more, c = _split(gg, hh, l2)
                for cols in (slice(0, c), slice(c, None)) if more > 0 else (slice(None),):
                    v = gg[cols].sum() / (hh[cols].sum() + l2)
                    gain += v * gg[cols].sum()
                    out[rows, cols] = v
            if gain > best[0]:
                best = (gain, out.T.copy() if flip else out)
    return (np.zeros_like(g), 0.0) if best[1] is None else (best[1], best[0])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.12, bins: int = 48, n_pairs: int = 8, pair_rounds: int = 30, l2: float = 4.0) -> Model:
    """A model of labels y in {0, 1}; without labels every score is 0.5, with one class it is near that class."""
    m = Model()
    n = len(y)
    mean = (float(y.sum()) + 0.5) / (n + 1)
    m.bias = float(np.log(mean / (1 - mean)))
    m.edges = [_edges(x[:, j], bins) if n else np.zeros(0, np.float32) for j in range(len(FEATURES))]
    m.coarse = [_edges(x[:, j], 8) if n else np.zeros(0, np.float32) for j in range(len(FEATURES))]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    if n < 2 or y.min() == y.max():
        return m
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(m.edges)]
    margin = np.full(n, m.bias)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-4)

    for _ in range(rounds):
        for j, table in enumerate(m.tables):
            g, h = gradients()
            step = rate * _tree(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)), l2)
            table += step
            margin += step[at[j]]
    low = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(m.coarse)]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        na, nb = len(m.coarse[a]) + 1, len(m.coarse[b]) + 1
        return np.bincount(low[a] * nb + low[b], v, na * nb).reshape(na, nb)

    g, h = gradients()
    gains = sorted(((_tree2(grid(a, b, g), grid(a, b, h), l2)[1], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    m.pairs = [(a, b, np.zeros((len(m.coarse[a]) + 1, len(m.coarse[b]) + 1))) for gain, a, b in gains[:n_pairs] if gain > 0]
    for _ in range(pair_rounds):
        for a, b, table in m.pairs:
            g, h = gradients()
            step = rate * _tree2(grid(a, b, g), grid(a, b, h), l2)[0]
            table += step
            margin += step[low[a], low[b]]
    return m


# --- on DataFrames ---------------------------------------------------------------------------------------


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out(column: str = "doc_id"):
    """Documents that are never learned from; a null id counts as learnable."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """A model from labels(doc_id, quality) that are not held out; null labels and ids are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most).collect()
    wanted = docs.sparkSession.createDataFrame([(i,) for i in sorted({r.doc_id for r in rows})], "doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for whole in batches:
            for batch in C.slices(whole):
                x = features(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))], names=["doc_id", "x"])

    # At most MAX_TRAIN ids are broadcast.
    got = _plain(docs).join(F.broadcast(wanted), "doc_id", "left_semi").mapInArrow(run, "doc_id long, x array<float>").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    at = dict(zip(got["doc_id"].to_pylist(), range(got.num_rows)))
    rows = [(at[r.doc_id], r.quality) for r in rows if r.doc_id in at]
    return fit(x[[i for i, _ in rows]], np.array([q for _, q in rows], float))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of docs(doc_id, text): one row per input row.

    Null and empty texts are scored like any other, from features that are all zero; repeated rows and null ids
    are kept; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for whole in batches:
            for batch in C.slices(whole):
                p = model.score(features(batch.column("text")))
                cols = [batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "predicted"])

    out = _plain(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, whose score reaches the threshold."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for whole in batches:
            for batch in C.slices(whole):
                good = model.score(features(batch.column("text"))) >= threshold
                yield batch.filter(pa.array(good))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema).select(*names)


def op4_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
