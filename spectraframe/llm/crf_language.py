"""Language identification: a linear-chain conditional random field over the words of a text.

Each word has hashed features: prefixes and suffixes, byte bigrams and trigrams, and the word itself (a learned
lexicon). Feature weights give each label an emission score, learned transitions link neighbouring words, and
forward-backward gives every word's label probabilities, so text that switches language is labelled word by
word. A document's language has the largest sum of probabilities.

Forward-backward runs over all documents of a slice at once: the words form one chain in which a document's
first word forgets what came before. The chain is cut into equal blocks; the blocks' transfer matrices are
multiplied side by side, joined block after block, and then every block is run side by side from its entry.
This is exact, and a long document costs no more than short ones.

Training takes an excerpt of at most EXCERPT characters from some PER_LANG documents of each language, whatever the
number of languages, and from fewer documents of each where there would be more than MAX_EXCERPTS in all (all three
are parameters); prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

PER_LANG, EXCERPT, MAX_EXCERPTS = 250, 1500, 16_000
BITS = 16
EPOCHS = 30
#: Bytes of text whose words form one chain: a chain of n words takes about the square root of n steps.
SLICE = 1 << 21


class WordFeatures:
    """Hashed features of the words of a string column, as flat arrays: word number and feature number."""

    def __init__(self) -> None:
        self.words = C.Words()

    def __call__(self, column: pa.Array):
        data, offsets = C.text_bytes(pc.utf8_lower(pc.fill_null(column.cast(pa.string()), "")))
        starts, ends, doc = C.spans_where(self.words.is_word[data], offsets)
        at = np.searchsorted(doc, np.arange(len(offsets)), "left")
        n = ends - starts
        blocks: list[np.ndarray] = []  # one feature for each word
        if len(starts):
            x = np.append(data, np.zeros(4, np.uint8)).astype(C.U64)
            blocks.append(C.hash_spans(self.words.table[data], starts, ends, self.words.powers))
            head = tail = np.zeros(len(starts), C.U64)
            for k in range(1, 5):
                fits = n >= k
                head = head * C.U64(257) + np.where(fits, x[np.minimum(starts + k - 1, len(data))], C.U64(256))
                tail = tail * C.U64(257) + np.where(fits, x[np.maximum(ends - k, 0)], C.U64(256))
                blocks += [C.mix(head, 10 + k), C.mix(tail, 20 + k)]
        keep = np.uint64((1 << BITS) - 1)
        single = [b & keep for b in blocks]
        grams = []
        for k in (2, 3):
            if len(data) < k or not len(starts):
                grams.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            code = np.zeros(len(data) - k + 1, C.U64)
            for j in range(k):
                code = code << C.U64(8) | x[j : len(data) - k + 1 + j]
            m = np.maximum(n - k + 1, 0)
            word = np.repeat(np.arange(len(starts)), m)
            first = np.repeat(starts, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            grams.append((word, (C.mix(code[first], 30 + k) & keep).astype(np.int64)))
        return at, len(starts), [s.astype(np.int64) for s in single], grams


def emissions(weights: np.ndarray, n_words: int, single: list[np.ndarray], grams: list) -> np.ndarray:
    """Scores of words by labels: sums of the weights of their features."""
    out = np.zeros((n_words, weights.shape[1]), weights.dtype)
    for f in single:
        out += weights[f]
    for word, f in grams:
        if len(f):
            sums = np.zeros((len(f) + 1, weights.shape[1]), np.float64)
            np.cumsum(weights[f], axis=0, out=sums[1:])
            ends = np.searchsorted(word, np.arange(n_words + 1))
            out += (sums[ends[1:]] - sums[ends[:-1]]).astype(weights.dtype)
    return out


def chain(e: np.ndarray, step: np.ndarray, start: np.ndarray, reset: np.ndarray) -> np.ndarray:
    """Normalised forward vectors: f[t] ~ (f[t-1] @ step) * e[t], and f[t] ~ start * e[t] where reset[t]."""
    n, k = e.shape
    if not n:
        return e.copy()
    size = max(1, int(np.sqrt(n)))
    blocks = -(-n // size)
    pad = blocks * size - n
    e = np.concatenate([e, np.ones((pad, k), e.dtype)]).reshape(blocks, size, k)
    reset = np.concatenate([reset, np.zeros(pad, bool)]).reshape(blocks, size)
    some = reset.any(0)
    m = np.broadcast_to(np.eye(k, dtype=e.dtype), (blocks, k, k)).copy()
    for t in range(size):
        m = (m.reshape(-1, k) @ step).reshape(blocks, k, k) * e[:, t, None, :]
        if some[t]:
            m[reset[:, t]] = (start * e[reset[:, t], t])[:, None, :]
        m /= m.sum((1, 2), keepdims=True)
    entry = np.empty((blocks, k), e.dtype)
    v = np.full(k, 1 / k, e.dtype)
    for b in range(blocks):
        entry[b] = v
        v = v @ m[b]
        v /= v.sum()
    out = np.empty_like(e)
    v = entry
    for t in range(size):
        v = (v @ step) * e[:, t]
        if some[t]:
            v[reset[:, t]] = start * e[reset[:, t], t]
        v /= v.sum(1, keepdims=True)
        out[:, t] = v
    return out.reshape(-1, k)[:n]


def forward_backward(score: np.ndarray, step: np.ndarray, start: np.ndarray, first: np.ndarray):
    """Label probabilities of every word, and the forward and backward vectors. first: a sequence begins."""
    e = np.exp(score - score.max(1, keepdims=True)) + 1e-12 if len(score) else score
    f = chain(e, step, start, first)
    last = np.append(first[1:], True)
    g = chain(e[::-1], step.T.copy(), np.ones_like(start), last[::-1])[::-1]
    p = f * g / e
    return p / p.sum(1, keepdims=True), f, g


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # features by labels
    step: np.ndarray  # transition scores
    start: np.ndarray

    def predict(self, column: pa.Array, features: WordFeatures) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the words by labels, and offsets of documents among them."""
        at, n, single, grams = features(column)
        if not self.labels:
            return np.zeros((n, 0)), at
        first = np.zeros(n, bool)
        first[at[:-1][np.diff(at) > 0]] = True
        p, _, _ = forward_backward(emissions(self.weights, n, single, grams), np.exp(self.step), np.exp(self.start), first)
        return p, at


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS, l2: float = 1e-4, rate: float = 0.15) -> Model:
    """Maximum likelihood by gradient steps of adaptive size (Adam) over all words.

    Excerpts are joined in threes to one sequence, so that changes of language are learned as well.
    """
    labels = sorted(set(langs))
    k = len(labels)
    features = WordFeatures()
    order = np.argsort(C.mix(np.arange(len(texts), dtype=C.U64), 9)) if texts else np.zeros(0, int)
    texts, langs = [texts[i] for i in order], [langs[i] for i in order]
    at, n, single, grams = features(pa.array(texts, pa.string()))
    y = np.repeat(np.array([labels.index(x) for x in langs], np.int64), np.diff(at)) if n else np.zeros(0, np.int64)
    first = np.zeros(n, bool)
    begins = at[:-1][np.diff(at) > 0][::3]
    first[begins] = True
    w, step, start = np.zeros((1 << BITS, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32)
    if k < 2 or not n:
        return Model(labels, w, step, start)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, step, start)]
    inside = np.flatnonzero(~first)
    seen_step = np.zeros((k, k))
    np.add.at(seen_step, (y[inside - 1], y[inside]), 1)
    seen_start = np.bincount(y[first], minlength=k)
    hot = np.zeros((n, k), np.float32)
    hot[np.arange(n), y] = 1
    for epoch in range(1, epochs + 1):
        p, f, g = forward_backward(emissions(w, n, single, grams), np.exp(step), np.exp(start), first)
        d = (hot - p) / n
        grad = np.zeros_like(w)
        for j in range(k):
            for feature in single:
                grad[:, j] += np.bincount(feature, d[:, j], len(w))
            for word, feature in grams:
                grad[:, j] += np.bincount(feature, d[word, j], len(w))
        both = f[inside - 1][:, :, None] * np.exp(step) * g[inside][:, None, :]
        both /= both.sum((1, 2), keepdims=True)
        grads = (grad - l2 * w, (seen_step - both.sum(0)) / n - l2 * step, (seen_start - p[first].sum(0)) / n - l2 * start)
        for x, gx, (m1, m2) in zip((w, step, start), grads, moments):
            m1 += 0.1 * (gx - m1)
            m2 += 0.02 * (gx * gx - m2)
            x += rate * (m1 / (1 - 0.9**epoch)) / (np.sqrt(m2 / (1 - 0.98**epoch)) + 1e-7)
    return Model(labels, w, step, start)


# --- on DataFrames -----------------------------------------------------------------------------------------


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG, excerpt: int = EXCERPT, most: int = MAX_EXCERPTS) -> Model:
    """A model from docs(doc_id, text, lang) that are not held out; null languages and texts are left out.

    Every language with such a document is learned. Documents are picked by hashes of their ids.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = known.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return fit([], [])
    per_lang = max(1, min(per_lang, most // len(counts)))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.5 * per_lang / r["count"] + 20 / r["count"])))])
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    n = F.length("text")
    begin = (F.pmod(F.xxhash64("doc_id", F.lit(18)), F.greatest(n - excerpt, F.lit(0)) + 1) + 1).cast("int")
    rows = known.where(place < share[F.col("lang")]).select("lang", "doc_id", F.substring("text", begin, F.lit(excerpt)).alias("text")).collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], r["text"]))
    taken: dict[str, list[str]] = {}
    for r in rows:
        taken.setdefault(r["lang"], []).append(r["text"])
    pairs = [(t, lang) for lang, ts in taken.items() for t in ts[: 2 * per_lang]]
    return fit([t for t, _ in pairs], [x for _, x in pairs])


def predict(docs: DataFrame, model: Model, runs: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words and n_switches of docs(doc_id, text); one row per input row.

    lang_pred is `und` with score 0 where the text is null, empty or without a letter. score is the mean
    probability of lang_pred over the words, n_switches the changes between the words' likeliest labels; with
    runs, column `runs` lists label:words of each run of words. Repeated rows and null ids are kept, other
    columns are ignored, an empty table gives an empty result. Ties go to the first label by name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = WordFeatures()
        for whole in batches:
            for batch in C.slices(whole, "text", SLICE):
                column = pc.fill_null(batch.column("text"), "")
                n = batch.num_rows
                letters = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False)
                if not model.labels:
                    letters = np.zeros(n, bool)
                p, at = model.predict(column, features)
                words = np.diff(at)
                k = max(1, len(model.labels))
                sums = np.zeros((len(p) + 1, k))
                if p.size:
                    np.cumsum(p, axis=0, out=sums[1:])
                mean = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(words, 1)[:, None]
                best = mean.argmax(1)
                known = letters & (words > 0)
                lang = [model.labels[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist())]
                score = np.where(known, np.clip(mean[np.arange(n), best], 0, 1), 0.0)
                label = p.argmax(1) if p.size else np.zeros(len(p), int)
                change = np.zeros(len(p) + 1, np.int64)
                if len(p) > 1:
                    change[2:] = np.cumsum(label[1:] != label[:-1])
                lo, hi = np.minimum(at[:-1] + 1, len(p)), at[1:]
                switches = np.where(words > 1, change[hi] - change[lo], 0)
                cols = [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(words.astype(np.int64)), pa.array(switches.astype(np.int64))]
                names = ["doc_id", "lang_pred", "score", "n_words", "n_switches"]
                if runs:
                    said = []
                    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                        own = label[a:b]
                        cut = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]]) if b > a else [0]
                        said.append(",".join(f"{model.labels[own[s]]}:{t - s}" for s, t in zip(cut[:-1], cut[1:])))
                    cols.append(pa.array(said, pa.string()))
                    names.append("runs")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = plain.mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long, n_switches long" + ", runs string" * runs)
    return out.select("doc_id", held_out().alias("held_out"), *out.columns[1:])


def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return predict(docs, train(docs))
