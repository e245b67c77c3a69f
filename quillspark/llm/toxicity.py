"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Method. A bag holds the character n-grams (bytes of the lower-cased text, with a mark at either end of a word) of a
window of WINDOW words that follow each other, hashed into buckets. The embeddings of a bag are averaged and go into a
linear softmax over two labels; a text's score is that of its most toxic window, so that a few toxic words count as much
in a long text as in a short one, and length as such counts nothing. Embeddings and softmax are trained jointly by Adam
on labels of whole texts, a bounded sample of the labelled rows; a text's windows share its gradient by a sharp softmax
over them, which is how the long clean texts of the sample set the threshold that the greatest of many windows has to pass.
Unseen spellings share most of their n-grams with those seen. Scoring needs one number for each bucket: embedding times
difference of the softmax rows.

Defined cases: a null text is empty; a text without words scores 0.0. A text of fewer words than a window is one window.
Very long texts are scored whole. A null doc_id counts as the text "" in the fold. Documents without a label are scored,
not learnt from. Rows that share a doc_id are scored each. Equal texts score the same. Without any label, or with one
kind only, every score is the share of toxic labels (0.0 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, map_text, saved, small

LENGTHS = (3, 4, 5, 6)
BUCKET_BITS, DIMENSIONS = 18, 8
WINDOW = 3
#: At most so many labelled rows, and of each only if its text has so many characters at most, are learnt from; no more
#: rows are taken once the texts taken have SAMPLE_TOTAL characters.
SAMPLE, SAMPLE_CHARS, SAMPLE_TOTAL = 6000, 200_000, 40_000_000
EPOCHS, BATCH, SEED = 5, 128, 11
#: So many steps at least: a small sample goes through more epochs.
STEPS = 30
#: Rate of Adam, decay of embeddings, sharpness of the softmax over a text's windows, least share that gets a gradient.
RATE, DECAY, SHARP, LEAST = 0.05, 0.5, 3.0, 0.01

#: Bytes that words have: all above 127, letters and digits; others part words.
_CLEAN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(texts: list[str | None]) -> tuple[list[bytes], list[np.ndarray]]:
    """(the different words of all texts, for each text the places of its words in turn)."""
    index: dict[bytes, int] = {}
    own = []
    for t in texts:
        found = (t or "").lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split()
        own.append(np.fromiter((index.setdefault(w, len(index)) for w in found), np.int64, len(found)))
    return list(index), own


def bags(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' n-grams in turn, where each word's begin, and the end)."""
    if not words:
        return np.empty(0, np.int32), np.zeros(1, np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    blank = b == 32
    word = np.cumsum(blank) - 1
    h = b.astype(np.uint64)
    inner = np.zeros(len(b), bool)
    hashes, owners = [], []
    for n in range(2, max(LENGTHS) + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + b[n - 1 :]
        if n >= 3:
            inner = inner[: len(h)] | blank[n - 2 : n - 2 + len(h)]
        if n in LENGTHS:
            at = np.flatnonzero(~inner[: len(h)])
            hashes.append(((h[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
            owners.append(word[at + 1] - blank[at + 1])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(hashes)[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words))[: len(words)])])


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, text) of the windows of texts that follow each other; one for each word, the last ones repeated."""
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    a = np.maximum(np.minimum(np.arange(len(text)), ends[text] - WINDOW), (ends - lengths)[text])
    return a, np.minimum(a + WINDOW, ends[text]), text


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])


@dataclass
class Model:
    """weights: of each bucket; bias. Both are what the softmax's second row has above the first."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words, own = words_of(texts)
        buckets, at = bags(words)
        total = _sums(self.weights[buckets])
        total, count = total[at[1:]] - total[at[:-1]], np.diff(at)
        out = np.zeros(len(own))
        some = [i for i, w in enumerate(own) if len(w)]
        if some:
            ids, n = np.concatenate([own[i] for i in some]), np.array([len(own[i]) for i in some])
            a, b, _ = windows(n)
            sums, counts = _sums(total[ids]), _sums(count[ids])
            best = np.maximum.reduceat((sums[b] - sums[a]) / np.maximum(counts[b] - counts[a], 1), np.cumsum(n) - n)
            out[some] = 1 / (1 + np.exp(-np.clip(best + self.bias, -60, 60)))
        return out


def _take(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows' entries, lengths of the rows) in a ragged array."""
    n = starts[rows + 1] - starts[rows]
    return np.repeat(starts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Joint training of embeddings and softmax; each batch updates the buckets that its texts' strongest windows hold."""
    labels = np.asarray(labels, np.float64)
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 60.0 if share else -60.0)
    rng = np.random.default_rng(SEED)
    words, own = words_of(texts)
    own, labels = [w for w in own if len(w)], labels[[len(w) > 0 for w in own]]
    buckets, at = bags(words)
    size = (1 << BUCKET_BITS, DIMENSIONS)
    e, m, v = rng.normal(0, 0.05, size), np.zeros(size), np.zeros(size)
    w, c = rng.normal(0, 1.0, (2, DIMENSIONS)), np.array([0.0, np.log(share / (1 - share))])
    rest = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (w, c)]
    step, epochs = 0, max(epochs, -(-STEPS // -(-len(own) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(len(own))
        for s in range(0, len(order), BATCH):
            docs = order[s : s + BATCH]
            ids, word = np.unique(np.concatenate([own[d] for d in docs]), return_inverse=True)
            lengths = np.array([len(own[d]) for d in docs])
            places, n = _take(at, ids)
            way, ends = w[1] - w[0], np.cumsum(n)
            total = _sums((e @ way)[buckets[places]])
            sums, counts = _sums((total[ends] - total[ends - n])[word]), _sums(n[word])
            a, b, doc = windows(lengths)
            grams = np.maximum(counts[b] - counts[a], 1)
            z = (sums[b] - sums[a]) / grams
            most = np.maximum.reduceat(z, np.cumsum(lengths) - lengths)
            part = np.exp(SHARP * (z - most[doc]))
            part /= np.bincount(doc, part, len(docs))[doc]
            odds = np.exp(np.clip(np.bincount(doc, part * z, len(docs)) + c[1] - c[0], -60, 60))
            wrong = (odds / (1 + odds) - labels[docs]) / len(docs)
            on = np.flatnonzero(part > LEAST)
            size_on = b[on] - a[on]
            inside = np.repeat(a[on] - np.cumsum(size_on) + size_on, size_on) + np.arange(size_on.sum())
            each = np.bincount(word[inside], np.repeat((wrong[doc] * part)[on] / grams[on], size_on), len(ids))
            used = np.flatnonzero(each)
            places, n = _take(at, ids[used])
            held, bucket = np.unique(buckets[places], return_inverse=True)
            g = np.bincount(bucket, np.repeat(each[used], n), len(held))
            gd, gc, ge = g @ e[held], wrong.sum(), g[:, None] * way
            step += 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for (p, mo, ve), x in zip(rest, (np.stack([-gd, gd]), np.array([-gc, gc])), strict=True):
                mo += 0.1 * (x - mo)
                ve += 0.001 * (x * x - ve)
                p -= rate * mo / (np.sqrt(ve) + 1e-10)
            m[held] = 0.9 * m[held] + 0.1 * ge
            v[held] = 0.999 * v[held] + 0.001 * ge * ge
            e[held] = e[held] * (1 - rate * DECAY) - rate * m[held] / (np.sqrt(v[held]) + 1e-10)
    return Model((e @ (w[1] - w[0])).astype(np.float32), float(c[1] - c[0]))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, total: int = SAMPLE_TOTAL) -> Model:
    """Learns from labelled rows outside fold 0: the sample of them with the smallest hashes of doc_id."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    ids = saved(ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.length("text") <= SAMPLE_CHARS).join(small(ids), "doc_id")
    texts, toxic = [], []
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").toLocalIterator():
        texts.append(r.text)
        toxic.append(r.toxic)
        total -= len(r.text)
        if total <= 0:
            break
    return train(texts, np.array(toxic))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # two to the BUCKET_BITS numbers; arrays need no package to be read

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = Model(*shared.value).scores(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return map_text(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double, predicted int", limit=1 << 20)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels)).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
