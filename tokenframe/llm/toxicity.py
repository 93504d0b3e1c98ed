"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Method: a word is the mean of the embeddings of its hashed character n-grams, a window of words the mean of
its words, and a softmax over two classes reads that mean; embeddings and softmax are trained together by
Adagrad. Unseen misspellings share n-gram vectors with what was seen. A long document's mean would drown a
few words, so a document is represented by its most toxic window of WINDOW words (windows overlap, at every word
one begins): training starts from whole-document means and goes on with each document's most toxic window. The score
is the softmax's second output. Its inputs are that window's mean and, as more windows give chance more to pick
from, the logarithm of their number; with the embeddings settled, its last scale, the weight of the number and its
bias are fitted once more, on every fifth sample row, which training left out. As the model is linear, scoring needs
one number per n-gram, and each distinct word of a chunk is scored once.

Settings were chosen by cross-validation within the rows that may be learned from (see the README).

Fitting takes a bounded sample: up to TRAIN_ROWS labelled rows, by hash and half of each label where there are as many, of texts
of up to TRAIN_CHARS characters. Scoring reads whole texts. Null and empty texts are scored as a window
without words. Rows without a label, or with a null one, teach nothing; without two classes of labels the score is
the share of label 1. Null doc_ids are never learned from; repeated rows keep a row each. Windows that tie are alike;
an empty table gives no rows. Columns other than doc_id and text, whatever their names, are never read for a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import hash_share, ranges, segment_sums, ship, small_batches, table, text_chunks

TRAIN_ROWS, TRAIN_CHARS = 4000, 12_000
WINDOW, DIM, BITS = 1, 4, 18
LEAST, MOST, LEAST_SEEN = 3, 6, 3
#: One sample row in so many is kept from training and fits the score instead.
CHECKED = 5


def fold(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def windows(counts: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, its words, windows of each text): one begins at every word that leaves room, one at least a text."""
    each = np.maximum(1, counts - size + 1)
    return ranges(np.cumsum(counts) - counts, each), np.repeat(np.minimum(size, counts), each), each


def window_means(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return (upto[first + sizes] - upto[first]) / np.maximum(1, sizes)


@dataclass
class Model:
    """What scoring needs: the softmax's difference of logits for each n-gram bucket, its bias, scales and last bias."""

    gram: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float

    def features(self, texts: pa.Array) -> np.ndarray:
        """The logit of each text's most toxic window, and the logarithm of its number of windows."""
        distinct, index, counts = words.split(texts)
        buckets, grams = words.ngrams(distinct, LEAST, MOST, BITS)
        of_word = segment_sums(self.gram[buckets], grams) / np.maximum(1, grams)
        first, sizes, each = windows(counts)
        logit = window_means(of_word[index], first, sizes) + self.bias
        best = np.maximum.reduceat(logit, np.cumsum(each) - each) if len(each) else logit
        return np.stack((best, np.log(each)), axis=1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The softmax's second output; of two classes, it depends on the difference of their logits."""
        return _sigmoid(self.features(texts) @ self.slopes + self.shift)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Net:
    """Embeddings and softmax with their Adagrad sums; bags are runs of word indices."""

    def __init__(self, buckets: np.ndarray, grams: np.ndarray, times: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.buckets, self.grams = buckets, np.maximum(1, grams)
        self.gram_word = np.repeat(np.arange(len(grams), dtype=np.int32), grams)
        self.runs = grams
        seen = np.bincount(buckets, weights=times[self.gram_word], minlength=1 << BITS)
        self.common = (seen >= LEAST_SEEN).astype(np.float32)  # rarer n-grams, and those of other texts, say nothing
        self.embed = (rng.random((DIM, 1 << BITS)) - 0.5).astype(np.float32) / DIM * self.common
        self.soft = rng.normal(0, 0.3, (DIM, 2))
        self.bias = np.zeros(2)
        self.sums = [np.full_like(self.embed, 1e-8), np.full_like(self.soft, 1e-8), np.full_like(self.bias, 1e-8)]

    def word_vectors(self) -> np.ndarray:
        return np.stack([segment_sums(e[self.buckets], self.runs) / self.grams for e in self.embed])

    def epoch(self, index, sizes, divisor, labels, rate: float, use: np.ndarray) -> None:
        vectors = self.word_vectors()
        hidden = np.stack([segment_sums(v[index], sizes) / divisor for v in vectors], axis=1)
        logits = hidden @ self.soft + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1
        weight = 0.5 / np.maximum(1, np.bincount(labels, minlength=2))
        g = p * (weight[labels] * use)[:, None]
        back = (g @ self.soft.T) / divisor[:, None]
        bag = np.repeat(np.arange(len(sizes)), sizes)
        grads = np.zeros_like(self.embed)
        for d in range(DIM):
            of_word = np.bincount(index, weights=back[bag, d], minlength=len(self.runs)) / self.grams
            grads[d] = np.bincount(self.buckets, weights=of_word[self.gram_word], minlength=1 << BITS) * self.common
        for value, grad, total in zip((self.embed, self.soft, self.bias), (grads, hidden.T @ g, g.sum(axis=0)), self.sums):
            total += grad * grad
            value -= (rate * grad / np.sqrt(total)).astype(value.dtype)

    def gram_logits(self) -> tuple[np.ndarray, float]:
        u = self.soft[:, 1] - self.soft[:, 0]
        return (u.astype(np.float32) @ self.embed), float(self.bias[1] - self.bias[0])


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = 8, rounds: int = 6, round_epochs: int = 6, rate: float = 1.0) -> Model:
    """Train on texts and their labels (0 or 1)."""
    share = float(labels.mean()) if len(labels) else 0.0
    if len(labels) == 0 or share in (0.0, 1.0):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, np.zeros(2), float(np.log(p / (1 - p))))
    distinct, index, counts = words.split(texts)
    net = _Net(*words.ngrams(distinct, LEAST, MOST, BITS), np.bincount(index, minlength=len(distinct)))
    checked = np.arange(len(labels)) % CHECKED == 0
    if len(labels) < 20 * CHECKED or not 0 < labels[checked].sum() < checked.sum():
        checked[:] = False
    for _ in range(epochs):
        net.epoch(index, counts, np.maximum(1, counts).astype(np.float64), labels, rate, ~checked)
    begins, sizes, each = windows(counts)
    first = np.cumsum(each) - each

    def top():
        gram, bias = net.gram_logits()
        logit = window_means((segment_sums(gram[net.buckets], net.runs) / net.grams)[index], begins, sizes) + bias
        best = np.maximum.reduceat(logit, first)
        order = np.lexsort((-logit, np.repeat(np.arange(len(each)), each)))
        return best, order[first]

    for _ in range(rounds):
        _, chosen = top()
        at = ranges(begins[chosen], sizes[chosen])
        for _ in range(round_epochs):
            net.epoch(index[at], sizes[chosen], np.maximum(1.0, sizes[chosen]), labels, rate / 2, ~checked)
    x = np.stack((top()[0], np.log(each)), axis=1)
    if checked.any():
        x, labels = x[checked], labels[checked]
    gram, bias = net.gram_logits()
    slopes, shift = _last_layer(x, labels)
    return Model(gram.astype(np.float32), bias, slopes, shift)


def _last_layer(x: np.ndarray, y: np.ndarray, held_back: float = 0.05) -> tuple[np.ndarray, float]:
    """The softmax's scales of its two inputs and its bias, by Newton steps."""
    mean, spread = x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    z = np.concatenate(((x - mean) / spread, np.ones((len(x), 1))), axis=1)
    share = float(y.mean())
    w, back = np.array([1.0, 0.0, np.log(share / (1 - share))]), np.array([held_back, held_back, 0.0])
    for _ in range(60):
        p = _sigmoid(z @ w)
        hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(back)
        w -= np.clip(np.linalg.solve(hess, z.T @ (p - y) + back * w), -1, 1)
    slopes = w[:2] / spread
    return slopes, float(w[2] - slopes @ mean)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0))
    there = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}  # two rows at most
    share = F.lit(False)
    for label, n in there.items():
        share = F.when(F.col("toxic") == label, hash_share(F.col("doc_id"), rows // 2, n)).otherwise(share)
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= chars)
    chosen = own.where(share).withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows // 2)  # at most `rows` rows
    sample = short.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").limit(rows).select("text", "toxic").toArrow()
    return fit(sample.column("text").combine_chunks().cast(pa.string()), sample.column("toxic").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """(the kept columns, score) of every row."""
    sent = small_batches(ship(docs.sparkSession)).sparkContext.broadcast(model)
    inputs = docs.select(*keep, F.col("text").alias("__text"))
    schema = inputs.drop("__text").schema.add("score", "double")

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, last in text_chunks(texts):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sent.value.scores(part.column(part.num_columns - 1)))], schema.names)

    return inputs.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    scored = score(docs, model, doc_id, (fold(F.col("doc_id"), 5) == 0).alias("held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that aren't predicted toxic (a score below 0.5), with all their columns.

    Null and empty texts are scored as a window without words; very long ones are read whole; repeated rows and null ids
    stay as they are; an empty table stays empty, and without labels all rows stay. Columns keep their names.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    sent = small_batches(ship(spark)).sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for first, last in text_chunks(batch.column(at)):
                part = batch.slice(first, last - first)
                yield part.filter(pa.array(sent.value.scores(part.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
