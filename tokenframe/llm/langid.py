"""Language identification: the language family first, then one-versus-one linear support vector machines.

Method: a document is the mean over its words of the mean of each word's hashed character n-grams. Linear
support vector machines, one per family against the rest, choose the family; within it, one machine per pair
of languages votes. All are trained in numpy by dual coordinate descent. The family of a language comes from
a table of language codes; a language outside it is a family of its own. As all machines are linear, each
distinct word of a chunk is scored once.

Fitting takes a sample of every language, bounded per language: up to TRAIN_ROWS rows by hash (fewer from nine
languages on, one at least), texts of up to TRAIN_CHARS characters, or the beginnings of longer texts where a
language has no others; prediction reads whole texts. Texts that are null or have no letter get `und`
and score 0. Rows with a null lang or doc_id teach nothing; with no learned language every text gets `und`
and score 0. Repeated rows keep a row each, an empty table gives none.
Ties go to the family, and the language, that is first by name. Columns other than doc_id and text are never read for a prediction.

The score is the least chance, by a logistic function of the margins, among the decisions taken. It is below
0.5 where votes go in a circle, and where a text isn't like its language: its mean log frequency of n-grams
under that language's is compared with what sample texts had that the frequencies were not taken from, in
deviations for its number of words. So texts of unlearned languages and gibberish are unsure; a language of
fewer than JUDGED sample texts isn't judged.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import segment_sums, share_bound, share_hash, ship, small_batches, table, text_chunks
from .toxicity import fold

TRAIN_ROWS, TRAIN_CHARS = 400, 20_000
LEAST, MOST, BITS = 1, 3, 13
UNKNOWN = "und"
#: A predicted document stays in the pipeline from this score on.
LEAST_SCORE = 0.5
#: Sample texts from which on a language's likeness is judged; deviations that are allowed; frequency of an unseen n-gram.
JUDGED, DEVIATIONS, UNSEEN = 20, 6.0, 1e-5
_FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi", "romance": "fr es it pt ro ca gl oc", "slavic": "ru uk be pl cs sk bg sr hr bs sl mk", "baltic": "lt lv",
    "uralic": "fi et hu", "turkic": "tr az kk uz ky tk", "indic": "hi bn mr gu pa ne ur si", "semitic": "ar he mt am", "dravidian": "ta te kn ml", "celtic": "ga cy gd br",
    "austronesian": "id ms tl jv", "sinitic": "zh yue", "japonic": "ja", "koreanic": "ko", "hellenic": "el", "iranian": "fa ps ku",
}
FAMILY = {code: family for family, codes in _FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 25, seed: int = 11) -> np.ndarray:
    """Weights (the last is the bias) of an L2-loss linear machine for labels of -1 and 1."""
    x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), axis=1)
    share = {s: len(y) / max(1, 2 * int((y == s).sum())) for s in (-1, 1)}
    half = np.array([1 / (2 * cost * share[int(s)]) for s in y])
    squares, alpha, w = np.einsum("ij,ij->i", x, x) + half, np.zeros(len(y)), np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            step = max(0.0, alpha[i] - (y[i] * (x[i] @ w) - 1 + half[i] * alpha[i]) / squares[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def _likeness(x: np.ndarray, rows: np.ndarray, counts: np.ndarray, word_rows: np.ndarray, of_words: np.ndarray, buckets: np.ndarray, grams: np.ndarray):
    """(log frequency of every n-gram, (mean, variance of texts, of words)) of the language of `rows`; the variances from five folds."""
    logs = lambda some: np.log(x[some].mean(axis=0, dtype=np.float64) + UNSEEN)
    if len(rows) < JUDGED:
        return logs(rows), (0.0, np.inf, 0.0)
    held, words_held = np.zeros(len(rows)), []
    for part in range(5):
        out = np.arange(len(rows)) % 5 == part
        w = logs(rows[~out])
        of_word = segment_sums(w[buckets], grams) / np.maximum(1, grams)
        held[out] = x[rows[out]] @ w
        words_held.append(of_word[of_words[np.isin(word_rows, rows[out])]])
    within = float(np.concatenate(words_held).var())
    mean = float(np.median(held))
    between = max(1e-4, float(np.mean((held - mean) ** 2 - within / counts[rows])))
    return logs(rows), (mean, between, within)


@dataclass
class Model:
    """Languages by family and one weight column per machine, then one of likeness per language; the last row holds the biases.

    likeness: per language, in the order of members, the mean, the variances of texts and of words.
    """

    families: list[str]
    members: list[list[str]]
    pairs: list[list[tuple[int, int, int]]]
    weights: np.ndarray
    likeness: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each text."""
        distinct, index, counts = words.split(texts)
        n = len(counts)
        lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
        if not self.families:
            return lang, score
        some = counts > 0
        margins = np.zeros((n, self.weights.shape[1]))
        if self.weights.shape[1]:
            buckets, grams = words.ngrams(distinct, LEAST, MOST, BITS)
            for j in range(self.weights.shape[1]):
                of_word = segment_sums(self.weights[:-1, j][buckets], grams) / np.maximum(1, grams)
                margins[:, j] = segment_sums(of_word[index], counts) / np.maximum(1, counts) + self.weights[-1, j]
        k = len(self.families)
        if k > 1:
            order = np.argsort(-margins[:, :k], axis=1, kind="stable")
            best = order[:, 0]
            rows = np.arange(n)
            gap = margins[rows, order[:, 0]] - margins[rows, order[:, 1]]
        else:
            best, gap = np.zeros(n, np.int64), np.full(n, np.inf)
        first = self.weights.shape[1] - len(self.likeness)
        for f, names in enumerate(self.members):
            rows = np.flatnonzero(some & (best == f))
            votes, sure = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            least = np.full((len(rows), len(names)), np.inf)
            for a, b, j in self.pairs[f]:
                m = margins[rows, j]
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
                sure[:, a] += m
                sure[:, b] -= m
                least[:, a] = np.minimum(least[:, a], m)
                least[:, b] = np.minimum(least[:, b], -m)
            won = np.lexsort((-sure, -votes), axis=1)[:, 0] if len(names) > 1 else np.zeros(len(rows), np.int64)
            lang[rows] = np.array(names, object)[won]
            at = sum(map(len, self.members[:f])) + won
            mean, between, within = self.likeness[at].T
            like = (margins[rows, first + at] - mean) / np.sqrt(between + within / counts[rows]) + DEVIATIONS
            margin = np.minimum(np.minimum(gap[rows], 2 * least[np.arange(len(rows)), won]), like)
            score[rows] = 1 / (1 + np.exp(-2 * np.clip(margin, -15, 15)))
        return lang, score


def fit(texts: pa.Array, langs: list[str]) -> Model:
    """Train on texts and their languages."""
    distinct, index, counts = words.split(texts)
    kept = np.flatnonzero(counts > 0)
    langs = [langs[i] for i in kept]
    names = sorted(set(langs))
    families = sorted({family_of(x) for x in names})
    members = [[x for x in names if family_of(x) == f] for f in families]
    if not names:
        return Model(families, members, [], np.zeros(((1 << BITS) + 1, 0), np.float32), np.zeros((0, 3)))
    buckets, grams = words.ngrams(distinct, LEAST, MOST, BITS)
    starts, word_starts = np.cumsum(grams) - grams, np.cumsum(counts) - counts
    x = np.zeros((len(kept), 1 << BITS), np.float32)
    for row, i in enumerate(kept.tolist()):
        ws, times = np.unique(index[word_starts[i] : word_starts[i] + counts[i]], return_counts=True)
        g = grams[ws]
        at = np.repeat(starts[ws] - (np.cumsum(g) - g), g) + np.arange(int(g.sum()))
        x[row] = np.bincount(buckets[at], weights=np.repeat(times / g, g), minlength=1 << BITS) / counts[i]
    of = np.array(langs, object)
    word_rows = np.repeat(np.arange(len(kept)), counts[kept])
    of_words = np.concatenate([index[word_starts[i] : word_starts[i] + counts[i]] for i in kept.tolist()])
    likes = [_likeness(x, np.flatnonzero(of == name), counts[kept], word_rows, of_words, buckets, grams) for own in members for name in own]
    scale = np.float32(1 / max(1e-9, float(np.sqrt(np.einsum("ij,ij->i", x, x).mean()))))
    x *= scale
    fam = np.array([family_of(v) for v in langs], object)
    columns, pairs = [], []
    if len(families) > 1:
        for f in families:
            columns.append(linear_svm(x, np.where(fam == f, 1, -1)))
    for own in members:
        mine = []
        for a, b in combinations(range(len(own)), 2):
            rows = (of == own[a]) | (of == own[b])
            mine.append((a, b, len(columns)))
            columns.append(linear_svm(x[rows], np.where(of[rows] == own[a], 1, -1)))
        pairs.append(mine)
    weights = np.stack(columns, axis=1) if columns else np.zeros(((1 << BITS) + 1, 0))
    weights[:-1] *= scale
    weights = np.concatenate((weights, np.stack([np.append(w, 0) for w, _ in likes], axis=1)), axis=1)
    return Model(families, members, pairs, weights.astype(np.float32), np.array([m for _, m in likes]))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Fit on a bounded sample of the documents outside the held-out fold, of every language that they have."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    usable = docs.select(doc_id, "lang", "text").where((fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    short = F.length("text") <= chars
    there = {r["lang"]: (r["short"], r["n"]) for r in usable.groupBy("lang").agg(F.count_if(short).alias("short"), F.count("*").alias("n")).collect()}
    each = min(rows, max(1, 8 * rows // max(1, len(there))))
    bounds = spark.createDataFrame([(lang, share_bound(each, few or n), not few) for lang, (few, n) in there.items()], "lang string, bound long, cut boolean")
    usable = usable.join(F.broadcast(bounds), "lang").where(F.col("cut") | short).withColumn("text", F.when(F.col("cut"), F.substring("text", 1, chars)).otherwise(F.col("text")))
    first = lambda *by: F.row_number().over(Window.partitionBy("lang").orderBy(*by))
    ids = usable.where(share_hash(F.col("doc_id")) < F.col("bound")).select("doc_id", "lang").withColumn("n", first(F.xxhash64("doc_id"), "doc_id")).where(F.col("n") <= each).select("doc_id", "lang").distinct()  # at most `each` ids a language
    sample = usable.join(F.broadcast(ids), ["doc_id", "lang"]).withColumn("n", first("doc_id", "text")).where(F.col("n") <= each).orderBy("doc_id", "lang", "text").select("text", "lang").toArrow()
    return fit(sample.column("text").combine_chunks().cast(pa.string()), sample.column("lang").to_pylist())


def predict(docs: DataFrame, model: Model, *keep) -> DataFrame:
    """(the kept columns, lang_pred, score) of every row."""
    sent = small_batches(ship(docs.sparkSession)).sparkContext.broadcast(model)
    inputs = docs.select(*keep, F.col("text").alias("__text"))
    schema = inputs.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, last in text_chunks(texts):
                part = batch.slice(first, last - first)
                lang, score = sent.value.predict(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], schema.names)

    return inputs.mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs), F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 4) == 2).alias("held_out"))


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of a predicted language, with all their columns; `und` and unsure ones go.

    So null, empty and letterless texts go; very long ones are read whole; repeated rows and null ids stay as they are; ties
    go as in the operator; an empty table stays empty. Columns keep their names, whatever they are.
    """
    sent = small_batches(ship(spark)).sparkContext.broadcast(train(docs))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for first, last in text_chunks(batch.column(at)):
                part = batch.slice(first, last - first)
                lang, score = sent.value.predict(part.column(at))
                yield part.filter(pa.array((lang != UNKNOWN) & (score >= LEAST_SCORE)))

    return docs.mapInArrow(run, docs.schema)
