"""Severity of toxic language by a cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - cut_k): all grades share the weights w, and the cuts rise. The
features x are log(1 + count) of marked words and word beginnings: those whose odds among toxic
labelled texts differ most (by z-score) from their odds among the others. Words are runs of
letters, digits and non-ASCII characters, A-Z lower-cased; beginnings are their first 6, 7 or 8
bytes. Both are named by 64-bit digests.

The model is fitted on the driver to at most `sample` labelled rows (by digest of their id, so that
each run takes the same) and `features` words; scoring covers every row. Labels without a
document, null labels and null ids are left out; several labels of one id count as the highest. With
labels of one kind only, or none, the model gives that kind's grade to all. Null and empty texts
have no features. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.llm.common import FlatWords, if_small, mix, slices
from tallymill.session import durable

SAMPLE = 4_000
FEATURES = 1_024
MIN_TEXTS = 3
BEGINNINGS = (6, 7, 8)
PENALTY = 5e-4
STEPS = 600
# `is_toxic` where P(grade > 0) is above this.
THRESHOLD = 0.4


@dataclass(frozen=True)
class Model:
    words: np.ndarray    # sorted digests (as signed 64 bits)
    weights: np.ndarray
    cuts: np.ndarray     # rising

    def value(self, text: np.ndarray, word: np.ndarray, n_texts: int) -> np.ndarray:
        """w . x of each text."""
        if not len(self.words):
            return np.zeros(n_texts)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        known = self.words[at] == word
        cells, n = np.unique(text[known] * len(self.words) + at[known], return_counts=True)
        return np.bincount(cells // len(self.words), np.log1p(n) * self.weights[cells % len(self.words)],
                           n_texts)

    def above(self, value: np.ndarray) -> np.ndarray:
        """P(grade > k) in column k."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - value[:, None], -60, 60)))


def _word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, digest, how often) of the distinct words and beginnings of each text."""
    text, word = _features(texts)
    order = np.lexsort((word, text))
    text, word = text[order], word[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1])
    heads = np.flatnonzero(new)
    return text[heads], word[heads], np.diff(np.append(heads, len(text)))


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of every word and every beginning of a longer word."""
    words = FlatWords(texts, punctuation=True)
    whose, size = words.text_of_word(), words.end - words.start
    parts = [(whose, words.hashes())]
    for limit in BEGINNINGS:
        longer = size > limit
        parts.append((whose[longer], mix(words.hashes(limit=limit)[longer])))
    text, word = (np.concatenate(x) for x in zip(*parts))
    return text, word.view(np.int64)


def labelled_words(docs: DataFrame, labels: DataFrame, label: str = "toxic",
                   sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """The sampled (doc_id, label), and (doc_id, label, word, n) of their texts, both written."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(
        "doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = durable(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    schema = "doc_id long, label int, word long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text, word, n = _word_counts(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(text)), part.column("label").take(
                        pa.array(text)), pa.array(word), pa.array(n)], ["doc_id", "label", "word", "n"])

    rows = docs.select("doc_id", "text").join(if_small(chosen), "doc_id").select(
        F.col("doc_id").cast("long"), "label", "text")
    return chosen, durable(rows.mapInArrow(run, schema))


def marked_words(rows: DataFrame, n_toxic: int, n_other: int, features: int = FEATURES) -> DataFrame:
    """The `features` words with the greatest z-score of the log-odds ratio."""
    counts = rows.groupBy("word").agg(
        F.sum((F.col("label") > 0).cast("long")).alias("t"), F.count(F.lit(1)).alias("all"))
    t, c = F.col("t") + 0.5, F.col("all") - F.col("t") + 0.5
    rest_t, rest_c = F.greatest(n_toxic + 1 - t, F.lit(0.5)), F.greatest(n_other + 1 - c, F.lit(0.5))
    odds = F.log(t / rest_t) - F.log(c / rest_c)
    z = odds / F.sqrt(1 / t + 1 / rest_t + 1 / c + 1 / rest_c)
    return counts.where(F.col("all") >= MIN_TEXTS).select("word", odds.alias("odds"), z.alias("z")) \
        .orderBy(F.abs("z").desc(), "word").limit(features)


def fit_grades(x: np.ndarray, grade: np.ndarray, penalty: float = PENALTY,
               steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts of greatest likelihood under a squared penalty (Adam, from zero)."""
    kinds = int(grade.max())
    rate = np.array([np.clip((grade > k).mean(), 1e-3, 1 - 1e-3) for k in range(kinds)])
    cuts = np.log((1 - rate) / rate)
    gaps = np.log(np.maximum(np.diff(cuts), 1e-2))
    values = np.concatenate([np.zeros(x.shape[1]), cuts[:1], gaps])
    speed, size = np.zeros_like(values), np.zeros_like(values)
    n, width = len(grade), x.shape[1]
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, cuts = values[:width], _cuts(values[width:])
        above = 1 / (1 + np.exp(np.clip(cuts[None, :] - (x @ w)[:, None], -60, 60)))
        edge = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        slope = np.hstack([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))])
        mass = np.maximum(edge[rows, grade] - edge[rows, grade + 1], 1e-12)
        push = (slope[rows, grade] - slope[rows, grade + 1]) / mass
        to_cut = np.zeros((n, kinds + 2))
        to_cut[rows, grade] -= slope[rows, grade] / mass
        to_cut[rows, grade + 1] += slope[rows, grade + 1] / mass
        by_cut = to_cut[:, 1:-1].mean(0)
        rest = np.cumsum(by_cut[::-1])[::-1]  # a gap moves its own cut and all above
        gradient = np.concatenate([x.T @ push / n - penalty * w, rest[:1],
                                   rest[1:] * np.exp(values[width + 1:])])
        speed = 0.9 * speed + 0.1 * gradient
        size = 0.999 * size + 0.001 * gradient ** 2
        values += 0.05 * (speed / (1 - 0.9 ** step)) / (np.sqrt(size / (1 - 0.999 ** step)) + 1e-8)
    return values[:width], _cuts(values[width:])


def _cuts(values: np.ndarray) -> np.ndarray:
    return values[0] + np.concatenate([[0.0], np.cumsum(np.exp(values[1:]))])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE,
        features: int = FEATURES) -> Model:
    """A model of the grades 0 (label 0), 1 and 2.

    Labels that only say toxic or not get their severity from the texts: of the toxic ones, those
    with more marked toxic words than the median are grade 2. Labels above 1 are grades already.
    """
    chosen, rows = labelled_words(docs, labels, label, sample)
    labelled = rows.select("doc_id", "label").distinct().toPandas()
    n_toxic = int((labelled["label"] > 0).sum())
    if n_toxic in (0, len(labelled)):
        top = int(labelled["label"].min()) if len(labelled) else 0
        return Model(np.zeros(0, np.int64), np.zeros(0), np.array([-60.0] * top + [60.0]))
    marked = marked_words(rows, n_toxic, len(labelled) - n_toxic, features).toPandas()
    marked = marked.sort_values("word")
    words = marked["word"].to_numpy(np.int64)
    held = rows.join(F.broadcast(rows.sparkSession.createDataFrame(
        [(int(x),) for x in words], "word long")), "word").select("doc_id", "word", "n").toPandas()
    labelled = labelled.sort_values("doc_id").reset_index(drop=True)
    at = np.searchsorted(labelled["doc_id"], held["doc_id"])
    column = np.searchsorted(words, held["word"])
    x = np.zeros((len(labelled), len(words)), np.float32)
    x[at, column] = np.log1p(held["n"])
    grade = labelled["label"].to_numpy(np.int64)
    if grade.max() == 1:
        bad = (marked["z"].to_numpy() > 3)[column]
        uses = np.bincount(at[bad], held["n"].to_numpy()[bad], len(labelled))
        grade = grade + ((grade > 0) & (uses > np.median(uses[grade > 0])))
    weights, cuts = fit_grades(x, grade)
    return Model(words, weights, cuts)


def score(docs: DataFrame, model: Model, key: str = "doc_id",
          threshold: float = THRESHOLD) -> DataFrame:
    """`key`, the expected grade `severity`, and `is_toxic`."""
    schema = T.StructType([docs.schema[key], T.StructField("severity", T.DoubleType()),
                           T.StructField("is_toxic", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                above = model.above(model.value(*_features(part.column("text")), part.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(above.sum(1)), pa.array(above[:, 0] > threshold)],
                    [key, "severity", "is_toxic"])

    return docs.select(key, "text").mapInArrow(run, schema)
