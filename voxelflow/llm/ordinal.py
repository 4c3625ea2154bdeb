"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade < k) = sigmoid(threshold_k - w . x): one weight vector over hashed features of the text is
shared by all grades, ordered thresholds part them. Features are the lower-cased words, their first
letters and shapes (runs of letters and digits made one), and how long and how varied the text is, hashed to a bounded number of weights. The model
gives each document an expected grade and the probability of the best grade, by which documents
are selected.

The fit reads at most ``max_labelled`` labelled documents, those with the smallest hash of doc_id;
that and the number of weights bound what the driver holds. Scoring reads every document whole.

Defined cases: null and empty texts have no features and get the grade that the thresholds alone
give; labels without a document and documents without a label are not fitted on; repeated label
rows count once, by their mean, repeated documents by their smallest text; with fewer than two grades in the sample all documents get the
same score and are kept; a null doc_id is scored; columns beside those named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_words

BITS = 20
MAX_LABELLED = 8000
ROUNDS = 400
LEAST_Z = 2.0
PREFIX = 5
SELECT = 0.5
_SHAPES = ((re.compile(r"[^\W\d_a-zà-ÿ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"))


class _Features(dict):
    """Memo of word -> (number of the word, of its shape, of its first letters), forgotten at a fixed size."""

    def __missing__(self, word: str):
        if len(self) > 300_000:
            self.clear()
        shape = word
        for pattern, by in _SHAPES:
            shape = pattern.sub(by, shape)
        mask = (1 << BITS) - 1
        value = self[word] = tuple(xxhash.xxh64_intdigest(x, k) & mask for k, x in ((1, word.lower()), (2, shape), (3, word.lower()[:PREFIX])))
        return value


_memo = _Features()


def features(text: str | None) -> np.ndarray:
    """The numbers of a text's features, each once."""
    words = text_words(text or "")
    different = len(set(words))
    sizes = (f"\x00length {len(words).bit_length()}", f"\x00different {10 * different // max(1, len(words))}", f"\x00lines {10 * len(set(lines := (text or '').split(chr(10)))) // len(lines)}")
    return np.unique(np.array([_memo[w] for w in (*words, *sizes)], np.int64).reshape(-1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """Weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def at_least(self, margin: np.ndarray) -> np.ndarray:
        """[row, k]: P(grade > k)."""
        return 1 - _sigmoid(self.thresholds[None, :] - np.asarray(margin)[:, None])


def telling(grades: np.ndarray, index: list[np.ndarray], levels: int, least: float = LEAST_Z) -> np.ndarray:
    """Features that speak for a lower grade: more frequent at or below some grade than above it, by
    at least ``least`` standard errors of the log odds ratio. Without them a document is taken for good."""
    used, flat = np.unique(np.concatenate(index), return_inverse=True)
    row = np.repeat(np.arange(len(index)), [len(x) for x in index])
    best = np.zeros(len(used))
    for k in range(levels - 1):
        low = grades <= k
        n1, n0 = low.sum() + 1, (~low).sum() + 1
        a = np.bincount(flat, low[row], len(used)) + 0.5
        b = np.bincount(flat, ~low[row], len(used)) + 0.5
        best = np.maximum(best, (np.log(a / (n1 - a)) - np.log(b / (n0 - b))) / np.sqrt(1 / a + 1 / b + 1 / (n1 - a) + 1 / (n0 - b)))
    return used[best >= least]


def fit(grades: np.ndarray, index: list[np.ndarray], levels: int, rounds: int = ROUNDS, rate: float = 1.0, decay: float = 1e-4) -> Ordinal:
    """Maximum likelihood by full-batch adaptive gradient steps."""
    size = 1 << BITS
    if len(set(grades.tolist())) < 2:
        return Ordinal(np.zeros(size, np.float32), np.linspace(-10, -9, levels - 1))
    share = np.array([(grades <= k).mean() for k in range(levels - 1)]).clip(0.01, 0.99)
    thresholds = np.log(share / (1 - share)) + np.arange(levels - 1) * 1e-3
    used = telling(grades, index, levels)
    weights = np.zeros(size, np.float32)
    if not len(used):
        return Ordinal(weights, thresholds)
    flat = np.concatenate(index)
    row = np.repeat(np.arange(len(index)), [len(x) for x in index])
    place = np.minimum(np.searchsorted(used, flat), len(used) - 1)
    kept = used[place] == flat
    flat, row = place[kept], row[kept]
    w, past, past_t = np.zeros(len(used)), np.full(len(used), 1e-8), np.full(levels - 1, 1e-8)
    below, above = np.maximum(grades - 1, 0), np.minimum(grades, levels - 2)
    for _ in range(rounds):
        margin = np.bincount(row, w[flat], len(index))
        a = np.where(grades > 0, _sigmoid(thresholds[below] - margin), 0.0)
        b = np.where(grades < levels - 1, _sigmoid(thresholds[above] - margin), 1.0)
        p = np.maximum(b - a, 1e-9)
        slope = np.bincount(flat, (a + b - 1)[row], len(used)) / len(index) - decay * w
        up = np.bincount(above, np.where(grades < levels - 1, b * (1 - b) / p, 0), levels - 1)
        down = np.bincount(below, np.where(grades > 0, a * (1 - a) / p, 0), levels - 1)
        slope_t = (up - down) / len(index)
        past += slope**2
        past_t += slope_t**2
        w += rate * slope / np.sqrt(past)
        thresholds = np.maximum.accumulate(thresholds + 0.1 * slope_t / np.sqrt(past_t) + np.arange(levels - 1) * 1e-9)
    weights[used] = w
    return Ordinal(weights, thresholds)


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, list]:
    """Grades and features of the labelled sample. labels: doc_id, grade."""
    chosen = labels.groupBy("doc_id").agg(F.round(F.avg("grade")).cast("int").alias("grade")).where("doc_id is not null and grade is not null")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = chosen.join(docs.select(F.col("doc_id").alias("_id"), "text"), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min("text").alias("text"))

    def of(batches):
        for batch in batches:
            found = [features(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.astype("<i4").tobytes() for i in found], pa.binary())], names=["doc_id", "grade", "i"])

    got = sorted(rows.mapInArrow(of, "doc_id long, grade int, i binary").collect(), key=lambda r: r["doc_id"])
    return np.array([r["grade"] for r in got], np.int64), [np.frombuffer(r["i"], "<i4") for r in got]


def classify(docs: DataFrame, labels: DataFrame, levels: int, max_labelled: int = MAX_LABELLED, select: float = SELECT) -> DataFrame:
    """doc_id, expected_grade, top_probability (of the best grade), kept of each row."""
    model = fit(*labelled(docs, labels, max_labelled), levels)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # 2**BITS weights, whatever the corpus

    def of(batches: Iterator[pa.RecordBatch]):
        model = Ordinal(*shared.value)
        for batch in batches:
            margins = []
            for text in batch.column(1).to_pylist():
                margins.append(float(model.weights[features(text)].sum(dtype=np.float64)))
            tail = model.at_least(np.array(margins).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tail.sum(1)), pa.array(tail[:, -1]), pa.array(tail[:, -1] >= select)], names=["doc_id", "expected_grade", "top_probability", "kept"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, expected_grade double, top_probability double, kept boolean")


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 poor, 1 toxic but else good, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


def op5_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), graded(table(spark, sf_dir, "labels")), 3)
