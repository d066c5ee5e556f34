"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0 to K - 1 share one vector of weights on hashed features of the text; K - 1 ordered thresholds
cut its score: P(grade >= k) = sigmoid(score - threshold_k). The model gives the expected grade and the
tail probability P(grade >= k) that selection uses.

Features: shapes of words (case, digits, signs), pairs of neighbouring shapes, immediate repeats, and the
words themselves, each with the square root of its share of the text's words as value. Fitted on a
bounded sample of labelled rows (``max_train_rows``, chosen by a hash of doc_id).

Defined cases: a null text, or one without words, has no feature and gets the thresholds' own
probabilities. A very long text is read whole; its arrays are the only ones that grow with it. Rows with a
null grade teach nothing. Without labelled rows, or with one grade only, every text gets the highest tail
probability that the rows support (1 if there are none), so nothing is dropped. Repeated rows and ties are
judged one by one; null ids are kept. An empty table gives no rows. Only the id and the text are read, under
names of their own; ``select_quality`` hands all other columns on, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import linear, textvec
from sparkweave.llm.common import labelled_sample, pick, table

BITS = 18


def _classes() -> np.ndarray:
    """Class of each code point up to 0xFFFF: 0 space, 1 capital, 2 other letter, 3 digit, else itself."""
    chars = [chr(i) for i in range(1 << 16)]
    return np.array([0 if c.isspace() else 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else i + 16 for i, c in enumerate(chars)], np.uint64)


class ShapeFeatures:
    """Call with texts and wanted features; made once a task."""

    def __init__(self):
        self.classes = None

    def __call__(self, texts: list[str], wanted: np.ndarray | None):
        if self.classes is None:
            self.classes = _classes()
        codes, starts = textvec.code_points(texts)
        kind = self.classes[np.minimum(codes, 0xFFFF)]
        kind = np.where((kind == 0) | (codes == 0), np.uint64(0), kind)
        inside = kind != 0
        first = inside & ~np.concatenate([[False], inside[:-1]])
        begins = np.flatnonzero(first)
        if not len(begins):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        text = np.searchsorted(starts, begins, "right") - 1
        word_of = np.cumsum(first)[inside] - 1
        lengths = np.bincount(word_of)
        words = textvec.stretch_hashes(codes[inside].astype(np.uint64), lengths)
        changed = inside & (first | (kind != np.concatenate([[np.uint64(0)], kind[:-1]])))
        shapes = textvec.stretch_hashes(kind[changed], np.bincount((np.cumsum(first) - 1)[changed], minlength=len(lengths)))
        follows = np.concatenate([[False], text[1:] == text[:-1]])
        repeats = follows & (words == np.concatenate([words[:1], words[:-1]]))
        pairs = textvec.mix(shapes * textvec.BASE + np.concatenate([shapes[:1], shapes[:-1]]))
        salt = [np.uint64(x) for x in (1, 2, 3, 4)]
        hashes = [textvec.mix(shapes + salt[0]), textvec.mix(pairs + salt[1])[follows], np.full(repeats.sum(), textvec.mix(salt[2:3])[0]), textvec.mix(words + salt[3])]
        owner = np.concatenate([text, text[follows], text[repeats], text])
        feature = np.concatenate(hashes) >> np.uint64(64 - BITS)
        if wanted is not None:
            owner, feature = owner[wanted[feature]], feature[wanted[feature]]
        keys = np.sort((owner.astype(np.uint64) << np.uint64(BITS)) | feature)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(at, len(keys)))
        number = (keys[at] >> np.uint64(BITS)).astype(np.int64)
        total = np.bincount(text, minlength=len(texts))
        return number, (keys[at] & np.uint64((1 << BITS) - 1)).astype(np.int64), np.sqrt(counts / total[number]).astype(np.float32)


def fit(sample: DataFrame, grades: int, steps: int = 300, rate: float = 0.05, ridge: float = 0.2, least: float = 4.0, min_count: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and ascending thresholds, from text, grade (0 to grades - 1)."""
    rows, (number, feature, value) = linear.collect_rows(sample, ShapeFeatures(), "grade int")
    y = np.array([int(r["grade"]) for r in rows], np.int64)
    size = 1 << BITS
    tails = np.array([(y >= k).mean() if len(y) else 1.0 for k in range(1, grades)])
    logit = np.clip(np.log(np.maximum(tails, 1e-6) / np.maximum(1 - tails, 1e-6)), -14, 14)
    if len(y) == 0 or len(set(y.tolist())) < 2:
        return np.zeros(size), -logit
    total, chosen = np.bincount(feature, minlength=size), np.zeros(size, bool)
    for k in range(1, grades):
        if 0 < tails[k - 1] < 1:
            # how much of the feature, not only whether: the sum of its values against what chance predicts
            chosen |= linear.surprising(np.bincount(feature, (y >= k)[number], size), total, tails[k - 1], least, min_count)
            amount, square = np.bincount(feature, value, size), np.bincount(feature, value**2, size)
            within = np.bincount(feature, value * (y >= k)[number], size)
            chosen |= (total >= min_count) & (np.abs(within - amount * tails[k - 1]) >= least * np.sqrt(square * tails[k - 1] * (1 - tails[k - 1]) + 1e-9))
    columns = np.flatnonzero(chosen)
    place = np.full(size, -1)
    place[columns] = np.arange(len(columns))
    used = place[feature] >= 0
    number, column, value = number[used], place[feature[used]], value[used].astype(float)
    n, m = len(columns), grades - 1

    def thresholds(x):  # the first, then steps upwards
        return np.cumsum(np.append(x[n], np.exp(x[n + 1 :])))

    def gradient(x):
        score, cuts = np.bincount(number, value * x[column], len(y)), thresholds(x)
        reach = linear.sigmoid(score[:, None] - cuts)  # P(grade >= k)
        upper, lower = np.hstack([np.ones((len(y), 1)), reach]), np.hstack([reach, np.zeros((len(y), 1))])
        row = np.arange(len(y))
        p = np.maximum(upper[row, y] - lower[row, y], 1e-9)
        slope = reach * (1 - reach)
        d = np.zeros((len(y), m))  # of -log p by (score - cut)
        has = y > 0
        d[row[has], y[has] - 1] -= slope[row[has], y[has] - 1] / p[has]
        has = y < m
        d[row[has], y[has]] += slope[row[has], y[has]] / p[has]
        by_score, by_cut = d.sum(1), -d.sum(0)
        tail = np.cumsum(by_cut[::-1])[::-1]
        return np.concatenate([np.bincount(column, value * by_score[number], n) + ridge * x[:n], tail[:1], tail[1:] * np.exp(x[n + 1 :])])

    start = np.concatenate([np.zeros(n), [-logit[0]], np.log(np.maximum(np.diff(-logit), 1e-3))])
    x = linear.adam(gradient, start, steps, rate)
    weights = np.zeros(size)
    weights[columns] = x[:n]
    return weights, thresholds(x)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, expected_grade and tails (P(grade >= 1), ...) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = shipped.value
        for batch, total in linear.scored(batches, ShapeFeatures(), weights):
            tails = linear.sigmoid(total[:, None] - cuts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tails.sum(1)), pa.array(list(tails), pa.list_(pa.float64()))], ["doc_id", "expected_grade", "tails"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, expected_grade double, tails array<double>")


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 bad, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    return labels.select("doc_id", grade.alias("grade"))


def fit_ratings(docs: DataFrame, graded: DataFrame, grades: int = 3, max_train_rows: int = 8000) -> tuple[np.ndarray, np.ndarray]:
    graded = graded.where(F.col("grade").between(0, grades - 1))
    return fit(labelled_sample(docs.select("doc_id", "text"), graded, max_train_rows, "grade").select("text", "grade"), grades)


def rate_quality(docs: DataFrame, graded: DataFrame, grades: int = 3, max_train_rows: int = 8000, at_least: int = 1, least_tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail (probability of grade ``at_least`` or more), selected of every row."""
    docs = pick(docs, doc_id=id_col, text=text_col)
    out = score(docs, fit_ratings(docs, graded, grades, max_train_rows))
    tail = F.element_at("tails", at_least)
    return out.select("doc_id", "expected_grade", tail.alias("tail"), (tail >= least_tail).alias("selected"))


def select_quality(docs: DataFrame, graded: DataFrame, grades: int = 3, max_train_rows: int = 8000, at_least: int = 1, least_tail: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns) whose tail probability suffices."""
    shipped = docs.sparkSession.sparkContext.broadcast(fit_ratings(docs, graded, grades, max_train_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = shipped.value
        for batch, total in linear.scored(batches, ShapeFeatures(), weights):
            yield batch.filter(pa.array(linear.sigmoid(total - cuts[at_least - 1]) >= least_tail))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_quality(table(spark, sf_dir, "documents"), ratings(table(spark, sf_dir, "labels")))
