"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

The features of a text are the character n-grams it holds (each counts once), of its lower-cased words
with a space before and after. Each is scaled by the log ratio of its smoothed rates in toxic and other
texts; a logistic regression on the scaled features gives the score. Features as frequent in one class as
chance would have it are left out, which keeps long clean texts from adding up noise.

Fitted on a bounded sample of labelled rows (``max_train_rows``, chosen by a hash of doc_id).

Defined cases: a null or empty text holds no feature and gets the score of the intercept alone; a very long
text is read whole. Without labelled rows, or with one class only, the score is the share of toxic rows (0
without rows). Repeated rows and ties are scored one by one; a null id is scored, and counts as not held out.
An empty table gives no rows. Columns other than the id and the text (of documents), the id and the label
(of labels) are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import linear, textvec
from sparkweave.llm.common import labelled_sample, materialize, pick, shared_dir, table

BITS = 18
SIZES = (3, 4, 5)


def ngram_features(texts: list[str], wanted: np.ndarray | None):
    codes, starts = textvec.code_points([f" {' '.join(t.lower().split())} " for t in texts])
    text = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(starts))
    # distance to the zero behind each text, so that no n-gram crosses it
    room = starts[1:].repeat(np.diff(starts)) - 1 - np.arange(len(codes))
    pairs = []
    for n in SIZES:
        h = textvec.char_ngrams(codes, n, BITS)
        inside = room[: len(h)] >= n
        if wanted is not None:
            inside &= wanted[h]
        pairs.append((text[: len(h)][inside] << np.uint64(BITS)) | h[inside])
    pairs = textvec.distinct(np.concatenate(pairs))
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64), np.ones(len(pairs), np.float32)


def fit(sample: DataFrame, steps: int = 150, rate: float = 0.05, ridge: float = 2.0, least: float = 4.0, min_count: int = 3) -> tuple[np.ndarray, float]:
    """Weights of the features (log-count ratio times coefficient) and intercept, from text, toxic.

    The sample is read three times; only counts and the chosen features of its rows are collected.
    """
    size = 1 << BITS
    total, toxic = linear.count_features(sample, ngram_features, size, "toxic")
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = positive / max(1, n)
    if not 0 < share < 1:
        return np.zeros(size), -50.0 if share == 0 else 50.0
    ratio = np.log((toxic + 1) / (positive + 2)) - np.log((total - toxic + 1) / (n - positive + 2))
    ratio[~linear.surprising(toxic, total, share, least, min_count)] = 0
    chosen = np.flatnonzero(ratio)
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    rows, (number, feature, _) = linear.collect_rows(sample, ngram_features, "toxic int", ratio != 0)
    y, column = np.array([float(r["toxic"]) for r in rows]), place[feature]
    x = ratio[chosen][column]

    def gradient(w):
        off = linear.sigmoid(np.bincount(number, x * w[column], len(y)) + w[-1]) - y
        return np.append(np.bincount(column, x * off[number], len(chosen)) + ridge * w[:-1], off.sum())

    w = linear.adam(gradient, np.append(np.zeros(len(chosen)), np.log(share / (1 - share))), steps, rate)
    weights = np.zeros(size)
    weights[chosen] = ratio[chosen] * w[:-1]
    return weights, float(w[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = shipped.value
        for batch, total in linear.scored(batches, ngram_features, weights):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(linear.sigmoid(total + intercept))], ["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify_toxicity(docs: DataFrame, labels: DataFrame, held_out: F.Column | None = None, max_train_rows: int = 8000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; rows where ``held_out`` is true teach nothing."""
    docs = pick(docs, doc_id=id_col, text=text_col)
    aside = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    taught = pick(labels, doc_id=id_col, toxic=label_col).where(F.col("toxic").isin(0, 1) & ~aside).withColumn("toxic", F.col("toxic").cast("int"))
    sample = labelled_sample(docs, taught, max_train_rows, "toxic").select("text", "toxic")
    model = fit(materialize(sample, f"{shared_dir(docs.sparkSession)}/sample"))
    return score(docs, model).select("doc_id", aside.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)
