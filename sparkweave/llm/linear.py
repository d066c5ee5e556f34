"""Hashed features of texts, and what linear models on them share.

A feature is a number below 2 ** bits; a text has each feature at most once, with a value. Models are
arrays of that length: their size does not depend on the data, so they may be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkweave.llm import textvec

#: texts, and whether a feature is wanted (None: all) -> text number, feature, value; by text
Extract = Callable[[list[str], "np.ndarray | None"], tuple[np.ndarray, np.ndarray, np.ndarray]]


def count_features(df: DataFrame, extract: Extract, size: int, label: str, tasks: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """In how many rows of a bounded sample ``df`` each feature stands, and the sum of ``label`` over them.

    The sample goes to ``tasks`` tasks, each of which sends two arrays as long as there are features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, marked = np.zeros(size, "<f4"), np.zeros(size, "<f4")
        for batch in textvec.portions(batches):
            labels = batch.column(label).to_numpy()
            for start, group in textvec.groups([t or "" for t in batch.column("text").to_pylist()]):
                number, feature, _ = extract(group, None)
                total += np.bincount(feature, minlength=size)
                marked += np.bincount(feature, labels[start + number], size)
        yield pa.RecordBatch.from_pydict({"total": [total.tobytes()], "marked": [marked.tobytes()]})

    rows = df.select("text", label).repartition(tasks).mapInArrow(run, "total binary, marked binary").collect()
    return tuple(np.sum([np.zeros(size), *(np.frombuffer(r[c], "<f4") for r in rows)], 0) for c in ("total", "marked"))


def collect_rows(df: DataFrame, extract: Extract, others: str, wanted: np.ndarray | None = None) -> tuple[list, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The other columns of a bounded sample ``df`` with a text, and the (wanted) features of all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.portions(batches):
            ids, values = [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for _, group in textvec.groups(texts):
                number, feature, value = extract(group, wanted)
                cuts = np.searchsorted(number, np.arange(len(group) + 1))
                ids += [feature[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])]
                values += [value[a:b].astype("<f2").tobytes() for a, b in zip(cuts, cuts[1:])]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], [*names, "features", "amounts"])

    names = [x.split()[0] for x in others.split(",")]
    rows = df.select(*names, "text").mapInArrow(run, f"{others}, features binary, amounts binary").collect()
    rows.sort(key=lambda r: tuple((x is None, x) for x in r[: len(names)]))
    ids = [np.frombuffer(r["features"], "<u4") for r in rows]
    number = np.repeat(np.arange(len(rows)), [len(x) for x in ids])
    feature = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int64)
    value = np.concatenate([*(np.frombuffer(r["amounts"], "<f2") for r in rows), np.zeros(0, "<f2")]).astype(np.float32)
    return rows, (number, feature, value)


def scored(batches: Iterator[pa.RecordBatch], extract: Extract, weights: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with the weighted sum of the features of its texts."""
    wanted = weights != 0
    for batch in textvec.portions(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        out = np.zeros(len(texts))
        for start, group in textvec.groups(texts):
            number, feature, value = extract(group, wanted)
            out[start : start + len(group)] = np.bincount(number, weights[feature] * value, len(group))
        yield batch, out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def adam(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Minimise by Adam with full gradients."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def surprising(counts: np.ndarray, total: np.ndarray, share: float, least: float, min_count: int) -> np.ndarray:
    """Features whose count within a class is ``least`` standard deviations off what its share of all rows predicts."""
    expected = total * share
    return (total >= min_count) & (np.abs(counts - expected) >= least * np.sqrt(np.maximum(expected * (1 - share), 1e-9)))
