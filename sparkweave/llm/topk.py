"""Exact top-k search by inner product: columnar branch and bound.

Vectors are turned into whole numbers and laid out by dimension. For a query and a chunk of candidates
the score is added up one block of dimensions after another; after each block, candidates go whose score
so far plus the most that the remaining dimensions can add (Cauchy-Schwarz on the remaining norms) stays
below the query's threshold, and the survivors are compacted. The threshold starts at the k-th best score
within a bounded sample of the candidates, and rises as a task finds better ones.

Queries are taken in blocks of bounded size, one pass over the candidates each; only a block's queries
travel to the executors. Each task sends at most k rows a query, none below the threshold.

Defined cases: vectors that are null or hold a null or a non-finite component take no part, nor do rows
with a null id. Missing components at the end count as zero. Of rows with equal id as a query, the
greatest vector is the query; none of them are its candidates. Repeated candidate rows each count.
Scores beyond 64 bits end at the greatest or smallest value that fits.
Ties go to the smaller id. Very long vectors are read whole, block by block. Without candidates or queries
there are no rows. Columns other than the id and the vector are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.llm.common import pick, table

#: Components beyond this can't be added up exactly in doubles; such chunks use Python's integers.
_EXACT = float(1 << 53)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def whole(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floor(scale * x) as doubles, one row a vector; short vectors are filled up with zeros."""
    ids, vectors = batch.column("vec_id"), batch.column("vector")
    vectors = vectors.filter(ids.is_valid())
    ids = ids.filter(ids.is_valid())
    lengths = np.asarray(pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False), np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return ids.to_numpy(zero_copy_only=False).astype(np.int64), np.floor(out * scale)


def usable(df: DataFrame) -> DataFrame:
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad)


def _widen(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


class Search:
    """Keeps the k best of what it has seen for each query."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, block: int, floor: np.ndarray | None = None):
        self.ids, self.queries, self.k, self.block = ids, queries, k, block
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.best_ids = [np.zeros(0, np.int64)] * len(ids)
        self.best = [np.zeros(0, np.float64)] * len(ids)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        width = max(vectors.shape[1], self.queries.shape[1])
        columns, queries = np.ascontiguousarray(_widen(vectors, width).T), _widen(self.queries, width)
        top = np.abs(columns).max(initial=0) * np.abs(queries).max(initial=0) * max(1, width)
        if top >= _EXACT:
            return self._add_large(ids, columns, queries)
        cuts = list(range(0, width, self.block)) or [0]
        rest = [np.sqrt((columns[c:] ** 2).sum(0)) for c in cuts[1:]]
        for q, query in enumerate(queries):
            alive = np.flatnonzero(ids != self.ids[q])
            score = np.zeros(len(alive))
            for n, c in enumerate(cuts):
                part = columns[c : c + self.block]
                score = score + query[c : c + self.block] @ (part if len(alive) == part.shape[1] else part[:, alive])
                if n < len(rest):
                    left = np.sqrt((query[cuts[n + 1] :] ** 2).sum())
                    keep = score + rest[n][alive] * left * (1 + 1e-9) >= self.floor[q]
                else:
                    keep = score >= self.floor[q]
                if not keep.all():
                    alive, score = alive[keep], score[keep]
                if not len(alive):
                    break
            if len(alive):
                self._merge(q, ids[alive], score)

    def _add_large(self, ids: np.ndarray, columns: np.ndarray, queries: np.ndarray) -> None:
        exact = [[int(x) for x in v] for v in columns.T]
        for q, query in enumerate(queries):
            whole_query = [int(x) for x in query]
            score = [min(_HIGH, max(_LOW, sum(a * b for a, b in zip(whole_query, v, strict=True)))) for v in exact]
            other = ids != self.ids[q]
            self._merge(q, ids[other], np.array(score, object)[other])

    def _merge(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        ids, score = np.concatenate([self.best_ids[q], ids]), np.concatenate([self.best[q], score])
        if len(ids) > 4 * self.k and score.dtype != object:  # the k-th best, ties with it included
            keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            ids, score = ids[keep], score[keep]
        order = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[: self.k] if score.dtype == object else np.lexsort((ids, -score))[: self.k]
        self.best_ids[q], self.best[q] = ids[order], score[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], float(score[order[-1]]) if score.dtype != object else -np.inf)


def _blocks(df: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The query vectors, about ``size`` at a time."""
    n = df.count()
    parts = -(-n // size)
    for i in range(parts):
        rows = df.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == i).groupBy("vec_id").agg(F.max("vector").alias("vector")).orderBy("vec_id")
        yield rows.toArrow().combine_chunks()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, block: int = 16, query_block: int = 8192, sample: int = 4096, chunk: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query.

    ``query_block`` queries at most (give or take the spread of a hash) are in memory at a time.
    ``sample`` candidates give the first thresholds; they only speed things up.
    """
    spark = vectors.sparkSession
    candidates = usable(pick(vectors, vec_id=id_col, vector=vector_col).select("vec_id", F.col("vector").cast("array<double>").alias("vector")))
    wanted = usable(pick(queries, vec_id=id_col, vector=vector_col).select("vec_id", F.col("vector").cast("array<double>").alias("vector")))
    schema = "query_id bigint, vec_id bigint, score bigint"
    first = candidates.limit(sample).toArrow().combine_chunks()
    parts = []
    for rows in _blocks(wanted, query_block):
        if not rows.num_rows:
            continue
        ids, matrix = whole(rows.to_batches()[0], scale)
        seed = Search(ids, matrix, k, block)
        for b in first.to_batches(max_chunksize=chunk):
            seed.add(*whole(b, scale))
        shipped = spark.sparkContext.broadcast((ids, matrix, seed.floor))
        parts.append(candidates.mapInArrow(_searcher(shipped, k, block, scale, chunk), schema))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(shipped, k: int, block: int, scale: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, floor = shipped.value
        search = Search(ids, matrix, k, block, floor.copy())
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                search.add(*whole(batch.slice(at, chunk), scale))
        counts = [len(x) for x in search.best_ids]
        scores = [int(s) for b in search.best for s in b]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.concatenate([np.zeros(0, np.int64), *search.best_ids])), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

    return run


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP3_SQL = """
WITH c AS (
  SELECT vec_id, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM c q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY 1, 2
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""
