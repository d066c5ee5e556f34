"""What the operators of this subpackage share: scratch tables and column picking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators.scratch import Scratch

#: Hashes by which samples are drawn lie below this.
HASH_RANGE = 1 << 62


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, deleted when the driver's JVM ends."""
    return Scratch(spark).path


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet under a shared folder and read it again: cuts lineage, runs it once."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so that further or clashing ones do no harm."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def sampled(key: Column, rows: int, of: int, salt: str = "sample") -> Column:
    """Whether a row is in a sample of about ``rows`` of ``of`` rows, by 62 bits of a hash of ``key``: the choice repeats."""
    if rows >= of:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(HASH_RANGE)) < F.lit(rows * HASH_RANGE // of)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, label: str) -> DataFrame:
    """About ``max_rows`` of the rows of ``docs`` (doc_id, text, ...) that have labels, with the labels.

    Rows are chosen by a hash of doc_id. Of each value of ``label`` (there are few) at least a tenth of its even
    share is taken if there are so many, so that rare ones are learned too. The labels kept are bounded by twice
    ``max_rows`` (give or take the spread of a hash), which makes their broadcast safe. Labels with a null or
    repeated doc_id count once. Raises if there are labels but none is drawn.
    """
    labels = labels.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    counts = {r[label]: r["count"] for r in labels.groupBy(label).count().collect()}
    total = sum(counts.values())
    if total > max_rows:
        least = max(1, max_rows // (10 * len(counts)))
        wanted = F.lit(False)
        for value, n in counts.items():
            share = max(max_rows * n // total, min(n, least))
            wanted = wanted | (F.col(label).eqNullSafe(F.lit(value)) & sampled(F.col("doc_id"), share, n))
        labels = labels.where(wanted)
        if labels.isEmpty():
            raise ValueError(f"none of {total} labelled rows was drawn")
    return docs.join(F.broadcast(labels), "doc_id")
