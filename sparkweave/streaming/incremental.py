"""Change-driven indexing: files that arrive in a folder are folded into graph tables batch by batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkweave.operators.graph import last_wins
from sparkweave.sources.extraction import RAW, extract

FILES = "path string, content string, version bigint"


def index_batch(batch: DataFrame, raw_path: str, epoch: int) -> None:
    """Append the raw rows of a batch of files, marked with its epoch; of a file only its newest version is read.

    A batch that runs again writes over its own folder, so that a restart doesn't count it twice.
    """
    files = last_wins(batch.select("path", "content", "version"), ["path"], "version")
    rows = extract(files).unionByName(files.select("path", F.lit("file").alias("kind")), True)
    rows.select(*(F.col(c.split()[0]) for c in RAW.split(", "))).write.mode("overwrite").parquet(f"{raw_path}/epoch={epoch}")


def current_rows(spark: SparkSession, raw_path: str) -> DataFrame:
    """Raw rows of the newest version of each file."""
    try:
        rows = spark.read.schema(f"{RAW}, epoch bigint").parquet(raw_path)
    except AnalysisException:
        return spark.createDataFrame([], RAW)
    newest = rows.where("kind = 'file'").groupBy("path").agg(F.max("epoch").alias("epoch"))
    return rows.join(newest, ["path", "epoch"]).where("kind <> 'file'").drop("epoch").select(*(c.split()[0] for c in RAW.split(", ")))


def watch(spark: SparkSession, folder: str, raw_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Index JSON files of (path, content, version) rows as they arrive in ``folder``."""
    stream = spark.readStream.schema(FILES).json(folder)
    writer = stream.writeStream.foreachBatch(lambda batch, epoch: index_batch(batch, raw_path, epoch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def progress(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Newest percent of each key of a stream (key, at, percent), never falling: complete-mode state is one row a key."""
    return events.groupBy("key").agg(F.max("percent").alias("percent"), F.max("at").alias("at"))
