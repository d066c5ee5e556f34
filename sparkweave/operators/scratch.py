"""Tables that cut a loop's lineage, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session on one machine that leaves it unset gets a temporary folder, set once."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sparkweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """A new folder under ``spark.checkpoint.dir``, deleted when the JVM ends; tables can go earlier by ``drop``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.paths, self.names = spark, 0, {}, {}
        self.path = f"{shared_root(spark)}/sparkweave-{uuid.uuid4().hex}"
        folder, fs = self._at(self.path)
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)

    def _at(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` written out and read again."""
        self.made += 1
        path = f"{self.path}/{self.made}"
        df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    __call__ = cut

    def bucketed(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """``df`` written out in ``buckets`` files by the hash of ``key`` and read again.

        Joins and groups on the key then read it as it lies, without another shuffle of it. The table is known to
        the catalog by a name of its own until ``drop``.
        """
        self.made += 1
        path, name = f"{self.path}/{self.made}", f"sparkweave_{uuid.uuid4().hex}"
        dealt = df.repartition(buckets, key)
        dealt.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
        # the shuffle behind the write holds as much again, until the driver's JVM finds that nothing refers to it
        self.spark.sparkContext._jvm.System.gc()
        out = df.sparkSession.table(name)
        self.paths[id(out)] = (out, path)
        self.names[id(out)] = name
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete the table that ``cut`` returned as ``df``; nothing may read it afterwards."""
        if id(df) in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS `{self.names.pop(id(df))}`")
        if id(df) in self.paths:
            folder, fs = self._at(self.paths.pop(id(df))[1])
            fs.delete(folder, True)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n numbers whose hashes fall into n different ones of n buckets, so that rows dealt under them are dealt evenly."""
    found: dict[int, int] = {}
    start, step = 0, 32 * n
    while len(found) < n:
        place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
        for row in spark.range(start, start + step).groupBy(place.alias("place")).agg(F.min("id").alias("id")).collect():
            found.setdefault(row["place"], row["id"])
        start += step
    return [found[i] for i in range(n)]
