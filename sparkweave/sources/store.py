"""Reviews and settings at rest: append-only Parquet, the last row of a key counts."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators.graph import last_wins
from sparkweave.schema import REVIEWS


class Store:
    """Tables below a folder: reviews, meta, and any DataFrame under a name (nodes, edges, files, findings)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _append(self, table: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}")

    def set_meta(self, key: str, value: str) -> None:
        self._append("meta", [(key, value, datetime.now(timezone.utc).isoformat())], "key string, value string, at string")

    def meta(self) -> DataFrame:
        return last_wins(self._read("meta", "key string, value string, at string"), ["key"], "at")

    def get_meta(self, key: str) -> str | None:
        row = self.meta().where(F.col("key") == key).first()
        return row["value"] if row else None

    def save_review(self, id: str, created_at: str, document: dict, repo_root: str = "", base_ref: str = "", head_ref: str = "") -> None:
        """A review saved again keeps its first facts and takes the new document."""
        saved = datetime.now(timezone.utc).isoformat()
        self._append("reviews", [(id, created_at, repo_root, base_ref, head_ref, json.dumps(document, default=str), saved)], f"{REVIEWS}, saved string")

    def reviews(self) -> DataFrame:
        rows = self._read("reviews", f"{REVIEWS}, saved string")
        first = [F.min_by(c, "saved").alias(c) for c in ("created_at", "repo_root", "base_ref", "head_ref")]
        return rows.groupBy("id").agg(*first, F.max_by("payload", "saved").alias("payload"))

    def get_review(self, id: str) -> dict | None:
        row = self.reviews().where(F.col("id") == id).first()
        return row.asDict() | {"payload": json.loads(row["payload"])} if row else None

    def write(self, table: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{table}")

    def cached(self, table: str, version: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """The rows kept under a version, or those computed now, which are kept from then on.

        A version's rows are whole once its write has committed; what an interrupted one left is written anew.
        Rows of other versions stay until ``forget``.
        """
        path = f"{self.path}/{table}/version={version}"
        if not self._exists(f"{path}/_SUCCESS"):
            compute().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def forget(self, table: str, but: str) -> list[str]:
        """Delete all versions of a table but one; their names."""
        folder, fs = self._at(f"{self.path}/{table}")
        old = [x.getPath() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        old = [x for x in old if x.getName().startswith("version=") and x.getName() != f"version={but}"]
        for x in old:
            fs.delete(x, True)
        return sorted(x.getName().removeprefix("version=") for x in old)

    def _at(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        folder, fs = self._at(path)
        return fs.exists(folder)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")


def fingerprint(files: DataFrame) -> str:
    """One hash of all paths and contents; the same for any order of rows. Rows are combined before they travel."""
    row = F.xxhash64("path", "hash")
    a, n, s = files.agg(F.bit_xor(row), F.count("*"), F.sum(row.cast("decimal(38,0)"))).first()
    return f"{(a or 0) & (1 << 64) - 1:016x}{int(s or 0) & (1 << 64) - 1:016x}{n:x}"
