"""An index kept on disk that follows changes of files, touching only what shares keys with them.

Tables are partitioned by a hash of the key under which they are looked up: raw rows and nodes and edges by id,
the ids of a file by its path, link keys by key, stitched edges by their entity. A change is a set of paths.
From it follow, each time by a semi join that reads only the partitions of the keys at hand:

1. the ids that the changed files gave or give now; their rows are folded anew;
2. entities derived from providers that changed (routes from includes, contracts from their field nodes);
3. old and new link keys of all these, and with them the entities whose links may differ: those whose own keys
   changed, and those that share a key with a provider that changed. Rows of removed files retract their keys;
4. the providers that share a key with such entities. The links run over these nodes alone.

Partitions that change are written anew; what else there is stays as it is. ``graph`` and ``residuals`` give what
a whole index of the same files gives (``plans.review.index_tree``). The manifest and the described operations belong to
the index; a change of theirs needs a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators.graph import Graph, index_drift
from sparkweave.operators.scratch import Scratch
from sparkweave.plans import stitching
from sparkweave.schema import EDGES, NODES, edge_id
from sparkweave.sources import extraction
from sparkweave.sources.tree import Manifest

TABLES = {
    "files": ("path string, hash string, language string", "path"), "raw": (extraction.RAW + ", key string", "key"), "places": ("path string, key string", "path"),
    "nodes": (NODES, "id"), "edges": (EDGES, "id"), "keys": ("link string, side string, id string, key string", "key"),
    "stitched": (stitching.STITCHED, "entity"), "gaps": (stitching.MISSING, "entity"),
}


class LiveIndex:
    """Tables of an index below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest | None = None, parts: int = 64):
        self.spark, self.path, self.manifest, self.parts = spark, path.rstrip("/"), manifest or Manifest(), parts

    # --- tables -----------------------------------------------------------------------------------

    def part(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{TABLES[name][0]}, part int").parquet(f"{self.path}/{name}").drop("part")

    def _parts_of(self, keys: DataFrame, key: str) -> list[int]:
        """The partitions of some keys: at most as many numbers as there are partitions."""
        return sorted(r["part"] for r in keys.select(self.part(key).alias("part")).distinct().collect())

    def _pruned(self, name: str, parts: list[int]) -> DataFrame:
        return self.spark.read.schema(f"{TABLES[name][0]}, part int").parquet(f"{self.path}/{name}").where(F.col("part").isin(parts)).drop("part")

    def lookup(self, name: str, keys: DataFrame, on: list[str] | None = None) -> DataFrame:
        """Rows of a table whose key is among ``keys`` (a small table that has the columns ``on``, the table's key by default)."""
        key = TABLES[name][1]
        on = on or [key]
        return self._pruned(name, self._parts_of(keys, key)).join(keys.select(*on).distinct(), on, "left_semi")

    def _write(self, name: str, rows: DataFrame) -> None:
        rows.withColumn("part", self.part(TABLES[name][1])).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{name}")

    def _replace(self, name: str, parts: list[int], gone: DataFrame, on: list[str], rows: DataFrame, scratch: Scratch) -> None:
        """Within some partitions, rows without those that match ``gone``, and ``rows``, which all belong there."""
        kept = self._pruned(name, parts).join(gone.select(*on).distinct(), on, "left_anti")
        new = scratch.cut(kept.unionByName(rows.select(*kept.columns)).withColumn("part", self.part(TABLES[name][1])))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{name}")
        left = {r["part"] for r in new.select("part").distinct().collect()}
        for empty in set(parts) - left:
            folder, fs = scratch._at(f"{self.path}/{name}/part={empty}")
            fs.delete(folder, True)

    # --- building ---------------------------------------------------------------------------------

    def _folded(self, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
        nodes, edges, _ = extraction.folded(raw.drop("key"), self.manifest.apps(self.spark), self.manifest.ui_paths(self.spark))
        return nodes, edges

    @staticmethod
    def _keyed(raw: DataFrame) -> DataFrame:
        edge = edge_id(F.col("src"), F.col("type"), F.col("dst"))
        return raw.withColumn("key", F.when(F.col("kind") == "edge", edge).otherwise(F.coalesce("id", "path")))

    def create(self, files: DataFrame, operations: DataFrame | None = None) -> LiveIndex:
        """Index all files (path, content)."""
        return self.create_from(extraction.extract(files), extraction.files_table(extraction.source_files(files)), operations)

    def create_from(self, raw: DataFrame, files: DataFrame, operations: DataFrame | None = None) -> LiveIndex:
        """Index raw rows of files that were extracted elsewhere."""
        self._write("files", files)
        self._write("raw", self._keyed(raw))
        raw = self.read("raw")
        self._write("places", raw.select("path", "key").distinct())
        nodes, edges = self._folded(raw)
        if operations is not None:
            nodes = nodes.unionByName(stitching.operation_nodes(operations), True)
        self._write("nodes", nodes)
        self._write("edges", edges)
        globs, own = self.manifest.globs(self.spark), Scratch(self.spark).cut(stitching.stitchable(self.read("nodes")))
        self._write("keys", stitching.keys_of(own, globs))
        found, gaps = stitching.linked(own, globs)
        self._write("stitched", found)
        self._write("gaps", gaps)
        return self

    # --- following changes ------------------------------------------------------------------------

    def update(self, files: DataFrame) -> int:
        """Follow the files (path, content) as they are now; the number of files that changed."""
        files = extraction.source_files(files)
        scratch = Scratch(self.spark)
        now = scratch.cut(extraction.files_table(files))
        drift = scratch.cut(index_drift(self.read("files"), now))
        changed = drift.count()
        if changed:
            fresh = extraction.extract(files.join(drift.where("change <> 'deleted'").select("path"), "path", "left_semi"))
            self.apply(drift.select("path"), fresh, now.join(drift.select("path"), "path", "left_semi"))
        return changed

    def apply(self, paths: DataFrame, fresh: DataFrame, files: DataFrame) -> None:
        """Replace what some paths gave by fresh raw rows of theirs (none: the file is gone)."""
        scratch = Scratch(self.spark)
        paths, fresh = scratch.cut(paths.distinct()), scratch.cut(self._keyed(fresh))
        path_parts = self._parts_of(paths, "path")
        places = fresh.select("path", "key").distinct()
        ids = scratch.cut(self.lookup("places", paths).select("key").unionByName(places.select("key")).distinct())
        parts = self._parts_of(ids, "key")
        self._replace("raw", parts, paths, ["path"], fresh, scratch)
        self._replace("places", path_parts, paths, ["path"], places, scratch)
        self._replace("files", path_parts, paths, ["path"], files, scratch)

        # ids are keys of nodes and edges alike; a table holds those of its kind
        by_id = ids.withColumnRenamed("key", "id")
        nodes, edges = self._folded(self.lookup("raw", ids))
        new, old = scratch.cut(nodes), scratch.cut(self.lookup("nodes", by_id))
        self._replace("nodes", parts, by_id, ["id"], new, scratch)
        self._replace("edges", parts, by_id, ["id"], edges, scratch)
        was, is_ = stitching.stitchable(old), stitching.stitchable(new)
        differ = scratch.cut(was.exceptAll(is_).select("id").unionByName(is_.exceptAll(was).select("id")).distinct())
        if not differ.isEmpty():
            self._restitch(differ, was.join(differ, "id", "left_semi"), scratch)

    def _closed(self, rows: DataFrame, scratch: Scratch, was: DataFrame | None = None, differ: DataFrame | None = None) -> DataFrame:
        """Nodes with the providers from which some of them are derived; ``was``: the old versions of the nodes ``differ``, which count instead of theirs."""
        rows = scratch.cut(rows)
        keys = scratch.cut(stitching.derivation_keys(rows).where("side = 'e'").select("link", "key").distinct())
        ids = scratch.cut(self.lookup("keys", keys, ["link", "key"]).where("side = 'p'").select("id").distinct())
        more = stitching.stitchable(self.lookup("nodes", ids))
        if was is not None:
            more = more.join(differ, "id", "left_anti").unionByName(was.join(ids, "id", "left_semi"))
        return scratch.cut(rows.unionByName(more.join(rows.select("id"), "id", "left_anti")))

    def _restitch(self, differ: DataFrame, was: DataFrame, scratch: Scratch) -> None:
        """Links of what shares keys with the nodes ``differ``, of which ``was`` holds the old versions."""
        globs = self.manifest.globs(self.spark)
        was = scratch.cut(was)
        current = lambda ids: stitching.stitchable(self.lookup("nodes", ids))
        # what is derived from a provider that changed has changed itself
        providers = stitching.derivation_keys(was).unionByName(stitching.derivation_keys(current(differ))).where("side = 'p'").select("link", "key")
        derived = self.lookup("keys", scratch.cut(providers.distinct()), ["link", "key"]).where("side = 'e'").select("id")
        touched = scratch.cut(differ.unionByName(derived).distinct())
        before = was.unionByName(current(touched.join(differ, "id", "left_anti")))
        old_keys = scratch.cut(stitching.keys_of(self._closed(before, scratch, was, differ), globs).join(touched, "id", "left_semi"))
        # keys of derivations first, as the others follow from what they find
        own = scratch.cut(current(touched))
        self._swap_keys(old_keys, stitching.derivation_keys(own), touched, scratch)
        new_keys = scratch.cut(stitching.keys_of(self._closed(own, scratch), globs).join(touched, "id", "left_semi"))
        self._swap_keys(new_keys, new_keys, touched, scratch)

        delta = scratch.cut(old_keys.unionByName(new_keys).distinct())
        sharing = self.lookup("keys", delta.where("side = 'p'"), ["link", "key"]).where("side = 'e'")
        entities = delta.where("side = 'e'").select("link", "id").unionByName(sharing.select("link", "id"))
        # a client that is superseded, or no longer, has another confidence in its links
        links = F.when(F.col("link") == "superseded", F.array(F.lit("client"), F.lit("operation"))).otherwise(F.array("link"))
        entities = scratch.cut(entities.where(~F.col("link").isin(*stitching.DERIVED)).select(F.explode(links).alias("link"), F.col("id").alias("entity")).distinct())
        ids = scratch.cut(entities.select(F.col("entity").alias("id")).distinct())
        whole = self._closed(current(ids), scratch)
        asked = scratch.cut(stitching.keys_of(whole, globs).where("side = 'e'").join(ids, "id", "left_semi").select("link", "key").distinct())
        found = scratch.cut(self.lookup("keys", asked, ["link", "key"]).where("side = 'p'").select("id").distinct())
        near = whole.unionByName(current(found).join(whole.select("id"), "id", "left_anti"))
        edges, gaps = stitching.linked(self._closed(near, scratch), globs)
        parts = self._parts_of(entities, "entity")
        for name, rows in (("stitched", edges), ("gaps", gaps)):
            self._replace(name, parts, entities, ["link", "entity"], rows.join(entities, ["link", "entity"], "left_semi"), scratch)

    def _swap_keys(self, where: DataFrame, rows: DataFrame, ids: DataFrame, scratch: Scratch) -> None:
        """Keys of some ids within the partitions of ``where`` and ``rows``, replaced by ``rows``."""
        parts = self._parts_of(where.select("key").unionByName(rows.select("key")), "key")
        self._replace("keys", parts, ids, ["id"], rows, scratch)

    # --- what it holds ----------------------------------------------------------------------------

    def graph(self) -> Graph:
        nodes, edges = self.read("nodes"), self.read("edges")
        linked = Graph(nodes, edges).pruned().edges
        more = stitching.as_edges(self.read("stitched"))
        return Graph(nodes, linked.unionByName(more.join(linked.select("id"), "id", "left_anti"))).pruned()

    def residuals(self) -> DataFrame:
        """path, what, line."""
        own = self.read("raw").where("kind = 'residual'").select("path", F.col("name").alias("what"), "line")
        return own.unionByName(self.read("gaps").select("path", "what", F.lit(None).cast("int").alias("line")))

