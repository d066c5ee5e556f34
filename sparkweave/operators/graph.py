"""Filters, point lookups, merges and set operations on the graph's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.operators.scratch import Scratch
from sparkweave.schema import edge_id, weight_for


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def node(self, id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == id)

    def of_types(self, *types: str) -> DataFrame:
        return self.nodes.where(F.col("type").isin(*types)) if types else self.nodes

    def edges_of(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))

    def edges_between(self, *types: str) -> DataFrame:
        """Edges both of whose ends have one of the types."""
        return linked(self.edges, self.of_types(*types))

    def induced(self, ids: DataFrame) -> Graph:
        """The graph of the nodes whose id is in ``ids`` (column id)."""
        nodes = self.nodes.join(ids.select("id").distinct(), "id", "left_semi")
        return Graph(nodes, linked(self.edges, nodes))

    def neighbors(self, id: str, direction: str = "both") -> DataFrame:
        """Edges at a node: in, out or both."""
        at = {"out": F.col("src") == id, "in": F.col("dst") == id, "both": (F.col("src") == id) | (F.col("dst") == id)}
        return self.edges.where(at[direction])

    def in_files(self, paths: DataFrame) -> DataFrame:
        """Nodes whose file is in ``paths`` (column path)."""
        return self.nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi")

    def search(self, text: str, limit: int = 24) -> DataFrame:
        """The first nodes one of whose columns contains the text, in any case."""
        row = F.lower(F.concat_ws(" ", "name", "qualified_name", "type", "file_path", "context"))
        return self.nodes.where(row.contains(text.lower())).orderBy("id").limit(limit)

    def counts(self) -> DataFrame:
        return self.nodes.agg(F.count("*").alias("nodes")).crossJoin(self.edges.agg(F.count("*").alias("edges")))

    def type_counts(self) -> DataFrame:
        return self.nodes.groupBy("type").agg(F.count("*").alias("n"))

    def pruned(self) -> Graph:
        """Without edges one of whose ends is missing."""
        return Graph(self.nodes, linked(self.edges, self.nodes))

    def union(self, other: Graph) -> Graph:
        return Graph(self.nodes.unionByName(other.nodes, True), self.edges.unionByName(other.edges, True))


def linked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among ``nodes``."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges one of whose ends is missing; each end is looked up once."""
    ids = nodes.select("id").distinct()
    src, dst = (ids.select(F.col("id").alias(side), F.lit(True).alias(f"_{side}")) for side in ("src", "dst"))
    return edges.join(src, "src", "left").join(dst, "dst", "left").where("_src is null or _dst is null").select(edges.columns)


def make_edges(rows: DataFrame, confidence: float = 1.0) -> DataFrame:
    """Edge rows from src, dst, type (and confidence, extra, where there)."""
    def has(c, default):
        return F.col(c) if c in rows.columns else F.lit(default)

    return rows.select(edge_id(F.col("src"), F.col("type"), F.col("dst")).alias("id"), "src", "dst", "type", weight_for(F.col("type")).alias("weight"), has("confidence", confidence).cast("double").alias("confidence"), has("extra", None).cast("string").alias("extra"))


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key, the last by ``order``: edges by (src, type, dst), files by path, settings by key.

    A maximum over structs, so that a key with very many rows is combined before the shuffle.
    """
    rest = [c for c in rows.columns if c not in key and c != order]
    return rows.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("last")).select(*key, *(f"last.{c}" for c in rest))


def merge_nodes(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """One row an id: versions merged in order, where a definition outlives later references.

    ``rows``: id, type, name, qualified_name, file_path, start_line, end_line, context, referenced, seq and
    ``keys``, the columns of extra values. Extra values merge new over old. If the new version is only a
    reference and the old a definition, the old file, line and context stay (where there), and old extra
    values that the new one lacks stay as well; a definition after a reference takes all from the new one;
    in both cases the result is a definition.

    So an id's row follows from its last version, its last definition and the last value of each key, all of which
    are maxima that combine before the shuffle. Only where the last definition lacks a file, line or context do
    the references after it count: the first value among these, again a combined minimum.
    """
    plain = ["type", "name", "qualified_name", "end_line"]
    kept = ["file_path", "start_line", "context"]
    is_ref = F.coalesce("referenced", F.lit(False))

    def given(c):
        return F.when(F.col(c).isNotNull(), F.struct(order, c))

    states = rows.groupBy("id").agg(
        F.max(F.struct(order, *plain, *kept, "referenced")).alias("last"), F.max(F.when(~is_ref, F.struct(order, *kept))).alias("defined"),
        F.count("*").alias("versions"), F.count_if(~is_ref).alias("definitions"), *(F.max(given(k)).alias(f"key_{k}") for k in keys),
    )
    lacking = F.greatest(*(F.col(f"defined.{c}").isNull().cast("int") for c in kept)) == 1
    since = states.where((F.col(f"last.{order}") > F.col(f"defined.{order}")) & lacking).select("id", F.col(f"defined.{order}").alias("since"))
    later = rows.where(is_ref).join(since, "id").where(F.col(order) > F.col("since")).groupBy("id").agg(*(F.min(given(c)).alias(f"later_{c}") for c in kept))
    is_last_ref = F.coalesce("last.referenced", F.lit(False))
    mixed = F.when(is_last_ref, F.col("definitions") > 0).otherwise((F.col("definitions") == 1) & (F.col("versions") > 1))
    merged = states.join(later, "id", "left")
    return merged.select(
        "id", *(F.col(f"last.{c}").alias(c) for c in plain),
        *(F.when(F.col("defined").isNull(), F.col(f"last.{c}")).otherwise(F.coalesce(f"defined.{c}", f"later_{c}.{c}")).alias(c) for c in kept),
        F.when(mixed, F.lit(False)).otherwise(F.col("last.referenced")).alias("referenced"), *(F.col(f"key_{k}.{k}").alias(k) for k in keys),
    )


def drop_files(graph: Graph, paths: DataFrame, removed: bool) -> Graph:
    """Without the nodes of files and their outgoing edges; incoming ones go only if the files were removed."""
    # asked up to three times, and the size of what is written tells Spark whether it may be broadcast
    gone = Scratch(paths.sparkSession).cut(graph.in_files(paths).select("id"))
    edges = graph.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
    if removed:
        edges = edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return Graph(graph.nodes.join(gone, "id", "left_anti"), edges)


def first_seen(rows: DataFrame, value: str, order: Column | str) -> DataFrame:
    """Distinct values by where they first stand."""
    return rows.groupBy(value).agg(F.min(order).alias("first")).orderBy("first", value)


def index_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, changed, deleted) between two tables of path, hash."""
    both = old.select("path", F.col("hash").alias("was")).join(new.select("path", F.col("hash").alias("now")), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def merge_diffs(committed: DataFrame, worktree: DataFrame) -> DataFrame:
    """path, status, added, deleted: the worktree's status wins, counts add up."""
    rows = committed.withColumn("late", F.lit(0)).unionByName(worktree.withColumn("late", F.lit(1)))
    return rows.groupBy("path").agg(F.max_by("status", "late").alias("status"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def degree_histogram(graph: Graph, id: str) -> DataFrame:
    """direction, type, n of a node's edges, most frequent first."""
    at = graph.neighbors(id).select(F.when(F.col("src") == id, "out").otherwise("in").alias("direction"), "type")
    return at.groupBy("direction", "type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type", "direction")


def newest(rows: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
