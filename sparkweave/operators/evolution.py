"""History of files from commit rows (sha, author, file): hotspots, co-change, knowledge, changed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES_A_BIN = 64


def hotspots(commits: DataFrame) -> DataFrame:
    """file, commits, authors of every file."""
    return commits.groupBy("file").agg(F.count_distinct("sha").alias("commits"), F.count_distinct("author").alias("authors"))


def co_change(commits: DataFrame, least: int = 3) -> DataFrame:
    """a, b, together, of_a, of_b: files that changed in the same commit often enough.

    Pairs form within a commit, not over all files; a commit's files are few, whatever the history's length.
    """
    rows = commits.select("sha", "file").distinct()
    pairs = rows.select("sha", F.col("file").alias("a")).join(rows.select("sha", F.col("file").alias("b")), "sha").where("a < b")
    together = pairs.groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    n = rows.groupBy("file").agg(F.count("*").alias("n"))
    return together.join(n.select(F.col("file").alias("a"), F.col("n").alias("of_a")), "a").join(n.select(F.col("file").alias("b"), F.col("n").alias("of_b")), "b").select("a", "b", "together", "of_a", "of_b")


def couplings(pairs: DataFrame, impact_files: DataFrame, contexts: DataFrame, most: int = 40, shown: int = 12) -> DataFrame:
    """The strongest pairs with just one file on the path. ``contexts``: file, context.

    The strongest are ranked before they are filtered, ties by name.
    """
    top = pairs.orderBy(F.desc("together"), "a", "b").limit(most)
    on = impact_files.select("file").distinct()
    for side in ("a", "b"):
        top = top.join(on.withColumnsRenamed({"file": side}).withColumn(f"{side}_on", F.lit(True)), side, "left")
        top = top.join(contexts.select(F.col("file").alias(side), F.col("context").alias(f"{side}_context")), side, "left")
    one = F.coalesce("a_on", F.lit(False)) != F.coalesce("b_on", F.lit(False))
    degree = F.round(F.col("together") / F.greatest("of_a", "of_b"), 3)
    return top.where(one).select("a", "b", "together", degree.alias("degree"), F.coalesce(F.col("a_context") != F.col("b_context"), F.lit(False)).alias("cross_context")).orderBy(F.desc("together"), "a", "b").limit(shown)


def knowledge_owners(commits: DataFrame, least: int = 3, limit: int = 8) -> DataFrame:
    """author, file, commits: authors of files with enough commits, by the busiest file of each; ties by name."""
    busy = commits.groupBy("file").agg(F.count_distinct("sha").alias("commits")).where(F.col("commits") >= least)
    first = F.min(F.struct((-F.col("commits")).alias("order"), "file", "commits")).alias("first")
    by = commits.select("file", "author").distinct().join(busy, "file").groupBy("author").agg(first)
    return by.orderBy("first", "author").limit(limit).select("author", "first.file", "first.commits")


def file_complexity(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """path, complexity: summed over the functions that hold a changed line."""
    return touched_functions(functions, lines).groupBy("path").agg(F.sum("complexity").alias("complexity"))


def notes(spots: DataFrame, pairs: DataFrame) -> DataFrame:
    """kind, subject, n: silos, busy and complex files, and couplings worth a note."""
    silo = (F.col("commits") >= 5) & (F.col("authors") == 1)
    complexity = F.coalesce("complexity", F.lit(0)) if "complexity" in spots.columns else F.lit(0)
    kind = F.when(silo, "silo").when(F.col("commits") >= 8, "hotspot").when((complexity >= 12) & (F.col("commits") >= 3), "complex")
    of_files = spots.select(kind.alias("kind"), F.col("file").alias("subject"), F.col("commits").alias("n")).where("kind is not null")
    kind = F.when(F.col("cross_context") & (F.col("degree") >= 0.4), "hidden_coupling").when(F.col("degree") >= 0.6, "coupling")
    return of_files.unionByName(pairs.select(kind.alias("kind"), F.concat_ws(" ", "a", "b").alias("subject"), F.col("together").alias("n")).where("kind is not null"))


def split_patches(patches: DataFrame) -> DataFrame:
    """path, patch of each file in patches of many files (column patch)."""
    parts = patches.select(F.explode(F.split("patch", r"(?m)^(?=diff --git )")).alias("patch")).where("patch like 'diff --git %'")
    return parts.select(F.regexp_extract("patch", r"^diff --git a/.* b/(.*)", 1).alias("path"), "patch")


def changed_lines(patches: DataFrame) -> DataFrame:
    """path, line of every added line in the new file, from path, patch."""
    lines = patches.select("path", F.posexplode(F.split("patch", "\n")).alias("at", "text"))
    start = F.when(F.col("text").rlike(r"^@@ "), F.regexp_extract("text", r"\+(\d+)", 1).cast("int"))
    w = Window.partitionBy("path").orderBy("at")
    hunk = F.last(F.when(start.isNotNull(), F.struct(start.alias("start"), F.col("at").alias("at"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    moves = F.when(F.col("text").rlike(r"^[ +]") & ~F.col("text").startswith("+++"), 1).otherwise(0)
    rows = lines.withColumn("hunk", hunk).withColumn("moves", moves).where("hunk is not null")
    inside = Window.partitionBy("path", "hunk.at").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("line", F.col("hunk.start") + F.coalesce(F.sum("moves").over(inside), F.lit(0)))
    return rows.where(F.col("text").startswith("+") & ~F.col("text").startswith("+++")).select("path", F.col("line").cast("int").alias("line"))


def touched_functions(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """Functions (path, name, start, end, complexity) that hold a changed line.

    Lines count once, however many patches name them, and meet the functions' stretches of ``LINES_A_BIN`` lines under
    equal keys, so that a file with very many lines is dealt among tasks.
    """
    def bin_of(c: str) -> Column:
        return F.floor(F.col(c) / LINES_A_BIN)

    at = lines.select("path", "line").distinct().withColumn("bin", bin_of("line"))
    spans = functions.where(F.col("start") <= F.col("end")).select("path", "start", "end").distinct()
    spans = spans.withColumn("bin", F.explode(F.sequence(bin_of("start"), bin_of("end"))))
    held = (spans["path"] == at["path"]) & (spans["bin"] == at["bin"]) & at["line"].between(spans["start"], spans["end"])
    return functions.join(spans.join(at, held, "left_semi").select("path", "start", "end").distinct(), ["path", "start", "end"], "left_semi").select(functions.columns)


def patch_identifiers(patches: DataFrame) -> DataFrame:
    """Distinct names on added or removed lines."""
    lines = patches.select(F.explode(F.split("patch", "\n")).alias("text")).where(F.col("text").rlike(r"^[+-](?![+-])"))
    return lines.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), 0)).alias("name")).distinct()
