"""Reviews over time: trend, health, differences, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.operators.graph import newest


def level_rank(level: Column) -> Column:
    return F.when(level == "low", 0).when(level == "medium", 1).when(level == "high", 2)


def direction(now: Column, before: Column) -> Column:
    return F.when(before.isNull(), "new").when(level_rank(now) > level_rank(before), "improved").when(level_rank(now) < level_rank(before), "dropped").otherwise("same")


def confidence_trend(reviews: DataFrame, key: list[str], order: str = "created_at", level: str = "level", limit: int = 12) -> DataFrame:
    """The newest reviews of each key with how their level moved."""
    before = F.lag(level).over(Window.partitionBy(*key).orderBy(order))
    rows = reviews.withColumn("before", before).withColumn("direction", direction(F.col(level), F.col("before")))
    return newest(rows, key, order, limit)


def architecture_health(points: DataFrame, limit: int = 24) -> DataFrame:
    """created_at, context, findings: the newest points of each context, from one row a finding."""
    return newest(points.groupBy("context", "created_at").agg(F.count("*").alias("findings")), ["context"], "created_at", limit)


def diff_reviews(current: DataFrame, previous: DataFrame, key: list[str]) -> DataFrame:
    """key, change (added or removed)."""
    now, was = current.select(*key).distinct(), previous.select(*key).distinct()
    return now.exceptAll(was).withColumn("change", F.lit("added")).unionByName(was.exceptAll(now).withColumn("change", F.lit("removed")))


def running_progress(events: DataFrame, key: list[str], order: list[str], percent: str = "percent") -> DataFrame:
    """``shown``: progress that never falls."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("shown", F.max(percent).over(w))


def match_reviews_to_prs(reviews: DataFrame, prs: DataFrame) -> DataFrame:
    """number, review: the first review whose head starts like the request's, or whose branch ends with its."""
    by_sha = prs.join(reviews, F.substring("head_sha", 1, 7) == F.substring("head_ref", 1, 7))
    tail = F.substring_index("head_ref", "/", -1)
    by_branch = prs.withColumn("_tail", F.substring_index("branch", "/", -1)).join(reviews.withColumn("_tail", tail), "_tail").where(F.col("head_ref").endswith(F.col("branch")) | F.col("branch").endswith(F.col("head_ref"))).drop("_tail")
    return by_sha.unionByName(by_branch, True).groupBy("number").agg(F.min_by("id", F.struct("created_at", "id")).alias("review"))


def list_reviews(reviews: DataFrame, limit: int = 50, with_payload: bool = False) -> DataFrame:
    rows = reviews if with_payload else reviews.drop("payload")
    return rows.orderBy(F.desc("created_at"), "id").limit(max(1, min(200, limit)))


# The share of the whole bar that each phase of indexing takes.
PHASES = {"scan": (0, 20), "extract": (20, 88), "boot": (88, 94), "stitch": (94, 99), "skipped": (100, 100), "done": (100, 100)}


def overall_percent(phase: Column, done: Column, total: Column, floor: Column) -> Column:
    """Percent of the whole, never below the floor; other phases stand still."""
    percent = floor
    for name, (start, end) in PHASES.items():
        share = F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / total))).otherwise(0.0)
        percent = F.when(phase == name, F.bround(F.lit(start) + (end - start) * share)).otherwise(percent)
    return F.least(F.lit(100), F.greatest(F.lit(0), floor, percent)).cast("int")


def summarize_reviews(reviews: DataFrame) -> DataFrame:
    """Stored reviews with what their payload (JSON) says of confidence, contract and findings."""
    p = lambda path: F.get_json_object("payload", f"$.{path}")
    waived = F.from_json(p("findings"), "array<struct<waived:boolean>>")
    return reviews.select(
        "id", "created_at", "base_ref", "head_ref", p("confidence.level").alias("level"), p("confidence.sinks").cast("int").alias("sinks"), p("confidence.covered_sinks").cast("int").alias("covered_sinks"),
        p("contract_break.kind").alias("contract_break"), F.size(F.filter(F.coalesce(waived, F.array().cast("array<struct<waived:boolean>>")), lambda f: ~F.coalesce(f["waived"], F.lit(False)))).alias("findings"), F.coalesce(p("what_if").cast("boolean"), F.lit(False)).alias("what_if"),
    )
