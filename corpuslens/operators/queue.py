"""The work queue: positions, ranking keys, clusters, skips, lifecycle views and plan edits as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.operators.findings import confidence_rank


def positions(items: DataFrame, order: list[str], known_since: str) -> DataFrame:
    """items with position (in a plan's queue_order, null if absent) and is_new (first seen at or after a time)."""
    plan = items.sparkSession.createDataFrame([(i, p) for p, i in enumerate(order)], "finding_id string, position int")
    return items.join(plan, "finding_id", "left").withColumn("is_new", F.col("first_seen") >= F.lit(known_since).cast("timestamp_ntz"))


def rank_key() -> list:
    """Planned items by position, then known ones by impact, confidence and id, new ones last."""
    group = F.when(F.col("position").isNotNull(), 0).when(~F.col("is_new"), 1).otherwise(2)
    return [group, F.col("position").asc_nulls_last(), F.desc("impact"), confidence_rank(F.col("confidence")), "finding_id"]


def ranked(items: DataFrame, most: int) -> DataFrame:
    """The first items of the queue with their 1-based rank. A top-k first, so only k rows are numbered."""
    top = items.orderBy(*rank_key()).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*rank_key())))


def with_impact(items: DataFrame, headroom: DataFrame) -> DataFrame:
    """items with impact: points an item gives times its dimension's headroom(detector, per_point, room)."""
    return items.join(headroom, "detector", "left").withColumn("impact", F.coalesce(F.col("per_point") * F.col("room"), F.lit(0)))


def collapse_clusters(items: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters of at least two present members as one row (largest impact); everything else as it is."""
    tagged = items.join(members, "finding_id", "left")
    sizes = tagged.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.max("impact").alias("best"))
    joined = tagged.join(sizes, "cluster", "left")
    whole = F.coalesce(F.col("size"), F.lit(0)) >= 2
    kept = joined.where(~whole).select(F.col("finding_id").alias("row_id"), "impact", F.lit(1).cast("long").alias("size"))
    meta = sizes.where("size >= 2").select(F.concat(F.lit("cluster::"), "cluster").alias("row_id"), F.col("best").alias("impact"), "size")
    return kept.union(meta)


def auto_clusters(findings: DataFrame, action: DataFrame, least: int = 2) -> DataFrame:
    """key, n, first: open findings grouped by a key made of their detector's action; judgment has none."""
    joined = findings.where(F.col("status") == "open").join(action, "detector")
    key = F.when(F.col("action") == "auto_fix", F.concat(F.lit("auto::"), "detector")).when(F.col("action") == "reorganize", F.concat(F.lit("move::"), F.element_at(F.split("file", "/"), 1)))
    return joined.withColumn("key", key).where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("finding_id").alias("first")).where(F.col("n") >= least)


def upserted_clusters(existing: DataFrame, made: DataFrame) -> DataFrame:
    """Clusters by key after a sync: kept, new, or pruned where they are automatic and gone and nobody changed them."""
    j = existing.join(made.select("key", F.col("n").alias("n_now")), "key", "full")
    state = F.when(F.col("n_now").isNotNull() & F.col("auto").isNull(), "new").when(F.col("n_now").isNotNull(), "kept").when(F.col("auto") & ~F.col("user_modified"), "pruned").otherwise("kept")
    return j.select("key", "n_now", state.alias("state"))


def split_skipped(items: DataFrame, skipped: DataFrame) -> DataFrame:
    """items with is_skipped by membership; the plan's skips are a table, so one join does both halves."""
    return items.join(skipped.select("finding_id", F.lit(True).alias("s")).distinct(), "finding_id", "left").withColumn("is_skipped", F.coalesce("s", F.lit(False))).drop("s")


def resurfaced(skipped: DataFrame, scan: int) -> DataFrame:
    """Temporary skips whose time is over."""
    return skipped.where((F.col("kind") == "temporary") & (F.col("skipped_at") + F.col("review_after") <= scan))


def moved(order: DataFrame, ids: list[str], target: str) -> DataFrame:
    """queue_order arrays with some ids moved to the top or the bottom, their own order kept."""
    wanted = F.array(*map(F.lit, ids))
    chosen = F.filter("queue_order", lambda x: F.array_contains(wanted, x))
    rest = F.filter("queue_order", lambda x: ~F.array_contains(wanted, x))
    return order.withColumn("queue_order", F.concat(chosen, rest) if target == "top" else F.concat(rest, chosen))


def purged(order: DataFrame, ids: list[str]) -> DataFrame:
    return order.withColumn("queue_order", F.array_except("queue_order", F.array(*map(F.lit, ids))))


def merged_members(clusters: DataFrame, merges: DataFrame) -> DataFrame:
    """Clusters(name, ids, description) after merges(source, name): united members, the first description there is."""
    source = clusters.select(F.col("name").alias("source"), F.col("ids").alias("other"), F.col("description").alias("other_text"))
    both = clusters.join(merges, "name").join(source, "source")
    return both.select("name", F.array_union("ids", "other").alias("ids"), F.coalesce("description", "other_text").alias("description"))


def queue_breakdown(items: DataFrame) -> DataFrame:
    """Counts of each class of the queue in one pass."""
    is_open = F.col("status") == "open"
    return items.agg(
        F.count_if(is_open & ~F.col("is_skipped") & F.col("position").isNotNull()).alias("planned"), F.count_if(is_open & ~F.col("is_skipped") & F.col("position").isNull()).alias("backlog"),
        F.count_if(is_open & F.col("is_skipped")).alias("skipped"), F.count_if(~is_open).alias("done"),
    )
