"""Queries of the work-queue operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import queue
from corpuslens.plans.findings import _values
from corpuslens.plans.registry import query
from corpuslens.sources import tables
from corpuslens.sources.tables import WORK

PLAN = ["smells::area8/mod8/f428.py::o8", "no::such", "dupes::area0/mod0/f0.py::o1"]
SINCE = "1998-06-01 00:00:00"
ROOM = [("smells", 3, 40), ("dupes", 2, 55), ("security", 5, 20), ("structural", 4, 30), ("cycles", 5, 22)]
ITEMS = f"""WITH {WORK}, items AS (SELECT w.*, coalesce(pp * room, 0) AS impact, p.position,
  first_seen >= TIMESTAMP '{SINCE}' AS is_new FROM work w LEFT JOIN {_values(ROOM)} r(detector, pp,
  room) USING (detector)
  LEFT JOIN {_values([(i, p) for p, i in enumerate(PLAN)])} p(finding_id, position) USING (finding_id)
  WHERE status = 'open' AND NOT suppressed)"""
KEY = "CASE WHEN position IS NOT NULL THEN 0 WHEN NOT is_new THEN 1 ELSE 2 END, position NULLS LAST, impact DESC, CASE confidence WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, finding_id"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.work_items(spark, sf_dir).where((F.col("status") == "open") & ~F.col("suppressed"))
    room = spark.createDataFrame(ROOM, "detector string, per_point int, room int")
    return queue.positions(queue.with_impact(w, room), PLAN, SINCE)


@query(ITEMS + " SELECT finding_id, impact, position, is_new FROM items")
def stamped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open findings with impact, plan position and whether they are new (245, 247)."""
    return _items(spark, sf_dir).select("finding_id", "impact", "position", "is_new")


@query(ITEMS + f" SELECT finding_id, impact, CAST(row_number() OVER (ORDER BY {KEY}) AS INTEGER) AS rank FROM items ORDER BY rank LIMIT 25")
def queue_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 items of the queue (243, 244, 246, 248, 254-258)."""
    return queue.ranked(_items(spark, sf_dir), 25).select("finding_id", "impact", "rank")


@query(ITEMS + """, m AS (SELECT *, CASE WHEN tier <= 2 THEN file END AS cluster FROM items), s AS (SELECT cluster,
  count(*) AS size, max(impact) AS best FROM m WHERE cluster IS NOT NULL GROUP BY cluster)
 SELECT finding_id AS row_id, impact, CAST(1 AS BIGINT) AS size FROM m LEFT JOIN s USING (cluster)
  WHERE coalesce(size, 0) < 2 UNION ALL SELECT 'cluster::' || cluster, best, size FROM s WHERE size >= 2""")
def collapsed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters (easy findings of one file) as one row each (251)."""
    items = _items(spark, sf_dir)
    members = items.where("tier <= 2").select("finding_id", F.col("file").alias("cluster"))
    return queue.collapse_clusters(items, members)


ACTIONS = [("smells", "auto_fix"), ("dupes", "refactor"), ("naming", "reorganize"), ("structural", "refactor"), ("cycles", "reorganize")]
CLUSTERS = f"""WITH {WORK}, k AS (SELECT finding_id, CASE WHEN action = 'auto_fix' THEN 'auto::' || detector
  WHEN action = 'reorganize' THEN 'move::' || split_part(file, '/', 1) END AS key FROM work
  JOIN {_values(ACTIONS)} a(detector, action) USING (detector) WHERE status = 'open'),
 made AS (SELECT key, count(*) AS n, min(finding_id) AS first FROM k WHERE key IS NOT NULL GROUP BY key
  HAVING count(*) >= 2)"""
EXISTING = [("auto::smells", True, False), ("auto::old", True, False), ("move::gone", True, True), ("mine", False, True)]


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.auto_clusters(tables.work_items(spark, sf_dir), spark.createDataFrame(ACTIONS, "detector string, action string"))


@query(CLUSTERS + " SELECT * FROM made")
def auto_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)


@query(CLUSTERS + f", e AS (SELECT * FROM {_values(EXISTING)} v(key, auto, user_modified)) SELECT key, n AS n_now, CASE WHEN n IS NOT NULL AND auto IS NULL THEN 'new' WHEN n IS NOT NULL THEN 'kept' WHEN auto AND NOT user_modified THEN 'pruned' ELSE 'kept' END AS state FROM e FULL JOIN made USING (key)")
def pruned_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic clusters after a sync: new, kept or pruned (216, 279)."""
    return queue.upserted_clusters(spark.createDataFrame(EXISTING, "key string, auto boolean, user_modified boolean"), _clusters(spark, sf_dir))


SKIPPED = "SELECT finding_id, CASE WHEN reopen_count = 1 THEN 'temporary' ELSE 'permanent' END AS kind, tier * 2 AS review_after, 3 + loc % 10 AS skipped_at FROM work WHERE confidence = 'low' AND status = 'open'"


def _skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.work_items(spark, sf_dir).where("confidence = 'low' AND status = 'open'")
    return w.select("finding_id", F.when(F.col("reopen_count") == 1, "temporary").otherwise("permanent").alias("kind"), (F.col("tier") * 2).alias("review_after"), (F.col("loc") % 10 + 3).alias("skipped_at"))


@query(f"WITH {WORK}, s AS ({SKIPPED}) SELECT * FROM s WHERE kind = 'temporary' AND skipped_at + review_after <= 15")
def resurfaced_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.resurfaced(_skipped(spark, sf_dir), 15)


@query(ITEMS + f", s AS ({SKIPPED}) SELECT finding_id, s.finding_id IS NOT NULL AS is_skipped FROM items LEFT JOIN s USING (finding_id)")
def skip_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.split_skipped(_items(spark, sf_dir), _skipped(spark, sf_dir)).select("finding_id", "is_skipped")


@query(ITEMS + f", s AS ({SKIPPED}) SELECT count(*) FILTER (s.finding_id IS NULL AND position IS NOT NULL) AS planned, count(*) FILTER (s.finding_id IS NULL AND position IS NULL) AS backlog, count(*) FILTER (s.finding_id IS NOT NULL) AS skipped, CAST(0 AS BIGINT) AS done FROM items LEFT JOIN s USING (finding_id)")
def queue_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.queue_breakdown(queue.split_skipped(_items(spark, sf_dir), _skipped(spark, sf_dir)))


QUEUES = """q AS (SELECT l_orderkey AS k, list(CAST(l_linenumber AS VARCHAR) ORDER BY l_linenumber) AS ids
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1),
m AS (SELECT k, list_filter(ids, lambda x: x IN ('2', '4')) AS picked, list_filter(ids, lambda x: x NOT IN ('2', '4')) AS rest FROM q)"""


@query(f"""WITH {QUEUES} SELECT k, 'top' AS how, list_concat(picked, rest) AS queue_order FROM m UNION ALL SELECT k, 'bottom',
  list_concat(rest, picked) FROM m UNION ALL SELECT k, 'purge', rest FROM m""")
def queue_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids moved to the top or bottom of a queue order, or purged (274, 278): the lines of each order."""
    l = tables.table(spark, sf_dir, "lineitem")
    order = l.groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.sort_array(F.collect_set("l_linenumber")), lambda x: x.cast("string")).alias("queue_order"))
    tag = lambda how, df: df.select("k", F.lit(how).alias("how"), "queue_order")
    ids = ["4", "2"]
    return tag("top", queue.moved(order, ids, "top")).union(tag("bottom", queue.moved(order, ids, "bottom"))).union(tag("purge", queue.purged(order, ids)))


@query("""WITH c AS (SELECT p_partkey AS k, 'c' || p_partkey AS name, [p_brand, p_type] AS ids, CASE WHEN p_size % 2 = 0 THEN p_name END AS description FROM part)
SELECT a.name, list_concat(a.ids, list_filter(b.ids, lambda x: NOT list_contains(a.ids, x))) AS ids, coalesce(a.description, b.description) AS description
FROM c a JOIN c b ON b.k = a.k + 1 WHERE a.k % 2 = 0""")
def cluster_membership_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters merged with the one after them: united members, the first description there is (277)."""
    p = tables.table(spark, sf_dir, "part")
    name = F.concat(F.lit("c"), F.col("p_partkey").cast("string"))
    clusters = p.select(name.alias("name"), F.array("p_brand", "p_type").alias("ids"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("description"))
    merges = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("c"), (F.col("p_partkey") + 1).cast("string")).alias("source"), name.alias("name"))
    return queue.merged_members(clusters, merges)
