"""Queries of the planning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import duplicates, planning
from corpuslens.operators.graph import checkpointed
from corpuslens.plans.corpus import COMMON
from corpuslens.plans.findings import _values
from corpuslens.plans.registry import query
from corpuslens.plans.scores import CATALOG, CATALOG_SQL, DIMS, _dims
from corpuslens.sources import tables
from corpuslens.sources.tables import DOCS, EDGES, WORK

DEFAULTS = [("Code quality",), ("Security",), ("Duplication",), ("Naming",)]
SCORED = [("Security", 120.5), ("Naming", -3.0), ("Extra", 55.0)]


@query(f"""WITH {WORK}, o AS (SELECT dimension, count(*) AS failing FROM work JOIN {CATALOG_SQL} USING (detector) WHERE status
  = 'open' GROUP BY dimension), j AS (SELECT dimension, score FROM {_values(DEFAULTS)} d(dimension) FULL JOIN
  {_values(SCORED)} s(dimension, score) USING (dimension)) SELECT dimension, CAST(least(100.0, greatest(0.0,
  coalesce(score, 0.0))) AS DOUBLE) AS score, score IS NULL AS placeholder, coalesce(failing, 0) AS failing FROM j
  LEFT JOIN o USING (dimension)""")
def subjective_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default and assessed dimensions with clamped scores and open reviews (187, 200)."""
    reviews = tables.work_items(spark, sf_dir).join(spark.createDataFrame(CATALOG, "detector string, dimension string"), "detector")
    return planning.subjective_entries(spark.createDataFrame(DEFAULTS, "dimension string"), spark.createDataFrame(SCORED, "dimension string, score double"), reviews)


@query(DIMS + ", b AS (SELECT * FROM (VALUES ('Security', 10.0), ('Gone', 33.0)) v(dimension, score)), n AS (SELECT * FROM dims WHERE mode = 'strict') SELECT dimension, CAST(coalesce(n.score, b.score) AS DOUBLE) AS score, n.score IS NULL AS carried FROM n FULL JOIN b USING (dimension)")
def carried_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = spark.createDataFrame([("Security", 10.0), ("Gone", 33.0)], "dimension string, score double")
    return planning.carried_forward(before, _dims(spark, sf_dir).where("mode = 'strict'"))


@query(f"""WITH {WORK}, r AS (SELECT detector, CAST(count(*) FILTER (status = 'open') AS DOUBLE) / count(*) AS confidence FROM
  work GROUP BY detector) SELECT dimension, min(confidence) AS confidence,
  array_to_string(list_sort(list_distinct(list(detector))), ',') AS detectors FROM r JOIN {CATALOG_SQL} USING
  (detector) GROUP BY dimension""")
def coverage_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions whose detectors see less: the share of open findings stands for what a detector could cover (191)."""
    seen = F.count_if(F.col("status") == "open").cast("double") / F.count(F.lit(1))
    reduced = tables.work_items(spark, sf_dir).groupBy("detector").agg(seen.alias("confidence"))
    return planning.coverage_confidence(reduced, spark.createDataFrame(CATALOG, "detector string, dimension string"))


@query(DIMS + " SELECT dimension, score FROM dims WHERE mode = 'strict' ORDER BY score, dimension LIMIT 3")
def lowest_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.lowest(_dims(spark, sf_dir).where("mode = 'strict'").select("dimension", "score"), 3)


@query(DIMS + f", w AS (SELECT dimension, max(score) FILTER (mode = 'lenient') - max(score) FILTER (mode = 'strict') AS gap FROM dims GROUP BY dimension), a AS (SELECT dimension, count(*) AS n FROM work JOIN {CATALOG_SQL} USING (detector) WHERE status = 'wontfix' GROUP BY dimension) SELECT dimension, gap, coalesce(n, 0) AS n FROM w LEFT JOIN a USING (dimension) WHERE gap > 1")
def biggest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions whose lenient score is over the strict one, with set-aside findings (236)."""
    catalog = spark.createDataFrame(CATALOG, "detector string, dimension string")
    aside = tables.work_items(spark, sf_dir).where("status = 'wontfix'").join(catalog, "detector").groupBy("dimension").agg(F.count(F.lit(1)).alias("n"))
    return planning.gaps(_dims(spark, sf_dir), aside, 1.0)


ACTIONS = [("smells", "auto_fix"), ("naming", "reorganize"), ("security", "manual_fix")]


@query(f"""WITH {WORK}, o AS (SELECT detector, count(*) AS n FROM work WHERE status = 'open' GROUP BY detector), s AS (SELECT
  CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN action = 'auto_fix' THEN n ELSE 0 END) AS BIGINT) AS fixable
  FROM o LEFT JOIN {_values(ACTIONS)} a(detector, action) USING (detector)) SELECT total, fixable, CAST(fixable AS
  DOUBLE) / total AS share FROM s""")
def fixer_leverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tables.work_items(spark, sf_dir).where("status = 'open'").groupBy("detector").agg(F.count(F.lit(1)).alias("n"))
    return planning.leverage(counts, spark.createDataFrame(ACTIONS, "detector string, action string"))


RISKS = [("much_debt", "debt", 0.2, 2), ("many_reopened", "reopened", 0.9, 1), ("suppression", "hidden", 0.01, 3)]


@query(f"""WITH {WORK}, t AS (SELECT CAST(count(*) FILTER (status = 'wontfix') AS DOUBLE) / count(*) AS debt, CAST(count(*)
  FILTER (reopen_count > 0) AS DOUBLE) / count(*) AS reopened, CAST(count(*) FILTER (suppressed) AS DOUBLE) /
  count(*) AS hidden FROM work) SELECT 'much_debt' AS flag, 2 AS severity FROM t WHERE debt > 0.2 UNION ALL SELECT
  'many_reopened', 1 FROM t WHERE reopened > 0.9 UNION ALL SELECT 'suppression', 3 FROM t WHERE hidden > 0.01""")
def risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    totals = tables.work_items(spark, sf_dir).agg(share(F.col("status") == "wontfix").alias("debt"), share(F.col("reopen_count") > 0).alias("reopened"), share(F.col("suppressed")).alias("hidden"))
    return planning.risk_flags(totals, RISKS)


@query(f"""WITH {WORK}, d AS (SELECT file AS fingerprint, count(*) AS n, count(*) FILTER (status = 'open') AS k FROM work WHERE
  tier = 1 GROUP BY file) SELECT fingerprint, n FROM d WHERE k > 0""")
def live_dismissals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dismissals that still have an open source (215)."""
    w = tables.work_items(spark, sf_dir)
    dismissed = w.where("tier = 1").groupBy("file").agg(F.collect_list("finding_id").alias("sources")).withColumnRenamed("file", "fingerprint")
    return planning.live_dismissals(dismissed, w).select("fingerprint", F.size("sources").cast("long").alias("n"))


@query(f"""WITH {WORK}, c AS (SELECT DISTINCT 'file::' || file AS fingerprint, 'file' AS kind FROM work WHERE status = 'open'
  AND detector = 'smells' UNION ALL SELECT DISTINCT 'detector::' || detector, 'systemic' FROM work WHERE status =
  'open') SELECT fingerprint, min(kind) AS kind FROM c WHERE fingerprint NOT IN (SELECT 'file::' || file FROM work
  WHERE tier = 1) GROUP BY fingerprint""")
def concern_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concerns of files and detectors without repeats and dismissed ones (214)."""
    w = tables.work_items(spark, sf_dir)
    mark = lambda df, kind, c: df.select(F.concat(F.lit(f"{kind}::"), c).alias("fingerprint"), F.lit("systemic" if kind == "detector" else kind).alias("kind"))
    parts = [mark(w.where("status = 'open' AND detector = 'smells'"), "file", "file"), mark(w.where("status = 'open'"), "detector", "detector")]
    return planning.concern_set(parts, mark(w.where("tier = 1"), "file", "file").select("fingerprint").distinct())


LANES = """e AS (SELECT DISTINCT o_custkey AS action, l_partkey AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_quantity >= 46 AND l_discount = 0)"""


@query(f"""WITH RECURSIVE {LANES}, l AS (SELECT DISTINCT x.action AS a, y.action AS b FROM e x JOIN e y USING (file)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b) SELECT a AS action, min(b) AS lane FROM r GROUP BY a""")
def overlap_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions joined into lanes by shared files (228): customers and the parts of their large sales."""
    l = tables.table(spark, sf_dir, "lineitem").where("l_quantity >= 46 AND l_discount = 0")
    sold = l.join(tables.table(spark, sf_dir, "orders"), l["l_orderkey"] == F.col("o_orderkey"))
    return planning.lanes(sold.select(F.col("o_custkey").alias("action"), F.col("l_partkey").alias("file")).distinct())


@query(f"""WITH {EDGES}, s AS (SELECT n_nationkey AS dir, count(c_custkey) AS n_files, CAST(coalesce(sum(length(c_name)), 0) AS BIGINT) AS loc FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
 r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM edges WHERE src <> dst), t AS (SELECT src, array_to_string(list(CAST(dst AS VARCHAR) ORDER BY k), ',') AS neighbours FROM r WHERE k <= 3 GROUP BY src)
 SELECT dir, n_files, loc, coalesce(neighbours, '') AS neighbours FROM s LEFT JOIN t ON src = dir""")
def directory_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as directories: members, sizes and the three closest neighbours (196)."""
    c = tables.table(spark, sf_dir, "customer")
    files = c.select(F.col("c_nationkey").alias("dir"), F.length("c_name").cast("long").alias("loc"))
    return planning.directory_profiles(files, tables.trade_edges(spark, sf_dir), 3)


@query(f"""WITH RECURSIVE p AS ({COMMON.format(cut="[ \\n]+")}), b AS (SELECT doc_a AS x, doc_b AS y FROM p UNION SELECT doc_b, doc_a FROM p),
r(x, y) AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y), m AS (SELECT x AS node, least(x, min(y)) AS root FROM r GROUP BY x),
s AS (SELECT root, count(*) AS size FROM m GROUP BY root), o AS (SELECT root, doc_a, doc_b, common, row_number() OVER (PARTITION BY root
  ORDER BY common DESC, doc_a, doc_b) AS k FROM p JOIN m ON node = doc_a)
SELECT root, size, doc_a, doc_b, CAST(common AS DOUBLE) AS ratio FROM o JOIN s USING (root) WHERE k = 1""")
def duplicate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pair and the size of each cluster of documents that share most of their words (77)."""
    words = tables.documents(spark, sf_dir).withColumn("text", F.regexp_replace("text", "[ \n]+", "\n"))
    pairs = checkpointed(duplicates.common_lines(words).withColumn("ratio", F.col("common").cast("double")))
    return planning.best_pair(pairs, duplicates.clusters(pairs))


@query(f"""WITH {DOCS}, same AS (SELECT doc_id FROM docs WHERE lang <> 'fr'), f AS (SELECT md5(text) AS digest, min(doc_id) AS
  doc_a FROM docs GROUP BY 1), p AS (SELECT doc_a, doc_id AS doc_b FROM docs JOIN f ON md5(text) = digest WHERE
  doc_id > doc_a) SELECT doc_a, doc_b FROM p WHERE doc_a IN (SELECT doc_id FROM same) AND doc_b IN (SELECT doc_id
  FROM same)""")
def reused_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached pairs whose units did not change; French texts stand for changed ones (79)."""
    docs = tables.documents(spark, sf_dir)
    digest = F.md5(F.col("text").cast("binary"))
    units = docs.select("doc_id", digest.alias("digest"), T.line_count(F.col("text")).alias("loc"), "lang")
    first = units.groupBy("digest").agg(F.min("doc_id").alias("doc_a"))
    pairs = units.join(first, "digest").where("doc_id > doc_a").select("doc_a", F.col("doc_id").alias("doc_b"))
    now = units.withColumn("digest", F.when(F.col("lang") == "fr", "changed").otherwise(F.col("digest")))
    return planning.reusable_pairs(pairs, units.select("doc_id", "digest", "loc"), now.select("doc_id", "digest", "loc")).select("doc_a", "doc_b")


RENAMED = [("gone::1", "smells::area8/mod8/f428.py::o8"), ("gone::2", None)]


@query(f"""WITH {WORK}, p AS (SELECT finding_id FROM work WHERE tier = 1 AND status = 'open' UNION ALL SELECT 'gone::1' UNION
  ALL SELECT 'gone::2') SELECT finding_id, CASE WHEN finding_id IN (SELECT finding_id FROM work) THEN 'kept' WHEN
  new_id IS NOT NULL THEN 'renamed' ELSE 'dead' END AS state, new_id FROM p LEFT JOIN {_values(RENAMED)}
  r(finding_id, new_id) USING (finding_id)""")
def reconciled_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned ids after a scan: kept, renamed or dead (270)."""
    w = tables.work_items(spark, sf_dir)
    plan = w.where("tier = 1 AND status = 'open'").select("finding_id").union(spark.createDataFrame([("gone::1",), ("gone::2",)], "finding_id string"))
    return planning.reconciled(plan, w, spark.createDataFrame(RENAMED, "finding_id string, new_id string"))


@query(f"""WITH {WORK}, p AS (SELECT finding_id, ord * 7 % 1000 AS position, CASE WHEN ord % 10 = 0 THEN 'renamed' ELSE 'kept' END AS step FROM work
    WHERE tier = 1 AND status = 'open'),
n AS (SELECT finding_id, NULL AS position, 'appended' AS step FROM work WHERE status = 'open' AND detector = 'review' AND tier > 2),
a AS (SELECT * FROM p UNION ALL SELECT * FROM n)
SELECT finding_id, row_number() OVER (ORDER BY position NULLS LAST, finding_id) AS rank, step FROM a""")
def reconciled_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan after a scan, in ordered passes (271): some of its ids are old ones, some twice, some without a finding."""
    w = tables.work_items(spark, sf_dir)
    planned, turn, place = w.where("tier = 1 AND status = 'open'"), F.col("ord") % 10, F.col("ord") * 7 % 1000
    old = F.concat(F.lit("old::"), "finding_id")
    plan = planned.select(F.when(turn == 0, old).otherwise(F.col("finding_id")).alias("finding_id"), place.alias("position"))
    again = planned.where(turn == 5).select("finding_id", (place + 5).alias("position"))
    gone = planned.where(turn == 3).select(F.concat(F.lit("gone::"), "finding_id").alias("finding_id"), place.alias("position"))
    renamed = planned.where(turn == 0).select(old.alias("finding_id"), F.col("finding_id").alias("new_id"))
    return planning.reconcile(plan.union(again).union(gone), w, renamed, w.where("tier <= 2").select("finding_id"))


@query(f"""WITH {WORK} SELECT finding_id FROM work WHERE status = 'open' AND detector = 'review' AND finding_id NOT IN (SELECT
  finding_id FROM work WHERE tier <= 2)""")
def new_review_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.work_items(spark, sf_dir)
    return planning.new_review_ids(w, w.where("tier <= 2").select("finding_id"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'imported' ELSE 'cached' END AS origin FROM labels")
def upserted_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review cache with imported rows put over the cached ones (282, 283)."""
    labels = tables.table(spark, sf_dir, "labels")
    cached = labels.select("doc_id", F.lit("cached").alias("origin"))
    return planning.upserted(cached, labels.where("quality = 1").select("doc_id", F.lit("imported").alias("origin")), "doc_id")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN [p_brand, p_type] ELSE [p_brand, p_type, 'size ' || p_size] END AS evidence,
  CASE WHEN length(p_type) > length(p_name) THEN p_type ELSE p_name END AS summary FROM part""")
def merged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists merged in order, a missing one empty, the longer text kept (284, 285)."""
    p = tables.table(spark, sf_dir, "part")
    other = F.when(F.col("p_size") % 3 != 0, F.array("p_type", F.concat(F.lit("size "), F.col("p_size").cast("string")), "p_brand"))
    merged = planning.merged_lists(F.array("p_brand", "p_type", "p_brand"), other)
    return p.select(F.col("p_partkey").alias("id"), merged.alias("evidence"), planning.longer(F.col("p_name"), F.col("p_type")).alias("summary"))


@query(f"""WITH {WORK} SELECT tier, CASE WHEN grouping(tier) = 0 THEN 'tier' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'all' END
  AS level, lang, count(*) AS n FROM work WHERE status = 'open' AND detector = 'review' GROUP BY GROUPING SETS ((),
  (tier), (lang))""")
def open_review_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open reviews in all, by tier and by language, in one pass (199)."""
    w = tables.work_items(spark, sf_dir).where("status = 'open' AND detector = 'review'")
    level = F.when(F.grouping("tier") == 0, "tier").when(F.grouping("lang") == 0, "lang").otherwise("all")
    return w.groupingSets([[], ["tier"], ["lang"]], "tier", "lang").agg(F.count(F.lit(1)).alias("n"), level.alias("level")).select("tier", "level", "lang", "n")


@query(f"""WITH {WORK}, d AS (SELECT dimension, status FROM work JOIN {CATALOG_SQL} USING (detector)) SELECT dimension,
  count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'fixed') AS resolved FROM d GROUP BY
  dimension HAVING count(*) FILTER (status = 'open') > 0 AND count(*) FILTER (status = 'fixed') > 0""")
def recurring_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions with both resolved and open findings (227)."""
    d = tables.work_items(spark, sf_dir).join(spark.createDataFrame(CATALOG, "detector string, dimension string"), "detector")
    return d.groupBy("dimension").agg(F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("status") == "fixed").alias("resolved")).where("open > 0 AND resolved > 0")


@query("""SELECT count(*) FILTER (event_type = 'purchase') AS committed, count(*) FILTER (event_type <> 'purchase') AS
  uncommitted, count(*) AS total, count(*) FILTER (props <> '{\"k\": 0}') AS annotated FROM events""")
def commit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a commit log and its annotations (219, 220)."""
    e = tables.table(spark, sf_dir, "events")
    done = F.col("event_type") == "purchase"
    return e.agg(F.count_if(done).alias("committed"), F.count_if(~done).alias("uncommitted"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("props") != '{"k": 0}').alias("annotated"))


@query(f"""WITH {WORK} SELECT tier, count(*) AS n_open, max(CASE WHEN reopen_count > 0 THEN 1 ELSE 0 END) = 1 AS any_reopened,
  avg(loc) AS mean_loc FROM work WHERE status = 'open' GROUP BY tier""")
def scorecard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a scorecard by tier: counts, means and whether any reopened (259-261)."""
    w = tables.work_items(spark, sf_dir).where("status = 'open'")
    return w.groupBy("tier").agg(F.count(F.lit(1)).alias("n_open"), F.bool_or(F.col("reopen_count") > 0).alias("any_reopened"), F.avg("loc").alias("mean_loc"))


@query("""WITH n AS (SELECT o_custkey AS cust, count(*) FILTER (o_orderdate < TIMESTAMP '1997-01-01') AS before, count(*) AS now,
  date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '1998-08-02') AS age FROM orders GROUP BY 1)
SELECT cust, CAST(age AS DOUBLE) AS age, CAST(now - before AS DOUBLE) / before AS change, age > 30 OR CAST(now - before AS DOUBLE) / before > 0.2 AS stale
FROM n WHERE before > 0""")
def holistic_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review of the whole is stale by age or by a change of a fifth of its files (120): customers and their orders."""
    o = tables.table(spark, sf_dir, "orders")
    before, now = F.count_if(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")), F.count(F.lit(1))
    age = F.date_diff(F.lit("1998-08-02").cast("date"), F.max(F.to_date("o_orderdate"))).cast("double")
    rows = o.groupBy(F.col("o_custkey").alias("cust")).agg(before.alias("before"), now.alias("now"), age.alias("age")).where("before > 0")
    change = F.abs(F.col("now") - F.col("before")) / F.col("before")
    return rows.select("cust", "age", change.alias("change"), ((F.col("age") > 30) | (change > 0.2)).alias("stale"))
