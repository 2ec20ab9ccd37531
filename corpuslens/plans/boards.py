"""Queries of the queue views, scorecards, assessments, commits and directory rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import boards, code_rules, graph, queue
from corpuslens.plans.findings import _values
from corpuslens.plans.queue import ITEMS, KEY, SKIPPED, _items, _skipped
from corpuslens.plans.registry import query
from corpuslens.plans.scores import DIMS, _dims
from corpuslens.sources import made, tables
from corpuslens.sources.tables import WORK

BOARD = ITEMS + f""", s AS ({SKIPPED}),
board AS (SELECT i.*, s.finding_id IS NOT NULL AS is_skipped FROM items i LEFT JOIN (SELECT DISTINCT finding_id
  FROM s) s USING (finding_id))"""


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.split_skipped(_items(spark, sf_dir), _skipped(spark, sf_dir))


PARTS = """
WITH files AS (SELECT 'parts/' || p_brand || '/' || p_size || '/' || p_partkey || '.py' AS path,
  'parts/' || p_brand AS brand, 'parts/' || p_brand || '/' || p_size AS dir FROM part),
leaf AS (SELECT brand AS parent, dir, count(*) AS n_files, 0 AS n_children FROM files GROUP BY ALL),
dirs AS (
  SELECT parent, dir, n_files, n_children FROM leaf
  UNION ALL SELECT 'parts', parent, 0, count(*) FROM leaf GROUP BY parent
  UNION ALL SELECT NULL, 'parts', 0, count(DISTINCT parent) FROM leaf)"""


def _part_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.table(spark, sf_dir, "part")
    path = F.concat_ws("/", F.lit("parts"), "p_brand", F.col("p_size").cast("string"), F.concat(F.col("p_partkey").cast("string"), F.lit(".py")))
    return boards.child_dirs(part.select(path.alias("path")))


@query(PARTS + """, c AS (
  SELECT parent AS dir, count(*) AS n_children, count(*) FILTER (n_files <= 2 AND n_children = 0) AS n_sparse
  FROM dirs WHERE parent IS NOT NULL GROUP BY parent)
SELECT * FROM c WHERE n_children >= 8 AND n_sparse >= 6 AND n_sparse * 100 >= n_children * 70""")
def fragmented_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand and size: brands most of whose sizes hold two files at most (99)."""
    return boards.fragmented_dirs(_part_dirs(spark, sf_dir), sparse_files=2)


@query(PARTS + """, c AS (SELECT parent, count(*) AS n_siblings FROM dirs WHERE parent IS NOT NULL GROUP BY parent
  HAVING count(*) >= 10)
SELECT dir, n_siblings FROM dirs JOIN c USING (parent) WHERE split_part(dir, '/', -1) IN ('7', '11', '23', '40')
  AND n_files + n_children = 1""")
def thin_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of certain names with one item among at least ten siblings (100)."""
    return boards.thin_wrappers(_part_dirs(spark, sf_dir), ["7", "11", "23", "40"])


TARGETS = [("./area1/mod1/f1",), ("../lib/f25",), ("f49.py",), ("x/f37.py",), ("mod2/f2",), ("f13",), ("area0/mod0/f60.py",), ("./",), ("other",)]


@query(f"""WITH {WORK}, files AS (SELECT DISTINCT file AS path FROM work WHERE file <> '.'),
t AS (SELECT DISTINCT regexp_replace(target, '^[./]+', '') AS r FROM {_values(TARGETS)} v(target)),
f AS (SELECT path, regexp_replace(path, '\\.[^./]*$', '') AS bare, split_part(path, '/', -1) AS name,
  regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS stem FROM files)
SELECT DISTINCT path FROM f, t WHERE r <> '' AND (r = bare OR r = path OR ends_with(bare,
  r) OR r = stem OR ends_with(r, '/' || stem) OR ends_with(r, '/' || name))""")
def dynamic_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a dynamic import names in one of five ways (92)."""
    files = tables.work_items(spark, sf_dir).where("file <> '.'").select(F.col("file").alias("path")).distinct()
    return boards.dynamically_imported(files, spark.createDataFrame(TARGETS, "target string"))


@query(f"""WITH {WORK} SELECT finding_id, reopen_count FROM work WHERE NOT suppressed
  AND (file = 'area3' OR starts_with(file, 'area3/')) AND status = 'open' AND reopen_count >= 2""")
def queue_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chronic open findings below a path (258)."""
    return boards.matching(tables.work_items(spark, sf_dir), "area3", "open", 2).select("finding_id", "reopen_count")


@query(f"""WITH {WORK} SELECT finding_id, row_number() OVER (ORDER BY ord * 7 % 1000, finding_id) AS rank FROM work
  WHERE status = 'open' AND NOT suppressed AND ord % 3 = 0 AND ord % 5 <> 0""")
def execution_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan's items in its order (255): a third of the open findings are planned, some of them skipped."""
    w = tables.work_items(spark, sf_dir).where((F.col("status") == "open") & ~F.col("suppressed"))
    planned = w.withColumns({"position": F.when(F.col("ord") % 3 == 0, F.col("ord") * 7 % 1000), "is_skipped": F.col("ord") % 5 == 0})
    return boards.execution(planned).select("finding_id", "rank")


@query(f"""WITH {WORK} SELECT count(*) FILTER (ord % 4 = 0) AS described, count(*) FILTER (ord % 6 = 0) AS noted, count(*) AS n FROM work WHERE ord % 3 = 0""")
def annotation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned items with a description and with a note; blanks are none (220)."""
    plan = tables.work_items(spark, sf_dir).where("ord % 3 = 0")
    text = F.when(F.col("ord") % 4 == 0, F.concat(F.lit("see "), "name")).when(F.col("ord") % 4 == 1, "  ")
    return boards.annotations(plan.select(text.alias("description"), F.when(F.col("ord") % 6 == 0, F.col("file")).alias("note")))


@query(BOARD + f", b AS (SELECT finding_id, impact, CAST(row_number() OVER (ORDER BY {KEY}) AS INTEGER) AS rank FROM board WHERE position IS NULL AND NOT is_skipped) SELECT * FROM b WHERE rank <= 50")
def backlog_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 unplanned items (256)."""
    return boards.backlog(_board(spark, sf_dir), 50).select("finding_id", "impact", "rank")


@query(BOARD + """ SELECT finding_id, CASE WHEN detector = 'review' THEN 'review' ELSE 'issue' END AS kind, impact,
  CASE confidence WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END AS confidence_rank,
  CASE WHEN detector = 'review' THEN CASE confidence WHEN 'high' THEN 1 WHEN 'low' THEN 3 ELSE 2 END
  END AS review_weight,
  'estimated_impact desc,confidence asc,' || CASE WHEN detector = 'review' THEN 'review_weight desc,' ELSE ''
  END || 'count desc,id asc' AS factors
FROM board""")
def explained_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each open item is ranked by (253, 257)."""
    return boards.explained(_board(spark, sf_dir))


@query(BOARD + """ SELECT CASE WHEN is_skipped THEN 'postponed' WHEN position IS NOT NULL THEN 'execute'
  WHEN is_new THEN 'triage'
  WHEN reopen_count > 0 THEN 'rescan' ELSE 'backlog' END AS phase, count(*) AS n, count(position) AS n_planned
  FROM board GROUP BY 1""")
def phase_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open items by the phase that they wait for (242)."""
    return boards.phase_snapshot(_board(spark, sf_dir))


@query(BOARD + " SELECT split_part(file, '/', 1) AS dimension, count(*) AS n FROM board WHERE position IS NULL AND NOT is_skipped GROUP BY 1")
def lifecycle_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, unplanned, unskipped items by area (226)."""
    return boards.inventory(_board(spark, sf_dir), F.element_at(F.split("file", "/"), 1))


CARD = DIMS + """, card AS (
  SELECT dimension, max(score) FILTER (mode = 'lenient') AS score, max(score) FILTER (mode = 'strict') AS strict,
    CAST(max(checks) FILTER (mode = 'strict') AS BIGINT) AS checks,
  CAST(max(failing) FILTER (mode = 'strict') AS BIGINT) AS failing FROM dims GROUP BY dimension)"""


def _card(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda mode, c, name: F.max(F.when(F.col("mode") == mode, F.col(c))).alias(name)
    pairs = [of("lenient", "score", "score"), of("strict", "score", "strict"), of("strict", "checks", "checks"), of("strict", "failing", "failing")]
    return _dims(spark, sf_dir).groupBy("dimension").agg(*pairs)


@query(CARD + " SELECT dimension, score, strict, checks, failing FROM card WHERE checks > 0")
def scorecard_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorecard's rows: the dimensions with checks, in both readings (259)."""
    return _card(spark, sf_dir).where("checks > 0")


@query(CARD + """ SELECT dimension, score, strict, checks, failing FROM card WHERE dimension NOT IN ('Code quality',
  'Duplication')
UNION ALL SELECT 'Elegance', round(avg(score), 1), round(avg(strict), 1), CAST(sum(checks) AS BIGINT),
  CAST(sum(failing) AS BIGINT)
FROM card WHERE dimension IN ('Code quality', 'Duplication') HAVING count(*) > 0""")
def scorecard_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component dimensions as one row (260)."""
    return boards.collapsed(_card(spark, sf_dir), ["Code quality", "Duplication"], "Elegance")


SUBJECTIVE = ["Test health", "Security"]


@query(CARD + f""", r AS (SELECT dimension, CAST(row_number() OVER (ORDER BY is_subjective, place, CASE
  WHEN is_subjective THEN strict END, dimension) AS INTEGER) AS rank
  FROM (SELECT *, dimension IN ('Test health', 'Security', 'Code quality', 'Duplication') AS is_subjective,
    CASE dimension WHEN 'Test health' THEN 1 WHEN 'Security' THEN 2 ELSE 3 END AS place FROM card)) SELECT * FROM r
  WHERE rank <= 4""")
def scorecard_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most four rows: mechanical dimensions, then subjective ones in order, then the lowest (261)."""
    marked = _card(spark, sf_dir).withColumn("is_subjective", F.col("dimension").isin("Test health", "Security", "Code quality", "Duplication"))
    return boards.capped(marked, SUBJECTIVE, 4)


@query("""WITH i AS (SELECT trim(lower(CASE doc_id % 5 WHEN 0 THEN ' Naming Quality' WHEN 1 THEN 'naming-quality'
  WHEN 2 THEN 'Logic' WHEN 3 THEN '' ELSE 'area ' || doc_id % 3 END)) AS d,
    CAST(quality * 130 - toxic * 20 + doc_id % 50 AS DOUBLE) AS score, CASE
  WHEN doc_id % 7 = 0 THEN 'holistic' ELSE 'per_file' END AS source, doc_id AS seen FROM labels),
k AS (SELECT regexp_replace(d, '[\\s-]+', '_', 'g') AS dimension, greatest(0.0, least(100.0, score)) AS score,
  source, seen FROM i WHERE d <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY source = 'holistic' DESC, seen DESC) AS k FROM k)
SELECT dimension, CAST(score AS DOUBLE) AS score, source FROM n WHERE k = 1""")
def assessment_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as imported assessments, the last of each dimension kept (282)."""
    labels, at = tables.table(spark, sf_dir, "labels"), F.col("doc_id")
    name = F.when(at % 5 == 0, " Naming Quality").when(at % 5 == 1, "naming-quality").when(at % 5 == 2, "Logic").when(at % 5 == 3, "").otherwise(F.concat(F.lit("area "), at % 3))
    score = (F.col("quality") * 130 - F.col("toxic") * 20 + at % 50).cast("double")
    source = F.when(at % 7 == 0, "holistic").otherwise("per_file")
    return boards.stored_assessments(labels.select(name.alias("dimension"), score.alias("score"), source.alias("source"), at.alias("at")))


ASSESSED = [("area1", "holistic", False), ("area2", "holistic", True), ("area3", "scan_reset_subjective", False), ("area4", "per_file", False)]


@query(f"""WITH {WORK} SELECT finding_id, CASE WHEN fixed THEN 'fixed' ELSE status END AS status, CASE
  WHEN fixed THEN 'completed by review import' END AS note
FROM (SELECT *, status = 'open' AND detector = 'review' AND split_part(file, '/', 1) IN ('area1', 'area4') AS fixed
  FROM work)""")
def coverage_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage markers of areas that an import assessed (281)."""
    real = spark.createDataFrame(ASSESSED, "dimension string, source string, placeholder boolean")
    return boards.resolved_coverage(tables.work_items(spark, sf_dir), F.element_at(F.split("file", "/"), 1), real)


COMMITS = """WITH commits AS (SELECT event_id AS sha, CASE WHEN event_id % 11 <> 0 THEN ts END AS recorded_at, CASE
  WHEN user_id % 3 <> 0 THEN 'cluster' || user_id % 40 END AS cluster,
  CAST(1 + event_id % 4 AS BIGINT) AS n_items, 'note ' || event_id AS note FROM events WHERE event_type = 'purchase')"""


@query(COMMITS + """, names AS (SELECT DISTINCT cluster FROM commits WHERE cluster IS NOT NULL
  ORDER BY cluster LIMIT 10)
SELECT count(*) AS n_commits, CAST(sum(n_items) AS BIGINT) AS n_items,
  count(*) FILTER (recorded_at IS NULL OR recorded_at >= TIMESTAMP '2024-01-15' - INTERVAL 7 DAY) AS n_recent,
  (SELECT string_agg(cluster, ',' ORDER BY cluster) FROM names) AS clusters, (SELECT note FROM commits
  WHERE recorded_at IS NOT NULL ORDER BY recorded_at DESC, sha DESC LIMIT 1) AS note FROM commits""")
def commit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a commit log, its last days, first clusters and latest note (225, 219)."""
    e = tables.table(spark, sf_dir, "events").where("event_type = 'purchase'")
    commits = e.select(
        F.col("event_id").alias("sha"), F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("recorded_at"),
        F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("cluster"), F.col("user_id") % 40)).alias("cluster"),
        (F.col("event_id") % 4 + 1).alias("n_items"), F.concat(F.lit("note "), "event_id").alias("note"),
    )
    return boards.commit_history(commits, "2024-01-15", 7)


@query("""WITH b AS (SELECT source, CAST(count(l.doc_id) AS DOUBLE) / count(*) AS coverage,
  CAST(sum(coalesce(quality, 0)) AS DOUBLE) / count(*) AS density
  FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source) SELECT count(*) AS n_batches,
  round(avg(coverage), 3) AS coverage, round(avg(density), 3) AS density FROM b""")
def review_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as review batches: mean share of labelled documents and mean evidence (208)."""
    docs, labels = tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels")
    share = lambda c: F.sum(c) / F.count(F.lit(1))
    rows = docs.select("doc_id", "source").join(labels.select("doc_id", "quality"), "doc_id", "left")
    batches = rows.groupBy("source").agg(share(F.col("quality").isNotNull().cast("int")).alias("coverage"), share(F.coalesce("quality", F.lit(0))).alias("density"))
    return boards.batch_quality(batches)


@query(f"""WITH {WORK} SELECT detector AS dimension, 1 + count(DISTINCT file) + count(*) AS weight FROM work
  WHERE status = 'open' GROUP BY detector""")
def evidence_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of dimensions by their evidence (files) and issues (203)."""
    return boards.evidence_weights(tables.work_items(spark, sf_dir).where("status = 'open'").select(F.col("detector").alias("dimension"), F.col("file").alias("evidence")))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_quantity >= 45),
  u AS (SELECT dst AS node, min(src) AS "user" FROM e WHERE src <> dst GROUP BY dst HAVING count(*) = 1)
SELECT node, "user" FROM u JOIN part ON p_partkey = node WHERE NOT p_size * 10 BETWEEN 50 AND 200
  AND node % 4 <> "user" % 4 AND p_brand <> 'Brand#1'""")
def single_use_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that one supplier sells, without those of middle size, of the supplier's own area or of a skipped brand (94)."""
    sold = tables.table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    part = tables.table(spark, sf_dir, "part")
    used = graph.single_use(sold).join(part, F.col("node") == part["p_partkey"])
    areas = used.select("node", "user", (F.col("p_size") * 10).alias("loc"), (F.col("node") % 4).alias("area"), (F.col("user") % 4).alias("user_area"), F.col("p_brand").alias("place"))
    return boards.single_use_issues(areas, skipped=["Brand#1"])


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE props END AS kind, value AS weight
  FROM events""")
def migrated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under an old schema: legacy columns renamed, new values win (67)."""
    e = tables.table(spark, sf_dir, "events")
    old = e.select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"), F.col("props").alias("type"), F.col("value").alias("score"))
    return boards.migrated(old, {"type": "kind", "score": "weight"})


PHASES = [("smells", False, False), ("dupes", True, False), ("security", True, False), ("review", False, True), ("cycles", False, False)]


@query(f"""WITH {WORK}, p AS (SELECT phase FROM {_values(PHASES)} v(phase, is_slow, is_subjective) WHERE NOT is_slow
  AND NOT is_subjective)
SELECT phase, count(finding_id) AS n FROM p LEFT JOIN work ON detector = phase GROUP BY phase""")
def phase_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the phases that a fast objective run holds (60)."""
    chosen = boards.selected_phases(spark.createDataFrame(PHASES, "phase string, is_slow boolean, is_subjective boolean"), False, "objective")
    w = tables.work_items(spark, sf_dir)
    return chosen.join(w, chosen["phase"] == w["detector"], "left").groupBy("phase").agg(F.count("finding_id").alias("n"))


_nested = "\n".join(["<AProvider>", "<BProvider x={1}>", "<CProvider>", "<DProvider />", "<DProvider>", "</XProvider>", "<EProvider><FProvider>", "</FProvider></EProvider>", "</DProvider>"])
_busy = "return (\n<div>\nfetch('/a')\nx.map(f)\ny.filter(g)\nz.sort()\n" + "const handleA = 1\n" * 5 + "\n" * 100
COMPONENTS = [
    ("web{k}/app.tsx", "typescript", _nested), ("web{k}/busy.tsx", "typescript", _busy), ("web{k}/short.tsx", "typescript", _busy.strip()),
    ("web{k}/log.ts", "typescript", "console.log('[Auth] in')\nconsole.info(`${DebugTag} x [y]`)\nconsole.warn(`${LOG} x`)\nconsole.log('plain')\nconsole.debug(\"🔍 [Net] x\")"),
]


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, and a few component files for each part, as the tables hold none."""
    docs = tables.documents(spark, sf_dir).select("path", F.lit("text").alias("lang"), "text")
    return docs.union(made.projects(spark, sf_dir, COMPONENTS))


_files_sql = "(SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, text FROM documents UNION ALL SELECT replace(path, '{k}', CAST(p_partkey AS VARCHAR)), text FROM part, " + _values([(p, t) for p, _, t in COMPONENTS]) + " v(path, text))"
_q = "'" + code_rules.LOG_TAG.replace("'", "''") + "'"
_v = "'" + code_rules.LOG_TAG_VARIABLE.replace("'", "''") + "'"


@query(f"""WITH l AS (SELECT path, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM (SELECT path,
  string_split(text, chr(10)) AS ls FROM {_files_sql}))
SELECT path, CAST(line_no AS INTEGER) AS line_no, coalesce(nullif(regexp_extract(line, '\\[([^\\]]+)\\]', 1), ''),
  'unknown') AS tag
FROM l WHERE regexp_matches(line, {_q}) OR regexp_matches(line, {_v})""")
def tagged_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with a tag (140)."""
    return code_rules.tagged_logs(_components(spark, sf_dir))


_concern = [f"CASE WHEN len(regexp_extract_all(text, '{p}')) >= {n} THEN '{name}' END" for name, p, n in code_rules.CONCERNS]


@query(f"""WITH f AS (SELECT path, list_filter([{", ".join(_concern)}], lambda x: x IS NOT NULL) AS c,
  CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text,
  chr(10)) THEN 1 ELSE 0 END END AS loc FROM {_files_sql})
SELECT path, loc, array_to_string(c, ',') AS concerns, CAST(len(c) AS INTEGER) AS n_concerns FROM f WHERE loc >= 100
  AND len(c) >= 3""")
def component_concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component files that mix at least three kinds of concerns (141)."""
    return code_rules.mixed_concerns(_components(spark, sf_dir))


@query("""SELECT 'web' || p_partkey || '/app.tsx' AS path, 6 AS depth,
  'AProvider,BProvider,CProvider,DProvider,EProvider,FProvider' AS names FROM part""")
def context_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with more than five nested context providers (143); also tested against a loop."""
    return code_rules.context_nesting(_components(spark, sf_dir))
