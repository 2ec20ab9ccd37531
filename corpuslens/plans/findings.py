"""Queries of the findings operators over orders as work items, and over small fixed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import findings
from corpuslens.plans.registry import query
from corpuslens.sources import tables
from corpuslens.sources.tables import WORK


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


@query(f"WITH {WORK} SELECT finding_id, detector, file, tier, confidence, status FROM work")
def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with ids made of detector, file and name (62)."""
    w = tables.work_items(spark, sf_dir)
    return w.select(findings.finding_id(F.col("detector"), F.col("file"), F.col("name")).alias("finding_id"), "detector", "file", "tier", "confidence", "status")


@query(f"WITH {WORK} SELECT finding_id FROM work WHERE starts_with(file, 'area3/') OR file = 'area3' OR file = '.'")
def scope_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.work_items(spark, sf_dir).where(findings.in_scope(F.col("file"), "area3")).select("finding_id")


@query(f"""WITH {WORK}, o AS (SELECT starts_with(file, 'area3/') OR file = 'area3' OR file = '.' AS inside FROM work
  WHERE status = 'open' AND NOT suppressed)
 SELECT count(*) FILTER (inside) AS in_scope, count(*) FILTER (NOT inside) AS out_of_scope, count(*) AS global FROM o""")
def scope_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.scope_breakdown(tables.work_items(spark, sf_dir), "area3")


@query(f"""WITH {WORK} SELECT finding_id, status FROM work WHERE NOT suppressed AND status = 'open'
  AND (regexp_matches(finding_id, '^security::area[0-9]*/mod1.*$') OR regexp_matches(file, '^security::area.*$'))""")
def pattern_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open findings that match a glob over ids (48, 51-53)."""
    return findings.select_matching(tables.work_items(spark, sf_dir), "security::area*/mod1*", "open").select("finding_id", "status")


IGNORE = ["smells::area1", "area2/mod2", "*/mod3/*", "dupes::*"]


@query(f"""WITH {WORK}, m AS (SELECT *, CASE WHEN starts_with(finding_id, 'smells::area1') THEN 'smells::area1'
  WHEN file = 'area2/mod2' OR starts_with(file, 'area2/mod2/') THEN 'area2/mod2'
  WHEN regexp_matches(finding_id, '/mod3/') OR regexp_matches(file, '/mod3/') THEN '*/mod3/*'
  WHEN starts_with(finding_id, 'dupes::') THEN 'dupes::*' END AS suppression_pattern FROM work)
 SELECT finding_id, suppression_pattern, suppressed OR suppression_pattern IS NOT NULL AS suppressed FROM m""")
def ignored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppression by the first ignore pattern that hits (49, 50)."""
    return findings.suppressed_by(tables.work_items(spark, sf_dir), IGNORE).select("finding_id", "suppression_pattern", "suppressed")


STANDALONE = [("smells", "medium"), ("structural", "high"), ("naming", "medium"), ("dupes", "medium")]


@query(f"""WITH {WORK}, c AS (SELECT * FROM {_values(STANDALONE)} v(detector, standalone)), r AS (SELECT finding_id,
  CASE confidence WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END AS a,
  CASE standalone WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END AS b, standalone FROM work LEFT
  JOIN c USING (detector)) SELECT finding_id FROM r WHERE standalone IS NULL OR a <= b""")
def evidence_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = spark.createDataFrame(STANDALONE, "detector string, standalone string")
    return findings.standalone(tables.work_items(spark, sf_dir), catalog).select("finding_id")


#: Detectors that a zone switches off.
SKIPS = [("test", d) for d in ("dupes", "test_coverage", "security")] + [("config", d) for d in ("smells", "structural", "dupes", "naming", "test_coverage", "security")]
SKIPS += [(z, d) for z in ("vendor", "generated") for d in ("structural", "smells", "dupes", "naming", "cycles", "test_coverage", "security")]
LOWER = [("script", "structural", "low"), ("test", "smells", "low"), ("script", "smells", "medium")]


@query(f"""WITH {WORK} SELECT finding_id, zone FROM work WHERE (zone, detector) NOT IN (SELECT (a, b)
  FROM {_values(SKIPS)} v(a, b))""")
def zone_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.zone_filtered(tables.work_items(spark, sf_dir), spark.createDataFrame(SKIPS, "zone string, detector string")).select("finding_id", "zone")


@query(f"""WITH {WORK} SELECT finding_id, coalesce(lower_to, confidence) AS confidence FROM work LEFT
  JOIN {_values(LOWER)} v(zone, detector, lower_to) USING (zone, detector)""")
def stamped_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence lowered by zone and detector (61)."""
    policy = spark.createDataFrame(LOWER, "zone string, detector string, lower_to string")
    return findings.downgraded(tables.work_items(spark, sf_dir), policy).select("finding_id", "confidence")


#: Findings with verdicts: some as concerns, as assessments or as reviews of the whole.
JUDGED = f"""{WORK}, j AS (SELECT finding_id, CASE ord % 9 WHEN 1 THEN 'concerns' WHEN 2 THEN 'subjective_review' WHEN 3 THEN 'holistic_review'
  ELSE detector END AS detector, CASE ord % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN ' Confirmed ' WHEN 2 THEN 'dismissed' END AS verdict FROM work)"""


@query(f"""WITH {JUDGED} SELECT finding_id, detector, verdict, CASE WHEN detector = 'review' THEN 'review_defect'
  WHEN detector = 'concerns' THEN 'review_concern' WHEN detector IN ('subjective_review', 'subjective_assessment',
  'holistic_review') THEN 'assessment_request'
  WHEN lower(trim(verdict)) = 'confirmed' THEN 'review_concern' ELSE 'mechanical_defect' END AS kind,
  CASE WHEN detector = 'review' OR (detector = 'concerns'
  AND lower(trim(verdict)) = 'confirmed') THEN 'review_import' WHEN detector IN ('subjective_review',
  'subjective_assessment', 'holistic_review') THEN 'synthetic_task' ELSE 'scan' END AS origin
 FROM j""")
def item_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and origin of work items (63, 64)."""
    w, turn = tables.work_items(spark, sf_dir), F.col("ord") % 9
    detector = F.when(turn == 1, "concerns").when(turn == 2, "subjective_review").when(turn == 3, "holistic_review").otherwise(F.col("detector"))
    verdict = F.when(F.col("ord") % 4 == 0, "confirmed").when(F.col("ord") % 4 == 1, " Confirmed ").when(F.col("ord") % 4 == 2, "dismissed")
    rows = w.select("finding_id", detector.alias("detector"), verdict.alias("verdict"))
    return rows.select("finding_id", "detector", "verdict", findings.kind_of(F.col("detector"), F.col("verdict")).alias("kind"), findings.origin_of(F.col("detector"), F.col("verdict")).alias("origin"))


#: Findings as loose text rows, some without an id, with statuses, tiers and counts that are none.
LOOSE = f"""{WORK}, v AS (SELECT CASE WHEN ord % 41 <> 0 THEN finding_id END AS finding_id, CASE ord % 5 WHEN 0 THEN upper(status) || ' ' WHEN 1 THEN 'bogus'
  WHEN 2 THEN NULL ELSE status END AS status, CASE WHEN ord % 7 = 6 THEN 'x' ELSE CAST(ord % 7 AS VARCHAR) END AS tier,
  CASE WHEN ord % 6 = 5 THEN 'y' ELSE CAST(ord % 6 - 2 AS VARCHAR) END AS reopen_count, CASE WHEN ord % 3 <> 0 THEN confidence END AS confidence FROM work)"""


@query(f"""WITH {LOOSE} SELECT finding_id, CASE WHEN lower(trim(status)) IN ('open', 'fixed', 'wontfix', 'false_positive',
  'auto_resolved', 'deferred', 'triaged_out') THEN lower(trim(status)) ELSE 'open' END AS status,
  CASE WHEN TRY_CAST(tier AS INTEGER) BETWEEN 1 AND 4 THEN TRY_CAST(tier AS INTEGER) ELSE 3 END AS tier,
  greatest(coalesce(TRY_CAST(reopen_count AS INTEGER), 0), 0) AS reopen_count, coalesce(confidence,
  'medium') AS confidence
 FROM v WHERE finding_id IS NOT NULL""")
def coerced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose rows with defaults filled in and values coerced (12, 65)."""
    w, ord_ = tables.work_items(spark, sf_dir), F.col("ord")
    status = F.when(ord_ % 5 == 0, F.concat(F.upper("status"), F.lit(" "))).when(ord_ % 5 == 1, "bogus").when(ord_ % 5 != 2, F.col("status"))
    loose = w.select(
        F.when(ord_ % 41 != 0, F.col("finding_id")).alias("finding_id"), status.alias("status"),
        F.when(ord_ % 7 == 6, "x").otherwise((ord_ % 7).cast("string")).alias("tier"),
        F.when(ord_ % 6 == 5, "y").otherwise((ord_ % 6 - 2).cast("string")).alias("reopen_count"), F.when(ord_ % 3 != 0, F.col("confidence")).alias("confidence"),
    )
    return findings.with_defaults(loose)


#: Findings of which some break an invariant.
BROKEN = f"""{WORK}, v AS (SELECT CASE WHEN ord % 90 = 5 THEN finding_id || 'x' ELSE finding_id END AS finding_id, detector, file, CASE WHEN ord % 4 = 1 THEN name END AS name,
  CASE WHEN ord % 50 = 1 THEN 'gone' ELSE status END AS status, CASE WHEN ord % 60 = 2 THEN 'sure' ELSE confidence END AS confidence,
  CASE WHEN ord % 70 = 3 THEN 5 ELSE tier END AS tier, CASE WHEN ord % 80 = 4 THEN -1 ELSE reopen_count END AS reopen_count FROM work)"""


@query(f"""WITH {BROKEN}, b AS (SELECT *, detector || '::' || file || CASE WHEN coalesce(name,
  '') <> '' THEN '::' || name ELSE '' END AS made FROM v)
 SELECT finding_id, 'status' AS rule FROM b WHERE status NOT IN ('open', 'fixed', 'wontfix', 'false_positive',
  'auto_resolved', 'deferred', 'triaged_out') UNION ALL SELECT finding_id, 'confidence' FROM b
  WHERE confidence NOT IN ('high', 'medium', 'low')
 UNION ALL SELECT finding_id, 'tier' FROM b WHERE tier NOT BETWEEN 1 AND 4 UNION ALL SELECT finding_id,
  'reopen_count' FROM b WHERE reopen_count < 0 UNION ALL SELECT finding_id, 'id' FROM b WHERE finding_id <> made""")
def invariant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, ord_ = tables.work_items(spark, sf_dir), F.col("ord")
    broken = w.withColumns({
        "finding_id": F.when(ord_ % 90 == 5, F.concat("finding_id", F.lit("x"))).otherwise(F.col("finding_id")), "name": F.when(ord_ % 4 == 1, F.col("name")),
        "status": F.when(ord_ % 50 == 1, "gone").otherwise(F.col("status")), "confidence": F.when(ord_ % 60 == 2, "sure").otherwise(F.col("confidence")),
        "tier": F.when(ord_ % 70 == 3, 5).otherwise(F.col("tier")), "reopen_count": F.when(ord_ % 80 == 4, -1).otherwise(F.col("reopen_count")),
    })
    return findings.violations(broken)


@query(f"""WITH {WORK}, s AS (SELECT file, CASE detector WHEN 'structural' THEN 'complexity'
  WHEN 'smells' THEN 'size' WHEN 'naming' THEN 'god' ELSE 'depth' END AS signal, loc AS score FROM work
  WHERE status = 'open' AND detector IN ('structural', 'smells', 'naming', 'cycles')),
 m AS (SELECT file, list_sort(list_distinct(list(signal))) AS kinds, max(score) AS score FROM s GROUP BY file)
 SELECT file, array_to_string(kinds, ',') AS signals, CASE WHEN len(kinds) >= 3 THEN 4 ELSE 3 END AS tier, CASE
  WHEN len(kinds) >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM m WHERE NOT (len(kinds) = 1
  AND kinds[1] = 'complexity') OR score >= 50""")
def structural_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.work_items(spark, sf_dir).where(F.col("status") == "open").where(F.col("detector").isin("structural", "smells", "naming", "cycles"))
    signal = F.when(F.col("detector") == "structural", "complexity").when(F.col("detector") == "smells", "size").when(F.col("detector") == "naming", "god").otherwise("depth")
    return findings.structural_merge(w.select("file", signal.alias("signal"), F.col("loc").alias("score")))


@query(f"""WITH {WORK} SELECT CASE WHEN grouping(tier) = 1 THEN NULL ELSE tier END AS tier, status, count(*) AS n
  FROM work WHERE NOT suppressed GROUP BY GROUPING SETS ((status, tier), (status))""")
def status_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.exploded_status_counts(tables.work_items(spark, sf_dir)).select("tier", "status", "n")


SCANS = [(1, "1995-01-01 00:00:00"), (2, "1998-06-01 00:00:00")]


@query(f"WITH {WORK} SELECT finding_id FROM work WHERE first_seen >= TIMESTAMP '1998-06-01'")
def new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings first seen since the last scan (73)."""
    history = spark.createDataFrame(SCANS, "scan int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return findings.first_seen_since(tables.work_items(spark, sf_dir), history).select("finding_id")


RANKED = f"""WITH {WORK}, r AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY tier, CASE confidence
  WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, finding_id) AS rank,
  count(*) OVER (PARTITION BY detector) AS total FROM work WHERE status = 'open'),
 b AS (SELECT finding_id, detector, CAST(rank AS INTEGER) AS rank, greatest(total - 20, 0) AS hidden FROM r
  WHERE rank <= 20)"""


def _budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.noise_budget(tables.work_items(spark, sf_dir).where(F.col("status") == "open"), 20).select("finding_id", "detector", "rank", "hidden")


@query(RANKED + " SELECT * FROM b")
def noise_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budgeted(spark, sf_dir)


@query(RANKED + " SELECT * FROM b ORDER BY rank, detector LIMIT 50")
def round_robin_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.round_robin(_budgeted(spark, sf_dir), 50)
