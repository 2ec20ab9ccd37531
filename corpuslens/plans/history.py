"""Queries of the merge, trend and history operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.operators import merge, trends
from corpuslens.plans.findings import SKIPS, _values
from corpuslens.plans.registry import query
from corpuslens.sources import tables
from corpuslens.sources.tables import WORK

NOW = "1999-01-01 00:00:00"
#: The scan before holds what was first seen before a date, the scan now what was seen since another.
SPLIT = "existing AS (SELECT * FROM work WHERE first_seen < TIMESTAMP '1998-01-01'), current AS (SELECT * FROM work WHERE last_seen >= TIMESTAMP '1997-06-01')"
MERGED = f"""WITH {WORK}, {SPLIT}, j AS (SELECT finding_id, e.status, e.reopen_count,
  e.finding_id IS NOT NULL AS was, c.finding_id IS NOT NULL AS seen, starts_with(finding_id, 'dupes::') AS ign
  FROM existing e FULL JOIN current c USING (finding_id)),
 merged AS (SELECT finding_id, CASE WHEN NOT was AND ign THEN 'suppressed' WHEN NOT was THEN 'new'
  WHEN NOT seen THEN 'absent' WHEN ign THEN 'suppressed' WHEN status IN ('fixed',
  'auto_resolved') THEN 'reopened' ELSE 'refreshed' END AS action,
  CASE WHEN NOT was OR (seen AND status IN ('fixed', 'auto_resolved') AND NOT ign) THEN 'open' ELSE status
  END AS status,
  coalesce(reopen_count, 0) + CASE WHEN was AND seen AND status IN ('fixed', 'auto_resolved')
  AND NOT ign THEN 1 ELSE 0 END AS reopen_count, CASE WHEN seen THEN TIMESTAMP '{NOW}' END AS seen_at FROM j)"""


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = tables.work_items(spark, sf_dir)
    return w.where("first_seen < TIMESTAMP_NTZ '1998-01-01'"), w.where("last_seen >= TIMESTAMP_NTZ '1997-06-01'")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, current = _scans(spark, sf_dir)
    return merge.upsert(existing, current, F.col("finding_id").startswith("dupes::"), NOW)


@query(MERGED + " SELECT * FROM merged")
def scan_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan merged into the findings before it (262, 265)."""
    return _merged(spark, sf_dir)


@query(MERGED + " SELECT action, count(*) AS n FROM merged GROUP BY action")
def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(MERGED + " SELECT finding_id, reopen_count FROM merged WHERE action = 'reopened' AND reopen_count >= 3")
def chronic_reopeners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).where("action = 'reopened' AND reopen_count >= 3").select("finding_id", "reopen_count")


@query(f"""WITH {WORK}, {SPLIT}, gone AS (SELECT * FROM existing WHERE status IN ('open', 'wontfix', 'fixed',
  'false_positive') AND finding_id NOT IN (SELECT finding_id FROM current)),
 s AS (SELECT g.*, z.b IS NOT NULL AS off, starts_with(file, 'area1/') OR file = 'area1' AS inside FROM gone g LEFT
  JOIN {_values(SKIPS)} z(a, b) ON a = zone AND b = detector)
 SELECT finding_id, CASE WHEN lang <> 'en' THEN 'other_language' WHEN detector IN ('review') THEN 'suspect'
  WHEN NOT inside AND status <> 'open' THEN 'verified_out_of_scope' WHEN NOT inside THEN 'out_of_scope'
  WHEN status = 'open' AND off THEN 'auto_resolved' WHEN status = 'open' THEN 'stays_open' ELSE 'verified'
  END AS verdict FROM s""")
def disappeared(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, current = _scans(spark, sf_dir)
    return merge.disappeared(existing, current, lang="en", suspects=["review"], scope="area1", skips=spark.createDataFrame(SKIPS, "zone string, detector string"))


@query(f"""WITH {WORK}, had AS (SELECT detector, count(*) AS n_open FROM work WHERE status = 'open'
  GROUP BY detector) SELECT detector, n_open FROM had WHERE detector NOT IN (SELECT detector FROM work
  WHERE detector IN ('smells', 'dupes')) AND (detector = 'review' OR detector NOT IN ('smells', 'security'))""")
def suspect_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.work_items(spark, sf_dir)
    return merge.suspect_detectors(w, w.where(F.col("detector").isin("smells", "dupes")), ["smells", "security"])


ASSESSED = [("Code quality", "1998-12-31 00:00:00"), ("Security", "1999-01-02 00:00:00"), ("Duplication", "1998-01-01 00:00:00")]
DIMS = [("smells", "Code quality"), ("naming", "Code quality"), ("security", "Security"), ("cycles", "Security"), ("dupes", "Duplication")]


@query(f"""WITH {WORK}, a AS (SELECT dimension, CAST(t AS TIMESTAMP) AS assessed_at
  FROM {_values(ASSESSED)} v(dimension, t)) SELECT dimension, assessed_at FROM a
  WHERE assessed_at < TIMESTAMP '{NOW}' AND dimension IN (SELECT d.dimension FROM work
  JOIN {_values(DIMS)} d(detector, dimension) USING (detector) WHERE first_seen >= TIMESTAMP '1998-06-01'
  AND detector <> 'dupes')""")
def stale_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = tables.work_items(spark, sf_dir).where("first_seen >= TIMESTAMP_NTZ '1998-06-01' AND detector <> 'dupes'").select("detector")
    assessed = spark.createDataFrame(ASSESSED, "dimension string, t string").select("dimension", F.col("t").cast("timestamp_ntz").alias("assessed_at"))
    return merge.stale_dimensions(changed, spark.createDataFrame(DIMS, "detector string, dimension string"), assessed, NOW)


@query(f"""WITH {WORK}, c AS (SELECT DISTINCT file, CAST(loc + CASE WHEN loc % 3 = 0 THEN 200 ELSE 0
  END AS INTEGER) AS loc_now FROM work WHERE file <> '.') SELECT finding_id, 12 - reopen_count * 2 >= 10 AS aged,
  loc_now >= loc * 1.25 AS grown FROM work JOIN c USING (file) WHERE status = 'wontfix'
  AND (12 - reopen_count * 2 >= 10 OR loc_now >= loc * 1.25)""")
def stale_wontfix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set-aside findings that aged or whose file grew (269)."""
    w = tables.work_items(spark, sf_dir).withColumn("set_aside_at", F.col("reopen_count") * 2)
    now = w.where("file <> '.'").select("file", (F.col("loc") + F.when(F.col("loc") % 3 == 0, 200).otherwise(0)).alias("loc"))
    return merge.stale_wontfix(w, now, 12, 10)


@query(f"""WITH {WORK}, h AS (SELECT DISTINCT CAST('0x' || substr(sha256(finding_id), 1, 14) AS BIGINT) AS h FROM work WHERE status = 'open' AND detector = 'review'),
x AS (SELECT bit_xor(h) AS x, sum(h) AS s, count(*) AS n FROM h)
SELECT CASE WHEN n > 0 THEN substr(sha256(CAST(x AS VARCHAR) || '|' || CAST(s AS VARCHAR)), 1, 16) ELSE '' END AS snapshot FROM x""")
def snapshot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of the open review ids (273), made of hashes of ids, so that no task holds a list of them all."""
    w = tables.work_items(spark, sf_dir).where("status = 'open' AND detector = 'review'")
    return merge.snapshot_hash(w)


# ------------------------------------------------------------------ trends over daily scans

#: A scan a day: the share of events that are no errors, as a score.
DAYS = """days AS (SELECT date_trunc('day', ts) AS ts, CAST(count(*) FILTER (event_type <> 'error') AS DOUBLE) * 100
  / count(*) AS score, count(*) AS raw, count(*) FILTER (event_type = 'error') AS open FROM events GROUP BY 1),
 scans AS (SELECT row_number() OVER (ORDER BY ts) AS seq, score, raw, open FROM days)"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    days = e.groupBy(F.date_trunc("day", "ts").alias("ts")).agg((F.count_if(F.col("event_type") != "error") * 100 / F.count(F.lit(1))).alias("score"), F.count(F.lit(1)).alias("raw"), F.count_if(F.col("event_type") == "error").alias("open"))
    return trends.numbered(days)


@query(f"WITH {DAYS} SELECT seq, score FROM scans WHERE seq > (SELECT max(seq) FROM scans) - 20")
def scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty scans (229)."""
    return trends.last_scans(_days(spark, sf_dir), 20).select("seq", "score")


@query(f"""WITH {DAYS}, w AS (SELECT seq, score, lag(score) OVER o AS prev, first_value(score) OVER o AS first,
  max(score) OVER (ORDER BY seq ROWS BETWEEN 2 PRECEDING
  AND CURRENT ROW) - min(score) OVER (ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS spread
  FROM scans WINDOW o AS (ORDER BY seq))
 SELECT seq, CASE WHEN seq = 1 THEN 'first_scan' WHEN score < prev - 0.5 THEN 'regression' WHEN seq >= 3
  AND spread <= 0.5 THEN 'stagnation' WHEN seq <= 5 AND score > first THEN 'early_momentum'
  WHEN score > 93 THEN 'maintenance' WHEN score > 80 THEN 'refinement' ELSE 'middle_grind' END AS phase FROM w""")
def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.phases(_days(spark, sf_dir)).select("seq", "phase")


@query(f"""WITH {DAYS}, w AS (SELECT seq, score, lag(score) OVER (ORDER BY seq) AS prev FROM scans) SELECT seq, CASE
  WHEN prev < 82 AND score >= 82 THEN 'crossed 82' WHEN prev < 80 AND score >= 80 THEN 'crossed 80' END AS milestone
  FROM w WHERE (prev < 82 AND score >= 82) OR (prev < 80 AND score >= 80)""")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.milestones(_days(spark, sf_dir), [82, 80])


@query(f"""WITH {DAYS}, r AS (SELECT * FROM scans WHERE seq > (SELECT max(seq) FROM scans) - 5),
  a AS (SELECT arg_max(score, seq) - arg_min(score, seq) AS delta, arg_max(score, seq) AS last, (SELECT max(score)
  FROM scans) AS high FROM r)
 SELECT delta, last, high, CASE WHEN delta > 0.5 AND last < high - 2 THEN 'recovering'
  WHEN delta > 0.5 THEN 'improving' WHEN delta < -0.5 THEN 'declining' ELSE 'stable' END AS trend FROM a""")
def score_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.trajectory(_days(spark, sf_dir), 5)


USERDAYS = """ud AS (SELECT event_type AS dimension, date_trunc('day', ts) AS ts, avg(value) AS score FROM events
  GROUP BY ALL), us AS (SELECT dimension, score, row_number() OVER (PARTITION BY dimension ORDER BY ts) AS seq,
  row_number() OVER (PARTITION BY dimension ORDER BY ts DESC) AS back FROM ud)"""


def _dimension_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("dimension"), F.date_trunc("day", "ts").alias("ts")).agg(F.avg("value").alias("score"))


@query(f"""WITH {USERDAYS} SELECT dimension, arg_max(score, seq) - arg_min(score, seq) AS delta, 100 - arg_max(score,
  seq) AS headroom FROM us WHERE back <= 5 GROUP BY dimension""")
def dimension_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.dimension_trajectories(_dimension_days(spark, sf_dir), 5).select("dimension", "delta", "headroom")


@query(f"""WITH {USERDAYS} SELECT dimension, max(score) - min(score) AS spread, count(*) AS samples FROM us
  WHERE back <= 5 GROUP BY dimension HAVING count(*) >= 3 AND max(score) - min(score) <= 12""")
def stagnant_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.stagnant(_dimension_days(spark, sf_dir), 5, 3, 12.0)


@query(f"""WITH {DAYS} SELECT seq, avg(score) OVER (ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth
  FROM scans""")
def sparkline_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.smooth(_days(spark, sf_dir)).select("seq", "smooth")


@query(f"""WITH {DAYS}, n AS (SELECT max(seq) - 1 AS last FROM scans), p AS (SELECT i,
  i * CAST(last AS DOUBLE) / 11 AS pos, last FROM n, range(12) t(i))
 SELECT CAST(i AS INTEGER) AS i, a.score + (b.score - a.score) * (pos - floor(pos)) AS score FROM p
  JOIN scans a ON a.seq = floor(pos) + 1 JOIN scans b ON b.seq = least(floor(pos) + 1, last) + 1""")
def sparkline_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series at twelve even places, by linear interpolation (239)."""
    return trends.resample(_days(spark, sf_dir), 12)


@query(f"""WITH {DAYS}, m AS (SELECT seq, score, min(score) OVER () AS low, max(score) OVER () AS high FROM scans)
  SELECT seq, CAST(least(7, floor((score - low) / (high - low) * 7 + 0.5)) AS INTEGER) AS level FROM m""")
def sparkline_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.levels(_days(spark, sf_dir), 8).select("seq", "level")


@query("""SELECT count(*) FILTER (event_type = 'purchase') AS resolved,
  count(*) FILTER (event_type = 'error') AS skipped, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) /
  count(*) FILTER (event_type IN ('purchase', 'error')) AS skip_rate FROM events
  WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 10 DAY""")
def execution_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved and skipped in the last ten days before a fixed time (223)."""
    return trends.execution_patterns(tables.table(spark, sf_dir, "events"), "2024-01-30 00:00:00", 10)


@query(f"""WITH {WORK}, s AS (SELECT date_trunc('month', first_seen) AS scan,
  count(*) FILTER (status = 'wontfix') AS debt, count(*) AS n FROM work GROUP BY 1), r AS (SELECT *,
  row_number() OVER (ORDER BY scan DESC) AS back FROM s) SELECT CAST(sum(debt) AS BIGINT) AS wontfix, arg_max(scan,
  debt * 100000 - back) AS worst, max(debt) FILTER (back = 1) - max(debt) FILTER (back = 5) AS gap_trend FROM r""")
def debt_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set-aside findings, the month with most (the latest on a tie), and the change over five scans (224)."""
    months = tables.work_items(spark, sf_dir).groupBy(F.date_trunc("month", "first_seen").cast("timestamp_ntz").alias("scan")).agg(F.count_if(F.col("status") == "wontfix").alias("debt"))
    back = months.withColumn("back", F.row_number().over(Window.orderBy(F.desc("scan"))))
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("debt")))
    return back.agg(F.sum("debt").alias("wontfix"), F.max_by("scan", F.struct("debt", "scan")).alias("worst"), (at(1) - at(5)).alias("gap_trend"))
