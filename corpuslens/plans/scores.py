"""Queries of the scoring operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import scoring
from corpuslens.plans.registry import query
from corpuslens.sources import tables
from corpuslens.sources.tables import WORK

CATALOG = [("smells", "Code quality"), ("dupes", "Duplication"), ("security", "Security"), ("structural", "File health"), ("naming", "Code quality"), ("test_coverage", "Test health"), ("cycles", "Security")]
CATALOG_SQL = "(VALUES " + ", ".join(f"('{d}', '{n}')" for d, n in CATALOG) + ") c(detector, dimension)"
WEIGHTS = {"File health": 2.0}

POTENTIALS = """pots AS (SELECT detector, CAST(count(DISTINCT file) * 3 AS BIGINT) AS potential FROM work
  GROUP BY detector)"""
FAILS = f"""WITH {WORK}, m AS (SELECT *, unnest(list_filter([CASE WHEN status IN ('open', 'deferred',
  'triaged_out') THEN 'lenient' END, CASE WHEN status IN ('open', 'wontfix', 'auto_resolved', 'deferred',
  'triaged_out') THEN 'strict' END,
  CASE WHEN status IN ('open', 'wontfix', 'fixed', 'false_positive', 'deferred',
  'triaged_out') THEN 'verified_strict' END], lambda x: x IS NOT NULL)) AS mode FROM work
  WHERE NOT suppressed AND zone NOT IN ('test', 'config', 'generated', 'vendor') AND detector <> 'review'),
 f AS (SELECT mode, detector, file, count(*) AS n, CAST(sum(CASE confidence WHEN 'high' THEN 10
  WHEN 'low' THEN 3 ELSE 7 END) AS BIGINT) AS w FROM m GROUP BY ALL),
 d AS (SELECT mode, detector, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN detector NOT IN ('smells',
  'test_coverage', 'security') THEN w WHEN file = '.' THEN w * 10 ELSE least(w, CASE WHEN n >= 6 THEN 20
  WHEN n >= 3 THEN 15 ELSE 10 END) END) AS BIGINT) AS weighted FROM f GROUP BY ALL)"""
RATES = FAILS + f""", {POTENTIALS}, modes AS (SELECT detector, potential, unnest(['lenient', 'strict',
  'verified_strict']) AS mode FROM pots),
 rates AS (SELECT mode, detector, CASE WHEN detector <> 'review' THEN coalesce(n, 0) ELSE 0 END AS n, CASE
  WHEN detector <> 'review' THEN coalesce(weighted, 0) ELSE 0 END AS weighted,
  CASE WHEN detector <> 'review' THEN greatest(0.0, CAST(potential * 10 - coalesce(weighted,
  0) AS DOUBLE) / (potential * 10)) ELSE 1.0 END AS pass_rate, potential FROM modes LEFT JOIN d USING (mode,
  detector))"""
DIMS = RATES + f""", dims AS (SELECT mode, dimension, CAST(sum(potential) AS BIGINT) AS checks,
  CAST(sum(n) AS BIGINT) AS failing, greatest(0.0, CAST(sum(potential) * 10 - sum(weighted) AS DOUBLE) /
  CAST(sum(potential) * 10 AS DOUBLE)) * 100 AS score FROM rates JOIN {CATALOG_SQL} USING (detector)
  WHERE potential > 0 GROUP BY ALL)"""
HEALTH = DIMS + """, h AS (SELECT *, CASE WHEN dimension = 'File health' THEN 2.0 ELSE 1.0 END * least(1.0,
  CAST(checks AS DOUBLE) / 200) AS w FROM dims), s AS (SELECT *, w / sum(w) OVER (PARTITION BY mode) AS share FROM h)"""


def _potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.work_items(spark, sf_dir).groupBy("detector").agg((F.count_distinct("file") * 3).alias("potential"))


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pass_rates(tables.work_items(spark, sf_dir), _potentials(spark, sf_dir))


def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.dimension_scores(_rates(spark, sf_dir), spark.createDataFrame(CATALOG, "detector string, dimension string"))


@query(FAILS + " SELECT * FROM d")
def file_cap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted failures (tenths) by mode and detector with per-file caps (177-180)."""
    return scoring.failures(tables.work_items(spark, sf_dir))


@query(RATES + " SELECT * FROM rates")
def detector_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir)


@query(DIMS + " SELECT * FROM dims")
def dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dims(spark, sf_dir)


@query(HEALTH + " SELECT mode, dimension, share, share * score AS contribution, share * (100 - score) AS drag FROM s")
def health_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.health(_dims(spark, sf_dir), WEIGHTS)


@query(HEALTH + " SELECT mode, sum(share * score) AS overall FROM s GROUP BY mode")
def overall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.health(_dims(spark, sf_dir), WEIGHTS).groupBy("mode").agg(F.sum("contribution").alias("overall"))


@query(RATES + """, p AS (SELECT mode, sum(potential) AS p, sum(weighted) AS w, sum(CASE WHEN detector = 'security'
  AND n > 0 THEN CAST(least(5, n) * weighted AS DOUBLE) / n ELSE 0.0 END) AS less FROM rates GROUP BY mode)
 SELECT mode, CAST(p * 10 - w AS DOUBLE) / CAST(p * 10 AS DOUBLE) * 100 AS before,
  (CAST(p * 10 - w AS DOUBLE) + less) / CAST(p * 10 AS DOUBLE) * 100 AS after FROM p""")
def score_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score if five average security findings were fixed (186)."""
    return scoring.impact(_rates(spark, sf_dir), "security", 5)


@query(f"""WITH {WORK}, p AS (SELECT lang, detector, count(*) AS potential FROM work GROUP BY ALL) SELECT detector,
  CAST(sum(potential) AS BIGINT) AS potential FROM p GROUP BY detector""")
def merged_potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_lang = tables.work_items(spark, sf_dir).groupBy("lang", "detector").agg(F.count(F.lit(1)).alias("potential"))
    return per_lang.groupBy("detector").agg(F.sum("potential").alias("potential"))


@query(f"""WITH {WORK}, c AS (SELECT lang, count(*) AS n, min(ord) AS first FROM work GROUP BY lang)
  SELECT arg_max(lang, n * 1000000 - first) AS lang FROM c""")
def primary_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent language, the first seen on a tie (188)."""
    counts = tables.work_items(spark, sf_dir).groupBy(F.lower("lang").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    return counts.agg(F.max_by("lang", F.struct("n", -F.col("first"))).alias("lang"))


@query(f"""WITH {WORK} SELECT CASE WHEN detector IN ('smells', 'naming') THEN 'style' ELSE detector END AS family,
  count(*) AS n FROM work WHERE status = 'open' AND NOT suppressed GROUP BY ALL""")
def open_by_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.work_items(spark, sf_dir).where((F.col("status") == "open") & ~F.col("suppressed"))
    return w.groupBy(F.when(F.col("detector").isin("smells", "naming"), "style").otherwise(F.col("detector")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {WORK}, s AS (SELECT date_trunc('month', first_seen) AS scan, count(*) AS raw,
  count(*) FILTER (suppressed) AS ignored FROM work GROUP BY 1), r AS (SELECT scan, raw, ignored,
  CAST(ignored AS DOUBLE) * 100 / raw AS pct, CAST(sum(ignored) OVER w AS DOUBLE) * 100 / CAST(sum(raw) OVER w AS
  DOUBLE) AS recent_pct FROM s WINDOW w AS (ORDER BY scan ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT * FROM r""")
def suppression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppressed share of each scan and of the last five (192, 193); one row a scan, so the window is small."""
    from pyspark.sql import Window

    scans = tables.work_items(spark, sf_dir).groupBy(F.date_trunc("month", "first_seen").cast("timestamp_ntz").alias("scan")).agg(F.count(F.lit(1)).alias("raw"), F.count_if("suppressed").alias("ignored"))
    last5 = Window.orderBy("scan").rowsBetween(-4, 0)
    return scans.withColumns({"pct": F.col("ignored") * 100 / F.col("raw"), "recent_pct": F.sum("ignored").over(last5) * 100 / F.sum("raw").over(last5)})


@query(f"""WITH {WORK}, f AS (SELECT file, count(DISTINCT detector) FILTER (detector IN ('smells', 'structural',
  'naming', 'dupes')) AS judged, count(*) AS n, max(CAST(detector = 'structural'
  AND confidence = 'high' AS INTEGER)) = 1 AS elevated FROM work WHERE status = 'open' AND NOT suppressed
  GROUP BY file) SELECT file, judged, n, elevated FROM f WHERE judged >= 1 AND (judged >= 2 OR elevated OR n >= 3)""")
def file_concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with signals of several judgment detectors, an elevated one, or many findings (211)."""
    w = tables.work_items(spark, sf_dir).where((F.col("status") == "open") & ~F.col("suppressed"))
    judged = F.when(F.col("detector").isin("smells", "structural", "naming", "dupes"), F.col("detector"))
    by_file = w.groupBy("file").agg(F.count_distinct(judged).alias("judged"), F.count(F.lit(1)).alias("n"), F.bool_or((F.col("detector") == "structural") & (F.col("confidence") == "high")).alias("elevated"))
    return by_file.where((F.col("judged") >= 1) & ((F.col("judged") >= 2) | F.col("elevated") | (F.col("n") >= 3)))


@query(f"""WITH {WORK}, f AS (SELECT file, array_to_string(list_sort(list_distinct(list(detector))), ',') AS profile,
  count(DISTINCT detector) AS k FROM work WHERE status = 'open' GROUP BY file) SELECT profile, count(*) AS n_files,
  min(file) AS first_file FROM f WHERE k >= 2 GROUP BY profile HAVING count(*) >= 3""")
def cross_file_concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same set of detectors in at least three files (212)."""
    by_file = tables.work_items(spark, sf_dir).where(F.col("status") == "open").groupBy("file").agg(F.array_sort(F.collect_set("detector")).alias("kinds"))
    return by_file.where(F.size("kinds") >= 2).groupBy(F.array_join("kinds", ",").alias("profile")).agg(F.count(F.lit(1)).alias("n_files"), F.min("file").alias("first_file")).where("n_files >= 3")


@query(f"""WITH {WORK} SELECT detector, tier, count(DISTINCT file) AS n_files FROM work WHERE status = 'open'
  GROUP BY ALL HAVING count(DISTINCT file) >= 5""")
def systemic_concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.work_items(spark, sf_dir).where(F.col("status") == "open").groupBy("detector", "tier").agg(F.count_distinct("file").alias("n_files")).where("n_files >= 5")


@query(f"""WITH {WORK} SELECT file, count(*) FILTER (status IN ('fixed', 'auto_resolved')) AS resolved,
  count(*) FILTER (status = 'open') AS open FROM work GROUP BY file HAVING count(*) FILTER (status IN ('fixed',
  'auto_resolved')) > 0 AND count(*) FILTER (status = 'open') > 0""")
def churn_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with resolved and open findings (221)."""
    found = tables.work_items(spark, sf_dir).groupBy("file").agg(F.count_if(F.col("status").isin("fixed", "auto_resolved")).alias("resolved"), F.count_if(F.col("status") == "open").alias("open"))
    return found.where("resolved > 0 AND open > 0")


@query(f"""WITH {WORK}, d AS (SELECT dimension, status, reopen_count FROM work JOIN {CATALOG_SQL} USING (detector))
  SELECT dimension, count(*) FILTER (status = 'fixed') AS resolved, count(*) FILTER (status = 'open') AS open,
  CAST(sum(reopen_count) AS BIGINT) AS reopened FROM d GROUP BY dimension
  HAVING (count(*) FILTER (status = 'fixed') > 0 AND count(*) FILTER (status = 'open') > 0) OR sum(reopen_count) > 0""")
def rework_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.work_items(spark, sf_dir).join(spark.createDataFrame(CATALOG, "detector string, dimension string"), "detector")
    sums = d.groupBy("dimension").agg(F.count_if(F.col("status") == "fixed").alias("resolved"), F.count_if(F.col("status") == "open").alias("open"), F.sum("reopen_count").alias("reopened"))
    return sums.where("(resolved > 0 AND open > 0) OR reopened > 0")
