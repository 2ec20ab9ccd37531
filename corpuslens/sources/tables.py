"""The test tables as the entities that the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as T

#: Time at which the queries stand ("now" is a parameter, never the clock).
AS_OF = "2000-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unsized(df: DataFrame) -> DataFrame:
    """df joined by sorting, never broadcast: rows of files and lines are far more than the planner guesses from the
    table that they come from, and a broadcast would take all of them through the driver."""
    return df.hint("merge")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path (source/lang/doc_id.txt) and text."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text", "lang", "source")


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each line: the columns kept, line_no (from 1) and line."""
    return docs.select(*keep, F.posexplode(T.line_array(F.col("text"))).alias("pos", "line")).select(*keep, (F.col("pos") + 1).alias("line_no"), "line")


DETECTORS = ["smells", "dupes", "security", "structural", "naming", "test_coverage", "review", "cycles"]
ZONES = ["test", "config", "vendor", "generated", "script"]
LANGS = ["en", "fr", "de", "es"]


def _pick(values: list[str], index) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings: status, priority and customer give status, confidence/tier, file, zone and language."""
    o = table(spark, sf_dir, "orders")
    key, cust, digit = F.col("o_orderkey"), F.col("o_custkey"), F.substring("o_orderpriority", 1, 1).cast("int")
    status = (
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "wontfix")
        .when(key % 13 == 0, "auto_resolved").when(key % 17 == 0, "false_positive").otherwise("fixed")
    )
    detector = _pick(DETECTORS, key % 8)
    file = F.when(key % 97 == 0, ".").otherwise(F.concat(F.lit("area"), cust % 12, F.lit("/mod"), cust % 60, F.lit("/f"), cust, F.lit(".py")))
    return o.select(
        F.concat_ws("::", detector, file, F.concat(F.lit("o"), key)).alias("finding_id"),
        detector.alias("detector"), file.alias("file"), F.concat(F.lit("o"), key).alias("name"),
        F.least(digit, F.lit(4)).alias("tier"), F.when(digit <= 2, "high").when(digit == 3, "medium").otherwise("low").alias("confidence"),
        status.alias("status"), _pick(LANGS, cust % 4).alias("lang"), F.when(cust % 9 < 5, _pick(ZONES, F.least(cust % 9, F.lit(4)))).otherwise("production").alias("zone"),
        F.col("o_orderdate").alias("first_seen"), (F.col("o_orderdate") + F.make_dt_interval((key % 400).cast("int"))).alias("last_seen"),
        (key % 4).cast("int").alias("reopen_count"), (key % 19 == 0).alias("suppressed"), (F.lit(10) + cust * 7 % 600).cast("int").alias("loc"), key.alias("ord"),
    )


#: The same in DuckDB SQL, as the first common table expressions of a query.
WORK = """
work AS (
  SELECT detector || '::' || file || '::o' || o_orderkey AS finding_id, detector, file, 'o' || o_orderkey AS name, least(digit, 4) AS tier,
    CASE WHEN digit <= 2 THEN 'high' WHEN digit = 3 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'P' THEN 'wontfix' WHEN o_orderkey % 13 = 0 THEN 'auto_resolved'
      WHEN o_orderkey % 17 = 0 THEN 'false_positive' ELSE 'fixed' END AS status,
    (['en', 'fr', 'de', 'es'])[o_custkey % 4 + 1] AS lang,
    CASE WHEN o_custkey % 9 < 5 THEN (['test', 'config', 'vendor', 'generated', 'script'])[o_custkey % 9 + 1] ELSE 'production' END AS zone,
    o_orderdate AS first_seen, o_orderdate + to_days(CAST(o_orderkey % 400 AS INTEGER)) AS last_seen, CAST(o_orderkey % 4 AS INTEGER) AS reopen_count,
    o_orderkey % 19 = 0 AS suppressed, CAST(10 + o_custkey * 7 % 600 AS INTEGER) AS loc, o_orderkey AS ord
  FROM (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS digit,
      (['smells', 'dupes', 'security', 'structural', 'naming', 'test_coverage', 'review', 'cycles'])[o_orderkey % 8 + 1] AS detector,
      CASE WHEN o_orderkey % 97 = 0 THEN '.' ELSE 'area' || o_custkey % 12 || '/mod' || o_custkey % 60 || '/f' || o_custkey || '.py' END AS file
    FROM orders) t)
"""

#: documents with their paths, and their lines.
DOCS = "docs AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, text, lang, source FROM documents)"
LINES = DOCS + """, lines AS (SELECT doc_id, path, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM docs))"""


def trade_edges(spark: SparkSession, sf_dir: str, least: float = 49) -> DataFrame:
    """src (customer's nation) -> dst (supplier's nation), with n lineitems of at least so much quantity."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    sold = l.where(F.col("l_quantity") >= least).join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == c["c_custkey"]).join(s, F.col("l_suppkey") == s["s_suppkey"])
    return sold.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


EDGES = """
edges AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 49 GROUP BY ALL)
"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and each href it holds, with repeats."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


HREFS = """links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""
