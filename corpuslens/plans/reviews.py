"""Queries of the review, coverage and schema operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import review
from corpuslens.plans.findings import _values
from corpuslens.plans.registry import query
from corpuslens.sources import tables
from corpuslens.sources.tables import DOCS, WORK

#: Batch scores from events: dimension = type, score = value cut to 0..100, weight by user.
BATCH = "b AS (SELECT event_type AS dimension, floor(least(value, 100)) AS score, user_id % 5 + 1 AS weight FROM events)"
FLOOR = BATCH + """, s AS (SELECT dimension, score, CAST(sum(weight) AS BIGINT) AS w FROM b GROUP BY ALL),
  r AS (SELECT *, sum(w) OVER (PARTITION BY dimension ORDER BY score) - w AS before,
  sum(w) OVER (PARTITION BY dimension) AS total FROM s),
 f AS (SELECT dimension, sum(score * w) / CAST(sum(w) AS DOUBLE) AS floor FROM r WHERE before * 100 < total * 10
  GROUP BY dimension)"""


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("dimension"), F.floor(F.least("value", F.lit(100.0))).cast("double").alias("score"), (F.col("user_id") % 5 + 1).alias("weight"))


@query(f"WITH {FLOOR} SELECT dimension, floor FROM f")
def weighted_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.weighted_floor(_batch(spark, sf_dir))


@query(f"""WITH {FLOOR}, m AS (SELECT dimension, sum(score * weight) / CAST(sum(weight) AS DOUBLE) AS mean FROM b
  GROUP BY dimension) SELECT dimension, mean, floor, least(100.0, greatest(0.0, mean * 0.7 + floor * 0.3)) AS merged
  FROM m JOIN f USING (dimension)""")
def batch_score_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.batch_scores(_batch(spark, sf_dir))


#: Parts as issues of a review: some with an identifier, some without words.
ISSUES = """issues AS (SELECT p_partkey AS issue_id, p_brand AS dimension, CASE WHEN p_partkey % 5 = 0 THEN 'id' || p_size WHEN p_partkey % 5 = 1 THEN '' END AS identifier,
  CASE WHEN p_partkey % 97 = 0 THEN '' ELSE p_name || ' of type ' || p_type || ' and size ' || (100 + p_size) END AS summary FROM part)"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = tables.table(spark, sf_dir, "part"), F.col("p_partkey")
    identifier = F.when(key % 5 == 0, F.concat(F.lit("id"), F.col("p_size").cast("string"))).when(key % 5 == 1, "")
    summary = F.concat("p_name", F.lit(" of type "), "p_type", F.lit(" and size "), (F.col("p_size") + 100).cast("string"))
    return p.select(key.alias("issue_id"), F.col("p_brand").alias("dimension"), identifier.alias("identifier"), F.when(key % 97 == 0, "").otherwise(summary).alias("summary"))


WORDS = "array_to_string(list_slice(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(summary), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3))), 1, 8), ',')"


@query(f"""WITH {ISSUES} SELECT issue_id, CASE WHEN coalesce(identifier, '') <> '' THEN dimension || '::' || identifier ELSE
  dimension || '::' || {WORDS} END AS key FROM issues""")
def issue_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.identity(_issues(spark, sf_dir)).select("issue_id", "key")


SETS = f"{ISSUES}, w AS (SELECT issue_id, dimension, list_distinct(list_filter(string_split(regexp_replace(lower(summary), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3)) AS words FROM issues)"


@query(f"""WITH RECURSIVE {SETS}, l AS (SELECT a.issue_id AS a, b.issue_id AS b FROM w a
  JOIN w b ON a.dimension = b.dimension AND a.issue_id <> b.issue_id WHERE len(a.words) > 0 AND len(b.words) > 0 AND CAST(len(list_intersect(a.words,
  b.words)) AS DOUBLE) / len(list_distinct(list_concat(a.words, b.words))) >= 0.45), r(a, b) AS (SELECT a, b
  FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b) SELECT issue_id, least(issue_id, coalesce(min(b),
  issue_id)) AS root FROM w LEFT JOIN r ON a = issue_id GROUP BY issue_id""")
def issue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive groups of similar issues (205, 206)."""
    return review.merged_groups(_issues(spark, sf_dir))


CACHE = "cache AS (SELECT doc_id, CASE WHEN quality = 1 THEN md5(text) ELSE 'old' END AS seen_digest, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) AS reviewed_at FROM labels JOIN documents USING (doc_id))"


@query(f"""WITH {DOCS}, {CACHE} SELECT path, CASE WHEN reviewed_at IS NULL THEN 'unreviewed'
  WHEN md5(text) <> seen_digest THEN 'changed' WHEN floor((epoch(TIMESTAMP '2024-03-15') - epoch(reviewed_at)) /
  86400) > 30 THEN 'stale' ELSE 'fresh' END AS state FROM docs LEFT JOIN cache USING (doc_id)""")
def review_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against their review cache (119, 68)."""
    docs, labels = tables.documents(spark, sf_dir), tables.table(spark, sf_dir, "labels")
    digest = F.md5(F.col("text").cast("binary"))
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("doc_id") % 60).cast("int"))
    cache = docs.join(labels, "doc_id").select("path", F.when(F.col("quality") == 1, digest).otherwise("old").alias("seen_digest"), at.alias("reviewed_at"))
    return review.staleness(docs.select("path", digest.alias("digest")), cache, "2024-03-15 00:00:00", 30)


@query(f"""WITH {WORK}, f AS (SELECT file, max(loc) AS loc, count(*) FILTER (status = 'open') AS n_open,
  count(*) FILTER (status = 'wontfix' AND detector IN ('structural', 'smells')) AS n_aside,
  count(DISTINCT lang || zone) AS importers, max(reopen_count) = 0 AS low_value, max(tier) * 30 AS complexity
  FROM work GROUP BY file),
 s AS (SELECT *, importers * CASE WHEN low_value THEN 2 ELSE 10 END + n_open * 5 + n_aside * 15 + CASE
  WHEN complexity > 100 THEN 20 ELSE 0 END + loc // 50 AS score FROM f)
 SELECT file, CAST(CASE WHEN loc < 20 THEN -1 WHEN low_value THEN score // 3 ELSE score END AS BIGINT) AS priority
  FROM s""")
def review_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.work_items(spark, sf_dir)
    f = w.groupBy("file").agg(
        F.max("loc").alias("loc"), F.count_if(F.col("status") == "open").alias("n_open"), F.count_if((F.col("status") == "wontfix") & F.col("detector").isin("structural", "smells")).alias("n_set_aside"),
        F.count_distinct(F.concat("lang", "zone")).alias("importers"), (F.max("reopen_count") == 0).alias("low_value"), (F.max("tier") * 30).alias("complexity"),
    )
    return review.priority(f).select("file", "priority")


COVER = f"""{DOCS}, loc AS (SELECT doc_id, path, source, lang, CASE
  WHEN length(text) = 0 THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text,
  chr(10)) THEN 1 ELSE 0 END END AS loc FROM docs),
 direct AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), reached AS (SELECT DISTINCT source, lang FROM loc
  JOIN direct USING (doc_id))"""


@query(f"""WITH {COVER} SELECT path, CAST(loc AS INTEGER) AS loc, CASE WHEN d.doc_id IS NOT NULL THEN 'direct'
  WHEN r.source IS NOT NULL AND l.loc > 3 THEN 'transitive' ELSE 'untested' END AS kind FROM loc l LEFT
  JOIN direct d USING (doc_id) LEFT JOIN reached r ON r.source = l.source AND r.lang = l.lang""")
def coverage_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a good label count as tested, longer ones beside them as reached (111-114)."""
    docs = tables.documents(spark, sf_dir).withColumn("loc", T.line_count(F.col("text")))
    good = tables.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    direct = docs.join(good, "doc_id", "left_semi")
    reached = docs.where("loc > 3").join(direct.select("source", "lang").distinct(), ["source", "lang"], "left_semi")
    return review.coverage_class(docs.select("path", "loc"), direct, reached)


@query(f"WITH {COVER} SELECT CAST(round(sum(least(sqrt(loc), 50))) AS BIGINT) AS potential FROM loc WHERE loc >= 10")
def coverage_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.coverage_potential(tables.documents(spark, sf_dir).select(T.line_count(F.col("text")).alias("loc")))


QUALITY = ["adequate", "smoke", "placeholder", "assertion_free"]


@query("""WITH t AS (SELECT conv_id AS path, turn AS test, (['adequate', 'smoke', 'placeholder',
  'assertion_free'])[length(text) % 4 + 1] AS quality FROM conversations), r AS (SELECT *, CASE quality
  WHEN 'assertion_free' THEN 3 WHEN 'placeholder' THEN 2 WHEN 'smoke' THEN 1 ELSE 0 END AS rank FROM t),
 p AS (SELECT *, bool_or(quality = 'adequate') OVER (PARTITION BY path) AS ok, row_number() OVER (PARTITION BY path
  ORDER BY rank DESC, test) AS place FROM r) SELECT path, test, quality FROM p WHERE place = 1 AND NOT ok AND rank > 0""")
def worst_test_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst test of each path without an adequate one (118): turns stand for tests."""
    c = tables.table(spark, sf_dir, "conversations")
    kind = F.element_at(F.array(*map(F.lit, QUALITY)), F.length("text") % 4 + 1)
    return review.worst_quality(c.select(F.col("conv_id").alias("path"), F.col("turn").alias("test"), kind.alias("quality")))


@query("""WITH f AS (SELECT c_custkey AS file, CAST(10 + c_custkey * 7 % 600 AS INTEGER) AS loc, count(o_orderkey) AS importers FROM customer
  LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT file, loc, importers, CASE WHEN importers >= 10 OR loc >= 500 THEN 'high' WHEN importers >= 3 OR loc >= 200 THEN 'medium' ELSE 'low' END AS risk FROM f""")
def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of untested files by importers and size (117): customers and their orders."""
    users = tables.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.count(F.lit(1)).alias("importers"))
    files = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), (F.col("c_custkey") * 7 % 600 + 10).cast("int").alias("loc"))
    rows = files.join(users, "file", "left").fillna(0, ["importers"])
    return rows.withColumn("risk", F.when((F.col("importers") >= 10) | (F.col("loc") >= 500), "high").when((F.col("importers") >= 3) | (F.col("loc") >= 200), "medium").otherwise("low"))


#: Parts of a brand as rows with three keys each, of which one is spelled otherwise in few rows.
KEYS = """k AS (SELECT p_brand AS cluster, p_partkey AS row, unnest(['name', CASE WHEN p_size % 25 = 3 THEN 'valeu' ELSE 'value' END,
  CASE p_size % 25 WHEN 1 THEN 'knd' WHEN 2 THEN 'other' ELSE 'kind' END]) AS key FROM part)"""


@query(f"""WITH {KEYS}, s AS (SELECT cluster,
  count(DISTINCT row) AS size FROM k GROUP BY cluster HAVING count(DISTINCT row) >= 3), u AS (SELECT cluster, key,
  count(DISTINCT row) AS n, size FROM k JOIN s USING (cluster) GROUP BY ALL),
 b AS (SELECT o.cluster, o.key, o.n, o.size, c.key AS near, levenshtein(o.key, c.key) AS d FROM u o
  JOIN u c ON c.cluster = o.cluster AND c.n * 100 >= c.size * 30 WHERE o.n * 100 < o.size * 30)
 SELECT cluster, key, n, size, CASE WHEN min(d) <= 2 THEN arg_min(near, d) END AS nearest FROM b GROUP BY ALL""")
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that few rows of a cluster use, with the common key they may stand for (126, 127)."""
    turn = F.col("p_size") % 25
    keys = F.array(F.lit("name"), F.when(turn == 3, "valeu").otherwise("value"), F.when(turn == 1, "knd").when(turn == 2, "other").otherwise("kind"))
    p = tables.table(spark, sf_dir, "part")
    return review.outlier_keys(p.select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("row"), F.explode(keys).alias("key")))


@query("""SELECT p_partkey AS id, 'a' AS param, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS forwarded, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 3 END AS used FROM part
  UNION ALL SELECT p_partkey, 'b', 1, CASE WHEN p_size % 3 = 0 THEN 3 ELSE 1 END FROM part""")
def passthrough_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a parameter is only handed on (102), in a function for each part."""
    first = F.when(F.col("p_size") % 2 == 0, "g(a)\n").otherwise("a = a + 1\n")
    body = F.concat(first, F.lit("h(a, b)\n"), F.when(F.col("p_size") % 3 == 0, "b = b + 1").otherwise("k(c)"))
    rows = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), body.alias("body"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("param"))
    count = lambda a, b: F.size(F.regexp_extract_all("body", F.concat(F.lit(a), "param", F.lit(b)), 0))
    return rows.select("id", "param", count("[(,] ?", "[,)]").alias("forwarded"), count("(?:^|[^A-Za-z0-9_])", "(?:$|[^A-Za-z0-9_])").alias("used"))


IMPORTED = "imported AS (SELECT finding_id FROM work WHERE tier = 1)"


@query(f"""WITH {WORK}, {IMPORTED}, c AS (SELECT finding_id, detector, unnest([false, true]) AS full_sweep FROM work WHERE status = 'open')
SELECT finding_id, full_sweep, 'auto_resolved' AS status FROM c WHERE (CASE WHEN full_sweep THEN detector IN ('security', 'cycles', 'review')
  ELSE detector IN ('security', 'cycles') END) AND finding_id NOT IN (SELECT finding_id FROM imported)""")
def holistic_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open findings of covered dimensions that an import no longer holds, without and with a full sweep (280)."""
    w = tables.work_items(spark, sf_dir)
    imported, kinds = w.where("tier = 1").select("finding_id"), ["security", "cycles", "review"]
    runs = [review.auto_resolved(w, imported, kinds, kinds[:2], sweep).select("finding_id", F.lit(sweep).alias("full_sweep"), "status") for sweep in (False, True)]
    return runs[0].union(runs[1])
