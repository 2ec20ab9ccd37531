"""Queries of the scanning, layout and duplicate operators over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import duplicates, layout, scanning
from corpuslens.plans.registry import query
from corpuslens.sources import tables
from corpuslens.sources.tables import DOCS, LINES


@query(f"WITH {DOCS} SELECT path FROM docs WHERE ends_with(path, '.txt') AND NOT (lang = 'de' OR source LIKE 'src1%')")
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by extension, minus excluded directories and globs (operators 1-4)."""
    docs = tables.documents(spark, sf_dir)
    return layout.file_scan(docs, [".txt"], ["de", "src1*"]).select("path")


@query(f"""WITH {DOCS} SELECT path, (lang = 'fr') AS is_dir, length(source) = 5 AS is_glob, starts_with(path, 'src2/en/') AS
  is_prefix FROM docs""")
def exclusion_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    p = F.col("path")
    return docs.select("path", layout.excluded(p, "fr").alias("is_dir"), (layout.excluded(p, "src??")).alias("is_glob"), layout.excluded(p, "src2/en").alias("is_prefix"))


@query(f"WITH {LINES} SELECT path, line_no, line FROM lines")
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lines(tables.documents(spark, sf_dir), "path")


@query(f"""WITH {DOCS} SELECT path, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE len(string_split(text, chr(10))) -
  CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS loc FROM docs""")
def loc_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).select("path", T.line_count(F.col("text")).alias("loc"))


@query(f"""WITH {DOCS} SELECT path, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) AS around FROM docs
  WHERE len(string_split(text, chr(10))) >= 2""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of context around the second line."""
    out = tables.documents(spark, sf_dir).select("path", T.snippet(F.col("text"), F.lit(2), 1).alias("around"))
    return out.where(F.col("around").isNotNull())


@query(f"""WITH {DOCS} SELECT source || '/' || lang AS area, count(*) AS n_files, sum(length(text)) AS n_chars FROM docs GROUP
  BY ALL""")
def area_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).groupBy(T.area(F.col("path")).alias("area")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length("text")).alias("n_chars"))


@query(f"WITH {LINES} SELECT path, line_no, line FROM lines WHERE regexp_matches(line, '[A-Za-z0-9]+@[a-z0-9.]+')")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanning.grep(tables.documents(spark, sf_dir), "[A-Za-z0-9]+@[a-z0-9.]+", "path")


NAMES = ["the", "token", "License", "der", "que"]


@query(f"""WITH {DOCS}, m AS (SELECT path, unnest(list_intersect(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+'), {NAMES}))
  AS name FROM docs) SELECT name, count(*) AS n_files, min(path) AS first_file FROM m GROUP BY name""")
def multi_name_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanning.files_by_name(tables.documents(spark, sf_dir), NAMES)


@query(f"WITH {DOCS} SELECT path FROM docs WHERE regexp_matches(text, '\\btoken\\b')")
def grep_file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).where(F.col("text").rlike(r"\btoken\b")).select("path")


def _quoted(q: str) -> str:
    return f"list_zip(regexp_extract_all(line, '(?:^|[\\s,;(])(?:const|let|var|export)?\\s*\\$?([A-Za-z_]\\w*)\\s*[:=]\\s*{q}([^{q}]+){q}', 1), regexp_extract_all(line, '(?:^|[\\s,;(])(?:const|let|var|export)?\\s*\\$?([A-Za-z_]\\w*)\\s*[:=]\\s*{q}([^{q}]+){q}', 2))"


SECRETS = f"""WITH {LINES}, near AS (SELECT path, line_no, line FROM lines WHERE regexp_matches(line, '{scanning.SECRET_NAME}')
    {''.join(f" AND NOT contains(line, '{x}')" for x in scanning.ENV_LOOKUPS)}),
  pairs AS (SELECT path, line_no, unnest(list_concat({_quoted('"')}, {_quoted("''")}, {_quoted('`')})) AS p FROM near),
  named AS (SELECT path, line_no, p[1] AS variable, p[2] AS value FROM pairs),
  kept AS (SELECT * FROM named WHERE regexp_matches(variable, '{scanning.SECRET_NAME}') AND NOT (
    trim(lower(value)) IN ('', 'changeme', 'xxx', 'yyy', 'zzz', 'placeholder', 'test', 'example', 'dummy', 'none', 'null', 'undefined', 'todo', 'fixme')
    OR starts_with(trim(lower(value)), 'your-') OR starts_with(trim(lower(value)), 'your_') OR starts_with(trim(lower(value)), '<')
    OR starts_with(trim(lower(value)), '${{') OR starts_with(trim(lower(value)), '{{{{') OR length(value) < 8 OR length(trim(value)) = 0
    OR regexp_matches(trim(value), '{T.FIELD_NAME}') OR contains(trim(value), ' ') OR (regexp_matches(trim(value), '[@:/\\s]') AND trim(value) = lower(trim(value)))))"""


@query(SECRETS + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY path, line_no, value) AS rank FROM kept) SELECT 'security::' || path || '::' || variable || ':' || line_no AS finding_id, path AS file, line_no, variable, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten hard-coded secrets of each variable, as findings (106, 110, 62, 249)."""
    found = scanning.top_per_rule(scanning.secret_names(tables.documents(spark, sf_dir)), "variable", 10, "path", "line_no", "value")
    name = F.concat_ws(":", "variable", F.col("line_no").cast("string"))
    return found.select(F.concat_ws("::", F.lit("security"), "path", name).alias("finding_id"), F.col("path").alias("file"), "line_no", "variable", "value", "rank")


def _format_cases() -> str:
    return ", ".join(f"CASE WHEN regexp_matches(line, '{p}') THEN {{'label': '{label}', 'severity': '{s}'}} END" for label, p, s in scanning.SECRET_FORMATS)


#: A text with a line in one of the formats for each part, made of its digest.
LEAKS = """leaks AS (SELECT 'leaks/p' || p_partkey || '.txt' AS path, 'first' || chr(10) || CASE p_partkey % 8 WHEN 0 THEN 'AKIA' || upper(substr(h, 1, 16))
  WHEN 1 THEN 'x ghp_' || h || h WHEN 2 THEN '-----BEGIN ' || 'RSA PRIVATE KEY-----' WHEN 3 THEN 'sk_live_' || h WHEN 4 THEN 'xoxb-' || h
  WHEN 5 THEN 'eyJ' || substr(h, 1, 12) || '.eyJ' || substr(h, 1, 14) || '.' || h WHEN 6 THEN 'postgres://user:' || h || '@host' ELSE h END AS text
  FROM (SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part))"""


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, h = F.col("p_partkey"), F.col("h")
    forms = [
        F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16))), F.concat(F.lit("x ghp_"), h, h), F.lit("-----BEGIN " + "RSA PRIVATE KEY-----"), F.concat(F.lit("sk_live_"), h),
        F.concat(F.lit("xoxb-"), h), F.concat(F.lit("eyJ"), F.substring(h, 1, 12), F.lit(".eyJ"), F.substring(h, 1, 14), F.lit("."), h), F.concat(F.lit("postgres://user:"), h, F.lit("@host")), h,
    ]
    p = tables.table(spark, sf_dir, "part").select("p_partkey", F.md5(key.cast("string").cast("binary")).alias("h"))
    line = F.element_at(F.array(*forms), (key % 8 + 1).cast("int"))
    return p.select(F.concat(F.lit("leaks/p"), key.cast("string"), F.lit(".txt")).alias("path"), F.concat(F.lit("first\n"), line).alias("text"))


@query(f"""WITH {DOCS}, {LEAKS}, lines AS (SELECT path, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line
  FROM (SELECT path, string_split(text, chr(10)) AS ls FROM docs UNION ALL SELECT path, string_split(text, chr(10)) FROM leaks)),
hits AS (SELECT path, line_no, unnest([{_format_cases()}]) AS r FROM lines) SELECT path, line_no, r.label AS label, r.severity AS severity FROM hits WHERE r IS NOT NULL""")
def secret_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the formats of secrets, in the documents and in texts made of the parts (104, 105)."""
    docs = tables.documents(spark, sf_dir).select("path", "text")
    return scanning.secret_formats(docs.union(_leaks(spark, sf_dir)))


RULES_SQL = (
    f"CASE WHEN regexp_matches(line, '{scanning.RANDOM_CALL}') AND regexp_matches(line, '{scanning.SECURITY_WORD}') THEN 'insecure_random' END, "
    + ", ".join(f"CASE WHEN regexp_matches(line, '{p.replace(chr(39), chr(39) * 2)}') THEN '{label}' END" for label, p in scanning.WEAK_TLS)
    + f", CASE WHEN regexp_matches(line, '{scanning.LOG_CALL}') AND regexp_matches(line, '{scanning.SENSITIVE_WORD}') THEN 'log_sensitive' END"
)
#: A few lines of source text beside the documents, as the test tables hold little code.
CODE = [
    (1, "token = random.random()\nx = 1"), (2, "requests.get(u, verify = False)\nlogger.info('password ' + p)"), (3, "brand(3)\nkey = rand (9)"),
    (4, "print(secret)\nreprint(token)"), (5, "ctx = ssl._create_unverified_context()"), (6, "rejectUnauthorized: false"), (7, "env NODE_TLS_REJECT_UNAUTHORIZED='0'"), (8, ""),
]
CODE_SQL = "code AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in CODE) + ") v(path, text) UNION ALL SELECT doc_id + 100, text FROM documents)"


@query(f"""WITH {CODE_SQL}, ls AS (SELECT path, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM code), hits AS (SELECT path, line_no,
  unnest([{RULES_SQL}]) AS rule FROM ls) SELECT path, line_no, rule FROM hits WHERE rule IS NOT NULL""")
def line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insecure random numbers, weak TLS and sensitive logging over lines of code (107-109)."""
    docs = tables.documents(spark, sf_dir).select((F.col("doc_id") + 100).alias("path"), "text")
    return scanning.line_rules(docs.union(spark.createDataFrame(CODE, "path long, text string")))


@query(f"""WITH {DOCS}, n AS (SELECT path, len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0
  END AS loc FROM docs WHERE length(text) > 0) SELECT path, loc FROM n WHERE loc > 20""")
def large_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir).select("path", T.line_count(F.col("text")).alias("loc"))
    return docs.where(F.col("loc") > 20).orderBy(F.desc("loc"), "path")


SIGNALS = [("long words", "[A-Za-z]{14,}", 2, 3), ("commas", ",", 20, 1), ("digits", "[0-9]+", 5, 2)]


@query(f"""WITH {DOCS}, n AS (SELECT path, CASE WHEN length(text) = 0 THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS loc,
  {' + '.join(f"greatest(len(regexp_extract_all(text, '{p}')) - {t}, 0) * {w}" for _, p, t, w in SIGNALS)} AS score FROM docs) SELECT path, CAST(loc AS INTEGER) AS loc, CAST(score AS INTEGER) AS score FROM n WHERE loc >= 3 AND score >= 15""")
def complexity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanning.complexity(tables.documents(spark, sf_dir), SIGNALS, 15, 3)


GODS = [("orders", "n_orders", 12), ("balance", "balance", 5000), ("value", "spent", 3000000)]


@query("""WITH m AS (SELECT c_custkey AS entity, count(o_orderkey) AS n_orders, CAST(max(c_acctbal) AS BIGINT) AS balance, CAST(floor(coalesce(sum(o_totalprice), 0) / 1000) * 1000 AS BIGINT) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
 r AS (SELECT *, list_filter([CASE WHEN n_orders > 12 THEN 'orders' END, CASE WHEN balance > 5000 THEN 'balance' END, CASE WHEN spent > 3000000 THEN 'value' END], lambda x: x IS NOT NULL) AS reasons FROM m)
 SELECT entity, array_to_string(reasons, ',') AS reasons, CAST(len(reasons) AS INTEGER) AS n_reasons FROM r WHERE len(reasons) >= 2""")
def god_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with at least two metrics over their thresholds."""
    c, o = tables.table(spark, sf_dir, "customer"), tables.table(spark, sf_dir, "orders")
    spent = (F.floor(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)) / 1000) * 1000).cast("long")
    m = c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy(F.col("c_custkey").alias("entity")).agg(F.count("o_orderkey").alias("n_orders"), F.round(F.max("c_acctbal")).cast("long").alias("balance"), spent.alias("spent"))
    return scanning.god_entities(m, GODS, 2).select("entity", "reasons", "n_reasons")


FAMILIES = {"quotes": {"double": '"', "guillemet": "«"}, "marks": {"table": r"\|", "hash": "###", "percent": "%%%"}, "data": {"mail": "@[a-z]", "address": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"}}
CENSUS = f"""WITH {DOCS}, m AS (SELECT source AS area, unnest([{', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN {{'family': '{f}', 'pattern': '{n}'}} END" for f, ps in FAMILIES.items() for n, p in ps.items())}]) AS m FROM docs),
 census AS (SELECT area, m.family AS family, m.pattern AS pattern, count(*) AS n_files FROM m WHERE m IS NOT NULL GROUP BY ALL)"""


def _census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanning.census(tables.documents(spark, sf_dir), F.col("source"), FAMILIES)


@query(CENSUS + " SELECT * FROM census")
def pattern_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _census(spark, sf_dir)


@query(CENSUS + """ SELECT area, family, 'competing' AS reason, count(*) AS n FROM census GROUP BY area, family HAVING count(*) >= 3
 UNION ALL SELECT min(area), family, 'low_adoption', count(*) FROM census GROUP BY family, pattern HAVING count(*) * 100 < (SELECT count(DISTINCT area) FROM census) * 90""")
def pattern_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanning.census_anomalies(_census(spark, sf_dir), 3, 90)


@query(f"""WITH {DOCS}, m AS (SELECT path, CAST(regexp_matches(text, '\\|') AS INTEGER) + CAST(regexp_matches(text, '@[a-z]')
  AS INTEGER) + CAST(regexp_matches(text, '[0-9]{{5,}}') AS INTEGER) + CAST(regexp_matches(text, '=') AS INTEGER) AS
  n_concerns FROM docs) SELECT * FROM m WHERE n_concerns >= 2""")
def mixed_concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that show at least two of four families of content (141)."""
    t = F.col("text")
    n = t.rlike(r"\|").cast("int") + t.rlike("@[a-z]").cast("int") + t.rlike("[0-9]{5,}").cast("int") + t.rlike("=").cast("int")
    return tables.documents(spark, sf_dir).select("path", n.alias("n_concerns")).where("n_concerns >= 2")


@query(f"""WITH {LINES} SELECT DISTINCT path, line_no, CASE WHEN regexp_matches(line, '[a-z]+@[a-z.]+') THEN
  regexp_extract(line, '([a-z]+)@[a-z.]+', 1) ELSE 'unknown' END AS tag FROM lines WHERE regexp_matches(line,
  '[a-z]+@[a-z.]+') OR regexp_matches(line, '[0-9]{{10,}}')""")
def tagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line that either of two patterns tags (140)."""
    rows = tables.lines(tables.documents(spark, sf_dir), "path")
    mail = F.col("line").rlike("[a-z]+@[a-z.]+")
    return rows.where(mail | F.col("line").rlike("[0-9]{10,}")).select("path", "line_no", F.when(mail, F.regexp_extract("line", "([a-z]+)@[a-z.]+", 1)).otherwise("unknown").alias("tag")).dropDuplicates(["path", "line_no"])


@query(f"""WITH {LINES}, steps AS (SELECT path, line_no, CASE WHEN contains(line, '|') THEN 1 ELSE -1 END AS step FROM lines),
  run AS (SELECT path, greatest(sum(step) OVER (PARTITION BY path ORDER BY line_no), 0) AS depth FROM steps) SELECT
  path, CAST(max(depth) AS BIGINT) AS depth FROM run GROUP BY path HAVING max(depth) >= 1""")
def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest running depth of opening over closing lines (143)."""
    step = F.when(F.col("line").contains("|"), 1).otherwise(-1)
    run = F.sum(step).over(Window.partitionBy("path").orderBy("line_no"))
    return tables.lines(tables.documents(spark, sf_dir), "path").select("path", F.greatest(run, F.lit(0)).alias("depth")).groupBy("path").agg(F.max("depth").alias("depth")).where("depth >= 1")


NORM = f"""{DOCS}, norm AS (SELECT doc_id, CAST(len(kept) AS INTEGER) AS loc, md5(array_to_string(kept, chr(10))) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS kept FROM docs))"""


@query(f"WITH {NORM} SELECT digest, count(*) AS n, min(doc_id) AS first FROM norm GROUP BY digest HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_groups(tables.documents(spark, sf_dir))


@query(f"""WITH {NORM}, g AS (SELECT digest, min(doc_id) AS first FROM norm GROUP BY digest) SELECT first AS doc_a, doc_id AS
  doc_b FROM norm JOIN g USING (digest) WHERE doc_id > first""")
def exact_dup_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal units, each linked with the first of its group (74)."""
    return duplicates.exact_links(tables.documents(spark, sf_dir))


@query()
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct units of at least 15 lines whose line sequences are 0.9 alike (75); tested by brute force."""
    return duplicates.near_pairs(tables.documents(spark, sf_dir))


COMMON = """WITH k AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '{cut}'), lambda x: trim(x)),
  lambda x: x <> '') AS kept FROM documents),
u AS (SELECT min(doc_id) AS doc_id, kept, len(kept) AS loc FROM k WHERE len(kept) >= 15 GROUP BY kept),
n AS (SELECT doc_id, loc, line, count(*) AS times FROM (SELECT doc_id, loc, unnest(kept) AS line FROM u) GROUP BY ALL)
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, CAST(sum(least(a.times, b.times)) AS BIGINT) AS common
FROM n a JOIN n b ON a.line = b.line AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.loc, b.loc
HAVING 20 * sum(least(a.times, b.times)) >= 9 * (a.loc + b.loc)"""


@query(COMMON.format(cut="\\n"))
def near_dup_common_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct units of at least 15 lines that share enough lines to be 0.9 alike in some order (75)."""
    return duplicates.common_lines(tables.documents(spark, sf_dir))


def _words_as_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a word a line: copies with single changed words are alike as sequences of words."""
    return tables.documents(spark, sf_dir).withColumn("text", F.regexp_replace("text", "[ \n]+", "\n"))


@query(COMMON.format(cut="[ \\n]+"))
def near_dup_common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct documents of at least 15 words that share enough words to be 0.9 alike in some order (75)."""
    return duplicates.common_lines(_words_as_lines(spark, sf_dir))


@query()
def near_dup_word_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of documents whose word sequences are equal or 0.9 alike: node, root, size (76); tested by brute force."""
    words = _words_as_lines(spark, sf_dir)
    return duplicates.sized_clusters(duplicates.exact_links(words).union(duplicates.near_links(words).select("doc_a", "doc_b")))


@query()
def near_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's cluster over exact and near links: node, root, size (76-78)."""
    docs = tables.documents(spark, sf_dir)
    return duplicates.sized_clusters(duplicates.exact_links(docs).union(duplicates.near_links(docs).select("doc_a", "doc_b")))


@query(f"""WITH {NORM}, g AS (SELECT digest, min(doc_id) AS root, count(*) AS size FROM norm GROUP BY digest HAVING count(*) > 1) SELECT doc_id AS node, root, size FROM norm JOIN g USING (digest)""")
def exact_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_clusters(tables.documents(spark, sf_dir))


@query(f"""WITH {LINES}, r AS (SELECT path, line_no, trim(line) AS line FROM lines WHERE trim(line) <> ''),
 w AS (SELECT path, line, lead(line, 1) OVER o AS l1, lead(line, 2) OVER o AS l2, lead(line, 3) OVER o AS l3 FROM r WINDOW o AS (PARTITION BY path ORDER BY line_no)),
 d AS (SELECT DISTINCT path, md5(line || chr(10) || l1 || chr(10) || l2 || chr(10) || l3) AS digest FROM w WHERE l3 IS NOT NULL)
 SELECT digest, count(*) AS n_files, min(path) AS first_path FROM d GROUP BY digest HAVING count(*) > 1""")
def boilerplate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four lines that occur in at least two texts (31, 80)."""
    return duplicates.boilerplate(tables.documents(spark, sf_dir))


TREE = f"""WITH {DOCS}, p AS (SELECT unnest([source, source || '/' || lang, path]) AS prefix, text FROM docs)"""


@query(TREE + ", s AS (SELECT prefix, count(*) AS n_files, sum(CASE WHEN length(text) = 0 THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END) AS loc FROM p GROUP BY prefix) SELECT prefix, n_files, CAST(loc AS BIGINT) AS loc, CAST(len(string_split(prefix, '/')) AS INTEGER) AS depth FROM s WHERE len(string_split(prefix, '/')) <= 2")
def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and lines up the path tree, to a depth of two (41, 195)."""
    docs = tables.documents(spark, sf_dir).select("path", T.line_count(F.col("text")).alias("loc"))
    return layout.tree_rollup(docs, 2)


@query(f"""WITH {DOCS}, f AS (SELECT source || '/' || lang AS dir, count(*) AS n_files FROM docs GROUP BY ALL), c AS (SELECT source AS dir, count(DISTINCT lang) AS n_children FROM docs GROUP BY ALL)
 SELECT dir, coalesce(n_files, 0) AS n_files, coalesce(n_children, 0) AS n_children FROM f FULL JOIN c USING (dir)""")
def dir_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.dir_stats(tables.documents(spark, sf_dir))


@query(f"""WITH {DOCS}, f AS (SELECT source || '/' || lang AS dir, count(*) AS n_files FROM docs GROUP BY ALL), c AS (SELECT source AS dir, count(DISTINCT lang) AS n_children FROM docs GROUP BY ALL),
 s AS (SELECT dir, coalesce(n_files, 0) AS n_files, coalesce(n_children, 0) AS n_children FROM f FULL JOIN c USING (dir))
 SELECT dir, n_files, n_children, CASE WHEN n_files >= 20 OR n_children >= 10 OR n_files + 3 * n_children >= 30 THEN 'overload' WHEN n_files = 1 AND n_children = 0 THEN 'thin_wrapper' END AS kind
 FROM s WHERE n_files >= 20 OR n_children >= 10 OR n_files + 3 * n_children >= 30 OR (n_files = 1 AND n_children = 0)""")
def flat_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.flat_dirs(layout.dir_stats(tables.documents(spark, sf_dir)))


#: Parts as files named in seven ways, in four directories.
NAMED_SQL = """named AS (SELECT 'area' || p_size % 4 || '/' || CASE p_partkey % 11 WHEN 0 THEN replace(p_name, ' ', '-') || '.py' WHEN 1 THEN 'Part' || p_partkey || '.py'
  WHEN 2 THEN 'partX' || p_partkey || '.py' WHEN 3 THEN '.hidden' WHEN 4 THEN 'UPPER-case.py' WHEN 5 THEN '1st.py' WHEN 6 THEN 'part' || p_partkey
  ELSE replace(p_name, ' ', '_') || '.py' END AS path, p_partkey AS i FROM part)"""
CONVENTION = """conv AS (SELECT split_part(path, '/', 1) AS dir, regexp_replace(split_part(path, '/', 2), '\\.[^.]*$', '') AS stem FROM named),
 kinds AS (SELECT dir, stem, CASE WHEN length(stem) = 0 THEN NULL WHEN contains(stem, '-') AND stem = lower(stem) THEN 'kebab-case' WHEN NOT contains(stem, '-') AND regexp_matches(stem, '^[A-Z]') THEN 'PascalCase'
  WHEN NOT contains(stem, '-') AND regexp_matches(stem, '^[a-z]') AND regexp_matches(stem, '[A-Z]') THEN 'camelCase' WHEN contains(stem, '_') AND stem = lower(stem) THEN 'snake_case'
  WHEN NOT contains(stem, '-') AND stem = lower(stem) AND regexp_matches(stem, '[a-z]') THEN 'flat_lower' END AS kind FROM conv)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, turn, key = tables.table(spark, sf_dir, "part"), F.col("p_partkey") % 11, F.col("p_partkey").cast("string")
    dashed, snake = (F.concat(F.replace("p_name", F.lit(" "), F.lit(c)), F.lit(".py")) for c in "-_")
    names = [dashed, F.concat(F.lit("Part"), key, F.lit(".py")), F.concat(F.lit("partX"), key, F.lit(".py")), F.lit(".hidden"), F.lit("UPPER-case.py"), F.lit("1st.py"), F.concat(F.lit("part"), key)]
    name = F.element_at(F.array(*names, *[snake] * 4), (turn + 1).cast("int"))
    return p.select(F.concat(F.lit("area"), (F.col("p_size") % 4).cast("string"), F.lit("/"), name).alias("path"), F.col("p_partkey").alias("i"))


@query(f"WITH {NAMED_SQL}, {CONVENTION} SELECT dir, stem, kind FROM kinds")
def convention_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _named(spark, sf_dir)
    name = T.base_name(F.col("path"))
    return named.select(T.area(F.col("path"), 1).alias("dir"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), T.naming_convention(name).alias("kind"))


@query(f"""WITH {NAMED_SQL}, {CONVENTION}, n AS (SELECT dir, kind, count(*) AS n FROM kinds WHERE kind IS NOT NULL GROUP BY ALL),
 r AS (SELECT *, sum(n) OVER (PARTITION BY dir) AS total, row_number() OVER (PARTITION BY dir ORDER BY n DESC, kind) AS place FROM n)
 SELECT a.dir, b.kind AS majority, b.n AS majority_count, a.kind AS minority, a.n AS minority_count, CAST(a.total AS BIGINT) AS total FROM r a JOIN r b ON a.dir = b.dir AND b.place = 1 WHERE a.place > 1 AND a.n >= 2 AND a.n * 100 >= a.total * 15""")
def naming_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minority conventions of a directory with at least two files and 15 % (95, 96)."""
    return layout.naming(_named(spark, sf_dir), 2, 15)


ZONE_RULES = [(1, "vendor", "/src1/"), (2, "generated", ".9"), (3, "test", "1_"), (4, "config", "17.txt"), (5, "script", "src5/"), (6, "test", "_3.txt"), (7, "config", "/fr/")]
ZONED = f"""{DOCS}, zoned AS (SELECT path, lang, CASE WHEN path = 'src1/en/1.txt' THEN 'script' WHEN contains('/' || path || '/', '/src1/') THEN 'vendor' WHEN contains(split_part(path, '/', 3), '.9') THEN 'generated'
 WHEN starts_with(split_part(path, '/', 3), '1_') THEN 'test' WHEN split_part(path, '/', 3) = '17.txt' THEN 'config' WHEN contains(path, 'src5/') THEN 'script'
 WHEN ends_with(split_part(path, '/', 3), '_3.txt') THEN 'test' WHEN contains('/' || path || '/', '/fr/') THEN 'config' ELSE 'production' END AS zone FROM docs)"""


def _zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.with_zone(tables.documents(spark, sf_dir), ZONE_RULES, {"src1/en/1.txt": "script"})


@query(f"WITH {ZONED} SELECT path, zone FROM zoned")
def zone_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zoned(spark, sf_dir).select("path", "zone")


@query(f"WITH {ZONED} SELECT zone, count(*) AS n FROM zoned GROUP BY zone")
def zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zoned(spark, sf_dir).groupBy("zone").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ZONED} SELECT lang, greatest(count(*) - count(*) FILTER (zone IN ('test', 'config', 'generated', 'vendor')),
  0) AS potential FROM zoned GROUP BY lang""")
def adjusted_potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.col("zone").isin("test", "config", "generated", "vendor")
    return _zoned(spark, sf_dir).groupBy("lang").agg(F.greatest(F.count(F.lit(1)) - F.count_if(out), F.lit(0).cast("long")).alias("potential"))


@query(f"""WITH {DOCS} SELECT doc_id, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(text),
  '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3))) AS words FROM docs""")
def word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).select("doc_id", T.word_set(F.col("text")).alias("words"))


@query(f"""WITH {DOCS} SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS short,
  regexp_replace(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
  FROM docs""")
def light_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows made light: shortened texts and slugs (34, scalar functions)."""
    return tables.documents(spark, sf_dir).select("doc_id", T.shortened(F.col("text"), 40).alias("short"), T.slug(F.concat_ws(" ", "source", "lang")).alias("slug"))


@query(f"""WITH {DOCS} SELECT count(*) AS n_files, CAST(sum(CASE WHEN length(text) = 0 THEN 0 ELSE len(string_split(text,
  chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END) AS BIGINT) AS loc, count(DISTINCT source ||
  '/' || lang) AS n_dirs FROM docs""")
def corpus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    return docs.agg(F.count(F.lit(1)).alias("n_files"), F.sum(T.line_count(F.col("text")).cast("long")).alias("loc"), F.count_distinct(T.area(F.col("path"))).alias("n_dirs"))
