"""Queries of the tool-report parsers, over reports made of the findings, and of payloads and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.operators import payloads
from corpuslens.plans.registry import query
from corpuslens.sources import reports, tables
from corpuslens.sources.tables import DOCS, LINES, WORK

#: Findings as rows of a report; every 11th has a line that is no number, every 13th no message.
FOUND = f"""{WORK}, f AS (SELECT ord, file, CAST(loc AS INTEGER) AS line, detector, name, ord % 13 = 0 AS mute,
  CASE WHEN ord % 13 = 0 THEN '' ELSE detector || ' ' || name END AS message FROM work WHERE ord % 11 <> 0)"""
KEPT = f"WITH {FOUND} SELECT file, line, message FROM f WHERE NOT mute"


def _reports(spark: SparkSession, sf_dir: str, entry, whole) -> DataFrame:
    """One report (a column raw) for each file: ``entry`` makes what stands for a finding, ``whole`` the text of them all."""
    w = tables.work_items(spark, sf_dir)
    line = F.when(F.col("ord") % 11 == 0, "x").otherwise(F.col("loc").cast("string"))
    message = F.when(F.col("ord") % 13 == 0, "").otherwise(F.concat_ws(" ", "detector", "name"))
    rows = w.select("file", "ord", "detector", line.alias("line"), message.alias("message"))
    listed = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("ord", entry.alias("e")))).alias("es"))
    return listed.select(whole(F.transform("es", lambda x: x["e"])).alias("raw"))


def _messages(*more: Column) -> Column:
    return F.struct("line", "message", *more)


@query(KEPT)
def parse_gnu(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.col("file"), F.lit(":"), "line", F.when((F.col("ord") % 2 == 0) & (F.col("ord") % 13 != 0) & (F.col("ord") % 11 != 0), ":7").otherwise(""), F.lit(": "), "message")
    return reports.gnu(_reports(spark, sf_dir, entry, lambda es: F.array_join(es, "\n")))


@query(KEPT)
def parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, lines and messages under three sets of names."""
    kind = F.col("ord") % 3
    names = [("file", "line", "message"), ("filename", "row", "text"), ("path", "line_no", "reason")]
    fields = [F.when(kind == i, F.col(c)).alias(n) for i, group in enumerate(names) for n, c in zip(group, ("file", "line", "message"))]
    return reports.flat_json(_reports(spark, sf_dir, F.struct(*fields), F.to_json))


def _file_of(es: Column) -> Column:
    """The file that all entries of a report share."""
    return es[0]["file"]


@query(KEPT)
def parse_eslint(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda es: F.to_json(F.array(F.struct(_file_of(es).alias("filePath"), es.alias("messages"))))
    return reports.eslint(_reports(spark, sf_dir, _messages(F.col("file")), whole))


@query(KEPT)
def parse_golangci(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.col("message").alias("Text"), F.struct(F.col("file").alias("Filename"), F.col("line").alias("Line")).alias("Pos"))
    return reports.golangci(_reports(spark, sf_dir, entry, lambda es: F.to_json(F.struct(es.alias("Issues")))))


@query(KEPT)
def parse_rubocop(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct("file", "message", F.struct("line").alias("location"))
    whole = lambda es: F.to_json(F.struct(F.array(F.struct(_file_of(es).alias("path"), es.alias("offenses"))).alias("files")))
    return reports.rubocop(_reports(spark, sf_dir, entry, whole))


@query(KEPT)
def parse_cargo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of JSON a finding, with its message as the first line of what the compiler shows, and lines that are no JSON."""
    shown = F.when(F.col("message") != "", F.concat("message", F.lit("\n --> "), "file"))
    spans = F.array(F.struct(F.col("file").alias("file_name"), F.col("line").alias("line_start")))
    message = F.struct(F.lit("compiler-message").alias("reason"), F.struct(shown.alias("rendered"), spans.alias("spans")).alias("message"))
    lines = lambda es: F.concat(F.array_join(F.transform(es, lambda x: F.to_json(x)), "\nnot json\n"), F.lit('\n{"reason":"build-finished"}'))
    return reports.cargo(_reports(spark, sf_dir, message, lines))


@query(f"""WITH {FOUND} SELECT file, line, CASE WHEN mute THEN '' ELSE '[' || detector || '] ' || message END || ' (C' || ord % 5 || ')' AS message
  FROM f""")
def parse_credo(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = F.concat(F.lit("C"), (F.col("ord") % 5).cast("string"))
    entry = F.struct(F.col("file").alias("filename"), F.col("line").alias("line_no"), "message", F.col("detector").alias("category"), check.alias("check"))
    return reports.credo(_reports(spark, sf_dir, entry, lambda es: F.to_json(F.struct(es.alias("issues")))))


@query(KEPT)
def parse_phpstan_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda es: F.to_json(F.struct(F.create_map(_file_of(es), F.struct(es.alias("messages"))).alias("files")))
    return reports.phpstan(_reports(spark, sf_dir, _messages(F.col("file")), whole))


@query(f"""WITH {WORK}, g AS (SELECT file, arg_min(CASE WHEN ord % 11 = 0 THEN 1 ELSE CAST(loc AS INTEGER) END, ord) AS line,
  arg_min(CASE WHEN ord % 13 = 0 THEN '' ELSE detector || ' ' || name END, ord) AS message, count(*) AS n FROM work GROUP BY file)
SELECT file, line, 'next lint: ' || message || ' (' || n || ' issue(s) in file)' AS message FROM g""")
def parse_next_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text around an array of JSON; a file's first message, and how many there are."""
    whole = lambda es: F.concat(F.lit("info\n"), F.to_json(F.array(F.struct(_file_of(es).alias("filePath"), es.alias("messages")))), F.lit("\ndone"))
    return reports.next_lint(_reports(spark, sf_dir, _messages(F.col("file")), whole))


@query(f"""WITH {DOCS}, o AS (SELECT doc_id, 40 + octet_length(encode(left(text, 400))) AS bytes,
  sum(40 + octet_length(encode(left(text, 400)))) OVER (ORDER BY doc_id) AS upto FROM docs) SELECT doc_id, bytes,
  CAST(upto AS BIGINT) AS upto FROM o WHERE doc_id < 200 AND upto <= 30000""")
def payload_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows, made light, that fit a byte budget (32-34); at most 200 rows are looked at."""
    return payloads.within_budget(tables.documents(spark, sf_dir), 200, 400, 30_000)


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 2000")
def event_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 2000 events of the log (37)."""
    return payloads.retained(tables.table(spark, sf_dir, "events"), 2000).select("event_id", "event_type")


@query(f"""WITH {WORK} SELECT file, count(*) AS n, count(*) FILTER (status = 'open') AS n_open,
  array_to_string(list_slice(list_sort(list(finding_id)), 1, 5), '|') AS first_ids FROM work WHERE starts_with(file,
  'area3/') GROUP BY file""")
def show_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a path grouped by file, with counts and the first ids (43, 252)."""
    return payloads.by_file(tables.work_items(spark, sf_dir).where(F.col("file").startswith("area3/")), 5)


@query(f"""WITH {WORK}, r AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY tier, finding_id) AS k
  FROM work WHERE status = 'open' AND NOT suppressed) SELECT detector, '- ' || array_to_string(list(finding_id
  ORDER BY tier, finding_id), chr(10) || '- ') AS section FROM r WHERE k <= 3 GROUP BY detector""")
def plan_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three open findings of each detector as a Markdown section (42)."""
    w = tables.work_items(spark, sf_dir).where((F.col("status") == "open") & ~F.col("suppressed"))
    top = w.withColumn("k", F.row_number().over(Window.partitionBy("detector").orderBy("tier", "finding_id"))).where("k <= 3")
    return top.groupBy("detector").agg(F.concat(F.lit("- "), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tier", "finding_id"))), lambda x: x["finding_id"]), "\n- ")).alias("section"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


STEPS = "1. First step\n   more of it\n2) Second\n\nintro\n10. Last"


@query(f"""WITH {LINES}, n AS (SELECT doc_id, line_no, trim(line) AS line, (line_no - 1) // 3 + 1 AS number FROM lines)
SELECT doc_id, CAST(number AS INTEGER) AS number, arg_min(line, line_no) AS title, CAST(count(*) FILTER (line <> '' OR line_no % 3 = 1)
  AS INTEGER) AS n_lines FROM n GROUP BY doc_id, number""")
def parsed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as steps of three lines: the first one numbered, with how many lines belong to each (16)."""
    number = lambda i: F.floor(i / 3) + 1
    mark = lambda x, i: F.when(i % 3 == 0, F.concat(number(i).cast("string"), F.lit(". "), F.trim(x))).otherwise(F.concat(F.lit("   "), F.trim(x)))
    text = F.array_join(F.transform(F.split("text", "\n"), mark), "\n")
    return payloads.steps(tables.documents(spark, sf_dir).select("doc_id", text.alias("text"))).select("doc_id", "number", "title", "n_lines")


@query(f"""WITH {DOCS}, t AS (SELECT doc_id, text FROM docs UNION ALL SELECT -1, {_text(STEPS)}),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text,
  chr(10)) AS ls FROM t)),
g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[0-9]+[.)] ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id
  ORDER BY pos) AS step FROM l),
k AS (SELECT doc_id, step, arg_min(line, pos) AS head, count(*) AS n FROM g WHERE step > 0 AND trim(line) <> ''
  GROUP BY ALL)
SELECT doc_id, CAST(regexp_extract(head, '^([0-9]+)[.)] (.*)$', 1) AS INTEGER) AS number, regexp_extract(head,
  '^([0-9]+)[.)] (.*)$', 2) AS title, CAST(n AS INTEGER) AS n_lines FROM k""")
def document_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered steps of all documents, and of a fixed text (16)."""
    docs = tables.documents(spark, sf_dir).select("doc_id", "text")
    return payloads.steps(docs.union(spark.createDataFrame([(-1, STEPS)], "doc_id long, text string"))).select("doc_id", "number", "title", "n_lines")


@query("""SELECT event_type, CASE WHEN event_type = 'purchase' THEN value END AS strict FROM events WHERE event_id % 9 <> 4""")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, damaged ones skipped; the strict score of those that carry scores (13, 241)."""
    e = tables.table(spark, sf_dir, "events")
    scores = F.when(F.col("event_type") == "purchase", F.struct(F.struct(F.col("value").alias("strict")).alias("scores")))
    line = F.to_json(F.struct(F.lit(1).alias("schema_version"), "event_type", scores.alias("payload")))
    damaged = F.when(F.col("event_id") % 2 == 0, "not json").otherwise(F.expr("left(line, 20)"))
    lines = e.withColumn("line", line).select(F.when(F.col("event_id") % 9 == 4, damaged).otherwise(F.col("line")).alias("value"))
    return payloads.read_log(lines)


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS mean FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT day, mean, mean - lag(mean) OVER (ORDER BY day) AS change FROM d""")
def strict_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean strict score of each day, and its change from the day before that has one (241)."""
    e = tables.table(spark, sf_dir, "events").where("event_type = 'purchase'")
    daily = e.groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"))
    # a row a day: the window sees as many rows as there are days
    return daily.withColumn("change", F.col("mean") - F.lag("mean").over(Window.orderBy("day")))


@query(f"""WITH {WORK} SELECT detector AS dimension, name AS identifier, 'tier ' || tier AS summary FROM work
  WHERE ord % 7 <> 0 AND ord % 10 <> 3""")
def review_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of review envelopes, one a file, that have all required fields; every tenth envelope is damaged (15)."""
    w = tables.work_items(spark, sf_dir)
    summary = F.when(F.col("ord") % 7 != 0, F.concat(F.lit("tier "), F.col("tier").cast("string")))
    issue = F.struct(F.col("detector").alias("dimension"), F.col("name").alias("identifier"), summary.alias("summary"))
    # findings of a file are in ten envelopes by the last digit of their number; those of the third are cut short
    rows = w.groupBy("file", (F.col("ord") % 10).alias("digit")).agg(F.collect_list(issue).alias("issues"))
    whole = F.to_json(F.struct("issues", F.create_map(F.lit("d"), F.lit(70.5)).alias("assessments")))
    return payloads.review_issues(rows.withColumn("raw", whole).select(F.when(F.col("digit") == 3, F.expr("left(raw, 30)")).otherwise(F.col("raw")).alias("raw")))
