"""Queries of the streams, run with all available data and compared with their batch equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.graph import scratch_path
from corpuslens.plans.registry import query
from corpuslens.streaming import events, logs


def _name(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex[:8]}"


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of six files, a micro-batch each, in which a quarter come up to half a day late."""
    path = events.as_files(events.table(spark, sf_dir), 6, _name("log"))
    return events.in_order_of_name(spark, path, events.EVENTS, "log").withColumn("ts", events.instant("ts"))


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: events.without_zone(c) for c in columns})


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_counts_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.drained(events.tumbling_counts(_batches(spark, sf_dir)), _name("tumbling"), "complete")
    return _ntz(found.drop("total"), "start")


@query("""WITH w AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start
  FROM events) SELECT start, count(*) AS n FROM w GROUP BY start""")
def event_counts_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.drained(events.sliding_counts(_batches(spark, sf_dir)), _name("sliding"), "complete")
    return _ntz(found, "start")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL
  THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.drained(events.sessions(_batches(spark, sf_dir)), _name("sessions"), "complete")
    return _ntz(found, "start", "end")


MACHINE = """e AS (SELECT user_id, event_type AS kind, row_number() OVER w AS k, lag(event_type) OVER w AS before,
    count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS errors
  FROM events WHERE event_type IN ('error', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, arg_max(CASE WHEN kind = 'error' THEN 'open' WHEN errors > 0 THEN 'resolved' ELSE 'new' END, k) AS status,
    count(*) FILTER (kind = 'error' AND before = 'purchase' AND errors > 1) AS reopened FROM e GROUP BY user_id)"""


@query(f"""WITH {MACHINE} SELECT user_id, coalesce(status, 'new') AS status, CAST(coalesce(reopened, 0) AS INTEGER) AS reopened
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN s USING (user_id)""")
def finding_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each user's finding (2.11), over micro-batches that hold late events."""
    with events.rocksdb(spark):
        return events.drained(events.finding_states(_batches(spark, sf_dir), "1 day"), _name("states"), "update", "user_id")


@query("""WITH w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events, w WHERE date_trunc('day',
  ts) + INTERVAL 1 DAY <= mark GROUP BY ALL""")
def event_counts_on_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the days that the watermark has closed, in append mode: each day is given out once (2.11)."""
    found = events.appended(events.on_time(_batches(spark, sf_dir), late="1 day"), _name("on_time"))
    return _ntz(found.drop("total"), "start")


@query("""SELECT CAST(user_id AS VARCHAR) AS unit, CAST(arg_max(event_id, (ts, CAST(event_id AS VARCHAR))) AS VARCHAR) AS digest,
  CAST(user_id AS VARCHAR) || ':' || CAST(arg_max(event_id, (ts, CAST(event_id AS VARCHAR))) AS VARCHAR) AS result FROM events
  GROUP BY user_id""")
def changed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as units whose content is their last event, recomputed as they change, over batches with late rows (2.11)."""
    e = _batches(spark, sf_dir)
    log = e.select(F.col("user_id").cast("string").alias("unit"), F.col("event_id").cast("string").alias("digest"), F.col("ts").alias("at"), F.col("event_id").cast("string").alias("id"))
    made = events.recomputed(log, scratch_path(spark, "units"), scratch_path(spark, "units-progress"), F.concat("unit", F.lit(":"), "digest"))
    return made.select("unit", "digest", "result")


def _as_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as lines of JSON; every 50th is cut short, every 70th has no time."""
    e = events.table(spark, sf_dir)
    at = F.when(F.col("event_id") % 70 == 3, F.lit(None)).otherwise(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    row = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), at.alias("at"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("unit"), F.sha2(F.col("props"), 256).alias("digest")))
    cut = F.when(F.col("event_id") % 50 == 7, F.expr("left(line, length(line) - 3)")).otherwise(F.col("line"))
    return e.withColumn("line", row).select("event_id", cut.alias("value"))


GOOD = "(event_id % 50 <> 7 AND event_id % 70 <> 3)"


@query(f"""SELECT CASE WHEN {GOOD} THEN event_type ELSE 'damaged' END AS kind, count(*) AS n FROM events GROUP BY ALL""")
def log_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a log of JSON lines by kind, read as a stream of files; damaged lines are counted, not lost (13)."""
    path = scratch_path(spark, "lines")
    _as_lines(spark, sf_dir).repartition(8, "event_id").select("value").write.text(path)
    kind = F.when(F.col("damaged"), "damaged").otherwise(F.col("kind"))
    counts = logs.read_log(spark, path, 2, damaged=True).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return events.drained(counts, _name("kinds"), "complete")


@query(f"""SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind FROM events WHERE {GOOD} ORDER BY ts DESC, id DESC LIMIT
  2000""")
def log_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log appended in parts, one of them twice, then compacted to its last 2000 rows behind a manifest (13, 37)."""
    root, lines = scratch_path(spark, "log"), _as_lines(spark, sf_dir)
    for part in (0, 1, 2, 1):
        logs.append(lines.where(F.col("event_id") % 3 == part), root)
    logs.compacted(spark, root, 2000)
    return logs.read(spark, root).select("id", "kind")
