"""Payloads and logs: light rows within a byte budget, retention, groupings, steps, JSON-lines logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def within_budget(docs: DataFrame, most_rows: int, most_chars: int, most_bytes: int) -> DataFrame:
    """doc_id, bytes, upto: the first rows in id order, texts shortened, while their bytes fit the budget."""
    first = docs.select("doc_id", (F.octet_length(F.substring("text", 1, most_chars)) + 40).alias("bytes")).orderBy("doc_id").limit(most_rows)
    upto = F.sum("bytes").over(Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return first.withColumn("upto", upto).where(F.col("upto") <= most_bytes)


def retained(events: DataFrame, most: int) -> DataFrame:
    """The newest events of a log: a top-k, each task keeps its own newest."""
    return events.orderBy(F.desc("event_id")).limit(most)


def by_file(findings: DataFrame, most_ids: int) -> DataFrame:
    """file, n, n_open and the first ids; ids are ranked first, so no group collects more than it shows."""
    rank = F.row_number().over(Window.partitionBy("file").orderBy("finding_id"))
    shown = findings.withColumn("rank", rank).where(F.col("rank") <= most_ids)
    ids = shown.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("finding_id")), "|").alias("first_ids"))
    sums = findings.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "open").alias("n_open"))
    return sums.join(ids, "file")


def steps(texts: DataFrame) -> DataFrame:
    """doc_id, number, title, n_lines of numbered steps; lines before the first step belong to none."""
    rows = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    opens = F.col("line").rlike(r"^[0-9]+[.)] ")
    group = F.sum(opens.cast("int")).over(Window.partitionBy("doc_id").orderBy("pos"))
    kept = rows.withColumn("step", group).where((F.col("step") > 0) & (F.trim("line") != ""))
    head = F.min_by("line", "pos")
    return kept.groupBy("doc_id", "step").agg(F.regexp_extract(head, r"^([0-9]+)[.)] (.*)$", 1).cast("int").alias("number"), F.regexp_extract(head, r"^([0-9]+)[.)] (.*)$", 2).alias("title"), F.count(F.lit(1)).cast("int").alias("n_lines"))


def read_log(lines: DataFrame) -> DataFrame:
    """event_type and strict of each line of value that is an event; corrupt lines give nothing."""
    event = F.from_json("value", "struct<event_type:string,payload:struct<scores:struct<strict:double>>>")
    return lines.select(event.alias("e")).where("e.event_type IS NOT NULL").select("e.event_type", F.col("e.payload.scores.strict").alias("strict"))


def review_issues(raw: DataFrame) -> DataFrame:
    """dimension, identifier, summary of issues in envelopes that have all three."""
    envelope = F.from_json("raw", "struct<issues:array<struct<dimension:string,identifier:string,summary:string>>,assessments:map<string,double>>")
    return raw.select(F.explode(envelope["issues"]).alias("i")).select("i.*").where("dimension IS NOT NULL AND identifier IS NOT NULL AND summary IS NOT NULL")
