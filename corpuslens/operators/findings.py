"""Findings: ids, semantics, scopes, patterns, suppression, checks. Every operator maps a findings table.

Columns follow one schema: finding_id, detector, file, name, tier, confidence, status, lang, zone, first_seen,
last_seen, reopen_count, suppressed. Ids are detector::file::name, so a merge by id is idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T

STATUSES = ["open", "fixed", "wontfix", "false_positive", "auto_resolved", "deferred", "triaged_out"]
CONFIDENCES = ["high", "medium", "low"]


def finding_id(detector: Column, file: Column, name: Column) -> Column:
    """detector::file, and ::name where there is one."""
    return F.concat_ws("::", detector, file, F.when(F.coalesce(name, F.lit("")) != "", name))


def in_scope(file: Column, path: str) -> Column:
    """Under the path or at it; findings about the whole corpus (file '.') are always in scope."""
    return file.startswith(path.rstrip("/") + "/") | (file == path) | (file == ".")


def scope_breakdown(findings: DataFrame, path: str) -> DataFrame:
    """One row: open findings in scope, out of scope and all."""
    is_open = (F.col("status") == "open") & ~F.col("suppressed")
    inside = in_scope(F.col("file"), path)
    return findings.agg(F.count_if(is_open & inside).alias("in_scope"), F.count_if(is_open & ~inside).alias("out_of_scope"), F.count_if(is_open).alias("global"))


def matches(pattern: str) -> Column:
    """Exact id, glob, id prefix (with ::), hash suffix (8 hex digits or more), detector, path or last segment."""
    i, file = F.col("finding_id"), F.col("file")
    hit = (i == pattern) | (F.col("detector") == pattern) | (file == pattern) | file.startswith(pattern.rstrip("/") + "/") | (F.element_at(F.split(i, "::"), -1) == pattern)
    if "*" in pattern or "?" in pattern:
        hit = hit | i.rlike(T.glob_regex(pattern)) | file.rlike(T.glob_regex(pattern))
    if "::" in pattern:
        hit = hit | i.startswith(pattern)
    if len(pattern) >= 8 and all(c in "0123456789abcdef" for c in pattern):
        hit = hit | i.endswith("::" + pattern)
    return hit


def ignore_pattern(patterns: list[str]) -> Column:
    """The first of the ordered patterns that hits (globs on id or file, id prefixes, paths), or null."""
    i, file, out = F.col("finding_id"), F.col("file"), None
    for p in patterns:
        if "*" in p or "?" in p:
            hit = i.rlike(T.glob_regex(p)) | file.rlike(T.glob_regex(p))
        elif "::" in p:
            hit = i.startswith(p)
        else:
            hit = (file == p) | file.startswith(p.rstrip("/") + "/")
        out = F.when(hit, p) if out is None else out.when(hit, p)
    return F.lit(None).cast("string") if out is None else out


def suppressed_by(findings: DataFrame, patterns: list[str]) -> DataFrame:
    """findings with suppressed and suppression_pattern set by the ignore patterns."""
    hit = ignore_pattern(patterns)
    return findings.withColumns({"suppression_pattern": hit, "suppressed": F.col("suppressed") | hit.isNotNull()})


def select_matching(findings: DataFrame, pattern: str, status: str = "all") -> DataFrame:
    """Findings that are not suppressed, in the status (or any) and match the pattern."""
    kept = findings.where(~F.col("suppressed") & matches(pattern))
    return kept if status == "all" else kept.where(F.col("status") == status)


def confidence_rank(confidence: Column) -> Column:
    """high 0, medium 1, low 2; anything else counts as medium."""
    return F.when(confidence == "high", 0).when(confidence == "low", 2).otherwise(1)


def standalone(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Drop findings weaker than their detector's standalone threshold; catalog has detector and standalone."""
    joined = findings.join(catalog, "detector", "left")
    return joined.where(F.col("standalone").isNull() | (confidence_rank(F.col("confidence")) <= confidence_rank(F.col("standalone"))))


def zone_filtered(findings: DataFrame, skips: DataFrame) -> DataFrame:
    """Drop findings whose zone skips their detector; skips(zone, detector) is a small policy table."""
    return findings.join(skips, ["zone", "detector"], "left_anti")


def downgraded(findings: DataFrame, policy: DataFrame) -> DataFrame:
    """Confidence replaced where policy(zone, detector, lower_to) says so."""
    joined = findings.join(policy, ["zone", "detector"], "left")
    return joined.withColumn("confidence", F.coalesce("lower_to", "confidence")).drop("lower_to")


ASSESSMENTS = ["subjective_review", "subjective_assessment", "holistic_review"]


def kind_of(detector: Column, verdict: Column) -> Column:
    """The kind of work item, by detector and then by the verdict on a concern."""
    confirmed = F.lower(F.trim(verdict)) == "confirmed"
    return (
        F.when(detector == "review", "review_defect").when(detector == "concerns", "review_concern")
        .when(detector.isin(ASSESSMENTS), "assessment_request").when(confirmed, "review_concern").otherwise("mechanical_defect")
    )


def origin_of(detector: Column, verdict: Column) -> Column:
    """Where the work item comes from: a scan, an imported review or a synthetic task."""
    imported = (detector == "review") | ((detector == "concerns") & (F.lower(F.trim(verdict)) == "confirmed"))
    return F.when(imported, "review_import").when(detector.isin(ASSESSMENTS), "synthetic_task").otherwise("scan")


def with_defaults(rows: DataFrame) -> DataFrame:
    """Loose text rows as findings: unknown status open, tier within 1..4 (else 3), counts not negative."""
    tier = F.col("tier").try_cast("int")
    return rows.where(F.col("finding_id").isNotNull()).select(
        "finding_id", F.when(F.lower(F.trim("status")).isin(STATUSES), F.lower(F.trim("status"))).otherwise("open").alias("status"),
        F.when(tier.between(1, 4), tier).otherwise(3).alias("tier"), F.greatest(F.coalesce(F.col("reopen_count").try_cast("int"), F.lit(0)), F.lit(0)).alias("reopen_count"),
        F.coalesce(F.col("confidence"), F.lit("medium")).alias("confidence"),
    )


def violations(findings: DataFrame) -> DataFrame:
    """finding_id and broken rule: enumerations, tier range, negative counts, id not made of its parts."""
    rules = F.array(
        F.when(~F.col("status").isin(STATUSES), "status"), F.when(~F.col("confidence").isin(CONFIDENCES), "confidence"),
        F.when(~F.col("tier").between(1, 4), "tier"), F.when(F.col("reopen_count") < 0, "reopen_count"),
        F.when(F.col("finding_id") != finding_id(F.col("detector"), F.col("file"), F.col("name")), "id"),
    )
    return findings.select("finding_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def structural_merge(signals: DataFrame) -> DataFrame:
    """file, signals (sorted), tier and confidence: three signals make tier 4 and high confidence."""
    by_file = signals.groupBy("file").agg(F.array_sort(F.collect_set("signal")).alias("kinds"), F.max("score").alias("score"))
    n = F.size("kinds")
    alone = (n == 1) & (F.col("kinds")[0] == "complexity")
    kept = by_file.where(~alone | (F.col("score") >= 50))
    return kept.select("file", F.array_join("kinds", ",").alias("signals"), F.when(n >= 3, 4).otherwise(3).alias("tier"), F.when(n >= 3, "high").otherwise("medium").alias("confidence"))


def exploded_status_counts(findings: DataFrame) -> DataFrame:
    """tier (null: all tiers), status, n of findings that are not suppressed: one pass with grouping sets."""
    return findings.where(~F.col("suppressed")).rollup("status", "tier").agg(F.count(F.lit(1)).alias("n")).where("status IS NOT NULL")


def first_seen_since(findings: DataFrame, history: DataFrame) -> DataFrame:
    """Findings first seen at or after the last scan of history(ts)."""
    last = history.agg(F.max("ts").alias("last_scan"))
    return findings.join(F.broadcast(last), F.col("first_seen") >= F.col("last_scan")).drop("last_scan")


def noise_budget(findings: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` findings of each detector by tier, confidence, id; hidden counts the others."""
    by = Window.partitionBy("detector")
    order = by.orderBy("tier", confidence_rank(F.col("confidence")), "finding_id")
    ranked = findings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget)
    totals = findings.groupBy("detector").agg(F.count(F.lit(1)).alias("total"))
    return ranked.join(totals, "detector").withColumn("hidden", F.greatest(F.col("total") - budget, F.lit(0).cast("long")))


def round_robin(budgeted: DataFrame, most: int) -> DataFrame:
    """Detectors in turn (rank, then detector) up to a global cap: a top-k, never a sort of all rows."""
    return budgeted.orderBy("rank", "detector").limit(most)
