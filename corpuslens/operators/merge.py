"""Scan merge: insert, refresh, reopen, suppress; corroboration of findings that disappeared; plan sets.

A merge is one full outer join by id, so repeating a scan changes nothing. Precedence of the rules is the
order of the ``when`` branches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOLVED = ["fixed", "wontfix", "false_positive", "auto_resolved"]


def upsert(existing: DataFrame, current: DataFrame, ignored: Column, now: str) -> DataFrame:
    """Merged findings with action: new, suppressed, reopened, refreshed or absent.

    existing has status and reopen_count; current has the ids found now; ignored is a condition on the id.
    A resolved finding that shows again reopens, but one resolved as wontfix or false positive stays so.
    """
    e = existing.select("finding_id", "status", "reopen_count", F.lit(True).alias("was"))
    c = current.select("finding_id", F.lit(True).alias("seen"))
    j = e.join(c, "finding_id", "full")
    reopen = F.col("was") & F.col("seen") & F.col("status").isin("fixed", "auto_resolved") & ~ignored
    action = (
        F.when(F.col("was").isNull() & ignored, "suppressed").when(F.col("was").isNull(), "new").when(F.col("seen").isNull(), "absent")
        .when(ignored, "suppressed").when(reopen, "reopened").otherwise("refreshed")
    )
    status = F.when(F.col("was").isNull() | reopen, "open").otherwise(F.col("status"))
    count = F.coalesce("reopen_count", F.lit(0)) + F.when(reopen, 1).otherwise(0)
    return j.select("finding_id", action.alias("action"), status.alias("status"), count.alias("reopen_count"), F.when(F.col("seen"), F.lit(now).cast("timestamp_ntz")).alias("seen_at"))


def disappeared(existing: DataFrame, current: DataFrame, *, lang: str, suspects: list[str], scope: str, skips: DataFrame) -> DataFrame:
    """What becomes of findings that the scan no longer shows: finding_id and verdict.

    In order: other language, suspect detector, out of scope, switched off by zone, still open, verified.
    """
    gone = existing.where(F.col("status").isin("open", "wontfix", "fixed", "false_positive")).join(current.select("finding_id"), "finding_id", "left_anti")
    gone = gone.join(skips.withColumn("off", F.lit(True)), ["zone", "detector"], "left")
    inside = F.col("file").startswith(scope + "/") | (F.col("file") == scope)
    verdict = (
        F.when(F.col("lang") != lang, "other_language").when(F.col("detector").isin(suspects), "suspect")
        .when(~inside & (F.col("status") != "open"), "verified_out_of_scope").when(~inside, "out_of_scope")
        .when((F.col("status") == "open") & F.col("off"), "auto_resolved").when(F.col("status") == "open", "stays_open").otherwise("verified")
    )
    return gone.select("finding_id", verdict.alias("verdict"))


def suspect_detectors(existing: DataFrame, current: DataFrame, ran: list[str] | None, least: int = 3, imported: tuple[str, ...] = ("review",)) -> DataFrame:
    """Detectors with open findings that show none now: not run, or (runs unknown) at least so many; imports always."""
    had = existing.where(F.col("status") == "open").groupBy("detector").agg(F.count(F.lit(1)).alias("n_open"))
    none_now = had.join(current.select("detector").distinct(), "detector", "left_anti")
    doubt = F.col("n_open") >= least if ran is None else ~F.col("detector").isin(ran)
    return none_now.where(F.col("detector").isin(list(imported)) | doubt)


def stale_dimensions(changed: DataFrame, catalog: DataFrame, assessed: DataFrame, now: str) -> DataFrame:
    """Assessed dimensions that a changed detector makes stale, unless assessed at or after now."""
    touched = changed.join(catalog, "detector").select("dimension").distinct()
    return assessed.join(touched, "dimension", "left_semi").where(F.col("assessed_at") < F.lit(now).cast("timestamp_ntz"))


def stale_wontfix(findings: DataFrame, current: DataFrame, scan: int, decay: int, growth: float = 1.25) -> DataFrame:
    """Findings set aside at least ``decay`` scans ago, or whose size grew by the factor since."""
    j = findings.where(F.col("status") == "wontfix").join(current.select("file", F.col("loc").alias("loc_now")).distinct(), "file")
    old = (scan - F.col("set_aside_at")) >= decay
    grown = F.col("loc_now") >= F.col("loc") * growth
    return j.where(old | grown).select("finding_id", old.alias("aged"), grown.alias("grown"))


def snapshot_hash(ids: DataFrame) -> DataFrame:
    """snapshot: the first 16 hex digits of a hash over the sorted distinct ids; empty without ids.

    Ids are hashed first and combined by exclusive or and sum, which needs no list of all ids in one task.
    """
    parts = ids.select("finding_id").distinct().select(F.conv(F.substring(F.sha2("finding_id", 256), 1, 14), 16, 10).cast("long").alias("h"))
    both = parts.agg(F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    return both.select(F.when(F.col("n") > 0, F.substring(F.sha2(F.concat_ws("|", F.col("x").cast("string"), F.col("s").cast("string")), 256), 1, 16)).otherwise("").alias("snapshot"))
