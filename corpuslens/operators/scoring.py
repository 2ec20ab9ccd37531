"""Scores: weighted failures by mode with per-file caps, pass rates, dimensions, health.

Weights are integers in tenths (high 10, medium 7, low 3; caps 10, 15, 20), so sums are exact and one
division at the end gives the rate. Sums run in two levels (file, then detector); Spark combines both before
their shuffles, so a detector that holds most findings is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses that count as failures in each mode (the sets are not nested).
FAILURES = {
    "lenient": ["open", "deferred", "triaged_out"],
    "strict": ["open", "wontfix", "auto_resolved", "deferred", "triaged_out"],
    "verified_strict": ["open", "wontfix", "fixed", "false_positive", "deferred", "triaged_out"],
}
#: Zones outside the score, detectors outside it, and detectors capped by file.
OUTSIDE = ["test", "config", "generated", "vendor"]
UNSCORED = ["concerns", "review", "subjective_review", "uncalled_functions", "unused_enums", "signature", "stale_wontfix"]
BY_FILE = ["smells", "dict_keys", "test_coverage", "security", "concerns", "review", "nextjs", "next_lint"]
MIN_SAMPLE = 200


def weight(confidence: Column) -> Column:
    """Tenths by confidence; medium where it is not known."""
    return F.when(confidence == "high", 10).when(confidence == "low", 3).otherwise(7)


def file_cap(n: Column) -> Column:
    """Tenths by the number of findings in a file."""
    return F.when(n >= 6, 20).when(n >= 3, 15).otherwise(10)


def by_mode(findings: DataFrame) -> DataFrame:
    """Scored findings, a row for each mode that counts them as failures."""
    kept = findings.where(~F.col("suppressed") & ~F.col("zone").isin(OUTSIDE) & ~F.col("detector").isin(UNSCORED))
    modes = F.array(*[F.when(F.col("status").isin(s), F.lit(m)) for m, s in FAILURES.items()])
    return kept.withColumn("mode", F.explode(F.filter(modes, lambda m: m.isNotNull())))


def failures(findings: DataFrame) -> DataFrame:
    """mode, detector, n, weighted (tenths): findings about the whole corpus (file '.') count ten times."""
    per_file = by_mode(findings).groupBy("mode", "detector", "file").agg(F.count(F.lit(1)).alias("n"), F.sum(weight(F.col("confidence"))).alias("w"))
    capped = (
        F.when(~F.col("detector").isin(BY_FILE), F.col("w")).when(F.col("file") == ".", F.col("w") * 10)
        .otherwise(F.least("w", file_cap(F.col("n"))))
    )
    return per_file.groupBy("mode", "detector").agg(F.sum("n").alias("n"), F.sum(capped).alias("weighted"))


def pass_rates(findings: DataFrame, potentials: DataFrame) -> DataFrame:
    """mode, detector, n, weighted, pass_rate for every detector of potentials(detector, potential); 1 where there is none to test."""
    modes = potentials.select("detector", "potential", F.explode(F.array(*map(F.lit, FAILURES))).alias("mode"))
    joined = modes.join(failures(findings), ["mode", "detector"], "left").na.fill(0, ["n", "weighted"])
    scored = (F.col("potential") > 0) & ~F.col("detector").isin(UNSCORED)
    rate = F.greatest(F.lit(0.0), F.try_divide(F.col("potential") * 10 - F.col("weighted"), F.col("potential") * 10))
    return joined.select("mode", "detector", F.when(scored, F.col("n")).otherwise(0).alias("n"), F.when(scored, F.col("weighted")).otherwise(0).alias("weighted"), F.when(scored, rate).otherwise(1.0).alias("pass_rate"), "potential")


def dimension_scores(rates: DataFrame, catalog: DataFrame) -> DataFrame:
    """mode, dimension, checks, failing, score (0-100): checks and failures pooled over a dimension's detectors."""
    pooled = rates.join(catalog.where("dimension IS NOT NULL"), "detector").where("potential > 0")
    sums = pooled.groupBy("mode", "dimension").agg(F.sum("potential").alias("checks"), F.sum("n").alias("failing"), F.sum("weighted").alias("weighted"))
    return sums.select("mode", "dimension", "checks", "failing", (F.greatest(F.lit(0.0), (F.col("checks") * 10 - F.col("weighted")) / (F.col("checks") * 10)) * 100).alias("score"))


def health(dimensions: DataFrame, weights: dict[str, float]) -> DataFrame:
    """mode, dimension, share and contribution of each dimension; weights are damped below MIN_SAMPLE checks."""
    base = F.lit(1.0)
    for name, w in weights.items():
        base = F.when(F.col("dimension") == name, F.lit(w)).otherwise(base)
    damped = dimensions.withColumn("w", base * F.least(F.lit(1.0), F.col("checks") / MIN_SAMPLE))
    share = F.col("w") / F.sum("w").over(Window.partitionBy("mode"))
    return damped.select("mode", "dimension", share.alias("share"), (share * F.col("score")).alias("contribution"), (share * (100 - F.col("score"))).alias("drag"))


def impact(rates: DataFrame, detector: str, fixed: int) -> DataFrame:
    """mode, before, after: the pooled score when so many average findings of a detector go."""
    is_it = F.col("detector") == detector
    less = F.when(is_it & (F.col("n") > 0), F.least(F.lit(fixed), F.col("n")) * F.col("weighted") / F.col("n")).otherwise(0.0)
    sums = rates.groupBy("mode").agg(F.sum("potential").alias("p"), F.sum("weighted").alias("w"), F.sum(less).alias("less"))
    score = lambda w: (F.col("p") * 10 - w) / (F.col("p") * 10) * 100
    return sums.select("mode", score(F.col("w")).alias("before"), score(F.col("w") - F.col("less")).alias("after"))
