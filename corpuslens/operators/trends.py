"""Trends over scan histories. A history has one row a scan, so its windows stay small whatever the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _order():
    return Window.orderBy("seq")


def numbered(scans: DataFrame) -> DataFrame:
    """scans(ts, ...) with seq, from 1 in time order."""
    return scans.withColumn("seq", F.row_number().over(Window.orderBy("ts")))


def last_scans(scans: DataFrame, most: int) -> DataFrame:
    return scans.orderBy(F.desc("seq")).limit(most)


def phases(scans: DataFrame) -> DataFrame:
    """The phase after each scan, by ordered rules over the last scores."""
    last3 = _order().rowsBetween(-2, 0)
    prev, first = F.lag("score").over(_order()), F.first("score").over(_order())
    spread = F.max("score").over(last3) - F.min("score").over(last3)
    s = F.col("score")
    phase = (
        F.when(F.col("seq") == 1, "first_scan").when(s < prev - 0.5, "regression").when((F.col("seq") >= 3) & (spread <= 0.5), "stagnation")
        .when((F.col("seq") <= 5) & (s > first), "early_momentum").when(s > 93, "maintenance").when(s > 80, "refinement").otherwise("middle_grind")
    )
    return scans.withColumn("phase", phase)


def milestones(scans: DataFrame, marks: list[int]) -> DataFrame:
    """Scans at which the score crossed a mark from below; the first mark of the list that fits."""
    prev, out = F.lag("score").over(_order()), None
    for m in marks:
        hit = (F.col("prev") < m) & (F.col("score") >= m)
        out = F.when(hit, f"crossed {m}") if out is None else out.when(hit, f"crossed {m}")
    return scans.withColumn("prev", prev).select("seq", out.alias("milestone")).where(F.col("milestone").isNotNull())


def trajectory(scans: DataFrame, window: int) -> DataFrame:
    """Change over the last scans, all-time high, and trend (recovering: improving but 2 below the high)."""
    marked = scans.withColumn("high", F.max("score").over(Window.partitionBy()))
    recent = last_scans(marked, window).agg(F.first("high").alias("high"), (F.max_by("score", "seq") - F.min_by("score", "seq")).alias("delta"), F.max_by("score", "seq").alias("last"))
    up = F.col("delta") > 0.5
    trend = F.when(up & (F.col("last") < F.col("high") - 2), "recovering").when(up, "improving").when(F.col("delta") < -0.5, "declining").otherwise("stable")
    return recent.withColumn("trend", trend)


def _recent(days: DataFrame, window: int) -> DataFrame:
    by = Window.partitionBy("dimension").orderBy(F.desc("ts"))
    return days.withColumn("back", F.row_number().over(by)).where(F.col("back") <= window)


def dimension_trajectories(days: DataFrame, window: int) -> DataFrame:
    """Change over the last scans and room to 100 of each dimension."""
    return _recent(days, window).groupBy("dimension").agg((F.min_by("score", "back") - F.max_by("score", "back")).alias("delta"), (100 - F.min_by("score", "back")).alias("headroom"))


def stagnant(days: DataFrame, window: int, least: int, spread: float) -> DataFrame:
    sums = _recent(days, window).groupBy("dimension").agg((F.max("score") - F.min("score")).alias("spread"), F.count(F.lit(1)).alias("samples"))
    return sums.where((F.col("samples") >= least) & (F.col("spread") <= spread))


def smooth(scans: DataFrame) -> DataFrame:
    return scans.withColumn("smooth", F.avg("score").over(_order().rowsBetween(-1, 1)))


def resample(scans: DataFrame, width: int) -> DataFrame:
    """i and score at ``width`` even places of the series."""
    last = scans.agg((F.max("seq") - 1).alias("last"))
    at = last.select("last", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("i")).withColumn("pos", F.col("i") * F.col("last") / F.lit(width - 1))
    at = at.withColumns({"left": F.floor("pos"), "right": F.least(F.floor("pos") + 1, F.col("last").cast("long"))})
    a = scans.select((F.col("seq") - 1).cast("long").alias("left"), F.col("score").alias("a"))
    b = scans.select((F.col("seq") - 1).cast("long").alias("right"), F.col("score").alias("b"))
    return at.join(a, "left").join(b, "right").select("i", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos"))).alias("score"))


def levels(scans: DataFrame, n: int) -> DataFrame:
    """Each score's level among n between the least and the largest; half rounds up."""
    every = Window.partitionBy()
    low, high = F.min("score").over(every), F.max("score").over(every)
    return scans.withColumn("level", F.least(F.lit(n - 1), F.floor(F.try_divide(F.col("score") - low, high - low) * (n - 1) + 0.5)).cast("int"))


def execution_patterns(log: DataFrame, now: str, days: int) -> DataFrame:
    """Resolved, skipped and the skip rate in the days before now; undated rows count as recent."""
    recent = log.where(F.col("ts").isNull() | (F.col("ts") > F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))))
    done, skipped = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error")
    return recent.agg(done.alias("resolved"), skipped.alias("skipped"), F.try_divide(skipped, done + skipped).alias("skip_rate"))
