"""Planning over findings and dimensions: entries, carry-over, evidence, flags, lanes, reconciliation, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.operators.boards import ranked
from corpuslens.operators.graph import connected_components


def subjective_entries(defaults: DataFrame, assessed: DataFrame, reviews: DataFrame) -> DataFrame:
    """dimension, score (0..100, 0 for a placeholder), placeholder, failing: defaults joined with assessments."""
    open_now = reviews.where(F.col("status") == "open").groupBy("dimension").agg(F.count(F.lit(1)).alias("failing"))
    j = defaults.join(assessed, "dimension", "full").join(open_now, "dimension", "left")
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0))))
    return j.select("dimension", score.alias("score"), F.col("score").isNull().alias("placeholder"), F.coalesce("failing", F.lit(0)).alias("failing"))


def carried_forward(before: DataFrame, now: DataFrame) -> DataFrame:
    """dimension, score, carried: dimensions absent now keep their former score, flagged."""
    j = now.select("dimension", F.col("score").alias("new")).join(before.select("dimension", F.col("score").alias("old")), "dimension", "full")
    return j.select("dimension", F.coalesce("new", "old").alias("score"), F.col("new").isNull().alias("carried"))


def coverage_confidence(reduced: DataFrame, catalog: DataFrame) -> DataFrame:
    """dimension, confidence (least over its reduced detectors), detectors."""
    return reduced.join(catalog, "detector").groupBy("dimension").agg(F.min("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("detector")), ",").alias("detectors"))


def lowest(dimensions: DataFrame, most: int) -> DataFrame:
    """The dimensions of least score: a top-k."""
    return dimensions.orderBy("score", "dimension").limit(most)


def gaps(dimensions: DataFrame, set_aside: DataFrame, least: float) -> DataFrame:
    """dimension, gap (lenient - strict) over ``least`` and how many findings are set aside in it."""
    wide = dimensions.groupBy("dimension").agg(F.max(F.when(F.col("mode") == "lenient", F.col("score"))).alias("l"), F.max(F.when(F.col("mode") == "strict", F.col("score"))).alias("s"))
    j = wide.withColumn("gap", F.col("l") - F.col("s")).where(F.col("gap") > least)
    return j.join(set_aside, "dimension", "left").select("dimension", "gap", F.coalesce("n", F.lit(0)).alias("n"))


def leverage(open_counts: DataFrame, actions: DataFrame) -> DataFrame:
    """One row: open findings, those that a fixer handles, and their share."""
    j = open_counts.join(actions, "detector", "left")
    fixable = F.sum(F.when(F.col("action") == "auto_fix", F.col("n")).otherwise(0))
    return j.agg(F.sum("n").alias("total"), fixable.alias("fixable")).withColumn("share", F.coalesce(F.try_divide("fixable", "total"), F.lit(0.0)))


def risk_flags(totals: DataFrame, rules: list[tuple[str, str, float, int]]) -> DataFrame:
    """flag and severity of one row of totals: rules are (flag, column, threshold, severity)."""
    marks = F.array(*[F.when(F.col(c) > t, F.struct(F.lit(f).alias("flag"), F.lit(s).alias("severity"))) for f, c, t, s in rules])
    return totals.select(F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m")).select("m.flag", "m.severity")


def live_dismissals(dismissals: DataFrame, findings: DataFrame) -> DataFrame:
    """Dismissals of which at least one source is still open."""
    each = dismissals.select("fingerprint", F.explode("sources").alias("finding_id"))
    alive = each.join(findings.where(F.col("status") == "open").select("finding_id"), "finding_id", "left_semi").select("fingerprint").distinct()
    return dismissals.join(alive, "fingerprint", "left_semi")


def concern_set(parts: list[DataFrame], dismissed: DataFrame) -> DataFrame:
    """Union of concerns without repeats of a fingerprint and without dismissed ones."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("fingerprint").agg(F.min("kind").alias("kind")).join(dismissed, "fingerprint", "left_anti")


def lanes(actions: DataFrame) -> DataFrame:
    """action and lane: actions that share files, directly or through others, are one lane (the least of them)."""
    shared = actions.groupBy("file").agg(F.min("action").alias("first"))
    links = actions.join(shared, "file").where("action <> first").select(F.col("action").alias("a"), F.col("first").alias("b")).distinct()
    found = connected_components(links)
    return actions.select("action").distinct().join(found, F.col("action") == F.col("node"), "left").select("action", F.coalesce("root", "action").alias("lane"))


def directory_profiles(files: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """dir, n_files, loc and its first neighbours by edges to other directories."""
    sums = files.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"), F.sum("loc").alias("loc"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    near = edges.where("src <> dst").withColumn("k", rank).where(F.col("k") <= most)
    named = near.groupBy("src").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "dst"))), lambda x: x["dst"].cast("string")), ",").alias("neighbours"))
    return sums.join(named, F.col("dir") == F.col("src"), "left").select("dir", "n_files", "loc", F.coalesce("neighbours", F.lit("")).alias("neighbours"))


def best_pair(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """root, size and best pair (largest ratio, then smallest ids) of each duplicate cluster."""
    of = pairs.join(members.select(F.col("node").alias("doc_a"), "root"), "doc_a")
    best = of.groupBy("root").agg(F.max_by(F.struct("doc_a", "doc_b", "ratio"), F.struct("ratio", -F.col("doc_a"), -F.col("doc_b"))).alias("b"))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return best.join(sizes, "root").select("root", "size", "b.doc_a", "b.doc_b", "b.ratio")


def reusable_pairs(pairs: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """Cached pairs none of whose units changed (digest and lines) since: the others are to be compared again."""
    same = before.join(now, ["doc_id", "digest", "loc"], "left_semi").select("doc_id")
    return pairs.join(same.select(F.col("doc_id").alias("doc_a")), "doc_a", "left_semi").join(same.select(F.col("doc_id").alias("doc_b")), "doc_b", "left_semi")


def reconciled(plan: DataFrame, findings: DataFrame, renamed: DataFrame) -> DataFrame:
    """finding_id, state of planned ids after a scan: kept, renamed (with the new id) or dead."""
    live = findings.select("finding_id", F.lit(True).alias("live"))
    j = plan.join(live, "finding_id", "left").join(renamed, "finding_id", "left")
    return j.select("finding_id", F.when(F.col("live"), "kept").when(F.col("new_id").isNotNull(), "renamed").otherwise("dead").alias("state"), "new_id")


def reconcile(plan: DataFrame, findings: DataFrame, renamed: DataFrame, triaged: DataFrame) -> DataFrame:
    """finding_id, rank and step of a plan (finding_id, position) after a scan, in ordered passes.

    Renamed ids are followed, if the new one is there; ids that no finding has go; an id that then stands twice keeps
    its first place; open reviews that were never triaged are appended in the order of their ids. Ranks are from 1.
    """
    state = reconciled(plan, findings, renamed).join(plan.groupBy("finding_id").agg(F.min("position").alias("position")), "finding_id")
    live = findings.select("finding_id").distinct()
    moved = state.where("state = 'renamed'").select(F.col("new_id").alias("finding_id"), "position", "state").join(live, "finding_id", "left_semi")
    kept = state.where("state = 'kept'").select("finding_id", "position", "state").unionByName(moved)
    first = kept.groupBy("finding_id").agg(F.min(F.struct("position", "state")).alias("f")).select("finding_id", "f.position", F.col("f.state").alias("step"))
    fresh = new_review_ids(findings, triaged).join(first.select("finding_id"), "finding_id", "left_anti")
    appended = fresh.select("finding_id", F.lit(None).cast("long").alias("position"), F.lit("appended").alias("step"))
    whole = first.select("finding_id", F.col("position").cast("long").alias("position"), "step").unionByName(appended)
    placed = whole.withColumns({"_new": F.col("position").isNull(), "_place": F.coalesce("position", F.lit(0))})
    return ranked(placed, "_new", "_place", "finding_id").select("finding_id", "rank", "step")


def new_review_ids(findings: DataFrame, triaged: DataFrame) -> DataFrame:
    """Open review findings that were never triaged; none at all where nothing ever was."""
    fresh = findings.where("status = 'open' AND detector = 'review'").join(triaged, "finding_id", "left_anti")
    return fresh.select("finding_id").where(F.lit(not triaged.isEmpty()))


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows inserted or replaced by key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def merged_lists(a: Column, b: Column) -> Column:
    """Distinct elements of both in order of first appearance; a missing list is empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))


def longer(a: Column, b: Column) -> Column:
    """The longer text; the first on a tie."""
    return F.when(F.length(F.coalesce(b, F.lit(""))) > F.length(F.coalesce(a, F.lit(""))), b).otherwise(a)
