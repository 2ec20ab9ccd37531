"""Views over the work queue and the plan: matches, execution and backlog, explanations, scorecard rows, commits.

All are joins, filters and groupings over whole tables; only rows that a caller writes down (a plan, a policy)
are few by nature, and joins leave it to the optimizer whether to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.operators.findings import confidence_rank
from corpuslens.operators.graph import checkpointed
from corpuslens.operators.layout import prefixes
from corpuslens.operators.queue import rank_key


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def child_dirs(files: DataFrame) -> DataFrame:
    """parent, dir, n_files, n_children of each directory of files(path), with those that hold directories only."""
    of_file = files.select(_parent(F.col("path")).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"))
    dirs = of_file.select(F.explode(prefixes(F.col("dir"))).alias("dir")).distinct()
    inner = dirs.where(F.col("dir").contains("/"))
    below = inner.groupBy(_parent(F.col("dir")).alias("dir")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = dirs.join(of_file, "dir", "left").join(below, "dir", "left").na.fill(0, ["n_files", "n_children"])
    return counted.select(F.when(F.col("dir").contains("/"), _parent(F.col("dir"))).alias("parent"), "dir", "n_files", "n_children")


def fragmented_dirs(dirs: DataFrame, children: int = 8, sparse: int = 6, percent: int = 70, sparse_files: int = 1) -> DataFrame:
    """dir, n_children, n_sparse: directories most of whose many children are leaves with few files."""
    leaf = (F.col("n_files") <= sparse_files) & (F.col("n_children") == 0)
    counts = dirs.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.count_if(leaf).alias("n_sparse"))
    wide = (F.col("n") >= children) & (F.col("n_sparse") >= sparse) & (F.col("n_sparse") * 100 >= F.col("n") * percent)
    return counts.where(wide).select(F.col("parent").alias("dir"), F.col("n").alias("n_children"), "n_sparse")


def thin_wrappers(dirs: DataFrame, names: list[str], siblings: int = 10) -> DataFrame:
    """dir, n_siblings: directories of certain names that hold one item only, among many siblings."""
    beside = dirs.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_siblings")).where(F.col("n_siblings") >= siblings)
    name = F.lower(F.element_at(F.split("dir", "/"), -1))
    thin = dirs.where(name.isin(names) & (F.col("n_files") + F.col("n_children") == 1))
    return thin.join(beside, "parent").select("dir", "n_siblings")


def dynamically_imported(files: DataFrame, targets: DataFrame) -> DataFrame:
    """path of files that a dynamic import names: the whole path, an ending of it, or a last component that is the file's.

    Each test is an equality of a key that both sides can make (endings of a path without its extension, the
    last component of a target), so nothing is compared pair by pair.
    """
    clean = targets.select(F.regexp_replace("target", r"^[./]+", "").alias("target")).distinct()
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    name = F.element_at(F.split("path", "/"), -1)
    endings = F.transform(F.sequence(F.lit(1), F.length(bare)), lambda i: F.substring(bare, i, F.length(bare)))
    by_path = files.select("path", F.explode(F.concat(endings, F.array("path"))).alias("target"))
    last = F.element_at(F.split("target", "/"), -1)
    # a file's name without its directories must follow a slash; its stem may stand alone
    keys = F.array(F.struct(F.lit("stem"), last), F.when(F.col("target").contains("/"), F.struct(F.lit("name"), last)))
    named = clean.select(F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k")).select("k.*").toDF("kind", "key").distinct()
    stem = F.when(name.rlike(r"^.+\."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    by_name = files.select("path", F.explode(F.array(F.struct(F.lit("stem"), stem), F.struct(F.lit("name"), name))).alias("k")).select("path", "k.*").toDF("path", "kind", "key")
    found = by_path.join(clean.where("target <> ''"), "target").select("path").union(by_name.join(named, ["kind", "key"]).select("path"))
    return found.distinct()


def matching(items: DataFrame, scope: str | None = None, status: str | None = "open", chronic: int | None = None) -> DataFrame:
    """Findings below a path, of a status, reopened at least so often; suppressed ones never match."""
    wanted = ~F.col("suppressed")
    if scope:
        wanted = wanted & ((F.col("file") == scope) | F.col("file").startswith(scope.rstrip("/") + "/"))
    if status:
        wanted = wanted & (F.col("status") == status)
    if chronic:
        wanted = wanted & (F.col("reopen_count") >= chronic)
    return items.where(wanted)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with rank from 1 in the given order: ranges are sorted each by itself and numbered from where the ranges
    before them end, so no task sorts all rows. At the driver is a count for each range."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # written once: the ranges of a second evaluation could be others
    placed = checkpointed(sorted_.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts, before, starts = sorted(placed.groupBy("_range").count().collect()), 0, []
    for number, n in counts:
        starts.append((number, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "_range int, _before long")
    return placed.join(F.broadcast(offsets), "_range").withColumn("rank", F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")


def execution(items: DataFrame) -> DataFrame:
    """Planned items that are not skipped, ranked by the plan's order."""
    return ranked(items.where(F.col("position").isNotNull() & ~F.col("is_skipped")), "position", "finding_id")


def annotations(items: DataFrame) -> DataFrame:
    """described, noted and n: items whose description, and whose note, is not blank, and all."""
    there = lambda c: F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return items.agg(there("description").alias("described"), there("note").alias("noted"), F.count(F.lit(1)).alias("n"))


def backlog(items: DataFrame, most: int) -> DataFrame:
    """The first unplanned items that are not skipped; a top-k first, so only k rows are numbered."""
    rest = items.where(F.col("position").isNull() & ~F.col("is_skipped")).orderBy(*rank_key()).limit(most)
    return rest.withColumn("rank", F.row_number().over(Window.orderBy(*rank_key())))


#: What an item of each kind is ranked by.
FACTORS = {
    "subjective": "estimated_impact desc,subjective_score asc,id asc",
    "review": "estimated_impact desc,confidence asc,review_weight desc,count desc,id asc",
    "issue": "estimated_impact desc,confidence asc,count desc,id asc",
}


def explained(items: DataFrame) -> DataFrame:
    """finding_id, impact, confidence_rank, review_weight and the ranking factors of each item."""
    kind = F.when(F.col("detector").isin("subjective_review"), "subjective").when(F.col("detector") == "review", "review").otherwise("issue")
    factors = F.lit(FACTORS["issue"])
    for name in ("review", "subjective"):
        factors = F.when(kind == name, FACTORS[name]).otherwise(factors)
    weight = F.when(kind == "review", confidence_rank(F.col("confidence")) + 1)
    return items.select("finding_id", kind.alias("kind"), "impact", confidence_rank(F.col("confidence")).alias("confidence_rank"), weight.alias("review_weight"), factors.alias("factors"))


def phase_snapshot(items: DataFrame) -> DataFrame:
    """phase, n and n_planned: open items by what they wait for: a rescan after reopening, triage, execution or nothing."""
    phase = F.when(F.col("is_skipped"), "postponed").when(F.col("position").isNotNull(), "execute").when(F.col("is_new"), "triage")
    phase = phase.when(F.col("reopen_count") > 0, "rescan").otherwise("backlog")
    return items.groupBy(phase.alias("phase")).agg(F.count(F.lit(1)).alias("n"), F.count("position").alias("n_planned"))


def inventory(items: DataFrame, dimension: Column) -> DataFrame:
    """dimension, n: open items that are neither planned nor skipped."""
    return items.where(F.col("position").isNull() & ~F.col("is_skipped")).groupBy(dimension.alias("dimension")).agg(F.count(F.lit(1)).alias("n"))


def collapsed(rows: DataFrame, components: list[str], label: str) -> DataFrame:
    """Scorecard rows with those of some names as one: mean scores to a tenth, sums of checks and failures."""
    name = F.when(F.col("dimension").isin(components), F.lit(label)).otherwise(F.col("dimension"))
    mean = lambda c: F.round(F.avg(c), 1).alias(c)
    joined = rows.where(F.col("dimension").isin(components)).groupBy(name.alias("dimension")).agg(mean("score"), mean("strict"), F.sum("checks").alias("checks"), F.sum("failing").alias("failing"))
    return rows.where(~F.col("dimension").isin(components)).select("dimension", "score", "strict", "checks", "failing").union(joined)


def capped(rows: DataFrame, subjective: list[str], most: int) -> DataFrame:
    """dimension, rank of at most so many rows: mechanical ones by name, subjective ones in their given order, then the lowest.

    A scorecard has a row a dimension, so the window sees few rows.
    """
    place = F.array_position(F.array(*map(F.lit, subjective)), F.col("dimension"))
    order = [F.when(~F.col("is_subjective"), 0).when(place > 0, 1).otherwise(2), F.when(F.col("is_subjective") & (place > 0), place), F.when(F.col("is_subjective"), F.col("strict")), "dimension"]
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.where(F.col("rank") <= most).select("dimension", "rank")


def stored_assessments(imports: DataFrame) -> DataFrame:
    """dimension, score, source: the last import of each dimension; a per-file one never replaces a holistic one."""
    key = F.regexp_replace(F.trim(F.lower("dimension")), r"[\s-]+", "_")
    rows = imports.select(key.alias("dimension"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), "score")).alias("score"), "source", "at").where("dimension <> ''")
    last = F.max_by(F.struct("score", "source"), F.struct((F.col("source") == "holistic").alias("whole"), "at"))
    return rows.groupBy("dimension").agg(last.alias("last")).select("dimension", "last.*")


def resolved_coverage(findings: DataFrame, dimension: Column, assessments: DataFrame) -> DataFrame:
    """finding_id, status, note: open coverage markers of dimensions that hold a real assessment are fixed."""
    real = assessments.where(~F.col("placeholder") & (F.col("source") != "scan_reset_subjective")).select("dimension", F.lit(True).alias("done")).distinct()
    marked = findings.withColumn("dimension", dimension).join(real, "dimension", "left")
    fixed = (F.col("status") == "open") & (F.col("detector") == "review") & F.col("done").isNotNull()
    return marked.select("finding_id", F.when(fixed, "fixed").otherwise(F.col("status")).alias("status"), F.when(fixed, "completed by review import").alias("note"))


def commit_history(commits: DataFrame, now: str, days: int = 30, most_names: int = 10) -> DataFrame:
    """n_commits, n_items, n_recent (undated count as recent), clusters (the first names) and the latest note."""
    at = F.col("recorded_at")
    recent = at.isNull() | (at >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))
    names = F.slice(F.array_sort(F.collect_set("cluster")), 1, most_names)
    totals = commits.agg(F.count(F.lit(1)).alias("n_commits"), F.sum("n_items").alias("n_items"), F.count_if(recent).alias("n_recent"), F.max_by("note", F.struct("recorded_at", "sha")).alias("note"))
    found = commits.select("cluster").distinct().agg(names.alias("names"))  # a name a row by then, not a commit
    return totals.join(found, F.lit(True)).select("n_commits", "n_items", "n_recent", F.array_join("names", ",").alias("clusters"), "note")


def batch_quality(batches: DataFrame) -> DataFrame:
    """n_batches, mean coverage and mean evidence density to three places."""
    mean = lambda c: F.round(F.avg(c), 3).alias(c)
    return batches.agg(F.count(F.lit(1)).alias("n_batches"), mean("coverage"), mean("density"))


def evidence_weights(issues: DataFrame) -> DataFrame:
    """dimension, weight: one, and one for each issue and each distinct piece of evidence."""
    return issues.groupBy("dimension").agg((F.lit(1) + F.count_distinct("evidence") + F.count(F.lit(1))).alias("weight"))


def single_use_issues(used: DataFrame, low: int = 50, high: int = 200, skipped: list[str] = ()) -> DataFrame:
    """node, user of single-use nodes worth a finding: neither of middle size, nor beside their user, nor in skipped places."""
    middle = F.col("loc").between(low, high)
    return used.where(~middle & (F.col("area") != F.col("user_area")) & ~F.col("place").isin(list(skipped))).select("node", "user")


def migrated(rows: DataFrame, renamed: dict[str, str]) -> DataFrame:
    """Legacy columns under their new names; a value that is there under the new name wins."""
    for old, new in renamed.items():
        value = F.coalesce(F.col(new), F.col(old)) if new in rows.columns else F.col(old)
        rows = rows.withColumn(new, value).drop(old)
    return rows


def selected_phases(phases: DataFrame, slow: bool, profile: str) -> DataFrame:
    """phase of phases(phase, is_slow, is_subjective) that a profile runs: objective ones only, or all."""
    return phases.where((~F.col("is_slow") | F.lit(slow)) & (~F.col("is_subjective") | F.lit(profile != "objective"))).select("phase")
