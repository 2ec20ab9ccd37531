"""Paths, directories and zones: scans with exclusions, directory statistics, tree rollups, rule-based zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T


def excluded(path: Column, pattern: str) -> Column:
    """A path component equals or globs the pattern; a pattern with a slash globs or opens the whole path."""
    parts = F.split(path, "/")
    if "/" in pattern:
        return path.rlike(T.glob_regex(pattern)) | path.startswith(pattern.rstrip("/") + "/") | (path == pattern)
    if "*" in pattern or "?" in pattern:
        return F.exists(parts, lambda p: p.rlike(T.glob_regex(pattern)))
    return F.array_contains(parts, pattern)


def file_scan(files: DataFrame, extensions: list[str], exclusions: list[str]) -> DataFrame:
    """Rows of files(path) with one of the extensions and none of the exclusions."""
    wanted, out = F.lit(False), F.lit(False)
    for e in extensions:
        wanted = wanted | F.col("path").endswith(e)
    for x in exclusions:
        out = out | excluded(F.col("path"), x)
    return files.where(wanted & ~out)


def prefixes(path: Column) -> Column:
    """All prefixes of a path by components, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def tree_rollup(files: DataFrame, depth: int) -> DataFrame:
    """prefix, n_files, loc, depth: sums of files(path, loc) up the tree to a depth."""
    each = files.select(F.posexplode(F.slice(prefixes(F.col("path")), 1, depth)).alias("at", "prefix"), "loc")
    return each.groupBy("prefix", (F.col("at") + 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("loc").alias("loc")).select("prefix", "n_files", "loc", "depth")


def dir_stats(files: DataFrame) -> DataFrame:
    """dir, n_files (in it), n_children (distinct directories in it)."""
    parent = lambda p: F.regexp_replace(p, "/[^/]*$", "")
    own = files.select(parent(F.col("path")).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"))
    up = own.select("dir", F.explode(prefixes(F.col("dir"))).alias("child")).select("child").distinct().where(F.col("child").contains("/"))
    children = up.groupBy(parent(F.col("child")).alias("dir")).agg(F.count(F.lit(1)).alias("n_children"))
    return own.join(children, "dir", "full").select("dir", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_children", F.lit(0)).alias("n_children"))


def flat_dirs(stats: DataFrame, files: int = 20, children: int = 10, combined: int = 30) -> DataFrame:
    """Overloaded and thin directories; the first rule that holds names the kind."""
    n, c = F.col("n_files"), F.col("n_children")
    kind = F.when((n >= files) | (c >= children) | (n + 3 * c >= combined), "overload").when((n == 1) & (c == 0), "thin_wrapper")
    return stats.withColumn("kind", kind).where(F.col("kind").isNotNull())


def naming(files: DataFrame, least: int = 5, percent: int = 15) -> DataFrame:
    """Minority naming conventions of each directory, with the majority one (ties by name)."""
    parent = F.regexp_replace("path", "/[^/]*$", "")
    counts = files.select(parent.alias("dir"), T.naming_convention(T.base_name(F.col("path"))).alias("kind")).where("kind IS NOT NULL").groupBy("dir", "kind").agg(F.count(F.lit(1)).alias("n"))
    by_dir = Window.partitionBy("dir")
    order = by_dir.orderBy(F.desc("n"), "kind")
    ranked = counts.withColumns({"total": F.sum("n").over(by_dir), "place": F.row_number().over(order), "majority": F.first("kind").over(order), "majority_count": F.first("n").over(order)})
    return ranked.where((F.col("place") > 1) & (F.col("n") >= least) & (F.col("n") * 100 >= F.col("total") * percent)).select("dir", "majority", "majority_count", F.col("kind").alias("minority"), F.col("n").alias("minority_count"), "total")


def zone_match(path: Column, pattern: str) -> Column:
    """One of six shapes: /dir/, .part of the name, prefix_, _suffix, exact name, part of the path."""
    name = T.base_name(path)
    if pattern.startswith("/") and pattern.endswith("/"):
        return F.concat(F.lit("/"), path, F.lit("/")).contains(pattern)
    if pattern.startswith("."):
        return name.contains(pattern)
    if pattern.endswith("_"):
        return name.startswith(pattern)
    if pattern.startswith("_"):
        return name.endswith(pattern)
    extension = pattern.rsplit(".", 1)[-1] if "." in pattern else ""
    if "/" not in pattern and extension.isalnum() and len(extension) <= 5:
        return name == pattern
    return path.contains(pattern)


def with_zone(files: DataFrame, rules: list[tuple[int, str, str]], overrides: dict[str, str] | None = None, default: str = "production") -> DataFrame:
    """files with zone: an override, else the first rule (ordinal, zone, pattern) that matches, else the default."""
    path, zone = F.col("path"), None
    for at, to in (overrides or {}).items():
        zone = F.when(path == at, to) if zone is None else zone.when(path == at, to)
    for _, to, pattern in sorted(rules):
        hit = zone_match(path, pattern)
        zone = F.when(hit, to) if zone is None else zone.when(hit, to)
    return files.withColumn("zone", F.lit(default) if zone is None else zone.otherwise(default))
