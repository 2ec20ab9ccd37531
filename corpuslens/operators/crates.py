"""Rules over the files of packages: dead exports, public conventions, error types, thread contracts, examples.

Files are rows (path, text); a package (crate) is the first part of a path. All rules are expressions over lines and
blocks and joins by name. Null texts have no lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.sources.tables import lines, unsized

EXPORT = r"^export\s+(?:default\s+)?(?:async\s+)?(?:function|const|let|class|interface|type|enum)\s+(\w+)"
IMPORTED = r"(?:import|export)\s+(?:type\s+)?\{([^}]*)\}\s*from"


def dead_exports(files: DataFrame) -> DataFrame:
    """path, name: exported names that no other file imports or exports on."""
    made = lines(files, "path").where(F.col("line").rlike(EXPORT)).select("path", F.regexp_extract("line", EXPORT, 1).alias("name"))
    lists = files.select(F.col("path").alias("user"), F.explode(F.regexp_extract_all("text", F.lit(IMPORTED), 1)).alias("names"))
    each = lists.select("user", F.explode(F.split("names", ",")).alias("n")).select("user", F.regexp_extract(F.trim("n"), r"^(?:type\s+)?(\w+)", 1).alias("name"))
    used = made.join(unsized(each), "name").where("user <> path").select("path", "name").distinct()
    return made.distinct().join(unsized(used), ["path", "name"], "left_anti")


def api_conventions(files: DataFrame) -> DataFrame:
    """path, line_no, name, kind: public methods whose names and receivers do not fit."""
    p = r"^\s*pub\s+(?:const\s+|async\s+)*fn\s+(\w+)\s*(?:<[^>]*>)?\(\s*(&mut self|&self|mut self|self)?"
    name, self_ = F.regexp_extract("line", p, 1), F.regexp_extract("line", p, 2)
    rows = lines(files, "path").where(F.col("line").rlike(p)).select("path", "line_no", name.alias("name"), self_.alias("self"))
    kind = (
        F.when(F.col("name").rlike("^into_") & F.col("self").startswith("&"), "into_by_reference")
        .when(F.col("name").rlike("^as_") & F.col("self").isin("self", "mut self"), "as_by_value")
        .when(F.col("name").rlike("^to_") & (F.col("self") == "&mut self"), "to_by_mutation")
        .when(F.col("name").rlike("^get_") & (F.col("self") == "&self"), "getter_prefix")
    )
    return rows.select("path", "line_no", "name", kind.alias("kind")).where("kind IS NOT NULL")


def error_boundaries(blocks: DataFrame) -> DataFrame:
    """path, name, kind: public functions with an untyped error, or whose own body unwraps or panics."""
    head = F.regexp_extract("head", r"pub\s+(?:async\s+)?fn\s+(\w+)[^{}]*\{$", 1)
    rows = blocks.withColumn("name", head).where("name <> ''")
    loose = r"->\s*Result<[^{}]*,\s*(?:Box<dyn\s+(?:std::error::)?Error[^{}]*>|String|&'static str|anyhow::Error)\s*>"
    kinds = F.array(F.when(F.col("head").rlike(loose), "untyped_error"), F.when(F.col("own").rlike(r"\.(?:unwrap|expect)\s*\(|\b(?:panic|todo|unimplemented)!\s*\("), "panics"))
    return rows.select("path", "name", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def _crate(column: str = "path"):
    return F.split_part(column, F.lit("/"), F.lit(1))


def thread_contracts(files: DataFrame) -> DataFrame:
    """path, type, trait: types that are declared Send or Sync by hand, without an assertion in their crate's tests."""
    p = r"unsafe\s+impl(?:<[^>]*>)?\s+(Send|Sync)\s+for\s+(\w+)"
    rows = lines(files, "path").where(F.col("line").rlike(p))
    made = rows.select("path", _crate().alias("crate"), F.regexp_extract("line", p, 2).alias("type"), F.regexp_extract("line", p, 1).alias("trait"))
    tests = files.where(F.col("path").contains("/tests/")).select(_crate().alias("crate"), F.explode(F.regexp_extract_all("text", F.lit(r"assert_(?:send|sync)\w*::<(\w+)>"), 1)).alias("type"))
    return made.join(unsized(tests.distinct()), ["crate", "type"], "left_anti").select("path", "type", "trait").distinct()


def unwired_examples(files: DataFrame) -> DataFrame:
    """path, n: README files with examples in code blocks that no source file of their crate includes as documentation."""
    examples = files.where(F.col("path").endswith("README.md")).select("path", _crate().alias("crate"), F.regexp_count("text", F.lit(r"(?m)^```(?:rust|rs)\b")).alias("n")).where("n > 0")
    wired = files.where(F.col("path").endswith(".rs") & F.col("text").rlike(r'include_str!\(\s*"[^"]*README\.md"')).select(_crate().alias("crate")).distinct()
    return examples.join(unsized(wired), "crate", "left_anti").select("path", "n")
