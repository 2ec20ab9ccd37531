"""Operators over source text: rule scans by language, imports and their graph, symbols, test quality.

Files are rows (path, lang, text). Rules are data: (lang, rule, pattern); one pass over the lines applies all
rules of a line's language. What needs a syntax tree is out of scope; these are line and token semantics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.sources.tables import lines, unsized

#: Line rules by language.
RULES = [
    ("python", "bare_except", r"^\s*except\s*:"), ("python", "mutable_default", r"def \w+\([^)]*=\s*(\[\]|\{\})"), ("python", "star_import", r"^from \S+ import \*"), ("python", "eval_call", r"\beval\("),
    ("typescript", "any_type", r":\s*any\b"), ("typescript", "ts_ignore", r"@ts-ignore"), ("typescript", "console", r"console\.(log|debug)\("), ("typescript", "inner_html", r"\.innerHTML\s*="),
    ("csharp", "sql_concat", r"new SqlCommand\(.*\+"), ("csharp", "binary_formatter", r"\bBinaryFormatter\b"), ("csharp", "weak_random", r"new Random\("), ("csharp", "tls_callback", r"ServerCertificateValidationCallback"),
    ("rust", "unwrap", r"\.unwrap\(\)"), ("rust", "unchecked", r"\b\w+_unchecked\("), ("rust", "crate_path", r"^use crate::"), ("rust", "panic", r"\bpanic!\("),
    ("r", "setwd", r"\bsetwd\("), ("r", "assign_global", r"<<-"), ("r", "true_letter", r"=\s*[TF]\b"), ("cpp", "strcpy", r"\bstrcpy\("), ("cpp", "system_call", r"\bsystem\("),
]
COMMENT = {"python": "#", "r": "#", "typescript": "//", "csharp": "//", "rust": "//", "cpp": "//"}


def is_comment(lang: Column, line: Column) -> Column:
    """A line that is a comment in its language, or goes on with a block comment's star."""
    bare, out = F.ltrim(line), F.lit(False)
    for name, mark in COMMENT.items():
        out = out | ((lang == name) & bare.startswith(mark))
    return out | bare.startswith("/*") | bare.startswith("* ")


def rule_hits(files: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """path, line_no, rule for lines that are no comments.

    A line is held against the rules of its own language, in columns without a lambda, which Spark would interpret.
    """
    langs = list(dict.fromkeys(lang for lang, _, _ in rules))
    marks = F.lit(None).cast("array<string>")
    for own in langs:
        marks = F.when(F.col("lang") == own, F.array(*[F.when(F.col("line").rlike(p), F.lit(rule)) for lang, rule, p in rules if lang == own])).otherwise(marks)
    rows = lines(files.where(F.col("lang").isin(langs)), "path", "lang").where(~is_comment(F.col("lang"), F.col("line")))
    return rows.select("path", "line_no", F.explode(marks).alias("rule")).where("rule IS NOT NULL")


#: Files whose hits one task counts.
FILES_A_TASK = 200_000


def smell_counts(files: DataFrame) -> DataFrame:
    """rule, n and n_files over all files.

    Hits are dealt by path to tasks of so many files, so the paths that a task tells apart do not grow with the input.
    """
    hits = rule_hits(files).select("path", "rule")
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // FILES_A_TASK))
    by_file = hits.repartition(tasks, "path").groupBy("path", "rule").agg(F.count(F.lit(1)).alias("n"))
    return by_file.groupBy("rule").agg(F.sum("n").alias("n"), F.count("path").alias("n_files"))


def asset_smells(files: DataFrame, most_lines: int = 300, most_important: int = 8) -> DataFrame:
    """path, loc, n_important of style sheets that are long or override much."""
    rows = files.where(F.col("path").rlike(r"\.(css|scss)$")).select("path", T.line_count(F.col("text")).alias("loc"), F.regexp_count("text", F.lit("!important")).alias("n_important"))
    return rows.where((F.col("loc") >= most_lines) | (F.col("n_important") >= most_important))


def module_of(path: Column) -> Column:
    """a/b/c.py -> a.b.c; a package's __init__ is the package."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"/__init__$", ""), "/", ".")


def imports(files: DataFrame) -> DataFrame:
    """path, module, deferred: import lines of Python files; indented ones are deferred."""
    p = r"^(\s*)(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"
    rows = lines(files.where(F.col("lang") == "python"), "path").where(F.col("line").rlike(p))
    module = F.greatest(F.regexp_extract("line", p, 2), F.regexp_extract("line", p, 3))
    return rows.select("path", module.alias("module"), (F.length(F.regexp_extract("line", p, 1)) > 0).alias("deferred"))


def import_edges(files: DataFrame) -> DataFrame:
    """src, dst, deferred among the files themselves; an edge is deferred if all its imports are."""
    known = files.where(F.col("lang") == "python").select(F.col("path").alias("dst"), module_of(F.col("path")).alias("module"))
    return imports(files).join(unsized(known), "module").where("path <> dst").groupBy(F.col("path").alias("src"), "dst").agg(F.bool_and("deferred").alias("deferred"))


def finalised(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both are nodes: dangling references go."""
    known = nodes.select("node").distinct()
    src, dst = (unsized(known.select(F.col("node").alias(c))) for c in ("src", "dst"))
    return edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi")


def definitions(files: DataFrame) -> DataFrame:
    """path, name of top-level Python functions."""
    return lines(files.where(F.col("lang") == "python"), "path").where(F.col("line").rlike(r"^def \w+")).select("path", F.regexp_extract("line", r"^def (\w+)", 1).alias("name"))


def tokens(files: DataFrame) -> DataFrame:
    """name, n: how often each word occurs anywhere; the sum is partial before its shuffle."""
    return files.select(F.explode(F.split("text", r"\W+")).alias("name")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def uncalled(files: DataFrame) -> DataFrame:
    """Private top-level functions whose name occurs nowhere but in their definition."""
    private = definitions(files).where(F.col("name").startswith("_") & ~F.col("name").startswith("__"))
    return private.join(unsized(tokens(files).where("n = 1")), "name", "left_semi").select("path", "name")


def unused_enums(files: DataFrame) -> DataFrame:
    """Enum classes that no other file names.

    A name's users are told by the least and the greatest hash of their paths: both are the class's own if no other file
    names it. So words are combined before their shuffle, and one that all files hold is one row in the join.
    """
    p = r"^class (\w+)\((?:str, |int, )?(?:Enum|StrEnum|IntEnum)\)"
    own = F.xxhash64("path")
    made = lines(files.where(F.col("lang") == "python"), "path").where(F.col("line").rlike(p)).select("path", own.alias("own"), F.regexp_extract("line", p, 1).alias("name"))
    words = files.select(own.alias("user"), F.explode(F.split("text", r"\W+")).alias("name"))
    users = words.groupBy("name").agg(F.min("user").alias("low"), F.max("user").alias("high"))
    return made.join(unsized(users), ["name"]).where("low = own AND high = own").select("path", "name").distinct()


def private_imports(files: DataFrame) -> DataFrame:
    """path, module, symbol: underscore names imported over a package's bounds."""
    p = r"^\s*from\s+([\w.]+)\s+import\s+(_[a-z]\w*)"
    rows = lines(files.where(F.col("lang") == "python"), "path").where(F.col("line").rlike(p)).select("path", F.regexp_extract("line", p, 1).alias("module"), F.regexp_extract("line", p, 2).alias("symbol"))
    top = lambda c, sep: F.element_at(F.split(c, sep), 1)
    return rows.where(top(F.col("path"), "/") != top(F.col("module"), r"\."))


def facades(files: DataFrame, most_users: int = 20) -> DataFrame:
    """path and n_users of Python files of imports and __all__ only, used by few."""
    kept = F.filter(T.line_array(F.col("text")), lambda x: (F.trim(x) != "") & ~x.rlike(r"^(from|import|__all__|#|\s|\)|\])"))
    pure = files.where((F.col("lang") == "python") & F.col("text").rlike(r"(?m)^(from|import) ")).where(F.size(kept) == 0).select(F.col("path").alias("dst"))
    users = import_edges(files).groupBy("dst").agg(F.count(F.lit(1)).alias("n_users"))
    return pure.join(unsized(users), "dst", "left").select(F.col("dst").alias("path"), F.coalesce("n_users", F.lit(0)).alias("n_users")).where(F.col("n_users") <= most_users)


def deprecated(files: DataFrame) -> DataFrame:
    """path, symbol, n_users: declarations right after @deprecated, and how many other files name them."""
    p = r"@deprecated[^\n]*\n\s*(?:export )?(?:function|const|class) (\w+)"
    made = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(p), 1)).alias("symbol"))
    used = files.select(F.col("path").alias("user"), F.explode(F.array_distinct(F.split("text", r"\W+"))).alias("symbol"))
    return made.join(unsized(used), "symbol").groupBy("path", "symbol").agg(F.count_if(F.col("user") != F.col("path")).alias("n_users"))


def undeclared_features(files: DataFrame) -> DataFrame:
    """feature: cfg features that Rust files use and no manifest declares."""
    used = files.where(F.col("lang") == "rust").select(F.explode(F.regexp_extract_all("text", F.lit(r'feature\s*=\s*"(\w+)"'), 1)).alias("feature")).distinct()
    declared = lines(files.where(F.col("path").endswith("Cargo.toml")), "path").select(F.regexp_extract("line", r"^(\w+)\s*=\s*\[", 1).alias("feature"))
    return used.join(unsized(declared), "feature", "left_anti")


def frameworks(files: DataFrame, evidence: list[tuple[str, str, str]]) -> DataFrame:
    """framework and n: evidence rows (framework, part of a path, pattern in the text) that hold in some file."""
    marks = F.array(*[F.when(F.col("path").contains(at) & F.col("text").rlike(p), F.lit(name)) for name, at, p in evidence])
    return files.select(F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("framework")).groupBy("framework").agg(F.count(F.lit(1)).alias("n"))


def test_quality(files: DataFrame) -> DataFrame:
    """path, n_tests, n_asserts, n_mocks and quality of test files, by ordered rules."""
    n = lambda p: F.regexp_count("text", F.lit(p))
    rows = files.where(F.col("path").contains("test")).select("path", n(r"(?m)^\s*def test_").alias("n_tests"), n(r"\bassert\b").alias("n_asserts"), n(r"[Mm]ock").alias("n_mocks"))
    quality = (
        F.when(F.col("n_tests") == 0, "no_tests").when(F.col("n_asserts") == 0, "assertion_free").when(F.col("n_mocks") > F.col("n_asserts"), "over_mocked")
        .when(F.col("n_asserts") < F.col("n_tests"), "smoke").when(F.col("n_asserts") >= 3 * F.col("n_tests"), "thorough").otherwise("adequate")
    )
    return rows.withColumn("quality", quality)


def passthrough_tier(n: Column, ratio: Column, spread: Column) -> Column:
    """Tier by the number and share of parameters handed on; null below all thresholds."""
    return F.when((n >= 20) | (ratio >= 0.8), 4).when((n >= 8) & (ratio >= 0.5), 3).when(spread & (n >= 4), 3)


def normalised_body(text: Column) -> Column:
    """A Python body without docstrings, comments, empty lines and log or print calls."""
    bare = F.regexp_replace(text, '(?s)("""|\'\'\').*?("""|\'\'\')', "")
    kept = F.filter(F.transform(T.line_array(bare), lambda x: F.rtrim(F.regexp_replace(x, r"\s#.*$", ""))), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*(#|print\(|log(ger|ging)?\.)"))
    return F.array_join(kept, "\n")


def without_comments(text: Column) -> Column:
    """C-style text without comments; strings keep what looks like one."""
    kept = r"(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|//[^\n]*|(?s:/\*.*?\*/)"
    return F.regexp_replace(text, kept, "$1")


#: A tag in brackets that opens a log message, or one in a variable of a template.
LOG_TAG = r"console\.(log|warn|info|debug)\s*\(\s*['\"`].{0,4}\["
LOG_TAG_VARIABLE = r"(?i)console\.(log|warn|info|debug)\s*\(\s*`\$\{\w*(TAG|DEBUG|LOG)\w*\}"


def tagged_logs(files: DataFrame) -> DataFrame:
    """path, line_no, tag of each log line with a tag; 'unknown' where a variable holds it."""
    line = F.col("line")
    hit = lines(files, "path").where(line.rlike(LOG_TAG) | line.rlike(LOG_TAG_VARIABLE))
    tag = F.regexp_extract("line", r"\[([^\]]+)\]", 1)
    return hit.select("path", "line_no", F.when(tag == "", "unknown").otherwise(tag).alias("tag"))


#: The kinds of concerns that a component file may mix (name, pattern, least number of places).
CONCERNS = [
    ("jsx_rendering", r"return\s*\(?\s*<", 1),
    ("data_fetching", r"useQuery|useMutation|supabase\.|fetch\(|axios", 1),
    ("direct_supabase", r"supabase\.\w+\.\w+\.\w+", 1),
    ("data_transforms", r"\.(map|filter|reduce|sort|flatMap)\s*\(", 3),
    ("handlers", r"(?:const|function)\s+handle\w+", 5),
]


def mixed_concerns(files: DataFrame, least_lines: int = 100, least: int = 3) -> DataFrame:
    """path, loc, concerns, n_concerns of files of at least so many lines that mix at least so many kinds."""
    found = [F.when(F.regexp_count("text", F.lit(p)) >= n, F.lit(name)) for name, p, n in CONCERNS]
    told = files.select("path", T.line_count(F.col("text")).alias("loc"), F.filter(F.array(*found), lambda c: c.isNotNull()).alias("c"))
    return told.where((F.col("loc") >= least_lines) & (F.size("c") >= least)).select("path", "loc", F.array_join("c", ",").alias("concerns"), F.size("c").alias("n_concerns"))


#: An element that provides a context opens, unless its line closes an element at once, or ends.
PROVIDER_OPENS, PROVIDER_ENDS = r"<(\w+Provider)\b(?!.*/>)", r"</(\w+Provider)\s*>"


def context_nesting(files: DataFrame, more_than: int = 5) -> DataFrame:
    """path, depth and the names at the deepest place of files whose context providers nest deeper than that.

    A fold over the lines keeps the open names as a stack: names that open are pushed, then those that end are
    popped if they are on top.
    """
    state = "struct<stack: array<string>, deepest: array<string>>"
    opened = lambda s, name: F.concat(s["stack"], F.array(name))
    deeper = lambda s, now: F.when(F.size(now) > F.size(s["deepest"]), now).otherwise(s["deepest"])
    push = lambda s, name: F.struct(opened(s, name).alias("stack"), deeper(s, opened(s, name)).alias("deepest"))
    top = lambda s, name: (F.size(s["stack"]) > 0) & (F.try_element_at(s["stack"], F.lit(-1)) == name)
    cut = lambda s, name: F.when(top(s, name), F.slice(s["stack"], 1, F.size(s["stack"]) - 1)).otherwise(s["stack"])
    pop = lambda s, name: F.struct(cut(s, name).alias("stack"), s["deepest"].alias("deepest"))
    events = F.transform(T.line_array(F.col("text")), lambda x: F.struct(F.regexp_extract_all(x, F.lit(PROVIDER_OPENS), 1).alias("o"), F.regexp_extract_all(x, F.lit(PROVIDER_ENDS), 1).alias("e")))
    busy = F.filter(events, lambda e: (F.size(e["o"]) > 0) | (F.size(e["e"]) > 0))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<string>").alias("deepest")).cast(state)
    end = F.aggregate(busy, start, lambda s, e: F.aggregate(e["e"], F.aggregate(e["o"], s, push), pop))
    told = files.where(F.col("text").contains("Provider")).select("path", end["deepest"].alias("names"))
    return told.where(F.size("names") > more_than).select("path", F.size("names").alias("depth"), F.array_join("names", ",").alias("names"))
