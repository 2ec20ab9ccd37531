"""Line scans: regular-expression search, secrets and other line rules, complexity and pattern counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.sources.tables import lines

#: Formats of secrets (label, pattern, severity).
SECRET_FORMATS = [
    ("AWS access key", "AKIA[0-9A-Z]{16}", "critical"),
    ("GitHub token", "gh[ps]_[A-Za-z0-9_]{36,}", "critical"),
    ("Private key block", r"-----BEGIN\s+(?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "critical"),
    ("Stripe key", "[sr]k_(?:live|test)_[0-9a-zA-Z]{20,}", "high"),
    ("Slack token", "xox[bpas]-[0-9a-zA-Z-]+", "high"),
    ("JWT token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", "medium"),
    ("Database connection string with password", r"(?:postgres|mysql|mongodb|redis)://\w+:[^@\s]{3,}@", "critical"),
]
#: Names that make an assigned literal a secret, and lookups that do not.
SECRET_NAME = "(?i)(?:password|passwd|secret|api_key|apikey|token|credentials|auth_token|private_key|access_key|client_secret|secret_key)"
ENV_LOOKUPS = ["os.environ", "os.getenv", "process.env.", "import.meta.env", "env(", "getenv(", "$_ENV[", "$_SERVER[", "config("]
#: An assignment of a quoted literal, one pattern a quote, as neither engine's dialect shares back-references.
ASSIGNED = {q: rf"(?:^|[\s,;(])(?:const|let|var|export)?\s*\$?([A-Za-z_]\w*)\s*[:=]\s*{q}([^{q}]+){q}" for q in ('"', "'", "`")}
#: Rules on two patterns of one line. ``(^|\W)`` stands for a lookbehind, which not every engine has.
RANDOM_CALL = r"(?:Math\.random|random\.random|random\.randint|(^|\W)rand|(^|\W)mt_rand|(^|\W)array_rand)\s*\("
SECURITY_WORD = "(?i)(?:token|key|nonce|session|salt|secret|password|otp|csrf|auth)"
WEAK_TLS = [
    ("TLS verification disabled", r"verify\s*=\s*False"),
    ("Unverified SSL context", r"ssl\._create_unverified_context\s*\("),
    ("TLS rejection disabled", r"rejectUnauthorized\s*:\s*false"),
    ("TLS rejection disabled via env", r"NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\"]0['\"]"),
]
LOG_CALL = (
    r"(?:console\.(?:log|warn|error|info|debug)|"
    r"log(?:ger)?\.(?:info|debug|warning|error|critical)|"
    r"logging\.(?:info|debug|warning|error|critical)|"
    r"Log::(?:info|debug|warning|error|critical|notice|alert|emergency)|"
    r"\berror_log|\bprint)\s*\("
)
SENSITIVE_WORD = "(?i)(?:password|token|secret|api_key|apikey|credentials|private_key|access_key|authorization)"


def grep(docs: DataFrame, pattern: str, *keep: str) -> DataFrame:
    """Every line that matches, with its 1-based number."""
    return lines(docs, *keep).where(F.col("line").rlike(pattern))


def files_by_name(docs: DataFrame, names: list[str], key: str = "path") -> DataFrame:
    """name -> texts that hold it as a whole word (letters, digits and _ of any script): one pass for all names."""
    found = F.array_intersect(F.split("text", r"[^\p{L}\p{N}_]+"), F.array(*map(F.lit, names)))
    return docs.select(key, F.explode(found).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_files"), F.min(key).alias("first_file"))


def secret_formats(docs: DataFrame) -> DataFrame:
    """path, line_no, label, severity of each secret format on each line: one pass, the rules are an array."""
    rules = F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(label).alias("label"), F.lit(severity).alias("severity"))) for label, p, severity in SECRET_FORMATS])
    hit = lines(docs, "path").select("path", "line_no", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r"))
    return hit.select("path", "line_no", "r.label", "r.severity")


def secret_names(docs: DataFrame) -> DataFrame:
    """path, line_no, variable, value: literals assigned to secret-like names, placeholders and lookups left out."""
    # whole texts first: only those with such a name at all are cut into lines
    wide = lines(docs.where(F.col("text").rlike(SECRET_NAME)), "path").where(F.col("line").rlike(SECRET_NAME))
    for lookup in ENV_LOOKUPS:
        wide = wide.where(~F.col("line").contains(lookup))
    pairs = F.concat(*[F.arrays_zip(F.regexp_extract_all("line", F.lit(p), 1).alias("variable"), F.regexp_extract_all("line", F.lit(p), 2).alias("value")) for p in ASSIGNED.values()])
    found = wide.select("path", "line_no", F.explode(pairs).alias("p")).select("path", "line_no", F.col("p")["variable"].alias("variable"), F.col("p")["value"].alias("value"))
    return found.where(F.col("variable").rlike(SECRET_NAME) & ~T.is_placeholder(F.col("value")))


def line_rules(docs: DataFrame) -> DataFrame:
    """path, line_no, rule: insecure random numbers, weak TLS and sensitive logging."""
    line = F.col("line")
    rules = F.array(
        F.when(line.rlike(RANDOM_CALL) & line.rlike(SECURITY_WORD), F.lit("insecure_random")),
        *[F.when(line.rlike(p), F.lit(label)) for label, p in WEAK_TLS],
        F.when(line.rlike(LOG_CALL) & line.rlike(SENSITIVE_WORD), F.lit("log_sensitive")),
    )
    return lines(docs, "path").select("path", "line_no", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def top_per_rule(found: DataFrame, rule: str, most: int, *order: str) -> DataFrame:
    """The first rows of each rule in the given order, ranked from 1."""
    rank = F.row_number().over(Window.partitionBy(rule).orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def complexity(docs: DataFrame, signals: list[tuple[str, str, int, int]], least: int, least_lines: int) -> DataFrame:
    """path, loc, score: sum of weight * (count - threshold) over the signals (label, pattern, threshold, weight)."""
    loc = T.line_count(F.col("text"))
    over = [F.greatest(F.regexp_count("text", F.lit(p)) - t, F.lit(0)) * w for _, p, t, w in signals]
    total = over[0]
    for o in over[1:]:
        total = total + o
    return docs.select("path", loc.alias("loc"), total.alias("score")).where((F.col("loc") >= least_lines) & (F.col("score") >= least))


def god_entities(metrics: DataFrame, rules: list[tuple[str, str, int]], least: int) -> DataFrame:
    """Entities with at least so many metrics above their thresholds; rules are (label, column, threshold)."""
    reasons = F.filter(F.array(*[F.when(F.col(c) > t, F.lit(label)) for label, c, t in rules]), lambda r: r.isNotNull())
    return metrics.withColumn("reasons", F.array_join(reasons, ",")).withColumn("n_reasons", F.size(reasons)).where(F.col("n_reasons") >= least)


def census(docs: DataFrame, area: Column, families: dict[str, dict[str, str]]) -> DataFrame:
    """area, family, pattern, n_files: how many texts of an area show each pattern of each family."""
    marks = F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(f).alias("family"), F.lit(n).alias("pattern"))) for f, ps in families.items() for n, p in ps.items()])
    seen = docs.select(area.alias("area"), F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m"))
    return seen.groupBy("area", "m.family", "m.pattern").agg(F.count(F.lit(1)).alias("n_files"))


def census_anomalies(found: DataFrame, competing: int, rare: int) -> DataFrame:
    """Areas with at least ``competing`` patterns of a family, or a pattern that fewer than ``rare`` % of areas adopt."""
    kinds = found.groupBy("area", "family").agg(F.count(F.lit(1)).alias("n_patterns"))
    areas = found.select("area").distinct().agg(F.count(F.lit(1)).alias("all_areas"))
    adopted = found.groupBy("family", "pattern").agg(F.count(F.lit(1)).alias("n_areas"), F.min("area").alias("first_area"))
    few = adopted.join(F.broadcast(areas), F.col("n_areas") * 100 < F.col("all_areas") * rare).select(F.col("first_area").alias("area"), "family", F.lit("low_adoption").alias("reason"), F.col("n_areas").alias("n"))
    many = kinds.where(F.col("n_patterns") >= competing).select("area", "family", F.lit("competing").alias("reason"), F.col("n_patterns").alias("n"))
    return many.union(few)
