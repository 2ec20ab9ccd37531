"""Queries of the source-text operators over whole documents, taken as Python (even ids) and TypeScript (odd ids)
files, and over a small project of code for each part, as the test tables hold little of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import code_rules as code
from corpuslens.operators import graph
from corpuslens.plans.registry import query
from corpuslens.sources import made, tables

FILES = [
    ("app{k}/core.py", "python", "import app{k}.util\nfrom lib{k}.base import _hidden\nimport os\n\ndef run(x=[]):\n    import app{k}.late\n    try:\n        return eval(x)\n    except:\n        pass\n\ndef _unused{k}():\n    return 1\n"),
    ("app{k}/util.py", "python", "from app{k}.core import run\nfrom lib{k}.base import Color{k}\n\ndef _helper{k}():\n    return _helper{k}\n# except:\n"),
    ("app{k}/late.py", "python", "from app{k}.util import *\n"),
    ("app{k}/__init__.py", "python", "from app{k}.core import run\n\n__all__ = ['run']\n"),
    ("lib{k}/base.py", "python", "from enum import Enum\n\nclass Color{k}(Enum):\n    RED = 1\n\nclass Lost{k}(str, Enum):\n    A = 'a'\n\ndef _hidden():\n    return 2\n"),
    ("tests/test_core{k}.py", "python", "import app{k}.core\n\ndef test_a():\n    assert 1\n\ndef test_b():\n    mock()\n"),
    ("tests/test_free{k}.py", "python", "def test_c():\n    pass\n"), ("tests/test_full{k}.py", "python", "def test_d():\n    assert 1\n    assert 2\n    assert 3\n"),
    ("web{k}/a.ts", "typescript", "let x: any = 1; // @ts-ignore\nconsole.log(x)\n// console.log(y)\nel.innerHTML = x\n/** @deprecated use b */\nexport function oldOne{k}() {}\n"),
    ("web{k}/b.ts", "typescript", "import { oldOne{k} } from './a'\noldOne{k}()\n"), ("web{k}/s.css", "css", "a { color: red !important }\n" * 9),
    ("svc{k}/Main.cs", "csharp", "var r = new Random();\nvar c = new SqlCommand(\"a\" + b);\n"), ("src{k}/lib.rs", "rust", "use crate::x;\n#[cfg(feature = \"fast{k}\")]\nlet y = v.get_unchecked(0);\nz.unwrap();\n#[cfg(feature = \"slow{k}\")]\n"),
    ("src{k}/Cargo.toml", "toml", "[features]\nfast{k} = []\n"), ("stat{k}/a.R", "r", "setwd('x')\ny <<- 3\nf(a = T)\n"), ("native{k}/m.cpp", "cpp", "strcpy(a, b); /* system( */\nsystem(\"ls\");\n"),
    ("web{k}/package.json", "json", "{\"dependencies\": {\"next\": \"14\", \"react\": \"18\"}}"), ("web{k}/next.config.js", "js", "module.exports = {}"),
]


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


FILE_SQL = "files AS (SELECT replace(path, '{k}', CAST(p_partkey AS VARCHAR)) AS path, lang, replace(text, '{k}', CAST(p_partkey AS VARCHAR)) AS text FROM part, (VALUES " + ", ".join(f"('{p}', '{g}', {_lit(t)})" for p, g, t in FILES) + """) v(path, lang, text)
  UNION ALL SELECT source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.ts' END, CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE 'typescript' END, text FROM documents)"""
ROWS = FILE_SQL + ", ls AS (SELECT path, lang, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM files)"
COMMENTS = " OR ".join(f"(lang = '{g}' AND starts_with(ltrim(line), '{m}'))" for g, m in code.COMMENT.items()) + " OR starts_with(ltrim(line), '/*') OR starts_with(ltrim(line), '* ')"
HITS = ROWS + ", hits AS (SELECT path, line_no, rule FROM ls JOIN (VALUES " + ", ".join(f"('{g}', '{r}', '{p}')" for g, r, p in code.RULES) + f") r(lang, rule, pattern) USING (lang) WHERE regexp_matches(line, pattern) AND NOT ({COMMENTS}))"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    path = F.concat(F.regexp_replace("path", r"\.txt$", ""), F.when(even, ".py").otherwise(".ts"))
    docs = tables.documents(spark, sf_dir).select(path.alias("path"), F.when(even, "python").otherwise("typescript").alias("lang"), "text")
    return docs.union(made.projects(spark, sf_dir, FILES))


@query(f"WITH {HITS} SELECT path, line_no, rule FROM hits")
def language_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line rules by language, comments left out (134-137, 154-156, 159, 160)."""
    return code.rule_hits(_files(spark, sf_dir))


@query(f"WITH {HITS} SELECT rule, count(*) AS n, count(DISTINCT path) AS n_files FROM hits GROUP BY rule")
def smell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.smell_counts(_files(spark, sf_dir))


@query(f"""WITH {FILE_SQL} SELECT path, CAST(len(string_split(text, chr(10))) - 1 AS INTEGER) AS loc,
  len(regexp_extract_all(text, '!important')) AS n_important FROM files WHERE regexp_matches(path, '\\.(css|scss)$')
  AND len(regexp_extract_all(text, '!important')) >= 8""")
def asset_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.asset_smells(_files(spark, sf_dir))


IMPORTS = ROWS + """, im AS (SELECT path, greatest(regexp_extract(line, '^(\\s*)(?:from\\s+([\\w.]+)\\s+import|import\\s+([\\w.]+))', 2), regexp_extract(line, '^(\\s*)(?:from\\s+([\\w.]+)\\s+import|import\\s+([\\w.]+))', 3)) AS module, regexp_matches(line, '^\\s') AS deferred
  FROM ls WHERE lang = 'python' AND regexp_matches(line, '^(\\s*)(?:from\\s+([\\w.]+)\\s+import|import\\s+([\\w.]+))')),
 mods AS (SELECT path AS dst, replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '/__init__$', ''), '/', '.') AS module FROM files WHERE lang = 'python'),
 edges AS (SELECT path AS src, dst, bool_and(deferred) AS deferred FROM im JOIN mods USING (module) WHERE path <> dst GROUP BY ALL)"""


@query(f"WITH {IMPORTS} SELECT * FROM edges")
def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import edges among the files, deferred ones marked (168)."""
    return code.import_edges(_files(spark, sf_dir))


@query(f"""WITH RECURSIVE {IMPORTS}, r(a, b) AS (SELECT src, dst FROM edges WHERE NOT deferred UNION SELECT r.a, e.dst FROM r
  JOIN edges e ON e.src = r.b AND NOT e.deferred) SELECT x.a AS node, min(x.b) AS root FROM r x JOIN r y ON x.a =
  y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1""")
def import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import cycles without deferred edges (86)."""
    return graph.strongly_connected(code.import_edges(_files(spark, sf_dir)).where("NOT deferred"))


@query(f"WITH {IMPORTS} SELECT src, dst FROM edges WHERE src NOT LIKE 'tests/%' AND dst NOT LIKE 'tests/%'")
def finalised_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left when excluded nodes go (85)."""
    files = _files(spark, sf_dir)
    nodes = files.where(~F.col("path").startswith("tests/")).select(F.col("path").alias("node"))
    return code.finalised(code.import_edges(files), nodes).select("src", "dst")


TOKENS = ROWS + ", tok AS (SELECT path, unnest(string_split_regex(text, '\\W+')) AS name FROM files)"


@query(f"""WITH {TOKENS}, n AS (SELECT name, count(*) AS n FROM tok WHERE name <> '' GROUP BY name) SELECT path,
  regexp_extract(line, '^def (\\w+)', 1) AS name FROM ls JOIN n ON n.name = regexp_extract(line, '^def (\\w+)', 1)
  AND n.n = 1 WHERE lang = 'python' AND regexp_matches(line, '^def _[^_]')""")
def uncalled_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.uncalled(_files(spark, sf_dir))


ENUM = "^class (\\w+)\\((?:str, |int, )?(?:Enum|StrEnum|IntEnum)\\)"


@query(f"""WITH {TOKENS}, e AS (SELECT path, regexp_extract(line, '{ENUM}', 1) AS name FROM ls WHERE lang = 'python' AND
  regexp_matches(line, '{ENUM}')) SELECT path, name FROM e WHERE NOT EXISTS (SELECT 1 FROM tok t WHERE t.name =
  e.name AND t.path <> e.path)""")
def unused_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.unused_enums(_files(spark, sf_dir))


PRIVATE = "^\\s*from\\s+([\\w.]+)\\s+import\\s+(_[a-z]\\w*)"


@query(f"""WITH {ROWS} SELECT path, regexp_extract(line, '{PRIVATE}', 1) AS module, regexp_extract(line, '{PRIVATE}', 2) AS
  symbol FROM ls WHERE lang = 'python' AND regexp_matches(line, '{PRIVATE}') AND split_part(path, '/', 1) <>
  split_part(regexp_extract(line, '{PRIVATE}', 1), '.', 1)""")
def private_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.private_imports(_files(spark, sf_dir))


@query("""SELECT 'app' || p_partkey || '/__init__.py' AS path, CAST(0 AS BIGINT) AS n_users FROM part UNION ALL SELECT 'app'
  || p_partkey || '/late.py', 1 FROM part""")
def facades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of re-exports only, with their users (123)."""
    return code.facades(_files(spark, sf_dir))


@query(f"""WITH {TOKENS}, d AS (SELECT path, unnest(regexp_extract_all(text,
  '@deprecated[^\\n]*\\n\\s*(?:export )?(?:function|const|class) (\\w+)', 1)) AS symbol FROM files) SELECT d.path,
  symbol, count(DISTINCT t.path) - 1 AS n_users FROM d JOIN tok t ON t.name = symbol GROUP BY ALL""")
def deprecated_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.deprecated(_files(spark, sf_dir))


@query(f"""WITH {ROWS} SELECT DISTINCT f AS feature FROM (SELECT unnest(regexp_extract_all(text, 'feature\\s*=\\s*"(\\w+)"', 1)) AS f FROM files WHERE lang = 'rust') WHERE f NOT IN (SELECT regexp_extract(line, '^(\\w+)\\s*=\\s*\\[', 1) FROM ls WHERE ends_with(path, 'Cargo.toml'))""")
def undeclared_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.undeclared_features(_files(spark, sf_dir))


EVIDENCE = [("nextjs", "package.json", '"next"'), ("nextjs", "next.config", "module"), ("react", "package.json", '"react"'), ("vue", "package.json", '"vue"')]


@query("SELECT 'nextjs' AS framework, 2 * count(*) AS n FROM part UNION ALL SELECT 'react', count(*) FROM part")
def framework_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.frameworks(_files(spark, sf_dir), EVIDENCE)


@query(f"""WITH {FILE_SQL}, n AS (SELECT path, len(regexp_extract_all(text, '(?m)^\\s*def test_')) AS n_tests, len(regexp_extract_all(text, '\\bassert\\b')) AS n_asserts, len(regexp_extract_all(text, '[Mm]ock')) AS n_mocks FROM files WHERE contains(path, 'test'))
 SELECT *, CASE WHEN n_tests = 0 THEN 'no_tests' WHEN n_asserts = 0 THEN 'assertion_free' WHEN n_mocks > n_asserts THEN 'over_mocked' WHEN n_asserts < n_tests THEN 'smoke' WHEN n_asserts >= 3 * n_tests THEN 'thorough' ELSE 'adequate' END AS quality FROM n""")
def test_quality_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.test_quality(_files(spark, sf_dir))


@query("""WITH n AS (SELECT o_custkey AS cust, count(*) AS n, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) AS ratio,
  count(DISTINCT o_orderpriority) >= 4 AS spread FROM orders GROUP BY 1)
SELECT *, CASE WHEN n >= 20 OR ratio >= 0.8 THEN 4 WHEN n >= 8 AND ratio >= 0.5 THEN 3 WHEN spread AND n >= 4 THEN 3 END AS tier FROM n""")
def passthrough_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers by the number and share of parameters handed on (103): customers by their orders."""
    n, ratio = F.count(F.lit(1)), F.count_if(F.col("o_orderstatus") == "F").cast("double") / F.count(F.lit(1))
    spread = F.count_distinct("o_orderpriority") >= 4
    rows = tables.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(n.alias("n"), ratio.alias("ratio"), spread.alias("spread"))
    return rows.withColumn("tier", code.passthrough_tier(F.col("n"), F.col("ratio"), F.col("spread")))
