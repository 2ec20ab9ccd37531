"""Queries of the block operators over source files made from the tables; their SQL follows from the rows directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import blocks, crates
from corpuslens.operators import code_rules as code
from corpuslens.operators.graph import checkpointed
from corpuslens.plans.registry import query
from corpuslens.sources import made, tables

PARTS = """p AS (SELECT p_partkey AS k, p_size AS s, 'parts/f' || p_partkey || '.py' AS path FROM part)"""


@query(f"""WITH {PARTS} SELECT path, u.name, u.parent, u.a AS start_line, u.b AS end_line FROM p, (VALUES ('alpha_one', NULL, 3, 9),
  ('beta_two', NULL, 10, 14 + 1), ('inner', 'beta_two', 12, 13), ('gamma_three', NULL, 17, 18)) u(name, parent, a, b)""")
def function_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions by indentation, nested ones with the one around them (170)."""
    return blocks.indent_units(made.python_files(spark, sf_dir)).select("path", "name", "parent", "start_line", "end_line")


@query(f"""WITH {PARTS}, b AS (SELECT path, 'alpha_one' AS name, 3 AS start_line, 3 AS n_lines,
    'def alpha_one(a):' || chr(10) || 'x = a' || chr(10) || CASE WHEN k % 3 = 0 THEN 'return beta_two(x)' ELSE 'return x' END AS body FROM p
  UNION ALL SELECT path, 'beta_two', 10, 5, 'def beta_two(b):' || chr(10) || CASE WHEN k % 4 < 2 THEN 'CACHE_' || k || '.append(b)' ELSE 'y = b' END
    || chr(10) || 'def inner(c):' || chr(10) || 'return c + ' || s || chr(10) || 'return inner(b)' FROM p)
SELECT path, name, start_line, n_lines, md5(body) AS digest FROM b""")
def function_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of normalised functions of at least three lines (170, 171)."""
    return blocks.unit_digests(blocks.indent_units(made.python_files(spark, sf_dir)))


@query(f"""WITH {PARTS} SELECT k AS id, 'import os' || chr(10) || 'CACHE_' || k || CASE WHEN k % 2 = 0 THEN ' = []' ELSE ' = 3' END || chr(10)
  || 'def alpha_one(a):' || chr(10) || '    x = a' || chr(10) || CASE WHEN k % 3 = 0 THEN '    return beta_two(x)' ELSE '    return x' END || chr(10)
  || 'def beta_two(b):' || chr(10) || CASE WHEN k % 4 < 2 THEN '    CACHE_' || k || '.append(b)' ELSE '    y = b' END || chr(10) || '    def inner(c):'
  || chr(10) || '        return c + ' || s || chr(10) || '    return inner(b)' || chr(10) || 'def gamma_three():' || chr(10) || '    return ' || s AS body FROM p""")
def normalised_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without docstrings, comments, empty lines and printing (171)."""
    files = made.python_files(spark, sf_dir)
    return files.select(F.regexp_extract("path", r"f(\d+)\.py$", 1).cast("long").alias("id"), code.normalised_body(F.col("text")).alias("body"))


@query("""SELECT p_partkey AS id, 'a = ''// ' || p_name || '''; ' || chr(10) || ' b = "/* ' || p_size || ' */";' || chr(10) AS body FROM part""")
def stripped_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-style texts without comments; what looks like one in a string stays (174)."""
    p = tables.table(spark, sf_dir, "part")
    text = F.concat(
        F.lit("a = '// "), "p_name", F.lit("'; // "), "p_type", F.lit("\n/* "), "p_brand", F.lit("\n more */ b = \"/* "),
        F.col("p_size").cast("string"), F.lit(' */";/**/\n// '), "p_name",
    )
    return p.select(F.col("p_partkey").alias("id"), code.without_comments(text).alias("body"))


@query(f"""WITH {PARTS} SELECT path, 'CACHE_' || k AS name, 'beta_two' AS unit, CAST(1 AS BIGINT) AS n FROM p WHERE k % 4 = 0""")
def mutable_globals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module-level lists that a function changes (133)."""
    files = made.python_files(spark, sf_dir)
    return blocks.mutated_globals(files, blocks.indent_units(files))


@query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
z AS (SELECT c, i // 3 AS part, count(*) AS size FROM o GROUP BY ALL), w AS (SELECT c, CAST(sum(size) AS BIGINT) AS n_units, count(*) AS n_components, max(size) AS largest FROM z GROUP BY c),
g AS (SELECT c, count(*) AS significant FROM z JOIN w USING (c) WHERE size >= greatest(2, n_units // 10) GROUP BY c),
f AS (SELECT c, count(DISTINCT k % 7) AS n_families, count(DISTINCT k % 5) AS n_imports FROM o GROUP BY c)
SELECT 'customers/f' || c || '.py' AS path, n_units, n_components, largest, n_families, n_imports FROM w LEFT JOIN g USING (c) JOIN f USING (c)
WHERE n_units >= 10 AND ((n_components >= 3 AND largest <= n_units // 2) OR (coalesce(significant, 0) >= 3 AND (n_families >= 5 OR n_imports >= 4)))""")
def cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose functions fall into unrelated parts (121)."""
    # stored: calls and imports read the units too, and their fold over lines costs most
    units = checkpointed(blocks.indent_units(made.order_modules(spark, sf_dir)).select("path", "name", "parent", "text"))
    imports = units.select("path", "name", F.explode(F.regexp_extract_all("text", F.lit(r"\b(m\d)\.run"), 1)).alias("root"))
    return blocks.cohesion(units, blocks.unit_calls(units), imports)


CUST = "c AS (SELECT c_custkey AS k, 'web/c' || c_custkey || '.ts' AS ts, 'src/c' || c_custkey || '.rs' AS rs FROM customer)"


def _blocks(spark: SparkSession, sf_dir: str, ending: str) -> DataFrame:
    return blocks.brace_blocks(made.spread(made.brace_files(spark, sf_dir).where(F.col("path").endswith(ending)), "path"))


@query(f"""WITH {CUST}, b AS (SELECT ts AS path, 'interface' AS head, 1 AS line, 1 AS depth FROM c
  UNION ALL SELECT ts, 'function', CAST(3 + k % 20 AS INTEGER), 1 FROM c UNION ALL SELECT ts, 'if', CAST(4 + k % 20 + k % 5 AS INTEGER), 2 FROM c
  UNION ALL SELECT ts, 'return', CAST(5 + k % 20 + k % 5 AS INTEGER), 2 FROM c) SELECT * FROM b""")
def brace_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in braces with their depth and line, by the first word of their heads."""
    found = _blocks(spark, sf_dir, ".ts")
    return found.select("path", F.regexp_extract("head", r"(interface|function|if|return)[^\n]*$", 1).alias("head"), "line", "depth")


@query(f"""WITH {CUST} SELECT ts AS path, 'Card' || k || 'Props' AS name, 1 AS line, CAST(k % 20 AS INTEGER) AS n FROM c WHERE
  k % 20 > 14""")
def prop_bloat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interfaces of more than 14 properties (142)."""
    return blocks.prop_bloat(_blocks(spark, sf_dir, ".ts"))


@query(f"WITH {CUST} SELECT ts AS path, 'useThing' || k AS name, CAST(k % 16 AS INTEGER) AS n FROM c WHERE k % 16 > 12")
def hook_return_bloat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hooks that return more than 12 fields (145)."""
    return blocks.hook_return_bloat(_blocks(spark, sf_dir, ".ts"))


@query(f"WITH {CUST} SELECT ts AS path, 'useThing' || k AS name, CAST(k % 5 AS INTEGER) AS n FROM c WHERE k % 5 >= 3")
def boolean_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with at least three boolean states (146)."""
    return blocks.boolean_states(_blocks(spark, sf_dir, ".ts"))


@query(f"""WITH {CUST} SELECT rs AS path, 'S' || k AS name, 'unwrap' AS kind FROM c WHERE k % 3 = 0 UNION ALL SELECT rs, 'S' ||
  k, 'panic' FROM c WHERE k % 5 = 0""")
def drop_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destructors that can panic (158)."""
    return blocks.drop_hazards(_blocks(spark, sf_dir, ".rs"))


@query(f"""WITH {CUST} SELECT rs AS path, 'S' || k AS name, 'struct' AS kind, CAST(k % 4 AS INTEGER) AS n FROM c WHERE k % 2 = 1 AND k % 4 >= 2
  UNION ALL SELECT rs, 'E' || k, 'enum', CAST(k % 8 AS INTEGER) FROM c WHERE k % 8 >= 5""")
def open_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public types whose shape is fixed early (163)."""
    return blocks.open_types(_blocks(spark, sf_dir, ".rs"))


@query(f"""WITH {CUST}, h AS (SELECT rs AS path, 'run' || k AS name, CASE WHEN k % 7 < 2 AND k % 2 = 1 THEN 'std_guard'
  WHEN k % 7 BETWEEN 2 AND 3 AND k % 2 = 1 THEN 'async_guard' WHEN k % 7 < 2 OR k % 3 = 0 THEN 'blocking_lock' END AS kind FROM c)
SELECT * FROM h WHERE kind IS NOT NULL""")
def async_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locks held across an await, or that block (157)."""
    return blocks.async_locks(_blocks(spark, sf_dir, ".rs"))


#: A crate and a web package for each part; each third crate has the second list too.
PACKAGE = [
    ("web{k}/c.ts", "ts", "export const used{k} = 1\nexport async function dead{k}() {}\nconst inner{k} = 2\nexport type Shape{k} = string\n"),
    ("web{k}/d.ts", "ts", "import { used{k}, other as mine } from './c'\nexport { Shape{k} } from './c'\n"),
    ("crate{k}/src/lib.rs", "rs", "unsafe impl Send for Held{k} {}\nunsafe impl<T> Sync for Free{k} {}\nimpl Held{k} {\n    pub fn into_parts(&self) -> u8 {\n        1\n    }\n    pub fn as_raw(self) -> u8 {\n        2\n    }\n"
     "    pub fn get_name(&self) -> &str {\n        self.name\n    }\n    pub fn to_list(&self) -> Vec<u8> {\n        vec![]\n    }\n}\npub fn load{k}(p: &str) -> Result<u8, Box<dyn Error>> {\n    let x = p.parse().unwrap();\n    Ok(x)\n}\n"
     "pub fn fine{k}() -> Result<u8, MyError> {\n    Ok(1)\n}\nfn hidden{k}() -> Result<u8, String> {\n    panic!(\"x\")\n}\n"),
    ("crate{k}/tests/threads.rs", "rs", "assert_send::<Held{k}>();\n"),
    ("crate{k}/README.md", "md", "# Title\n```rust\nlet a = 1;\n```\ntext\n```rust\nlet b = 2;\n```\n"),
]
WIRED = [("crate{k}/src/docs.rs", "rs", '#![doc = include_str!("../README.md")]\n')]


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    wired = made.projects(spark, sf_dir, WIRED).where(F.regexp_extract("path", r"^crate(\d+)/", 1).cast("long") % 3 == 0)
    return made.projects(spark, sf_dir, PACKAGE).union(wired).select("path", "text")


@query("SELECT 'web' || p_partkey || '/c.ts' AS path, 'dead' || p_partkey AS name FROM part")
def dead_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported names that nothing imports (147)."""
    return crates.dead_exports(_packages(spark, sf_dir))


@query("""SELECT 'crate' || p_partkey || '/src/lib.rs' AS path, n AS line_no, name, kind FROM part, (VALUES (4, 'into_parts', 'into_by_reference'),
  (7, 'as_raw', 'as_by_value'), (10, 'get_name', 'getter_prefix')) v(n, name, kind)""")
def api_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public methods whose names and receivers do not fit (161)."""
    return crates.api_conventions(_packages(spark, sf_dir))


@query("""SELECT 'crate' || p_partkey || '/src/lib.rs' AS path, 'load' || p_partkey AS name, kind FROM part, (VALUES
  ('untyped_error'), ('panics')) v(kind)""")
def error_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public functions with untyped errors or panics (162)."""
    return crates.error_boundaries(blocks.brace_blocks(made.spread(_packages(spark, sf_dir).where(F.col("path").endswith(".rs")), "path")))


@query("SELECT 'crate' || p_partkey || '/src/lib.rs' AS path, 'Free' || p_partkey AS type, 'Sync' AS trait FROM part")
def thread_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types declared Send or Sync by hand, without an assertion (164)."""
    return crates.thread_contracts(_packages(spark, sf_dir))


@query("SELECT 'crate' || p_partkey || '/README.md' AS path, 2 AS n FROM part WHERE p_partkey % 3 <> 0")
def unwired_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples that no documentation test runs (166)."""
    return crates.unwired_examples(_packages(spark, sf_dir))
