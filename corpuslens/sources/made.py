"""Source files made from rows of the tables by rule, as the test tables hold no code: a file a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.sources.tables import table


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _repeat(n: Column, line) -> Column:
    """line(i) for i from 1 to n, joined."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: line(i.cast("string"))), "")).otherwise("")


#: Rows of a table that one task makes files from.
ROWS_A_TASK = 20_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt to tasks by their key, so many to each. Files are far larger than the rows that they are made from: a
    task for so many bytes of the table would hold ever more text, on few cores."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))
    return rows.repartition(tasks, key)


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and text of a Python file for each part: four functions, one of them nested, and a module-level name."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = _text("CACHE_", k.cast("string"))
    text = _text(
        "import os\n", name, F.when(k % 2 == 0, " = []\n").otherwise(" = 3\n"),
        'def alpha_one(a):\n    """Doc\n    string."""\n    x = a  # note\n\n    print(x)\n', F.when(k % 3 == 0, "    return beta_two(x)\n").otherwise("    return x\n"),
        "def beta_two(b):\n", F.when(k % 4 < 2, _text("    ", name, ".append(b)\n")).otherwise("    y = b\n"),
        "    def inner(c):\n        return c + ", size, "\n\n    return inner(b)\n# end\ndef gamma_three():\n    return ", size, "\n",
    )
    return p.select(_text("parts/f", k.cast("string"), ".py").alias("path"), text.alias("text"))


def projects(spark: SparkSession, sf_dir: str, files: list[tuple[str, str, str]]) -> DataFrame:
    """path, lang and text of the given files for each part, with its number in place of ``{k}``."""
    each = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("path", "lang", "text"), f)]) for f in files])
    parts = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    rows = parts.select(F.col("p_partkey").cast("string").alias("k"), F.explode(each).alias("f"))
    put = lambda c: F.replace(F.col(f"f.{c}"), F.lit("{k}"), F.col("k")).alias(c)
    return rows.select(put("path"), "f.lang", put("text"))


def order_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and text of a Python file for each customer: a function for each order, every one but each third calls the
    one before, names are of seven families, and functions use one of five modules."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("key"))
    listed = o.groupBy("cust").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    name = lambda x: _text("f", (x % 7).cast("string"), "_", x.cast("string"))
    unit = lambda x, i: _text(
        "def ", name(x), "(a):\n    m", (x % 5).cast("string"), ".run(a)\n",
        F.when(i % 3 == 0, "    return a\n").otherwise(_text("    return ", name(F.get("keys", i - 1)), "(a)\n")),
    )
    return listed.select(_text("customers/f", F.col("cust").cast("string"), ".py").alias("path"), F.array_join(F.transform("keys", unit), "").alias("text"))


def brace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and text of a TypeScript and a Rust file for each customer."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    k = F.col("c_custkey")
    n, s = k.cast("int"), k.cast("string")
    ts = _text(
        "interface Card", s, "Props {\n", _repeat(n % 20, lambda i: _text("  prop", i, "?: string;\n")), "}\n",
        "function useThing", s, "() {\n", _repeat(n % 5, lambda i: _text("  const [a", i, ", setA", i, "] = useState(false);\n")),
        "  if (x) { y(); }\n  return { ", _repeat(n % 16, lambda i: _text("f", i, ", ")), "};\n}\n",
    )
    rust = _text(
        F.when(k % 2 == 0, "#[non_exhaustive]\n").otherwise(""), "pub struct S", s, " {\n", _repeat(n % 4, lambda i: _text("    pub a", i, ": u8,\n")), "    b: u8,\n}\n",
        "pub enum E", s, " {\n", _repeat(n % 8, lambda i: _text("    V", i, ",\n")), "}\n",
        "impl Drop for S", s, " {\n    fn drop(&mut self) {\n", F.when(k % 3 == 0, "        self.x.take().unwrap();\n").otherwise(""),
        F.when(k % 5 == 0, '        panic!("no");\n').otherwise(""), "    }\n}\n",
        "async fn run", s, "() {\n", F.when(k % 7 < 2, "    let g = m.lock().unwrap();\n").when(k % 7 < 4, "    let g = m.lock().await;\n").otherwise(""),
        F.when(k % 2 == 0, "    drop(g);\n").otherwise(""), "    tick().await;\n", F.when(k % 3 == 0, "    m.lock().unwrap().push(1);\n").otherwise(""), "}\n",
    )
    rows = F.array(F.struct(_text("web/c", s, ".ts").alias("path"), ts.alias("text")), F.struct(_text("src/c", s, ".rs").alias("path"), rust.alias("text")))
    return c.select(F.explode(rows).alias("f")).select("f.path", "f.text")
