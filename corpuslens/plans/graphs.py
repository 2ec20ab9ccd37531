"""Queries of the graph operators: the trade graph of nations, page links, and long chains of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.operators import graph
from corpuslens.plans.registry import query
from corpuslens.sources import tables
from corpuslens.sources.tables import EDGES, HREFS

SIMPLE = "e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst)"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("area"))


@query(f"""WITH {EDGES}, {SIMPLE}, i AS (SELECT dst AS node, count(*) AS fan_in FROM e GROUP BY 1), o AS (SELECT src AS node,
  count(*) AS fan_out FROM e GROUP BY 1) SELECT node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out
  FROM i FULL JOIN o USING (node)""")
def fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(tables.trade_edges(spark, sf_dir))


@query(f"""WITH {EDGES}, {SIMPLE}, i AS (SELECT dst AS node, count(*) AS fan_in FROM e GROUP BY 1), o AS (SELECT src AS node,
  count(*) AS fan_out FROM e GROUP BY 1), d AS (SELECT node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS
  fan_out FROM i FULL JOIN o USING (node)) SELECT node, fan_in, fan_out, CAST(fan_out AS DOUBLE) / (fan_in +
  fan_out) AS instability FROM d""")
def instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.instability(graph.degrees(tables.trade_edges(spark, sf_dir)))


@query(f"""WITH {EDGES} SELECT src, dst, n, a.n_regionkey AS src_area, b.n_regionkey AS dst_area FROM edges JOIN nation a ON
  a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey""")
def cross_area_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.cross_area(tables.trade_edges(spark, sf_dir), _nations(spark, sf_dir))
    return found.select("src", "dst", "n", "src_area", "dst_area")


@query(f"""WITH {EDGES} SELECT count(*) FILTER (src < 5 AND dst >= 20) AS violating, count(*) FILTER (src < 5 AND (dst >= 20 OR
  dst < 5)) AS eligible FROM edges""")
def backward_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.backward(tables.trade_edges(spark, sf_dir), lambda c: F.col(c) < 5, lambda c: F.col(c) >= 20)


@query(f"""WITH {HREFS}, u AS (SELECT href, regexp_extract(url, 'example.com/([a-z]+)/', 1) AS area, page_id FROM links JOIN
  pages USING (page_id)) SELECT href AS node, min(area) AS area, count(DISTINCT page_id) AS n_users FROM u GROUP BY
  href HAVING min(area) = max(area)""")
def boundary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that only pages of one area (the language in their address) use."""
    users = tables.page_links(spark, sf_dir).select(F.col("page_id").cast("string").alias("src"), F.col("href").alias("dst"))
    areas = tables.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("node"), F.regexp_extract("url", "example.com/([a-z]+)/", 1).alias("area"))
    return graph.boundary_candidates(users, areas)


@query("""SELECT l_partkey AS node, min(l_orderkey) AS user FROM lineitem WHERE l_quantity >= 50 AND l_partkey <> l_orderkey
  GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) = 1""")
def single_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that exactly one order takes in a large quantity."""
    l = tables.table(spark, sf_dir, "lineitem").where("l_quantity >= 50")
    return graph.single_use(l.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("""SELECT c_custkey AS node FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND
  o_totalprice > 300000 AND o_custkey <> o_orderkey)""")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no large order enters."""
    nodes = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    edges = tables.table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return graph.orphans(nodes, edges)


#: Orders in the order of customer and key within blocks of 100 customers.
ORDER_CHAIN = """o AS (SELECT o_orderkey AS node, o_custkey // 100 AS block, o_custkey % 100 >= 50 AS late,
  row_number() OVER (PARTITION BY o_custkey // 100 ORDER BY o_custkey, o_orderkey) AS place FROM orders)"""


def _order_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src -> dst: each order and the next one of its customer, or the first one of the next customer of its block; the
    last one leads back to the block's first order of a customer of its second half. Paths are as long as a block."""
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("cust"))
    own = o.select(F.col("node").alias("src"), F.lead("node").over(Window.partitionBy("cust").orderBy("node")).alias("dst")).where("dst IS NOT NULL")
    ends = o.groupBy("cust").agg(F.min("node").alias("first"), F.max("node").alias("last")).withColumn("block", F.floor(F.col("cust") / 100))
    near = ends.select(F.col("last").alias("src"), F.lead("first").over(Window.partitionBy("block").orderBy("cust")).alias("dst")).where("dst IS NOT NULL")
    late = F.col("cust") % 100 >= 50
    back = ends.groupBy("block").agg(F.max_by("last", "cust").alias("src"), F.min_by("first", F.when(late, F.col("cust"))).alias("dst"), F.count_if(late).alias("n"))
    return own.union(near).union(back.where("n > 0").select("src", "dst"))


@query(f"WITH {ORDER_CHAIN} SELECT node, CAST(place - 1 AS INTEGER) AS depth FROM o")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their distance from the first one of their block, along paths of a thousand orders (114)."""
    o = tables.table(spark, sf_dir, "orders")
    first = o.groupBy(F.floor(F.col("o_custkey") / 100)).agg(F.min_by("o_orderkey", F.struct("o_custkey", "o_orderkey")).alias("node"))
    return graph.reachable(_order_chain(spark, sf_dir), first.select("node"))


@query(f"""WITH {ORDER_CHAIN}, g AS (SELECT node, min(node) OVER w AS root, count(*) OVER w AS n FROM o WHERE late
  WINDOW w AS (PARTITION BY block)) SELECT node, root FROM g WHERE n > 1""")
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles: strongly connected groups of at least two orders; each is one long cycle behind a long path (86)."""
    return graph.strongly_connected(_order_chain(spark, sf_dir))


@query(f"""WITH {ORDER_CHAIN}, g AS (SELECT node, min(node) OVER w AS root, count(*) OVER w AS n FROM o WINDOW w AS (PARTITION
  BY block)) SELECT node, root FROM g WHERE n > 1""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected groups of at least two orders."""
    links = _order_chain(spark, sf_dir).where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return graph.connected_components(links)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_quantity >= 50 AND l_discount = 0 AND c_nationkey <> s_nationkey),
 r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
 SELECT x.a AS node, min(x.b) AS root FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1""")
def trade_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected nations of a thin trade graph."""
    l = tables.table(spark, sf_dir, "lineitem").where("l_quantity >= 50 AND l_discount = 0")
    o, c, s = (tables.table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    e = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == c["c_custkey"]).join(s, F.col("l_suppkey") == s["s_suppkey"])
    e = e.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))
    return graph.strongly_connected(e)


SALES = """e AS (SELECT DISTINCT o_custkey AS a, 1000000 + l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 50 AND l_discount = 0)"""


@query(f"""WITH RECURSIVE {SALES}, both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM r JOIN both_ways x ON x.a = r.b) SELECT a AS node, least(min(b), a) AS root FROM r GROUP BY a""")
def sale_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers joined by large sales without discount, with the smallest of each component (85, 114)."""
    l = tables.table(spark, sf_dir, "lineitem").where("l_quantity >= 50 AND l_discount = 0")
    sold = l.join(tables.table(spark, sf_dir, "orders"), l["l_orderkey"] == F.col("o_orderkey"))
    return graph.connected_components(sold.select(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 1_000_000).alias("b")).distinct())


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_quantity >= 50 AND l_discount = 0 AND c_nationkey <> s_nationkey),
 r(node, depth) AS (SELECT 0, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 30) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def trade_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that sales of a thin trade graph reach from nation 0, with the number of steps (114)."""
    l = tables.table(spark, sf_dir, "lineitem").where("l_quantity >= 50 AND l_discount = 0")
    o, c, s = (tables.table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    e = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == c["c_custkey"]).join(s, F.col("l_suppkey") == s["s_suppkey"])
    edges = e.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))
    return graph.reachable(edges, spark.createDataFrame([(0,)], "node int"))


@query(f"""WITH {HREFS}, w AS (SELECT DISTINCT page_id, href FROM links), used AS (SELECT DISTINCT page_id,
  unnest(regexp_extract_all(html, '>([A-Za-z,.]+)</a>', 1)) AS word FROM pages), f AS (SELECT coalesce(w.page_id,
  u.page_id) AS page_id, coalesce(substr(w.href, 2), u.word) AS key, w.href IS NOT NULL AS written, u.word IS NOT
  NULL AS read FROM w FULL JOIN used u ON w.page_id = u.page_id AND substr(w.href, 2) = u.word) SELECT page_id, key,
  written, read FROM f WHERE NOT (written AND read)""")
def one_sided_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys written but not read, or read but not written, in one scope (128): hrefs against link texts."""
    pages = tables.table(spark, sf_dir, "pages")
    wrote = tables.page_links(spark, sf_dir).distinct().select("page_id", F.expr("substring(href, 2)").alias("key"), F.lit(True).alias("written"))
    read = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(">([A-Za-z,.]+)</a>"), 1)).alias("key")).distinct().withColumn("read", F.lit(True))
    both = wrote.join(read, ["page_id", "key"], "full").select("page_id", "key", F.coalesce("written", F.lit(False)).alias("written"), F.coalesce("read", F.lit(False)).alias("read"))
    return both.where("NOT (written AND read)")


@query("""SELECT p_name AS name, p_size AS value, count(DISTINCT p_brand) AS n_files FROM part GROUP BY ALL HAVING
  count(DISTINCT p_brand) > 1""")
def duplicate_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same (name, value) in several files (129): part names and sizes over brands."""
    part = tables.table(spark, sf_dir, "part")
    return part.groupBy(F.col("p_name").alias("name"), F.col("p_size").alias("value")).agg(F.count_distinct("p_brand").alias("n_files")).where("n_files > 1")


@query("""SELECT p_name AS name, count(*) AS n, count(DISTINCT p_brand) AS n_files, count(DISTINCT p_type) AS n_signatures,
  count(DISTINCT p_size) AS n_returns FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 3 AND
  (count(DISTINCT p_type) >= 2 OR count(DISTINCT p_size) >= 2)""")
def signature_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in at least three files with at least two signatures or return kinds (101)."""
    part = tables.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name"))
    found = part.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("n_files"), F.count_distinct("p_type").alias("n_signatures"), F.count_distinct("p_size").alias("n_returns"))
    return found.where("n_files >= 3 AND (n_signatures >= 2 OR n_returns >= 2)")
