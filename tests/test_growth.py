"""Steps whose cost must follow the input: plans without broadcasts of made files, classes of equal rows, tasks by rows."""

from pyspark.sql import functions as F

from corpuslens.operators import blocks, code_rules, crates, graph, review
from corpuslens.sources import made


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _files(spark):
    return spark.range(50).select(F.concat(F.lit("a/f"), "id").alias("path"), F.lit("python").alias("lang"), F.lit("import os\nfn a {\n b { c }\n}\n").alias("text"))


def test_braces_take_one_shuffle_and_no_join(spark):
    plan = _plan(blocks.drop_hazards(blocks.brace_blocks(_files(spark))))
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_joins_of_files_are_never_broadcast(spark):
    files = _files(spark)
    units = blocks.indent_units(files)
    edges = code_rules.import_edges(files)
    for found in (
        edges, code_rules.finalised(edges, files.select(F.col("path").alias("node"))), code_rules.deprecated(files), code_rules.unused_enums(files), code_rules.uncalled(files),
        crates.dead_exports(files), blocks.mutated_globals(files, units), blocks.unit_calls(units),
    ):
        assert "Join" in _plan(found) and "Broadcast" not in _plan(found)


def test_made_files_are_dealt_to_tasks_by_rows(spark):
    rows = spark.range(0, 5 * made.ROWS_A_TASK + 1, 1, 1)
    assert made.spread(rows, "id").rdd.getNumPartitions() == 6


def test_equal_issues_are_one_class(spark, monkeypatch):
    met, links = [], review.similar_links
    monkeypatch.setattr(review, "similar_links", lambda issues, least: met.append(issues.count()) or links(issues, least))
    rows = [(i, "d", None, "big red ring") for i in range(40)] + [(100, "d", None, "big red ring of size"), (101, "e", None, "big red ring"), (102, "d", None, ""), (103, "d", None, "")]
    found = review.merged_groups(spark.createDataFrame(rows, "issue_id long, dimension string, identifier string, summary string"))
    assert dict(map(tuple, found.collect())) == {**dict.fromkeys(range(40), 0), 100: 0, 101: 101, 102: 102, 103: 103}
    assert met == [3]


def test_chains_are_contracted(spark, monkeypatch):
    """A chain of 60 into a cycle of 30, whose rounds shrink; components and depths by the same rounds."""
    monkeypatch.setattr(graph, "FEW_EDGES", 12)
    edges = spark.createDataFrame([(i, i + 1) for i in range(89)] + [(89, 60)], "src int, dst int").coalesce(1)
    rounds = []
    assert {tuple(r) for r in graph.strongly_connected(edges, rounds).collect()} == {(i, 60) for i in range(60, 90)}
    assert "contract" in rounds
    found = graph.reachable(edges, spark.createDataFrame([(0,), (70,)], "node int"), rounds := [])
    assert {tuple(r) for r in found.collect()} == {(i, min(i, (i - 70) % 30) if i >= 60 else i) for i in range(90)}
    assert "contract" in rounds
