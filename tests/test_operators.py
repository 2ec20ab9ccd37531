"""Operators that SQL does not check: near pairs, graphs on random edges, hashes, the streaming state machine."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import duplicates, graph, merge, queue, review
from corpuslens.plans import registry


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, f"s/en/{i}.txt") for i, t in enumerate(texts)], "doc_id long, text string, path string")


def test_near_pairs_equal_brute_force(spark):
    rng, base = random.Random(3), [f"line {i}" for i in range(60)]
    texts = [None, "", "\n\n", "one line"]
    for _ in range(30):
        rows = rng.sample(base, rng.randint(15, 40))
        texts.append("\n".join(rows))
        for _ in range(2):
            changed = list(rows)
            for _ in range(rng.randint(0, 4)):
                changed[rng.randrange(len(changed))] = rng.choice([*base, "x"])
            texts.append("\n".join(changed))
    units = {i: [x.strip(" ") for x in (t or "").split("\n") if x.strip(" ")] for i, t in enumerate(texts)}
    first = {}
    for i, u in units.items():
        if texts[i] is not None:
            first.setdefault(tuple(u), i)
    kept = sorted(first.values())
    expected = set()
    for a in kept:
        for b in kept:
            x, y = units[a], units[b]
            if a < b and min(len(x), len(y)) >= 15 and max(len(x), len(y)) <= 1.5 * min(len(x), len(y)):
                if difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.9:
                    expected.add((a, b))
    found = {(r.doc_a, r.doc_b) for r in duplicates.near_pairs(docs_of(spark, texts)).collect()}
    assert expected and found == expected


def test_lines_are_trimmed_of_blanks_only(spark):
    texts = ["a\nb 1", "a\nb 11", "  a\nc", "a\nc", "0abc0\n  x  \n22 z2\n   ", "10\n21\n32\n43\n", "a\n\n  c  "] + [f"l{i}\nm{i}" for i in range(200)]
    plain = [[x.strip(" ") for x in t.split("\n") if x.strip(" ")] for t in texts]
    docs = docs_of(spark, texts)
    assert [r.kept for r in duplicates.units(docs).orderBy("doc_id").collect()] == plain
    first = {}
    expected = {(first.setdefault(tuple(u), i), i) for i, u in enumerate(plain)}
    assert {tuple(r) for r in duplicates.exact_links(docs).collect()} == {(a, b) for a, b in expected if a != b} == {(2, 3), (2, 6)}


def _alike(x, y):
    x, y = sorted((x, y), key=len)
    return difflib.SequenceMatcher(None, x, y, autojunk=len(x) >= 80).ratio() >= 0.9


def _components(nodes, links):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return {n: r for n, r in root.items() if sum(x == r for x in root.values()) > 1}


def test_near_clusters_of_templates(spark):
    """A template of many texts, and texts of common lines only, give the components of all pairs with far fewer links."""
    rng = random.Random(6)
    form, common = [f"field {i}:" for i in range(40)], [f"common {i}" for i in range(22)]
    texts = ["\n".join([*form[:20], f"name {i}", *form[20:]]) for i in range(120)]
    texts += ["\n".join(rng.sample(common, rng.randint(15, 22))) for _ in range(40)]
    texts += ["\n".join([*(f"own {i} {j}" for j in range(150)), *(["rule"] * 90 if i % 2 else ["other"] * 60)]) for i in range(4)]
    units = [t.split("\n") for t in texts]
    pairs = [(a, b) for a in range(len(units)) for b in range(a + 1, len(units)) if max(len(units[a]), len(units[b])) <= 1.5 * min(len(units[a]), len(units[b])) and _alike(units[a], units[b])]
    links = duplicates.near_links(docs_of(spark, texts))
    found = {r.node: r.root for r in duplicates.clusters(links).collect()}
    assert found == _components(range(len(units)), pairs) and len(pairs) > 7000 and links.count() < 1500


def test_junk_lines_of_long_units(spark):
    a = [f"line {i}" for i in range(150)] + ["}"] * 150
    b = ["}"] * 150 + [f"line {i}" for i in range(150)]
    rows = spark.createDataFrame([(1, 2, a, b), (3, 4, a[:79], a[:79] + ["x"])], "doc_a long, doc_b long, lines_a array<string>, lines_b array<string>")
    found = {r.doc_a: r.ratio for r in duplicates.sequence_ratio(rows).collect()}
    assert found[1] == difflib.SequenceMatcher(None, a, b, autojunk=True).ratio() and found[3] == 158 / 159


def _brute_scc(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    groups = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    return {(n, r) for n, r in groups.items() if sum(x == r for x in groups.values()) > 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_strongly_connected_groups(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(18)]
    found = graph.strongly_connected(spark.createDataFrame(edges, "src int, dst int"))
    assert {tuple(r) for r in found.collect()} == _brute_scc([e for e in edges if e[0] != e[1]])


def test_graphs_without_edges(spark):
    none = spark.createDataFrame([], "src int, dst int")
    assert graph.strongly_connected(none).count() == 0
    assert graph.degrees(none).count() == 0
    assert graph.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0
    seeds = spark.createDataFrame([(1,)], "node int")
    assert graph.reachable(none, seeds).collect() == [(1, 0)]


def test_snapshot_hash_ignores_order_and_repeats(spark):
    ids = [("a",), ("b",), ("c",)]
    one = merge.snapshot_hash(spark.createDataFrame(ids, "finding_id string")).first()[0]
    other = merge.snapshot_hash(spark.createDataFrame([*reversed(ids), ("a",)], "finding_id string")).first()[0]
    less = merge.snapshot_hash(spark.createDataFrame(ids[:2], "finding_id string")).first()[0]
    empty = merge.snapshot_hash(spark.createDataFrame([], "finding_id string")).first()[0]
    assert one == other != less and len(one) == 16 and empty == ""


def test_merge_is_idempotent(spark):
    current = spark.createDataFrame([("a",), ("b",)], "finding_id string")
    existing = spark.createDataFrame([("a", "fixed", 1), ("c", "open", 0)], "finding_id string, status string, reopen_count int")
    none = F.lit(False)
    once = merge.upsert(existing, current, none, "2024-01-01")
    assert {(r.finding_id, r.action, r.status, r.reopen_count) for r in once.collect()} == {("a", "reopened", "open", 2), ("b", "new", "open", 0), ("c", "absent", "open", 0)}
    twice = merge.upsert(once.select("finding_id", "status", "reopen_count"), current, none, "2024-01-02")
    assert {(r.finding_id, r.action, r.reopen_count) for r in twice.collect()} == {("a", "refreshed", 2), ("b", "refreshed", 0), ("c", "absent", 0)}


def test_placeholders(spark):
    values = ["changeme", "your-key-here", "${KEY}", "short", "token_usage", "has a space", "redis://host", "24be64439e3e49cf46b2d7c90f3602a3", "Abcdefgh1"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(T.is_placeholder(F.col("v")).alias("p")).collect()
    assert [r.p for r in rows] == [True] * 7 + [False] * 2


def test_snippet_and_lines(spark):
    df = spark.createDataFrame([("a\nb\nc\n",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(T.line_count(F.col("text"))).collect()] == [3, 0, 0]
    assert df.limit(1).select(T.snippet(F.col("text"), F.lit(1), 1)).first()[0] == "a\nb"
    assert df.limit(1).select(T.snippet(F.col("text"), F.lit(9), 1)).first()[0] is None


def test_state_machine_equals_a_loop(spark, sf):
    expected = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").collect():
        status, n = expected.get(r.user_id, ("new", 0))
        if r.event_type == "error":
            n, status = n + (status == "resolved"), "open"
        elif r.event_type == "purchase" and status == "open":
            status = "resolved"
        expected[r.user_id] = (status, n)
    found = registry.queries()["finding_state_machine"](spark, sf).collect()
    assert {r.user_id: (r.status, r.reopened) for r in found} == expected


def test_clusters_join_exact_and_near(spark, sf):
    rows = registry.queries()["near_dup_clusters"](spark, sf).collect()
    assert all(r.root <= r.node and r.size >= 2 for r in rows)


def test_review_without_issues(spark):
    none = spark.createDataFrame([], "issue_id long, dimension string, identifier string, summary string")
    assert review.merged_groups(none).count() == 0
    order = spark.createDataFrame([(["a"],)], "queue_order array<string>")
    assert queue.moved(order, ["zz"], "top").first()[0] == ["a"]
