"""Graphs that need more than 50 rounds by single edges."""

import random

from pyspark.sql import functions as F

from corpuslens.operators import graph


def _chain_and_cycle(chain, cycle):
    """0 -> 1 -> ... -> chain, which leads into a cycle of so many nodes."""
    return [(i, i + 1) for i in range(chain)] + [(chain + i, chain + (i + 1) % cycle) for i in range(cycle)]


def test_reachable_past_fifty_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(55)], "src int, dst int").coalesce(1)
    found = graph.reachable(edges, spark.createDataFrame([(0,)], "node int"))
    assert {(r.node, r.depth) for r in found.collect()} == {(i, i) for i in range(56)}


def test_long_cycle_behind_a_long_chain(spark):
    edges = spark.createDataFrame(_chain_and_cycle(52, 53), "src int, dst int").coalesce(1)
    assert {tuple(r) for r in graph.strongly_connected(edges).collect()} == {(52 + i, 52) for i in range(53)}


def test_rounds_follow_the_logarithm(spark):
    edges = spark.createDataFrame(_chain_and_cycle(500, 300), "src int, dst int").coalesce(1)
    rounds = []
    assert {tuple(r) for r in graph.strongly_connected(edges, rounds).collect()} == {(500 + i, 500) for i in range(300)}
    assert len(rounds) <= 30, rounds
    rounds = []
    found = graph.reachable(edges, spark.createDataFrame([(0,)], "node int"), rounds)
    assert {(r.node, r.depth) for r in found.collect()} == {(i, i) for i in range(800)}
    assert len(rounds) <= 30, rounds


def _groups(edges):
    """Strongly connected groups of at least two nodes, by reach from each node."""
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    reach = {}
    for a in {n for e in edges for n in e}:
        seen, todo = set(), [a]
        while todo:
            for b in ahead.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[a] = seen
    return {(a, min(group)) for a in reach if len(group := {b for b in reach[a] if a in reach[b]} | {a}) > 1}


def test_random_graphs(spark):
    rng = random.Random(7)
    for n, m in ((40, 44), (60, 66), (50, 90)):
        # ladders, cycles in chains and random edges, with names in no order
        names = rng.sample(range(1000), n)
        edges = [(names[i], names[i + 1]) for i in range(n - 1) if i % 9] + [(names[i], names[i - 7]) for i in range(10, n, 13)]
        edges += [(rng.choice(names), rng.choice(names)) for _ in range(m - n)]
        frame = spark.createDataFrame(edges, "src int, dst int").coalesce(1)
        assert {tuple(r) for r in graph.strongly_connected(frame).collect()} == _groups([e for e in edges if e[0] != e[1]])
        depth, frontier, steps = {names[0]: 0}, [names[0]], 0
        while frontier:
            steps += 1
            frontier = sorted({b for a, b in edges if a in frontier} - depth.keys())
            depth |= dict.fromkeys(frontier, steps)
        found = graph.reachable(frame, spark.createDataFrame([(names[0],)], "node int"))
        assert {(r.node, r.depth) for r in found.collect()} == set(depth.items())


def test_fixed_graph(spark):
    """Two cycles joined by a bridge, a self loop, a tail and a part on its own."""
    fixed = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (6, 7), (7, 8), (8, 8), (9, 10), (10, 9), (11, 12), (1, 2)]
    edges = spark.createDataFrame(fixed, "src int, dst int").coalesce(1)
    assert {tuple(r) for r in graph.strongly_connected(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (9, 9), (10, 9)}
    found = graph.reachable(edges, spark.createDataFrame([(1,)], "node int")).collect()
    assert {(r.node, r.depth) for r in found} == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6), (8, 7)}
    links = edges.selectExpr("src AS a", "dst AS b")
    assert {tuple(r) for r in graph.connected_components(links).collect()} == {*((i, 1) for i in range(1, 9)), (9, 9), (10, 9), (11, 11), (12, 11)}
    assert graph.strongly_connected(edges.where("src > 90")).count() == 0 and graph.reachable(edges, spark.createDataFrame([], "node int")).count() == 0


def test_few_links_are_joined_in_one_task(spark, monkeypatch):
    """Components by the rounds and at once agree, also of texts; few links take no rounds."""
    rng = random.Random(9)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(300)] + [(7, 7), (5000, 5000)]
    df = spark.createDataFrame(links, "a long, b long")
    drawn = []
    monkeypatch.setattr(graph, "_draw", lambda node, time: drawn.append(time) or F.xxhash64(node, F.lit(time)))
    at_once = {tuple(r) for r in graph.connected_components(df).collect()}
    assert not drawn
    names = df.select(*[F.format_string("n%06d", c).alias(c) for c in "ab"])
    assert {(int(n[1:]), int(r[1:])) for n, r in graph.connected_components(names).collect()} == at_once
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    assert {tuple(r) for r in graph.connected_components(df).collect()} == at_once and drawn


def test_stars_take_few_rounds(spark, monkeypatch):
    """Nodes that are linked with a few hubs: a round joins a share of them, not one a hub."""
    monkeypatch.setattr(graph, "FEW_EDGES", 100)
    rounds, draw = set(), graph._draw
    monkeypatch.setattr(graph, "_draw", lambda node, time: _counted(rounds, time) or draw(node, time))
    links = spark.createDataFrame([(i, 10_000 + (i * 7 + k) % 9) for i in range(1_200) for k in range(2)], "a long, b long").coalesce(2)
    found = {r.root for r in graph.connected_components(links).collect()}
    assert found == {0} and len(rounds) < 25


def _counted(rounds, time):
    rounds.add(time)
    assert time < 25, "the rounds do not end"
