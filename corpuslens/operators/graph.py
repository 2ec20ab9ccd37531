"""Graph operators over edge tables: degrees, coupling, reachability, components and cycles.

Iterations are DataFrame loops. Each round is written as a table (below spark.checkpoint.dir), so lineage stays short
and a lost executor costs one round.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: With this set, a query's shuffle files go when it ends: a table that is written does not need them any more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is not set, a folder of this machine, but in local mode only."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (root or os.path.join(tempfile.gettempdir(), "corpuslens-checkpoints")).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, removed when the JVM ends."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def checkpointed(df: DataFrame, paths: list | None = None) -> DataFrame:
    """df computed once into a table in the shared checkpoint folder: the lineage ends there, and so do the constraints
    that the optimizer would carry from round to round. ``paths`` gets the place of the table, for ``freed``."""
    spark = df.sparkSession
    path, before = scratch_path(spark, "checkpoint"), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession, paths: list, keep: int = 0) -> None:
    """Remove the tables at all but the last ``keep`` of the paths: nothing reads them any more."""
    while len(paths) > keep:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop(0))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def degrees(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out over distinct neighbours; self loops and repeats count once at most."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))
    out = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))
    return into.join(out, "node", "full").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def instability(degree: DataFrame) -> DataFrame:
    """fan_out over all neighbours' links; 0 without any."""
    return degree.withColumn("instability", F.coalesce(F.try_divide("fan_out", F.col("fan_in") + F.col("fan_out")), F.lit(0.0)))


def cross_area(edges: DataFrame, area_of: DataFrame) -> DataFrame:
    """Edges between different areas; area_of has node and area."""
    a, b = (area_of.select(F.col("node").alias(n), F.col("area").alias(f"{n}_area")) for n in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").where("src_area <> dst_area")


def backward(edges: DataFrame, protected, forbidden) -> DataFrame:
    """One row: violating (protected -> forbidden) and eligible (those and protected -> protected) edges."""
    bad = protected("src") & forbidden("dst")
    return edges.agg(F.count_if(bad).alias("violating"), F.count_if(bad | (protected("src") & protected("dst"))).alias("eligible"))


def boundary_candidates(edges: DataFrame, area_of: DataFrame) -> DataFrame:
    """Nodes all of whose users lie in one area: node, area, n_users."""
    users = edges.where("src <> dst").join(area_of.select(F.col("node").alias("src"), "area"), "src")
    return users.groupBy(F.col("dst").alias("node")).agg(F.min("area").alias("area"), F.max("area").alias("other"), F.count_distinct("src").alias("n_users")).where("area = other").drop("other")


def single_use(edges: DataFrame) -> DataFrame:
    """Nodes with exactly one user: node, user."""
    return edges.where("src <> dst").select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("user")).where("n = 1").drop("n")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge enters."""
    return nodes.join(edges.where("src <> dst").select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


#: Rounds by single edges before shortcuts are made: most graphs are done by then.
PLAIN_ROUNDS = 3
#: Shortcuts of a node at each length.
SHORTCUTS = 3


def shortcuts(edges: DataFrame, per_node: int = SHORTCUTS, rounds: list | None = None) -> DataFrame:
    """src, dst, hops: paths of doubled and doubled length, at most so many from each node at each length.

    A path of length 2^i is two of length 2^(i-1). With them a long path has as many steps as its length has binary
    digits; their number is that of the nodes times that of the lengths. They only speed rounds up: what is reached is
    decided by the edges, of which the rounds go on until nothing changes.
    """
    hops = F.col("hops") if "hops" in edges.columns else F.lit(1).cast("long").alias("hops")
    step = _some(edges.select("src", "dst", hops), per_node)
    n, length, found = edges.select("src").distinct().count(), 1, None
    while length < n:
        a, b = step.select("src", F.col("dst").alias("via"), "hops"), step.select(F.col("src").alias("via"), "dst", F.col("hops").alias("more"))
        longer = a.join(b, "via").where("src <> dst").groupBy("src", "dst").agg(F.min(F.col("hops") + F.col("more")).alias("hops"))
        step = checkpointed(_some(longer, per_node))
        _count(rounds, "shortcuts")
        if step.isEmpty():
            break
        found, length = step if found is None else found.union(step), length * 2
    return found if found is not None else step


def _some(edges: DataFrame, per_node: int) -> DataFrame:
    """At most so many of each node's edges, by a hash. The best ones are kept by partial sums, never a node's whole list."""
    lanes = [F.min(F.struct(F.xxhash64("dst", F.lit(i)).alias("h"), "dst", "hops")).alias(f"k{i}") for i in range(per_node)]
    kept = F.array_distinct(F.array(*[F.struct(F.col(f"k{i}.dst").alias("dst"), F.col(f"k{i}.hops").alias("hops")) for i in range(per_node)]))
    return edges.groupBy("src").agg(*lanes).select("src", F.explode(kept).alias("k")).select("src", "k.dst", "k.hops")


def _count(rounds: list | None, kind: str) -> None:
    if rounds is not None:
        rounds.append(kind)


#: Rounds of contraction stop when one takes fewer than one in so many edges.
FEWEST = 50
#: Edges from which on chains are contracted; fewer are done by the rounds on the whole graph.
FEW_EDGES = 100_000
#: Times as many links are joined in one task, which holds about 40 bytes a link.
TASK_LINKS = 10


def _draw(node: str, time: int):
    """A node's lot in a round."""
    return F.xxhash64(node, F.lit(time))


def _stays(node: str, time: int):
    """Is a node one of the two in five that others join in a round?"""
    return F.pmod(F.xxhash64(node, F.lit(time), F.lit("stays")), F.lit(5)) < 2


def _folded(edges: DataFrame, time: int, fixed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Nodes that one edge enters and one leaves (without ``fixed`` nodes: or none leaves), none beside another, as
    (node, u, w, hops, more): u -> node -> w; and edges(src, dst, hops) with one edge for the two of each."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("u"), F.min("hops").alias("hops"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("w"), F.min("hops").alias("more"))
    single = into.where("n_in = 1").join(out.hint("merge"), "node", "inner" if fixed is None else "left").where("n_out = 1 OR n_out IS NULL")
    least = (_draw("node", time) < _draw("u", time)) & (F.col("w").isNull() | (_draw("node", time) < _draw("w", time)))
    taken = single.where(least).select("node", "u", "w", "hops", "more")
    if fixed is not None:
        taken = taken.join(fixed.select("node").hint("merge"), "node", "left_anti")
    taken = checkpointed(taken)
    gone = taken.select("node").hint("merge")
    kept = edges.join(gone.withColumnRenamed("node", "src").hint("merge"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_anti").select("src", "dst", "hops")
    passed = taken.where("w IS NOT NULL AND u <> w").select(F.col("u").alias("src"), F.col("w").alias("dst"), (F.col("hops") + F.col("more")).alias("hops"))
    return taken, kept.union(passed).groupBy("src", "dst").agg(F.min("hops").alias("hops"))


def contracted(edges: DataFrame, rounds: list | None = None, fixed: DataFrame | None = None) -> tuple[list[DataFrame], DataFrame]:
    """The nodes that rounds of ``_folded`` take, round by round, and the edges(src, dst, hops) that they leave.

    About a third of a chain's nodes goes in each round, so all rounds together cost a few times the edges, however
    long the chains are. With ``fixed`` nodes (the seeds) these stay.
    """
    now, levels, paths, time, n = edges, [], [], 0, edges.count()
    while n > FEW_EDGES:
        taken, less = _folded(now, time, fixed)
        _count(rounds, "contract")
        many = taken.count()
        if not many:
            break
        levels.append(taken)
        now = checkpointed(less, paths)
        if fixed is None:
            now = trimmed(now, rounds=None, paths=paths)
        freed(edges.sparkSession, paths, 1)
        if many * FEWEST < n:
            break
        n, time = now.count(), time + 1
    return levels, now


def reachable(edges: DataFrame, seeds: DataFrame, rounds: list | None = None) -> DataFrame:
    """node and depth (edges from the nearest seed); seeds have depth 0. ``rounds`` gets an entry for each round.

    Chains are contracted first, and their nodes get their depths from those before them in the end. On what is left,
    after a few rounds of single edges, shortcuts take part, so the rounds follow the logarithm of the longest path.
    Depths only fall, and only nodes whose depth fell go on, until none does: so they are exact.
    """
    start = checkpointed(seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("long")))
    whole = checkpointed(edges.where("src <> dst").select("src", "dst").distinct().withColumn("hops", F.lit(1).cast("long")))
    levels, left = contracted(whole, rounds, start)
    depth = start if left.isEmpty() else _depths(left, start, rounds)
    for taken in reversed(levels):
        before = depth.select(F.col("node").alias("u"), F.col("depth").alias("before"))
        added = taken.select("node", "u", "hops").join(before.hint("merge"), "u").select("node", (F.col("before") + F.col("hops")).alias("depth"))
        depth = depth.union(checkpointed(added))
    return depth.withColumn("depth", F.col("depth").cast("int"))


def _depths(e: DataFrame, seeds: DataFrame, rounds: list | None) -> DataFrame:
    """node and depth of what seeds(node, depth) reach by e(src, dst, hops)."""
    spark, paths, steps, depth = e.sparkSession, [], e, seeds
    changed, done = depth, 0
    while True:
        _count(rounds, "reach")
        offer = changed.join(steps.hint("merge"), changed["node"] == steps["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("hops")).alias("offer"))
        now = checkpointed(depth.join(offer.hint("merge"), "node", "full").select("node", F.least("depth", "offer").alias("depth"), (F.col("depth").isNull() | (F.col("offer") < F.col("depth"))).alias("fell")), paths)
        freed(spark, paths, 1)
        changed = now.where("fell").select("node", "depth")
        depth, done = now.select("node", "depth"), done + 1
        if changed.isEmpty():
            return depth
        if done == PLAIN_ROUNDS:
            steps = checkpointed(steps.union(shortcuts(e, rounds=rounds)).groupBy("src", "dst").agg(F.min("hops").alias("hops")))
            changed = depth  # what is known takes the shortcuts too


def _joined_at_once(links: DataFrame) -> DataFrame:
    """node and to (one node of its component) of few links(u, v), in one task; the nodes that others join have no row."""
    kind = links.schema["u"].dataType.simpleString()

    def run(batches):
        found = [(b.column("u").to_numpy(zero_copy_only=False), b.column("v").to_numpy(zero_copy_only=False)) for b in batches]
        if not found:
            return
        u, v = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
        while True:
            # a root takes the least root that it is linked with, then paths to roots are cut short
            low, here, there = label.copy(), label[a], label[b]
            np.minimum.at(low, np.maximum(here, there), np.minimum(here, there))
            while (low[low] != low).any():
                low = low[low]
            if (low == label).all():
                break
            label = low
        other = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_pydict({"node": nodes[other], "to": nodes[label[other]]})

    return links.select("u", "v").repartition(1).mapInArrow(run, f"node {kind}, to {kind}")


def connected_components(links: DataFrame) -> DataFrame:
    """node and root (smallest node of its component) of links(a, b), also of nodes that are linked with themselves only.

    In each round a lot decides which nodes stay. The others join a neighbour that stays, if they have one: a quarter of
    them all or more, in chains as in stars of any size. Links go on between what is left, so all rounds together cost a few times the links. At most
    TASK_LINKS * FEW_EDGES links, whatever their number was, are joined in one task. In the end the nodes get their roots from those that they joined, from the last round to the first.
    """
    spark, paths, levels, time = links.sparkSession, [], [], 0
    nodes = checkpointed(links.select(F.col("a").alias("node")).union(links.select("b")).distinct())
    now = checkpointed(links.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), paths)
    while left := now.count():
        if left <= TASK_LINKS * FEW_EDGES:
            levels.append(checkpointed(_joined_at_once(now)))
            freed(spark, paths)
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).where(~_stays("u", time) & _stays("v", time))
        joined = checkpointed(both.groupBy("u").agg(F.min(F.struct(_draw("v", time), "v")).alias("m")).select(F.col("u").alias("node"), F.col("m.v").alias("to")))
        levels.append(joined)
        u, v = (joined.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")).hint("merge") for c in ("u", "v"))
        moved = now.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("u_to", "u").alias("a"), F.coalesce("v_to", "v").alias("b"))
        now = checkpointed(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), paths)
        freed(spark, paths, 1)
        time += 1
    top = None
    for joined in reversed(levels):
        if top is None:
            top = joined.select("node", F.col("to").alias("top"))
            continue
        above = top.select(F.col("node").alias("to"), "top")
        top = top.union(checkpointed(joined.join(above.hint("merge"), "to", "left").select("node", F.coalesce("top", "to").alias("top"))))
    if top is None:
        return nodes.select("node", F.col("node").alias("root"))
    all_ = nodes.join(top.hint("merge"), "node", "left").select("node", F.coalesce("top", "node").alias("top"))
    least = all_.groupBy("top").agg(F.min("node").alias("root"))
    return all_.join(least.hint("merge"), "top").select("node", "root")


def trimmed(edges: DataFrame, most_rounds: int = 1, rounds: list | None = None, paths: list | None = None) -> DataFrame:
    """edges without those from nodes that no edge enters or to nodes that none leaves, so many times over."""
    for _ in range(most_rounds):
        entered, left = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = checkpointed(edges.join(entered.hint("merge"), "src", "left_semi").join(left.hint("merge"), "dst", "left_semi").select(*edges.columns), paths)
        _count(rounds, "trim")
    return edges


def strongly_connected(edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """node and root (smallest node) of the strongly connected groups of at least two nodes.

    Each node takes the least labels, in several random orders, of the nodes that reach it and of those that it reaches.
    Where both are the same node in the first order, this one is in a cycle with it: a group is found. Other nodes of
    one group have equal labels in all orders, so only edges between equal labels are left, and these start again. Chains
    into and out of cycles fall apart this way, without a round for each of their nodes. Labels spread by edges and,
    after a few rounds, by shortcuts; a shortcut between nodes of equal labels runs among such nodes only, so shortcuts
    are made once. Every time the least label of what is left is settled, so this ends.
    """
    whole = trimmed(checkpointed(edges.where("src <> dst").select("src", "dst").distinct().withColumn("hops", F.lit(1).cast("long"))), rounds=rounds)
    levels, left = contracted(whole, rounds)
    found = checkpointed(_groups(left.select("src", "dst"), rounds).where("node <> root"))
    for taken in reversed(levels):
        # a node of a chain is in the group of its neighbours if both are in one
        u, w = (found.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")).hint("merge") for c in ("u", "w"))
        ends = taken.select("node", "u", "w").join(u, "u", "left").join(w, "w", "left")
        added = ends.withColumn("root", F.coalesce("u_root", "u")).where(F.col("root") == F.coalesce("w_root", "w")).select("node", "root")
        found = found.union(checkpointed(added))
    if not levels:
        return found.union(found.select(F.col("root").alias("node"), "root").distinct())
    every = found.union(found.select(F.col("root").alias("node"), "root")).distinct()
    least = found.groupBy("root").agg(F.least(F.min("node"), F.first("root")).alias("least"))
    return every.join(least.hint("merge"), "root").select("node", F.col("least").alias("root"))


def _groups(left: DataFrame, rounds: list | None) -> DataFrame:
    """node and root of the groups of edges without chains: the rounds of labels."""
    groups, jumps, time = None, None, 0
    while not left.isEmpty():
        label, jumps = _labelled(left, jumps, time, rounds)
        found = checkpointed(label.where(F.col("f0.node") == F.col("b0.node")).select("node", F.col("f0.node").alias("root")))
        groups = found if groups is None else checkpointed(groups.union(found))
        rest = checkpointed(label.where(F.col("f0.node") != F.col("b0.node")))
        left = _inside(left, rest)
        if left.isEmpty():
            break
        left, jumps = trimmed(left, rounds=rounds), None if jumps is None else _inside(jumps, rest)
        time += 1
    if groups is None:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    size = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1")
    return groups.join(size, "root").select("node", F.col("least").alias("root"))


#: Random orders of nodes whose least labels spread at once.
ORDERS = 5


def _inside(edges: DataFrame, label: DataFrame) -> DataFrame:
    """The edges (src, dst) between nodes of equal labels."""
    a, b = (label.select(F.col("node").alias(n), F.struct(*label.columns[1:]).alias(f"{n}_label")) for n in ("src", "dst"))
    return checkpointed(edges.join(a, "src").join(b, "dst").where("src_label = dst_label").select("src", "dst"))


def _labelled(edges: DataFrame, jumps: DataFrame | None, time: int, rounds: list | None) -> tuple[DataFrame, DataFrame | None]:
    """node and f0.., b0..: the least labels of the nodes that reach a node and that it reaches, itself included; the
    shortcuts. Labels of the first order hold the node itself, those of the others are hashes: two nodes of one hash
    would only be told apart later."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    hashed = lambda i: F.xxhash64("node", F.lit(time * ORDERS + i))
    # the nodes' own order the first time: chains often follow it
    rank = F.lit(0).cast("long") if time == 0 else hashed(0)
    own = [F.struct(rank.alias("rank"), F.col("node")), *[hashed(i) for i in range(1, ORDERS)]]
    names = [f"{side}{i}" for side in "fb" for i in range(ORDERS)]
    label = checkpointed(nodes.select("node", *[c.alias(n) for n, c in zip(names, own * 2)], F.lit(True).alias("fell")))
    ways, done = edges if jumps is None else checkpointed(edges.union(jumps).distinct()), 0
    while True:
        _count(rounds, "labels")
        now = label.where("fell")

        def sent(side: str, at: str, to: str) -> DataFrame:
            kept = [F.col(n) if n[0] == side else F.lit(None).cast(label.schema[n].dataType).alias(n) for n in names]
            return now.join(ways, now["node"] == ways[at]).select(F.col(to).alias("node"), *kept)

        offers = sent("f", "src", "dst").union(sent("b", "dst", "src")).groupBy("node").agg(*[F.min(n).alias(f"{n}_offer") for n in names])
        merged = label.drop("fell").join(offers, "node", "left")
        fell = F.lit(False)
        for n in names:
            fell = fell | F.coalesce(F.col(f"{n}_offer") < F.col(n), F.lit(False))
        label = checkpointed(merged.select("node", *[F.least(n, f"{n}_offer").alias(n) for n in names], fell.alias("fell")))
        done += 1
        if label.where("fell").isEmpty():
            return label.drop("fell"), jumps
        if done == PLAIN_ROUNDS and jumps is None:
            jumps = checkpointed(shortcuts(edges, rounds=rounds).select("src", "dst"))
            ways = checkpointed(edges.union(jumps).distinct())
            label = label.withColumn("fell", F.lit(True))
