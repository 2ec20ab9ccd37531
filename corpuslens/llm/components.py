"""Connected components of a table of links, in rounds of large-star and small-star steps.

Each round replaces links by links to the smallest neighbour until only stars are left (Kiveris and others,
2014); the number of rounds grows with the logarithm of the longest path. Every step aggregates its minimum
before the shuffle, and each round is written as a table, so the lineage stays short; that of the round before goes.
Nothing but two counts a round comes to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import remove_path, stored, tidied


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the smallest node it reaches within these links."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def contracted(links: DataFrame) -> DataFrame:
    """The same components with fewer, shorter paths: each task's links become stars. u > v in every row."""

    def run(batches):
        for batch in batches:
            u, v = _stars(batch.column("u").to_numpy(), batch.column("v").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def components(links: DataFrame, most_rounds: int = 50, paths: list | None = None) -> DataFrame:
    """node, root (smallest node reachable) for every node of links(u, v) that is not its own root.

    Links from a node to itself are ignored; an empty table gives an empty result. ``paths`` gets the place of the
    table that the result reads.
    """
    spark, used = links.sparkSession, []
    now = stored(contracted(links.where("u <> v")).distinct(), "links", used)
    before = None
    for _ in range(most_rounds):
        # large star: each larger neighbour of a node goes to the node's smallest neighbour (or the node)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each smaller neighbour, and the node itself, go to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(contracted(small.union(least.select("u", F.col("m").alias("v")))).distinct(), "links", used)
        remove_path(spark, used.pop(0))
        # done when the links are stars and stayed the same
        with tidied(spark):
            state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum(F.xxhash64("u", "v") % (1 << 30)).alias("x")).first()
        if state == before:
            if paths is not None:
                paths += used
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError("the components did not settle")
