"""Centroid clustering by sort-means over whole numbers.

Each round orders, for each centroid, the other centroids by their distance from it. A vector starts at the centroid
it was assigned to and looks at the others in that order; it stops strictly beyond twice its distance from the first
one, as no centroid from there on can be as near (with equality one could tie, and ties go to the smaller number).
All arithmetic is exact, on 64-bit integers; squared distances are compared, so twice a distance is a factor of four.

Vectors are read once into a table of integers; a round is one pass over it that writes each vector's new number
beside it. Sums and counts of a centroid are added up in each task and then over the tasks; at the driver are the
k centroids only, whose size is fixed by k and the number of components.

Kept: vectors with exactly the given number of components, none null, NaN or infinite, and none beyond ``LIMIT`` after
scaling (a squared distance then still fits 64 bits). A null vector is none. Equal vectors and repeated ids are rows of
their own; a null id is kept and cannot be a seed before others. Fewer vectors than k give fewer centroids, an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import drop_held, stored

CENTROIDS, ROUNDS, COMPONENTS, SCALE, SEED = 16, 3, 64, 64, 1
LIMIT = 1 << 27
#: Vectors that a task handles at once.
BLOCK = 4_096
ASSIGNED = "vec_id long, v array<long>, cluster int, distance long"


def integer_vectors(table: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component x, of the vectors that are kept."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LIMIT / scale))
    kept = table.where((F.size("embedding") == components) & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<long>").alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors of smallest sha256 of ``seed:vec_id``, in that order (equal ids: smaller vector first)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a from the vector b."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def neighbour_order(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid, the others in order of distance from it (then number), and these squared distances."""
    k = len(centroids)
    between = np.stack([squared(centroids, c) for c in centroids])
    order = np.stack([[j for j in np.lexsort((np.arange(k), between[c])) if j != c] for c in range(k)]).astype(np.int64).reshape(k, k - 1)
    return order, np.take_along_axis(between, order, axis=1)


def nearest(vectors: np.ndarray, start: np.ndarray, centroids: np.ndarray, order: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, its squared distance, and how many distances were computed.

    ``start`` is each vector's assignment so far: the scan follows that centroid's order.
    """
    best, least, looked = start.copy(), np.zeros(len(vectors), np.int64), 0
    for c in np.unique(start):
        rows = np.flatnonzero(start == c)
        own = squared(vectors[rows], centroids[c])
        low, near = own.copy(), np.full(len(rows), c, np.int64)
        looked += len(rows)
        left = np.arange(len(rows))
        for j, gap in zip(order[c].tolist(), gaps[c].tolist()):
            left = left[gap <= 4 * own[left]]  # strictly beyond twice the distance: no later one can be as near
            if not len(left):
                break
            d = squared(vectors[rows[left]], centroids[j])
            looked += len(left)
            better = (d < low[left]) | ((d == low[left]) & (j < near[left]))
            low[left[better]], near[left[better]] = d[better], j
        best[rows], least[rows] = near, low
    return best, least, looked


def _matrix(batch, components: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(-1, components)


def assigned(vectors: DataFrame, centroids: np.ndarray, components: int = COMPONENTS) -> DataFrame:
    """vec_id, v, cluster and distance of vectors(vec_id, v, cluster): clusters so far are where the scans begin."""
    order, gaps = neighbour_order(centroids)

    def run(batches):
        drop_held()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                start = part.column("cluster").to_numpy().astype(np.int64)
                best, least, _ = nearest(_matrix(part, components), start, centroids, order, gaps)
                columns = [part.column("vec_id"), part.column("v"), pa.array(best.astype(np.int32)), pa.array(least)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "distance"])

    return vectors.select("vec_id", "v", "cluster").mapInArrow(run, ASSIGNED)


def moved(vectors: DataFrame, centroids: np.ndarray, components: int = COMPONENTS) -> np.ndarray:
    """The centroids after an update: floor of sum / count of their vectors; a centroid without vectors stays."""
    k = len(centroids)

    def run(batches):
        drop_held()
        sums, counts = np.zeros((k, components), object), np.zeros(k, np.int64)
        for batch in batches:
            cluster, v = batch.column("cluster").to_numpy(), _matrix(batch, components)
            for c in np.unique(cluster).tolist():
                rows = v[cluster == c]
                # a batch's sum fits 64 bits, that of a task may not
                sums[c] = sums[c] + rows.sum(axis=0).astype(object)
                counts[c] += len(rows)
        found = [(c, i, str(s), n) for c, n in enumerate(counts.tolist()) if n for i, s in enumerate(sums[c])]
        columns = list(zip(*found)) if found else [[]] * 4
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["cluster", "i", "s", "n"])

    parts = vectors.select("cluster", "v").mapInArrow(run, "cluster int, i int, s string, n long")
    total = parts.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for row in total.collect():  # k * components rows
        out[row["cluster"], row["i"]] = int(row["s"]) // row["n"]
    return out


def clustered(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, v, cluster, distance of table(vec_id, embedding) after so many rounds, and the last centroids."""
    vectors = stored(integer_vectors(table, components, scale).withColumn("cluster", F.lit(0)), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.withColumn("distance", F.lit(0).cast("long")).select("vec_id", "v", "cluster", "distance"), centroids
    for _ in range(rounds):
        vectors = stored(assigned(vectors, centroids, components), "assigned")
        centroids = moved(vectors, centroids, components)
    return stored(assigned(vectors, centroids, components), "assigned"), centroids


def digests(table: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    found, centroids = clustered(table)
    spark = table.sparkSession
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    rows = [(c, int(s), int(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
