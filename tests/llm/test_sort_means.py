"""Sort-means against plain clustering."""

import hashlib
import math
import random

import numpy as np
import pytest

from corpuslens.llm import sort_means


def _plain(rows, k=16, rounds=3):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(64 * x) for x in e]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    cents = [list(v) for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(cents)):
            members = [v for (_, v), (_, c) in zip(kept, own) if c == j]
            if members:
                cents[j] = [sum(x) // len(members) for x in zip(*members)]
    own = assign()
    total = sum(d for d, _ in own)
    out = []
    for (i, _), (d, c) in zip(kept, own):
        out.append((i, c, d, sum(x for x, y in own if y == c), total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()))
    return sorted(out, key=repr)


def _rows(seed, n, spread):
    rng = random.Random(seed)
    rows = [(i, [rng.choice(spread) for _ in range(64)]) for i in range(n)]
    same = [0.25] * 64
    rows += [(1000 + i, same) for i in range(40)] + [(3, rows[3][1]), (None, rows[4][1])]
    bad = [(2000, None), (2001, []), (2002, same[:63]), (2003, [*same[:63], None]), (2004, [*same[:63], float("nan")]), (2005, [*same[:63], float("inf")]), (2006, same + [0.1])]
    return rows + bad


@pytest.mark.parametrize("seed,n,spread", [(1, 150, [-0.3, -0.01, 0.0, 0.02, 0.5]), (2, 120, [0.0, 0.016]), (3, 5, [0.5, 1.0])])
def test_equals_plain_clustering(spark, seed, n, spread):
    rows = _rows(seed, n, spread)
    rows = [(i, e and [x if x is None else float(np.float32(x)) for x in e]) for i, e in rows]
    table = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<float>, cluster int, v int").repartition(3)
    made = sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in sort_means.digests(table).collect()), key=repr)
    assert made == _plain(rows)


def test_nearest_looks_at_fewer(spark):
    rng = np.random.default_rng(4)
    cents = rng.integers(-900, 900, (16, 8))
    vectors = np.concatenate([c + rng.integers(-20, 20, (50, 8)) for c in cents])
    order, gaps = sort_means.neighbour_order(cents)
    full = np.stack([sort_means.squared(vectors, c) for c in cents])
    for start in (full.argmin(axis=0), rng.integers(0, 16, len(vectors))):
        best, least, looked = sort_means.nearest(vectors, start, cents, order, gaps)
        assert (best == full.argmin(axis=0)).all() and (least == full.min(axis=0)).all()
    assert sort_means.nearest(vectors, full.argmin(axis=0), cents, order, gaps)[2] < 2 * len(vectors)


def test_empty(spark):
    assert sort_means.digests(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    large = spark.createDataFrame([(1, [1e30] * 64), (2, [0.5] * 64)], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.distance) for r in sort_means.digests(large).collect()] == [(2, 0)]
