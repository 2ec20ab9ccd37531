"""Groups of similar issues against all pairs, and the links that they are made of."""

import random

import pytest

from corpuslens.operators import review


def _groups(rows, least=0.45):
    """issue -> smallest issue of its group, by all pairs."""
    words, root = [set(w.split()) for _, _, w in rows], list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if rows[a][1] == rows[b][1] and len(words[a] & words[b]) / len(words[a] | words[b]) >= least and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return dict(enumerate(root))


def _rows(seed):
    rng, made = random.Random(seed), {}
    while len(made) < 260:
        size = rng.choice([1, 2, 3, 5, 7, 7, 7, 12])
        words = rng.sample([f"word{i}" for i in range(14 if rng.random() < 0.3 else 90)], size) + ["common"] * (rng.random() < 0.5)
        made[rng.choice("xyz"), " ".join(sorted(set(words)))] = len(made)
    return [(i, d, w) for i, (d, w) in enumerate(made)]


@pytest.mark.parametrize("block", [4, 2_048])
def test_groups_equal_all_pairs(spark, block):
    rows = _rows(block)
    issues = spark.createDataFrame(rows, "issue_id long, dimension string, summary string")
    found = {r.node: r.root for r in review.connected_components(review.similar_links(issues, 0.45, block)).collect()}
    expected = _groups(rows)
    assert {k: found.get(k, k) for k in expected} == expected and 20 < len(set(expected.values())) < 240


def test_links_do_not_grow_with_pairs(spark, monkeypatch):
    """Issues of one form: a few links an issue, where all pairs are thousands."""
    counts, components = [], review.connected_components
    monkeypatch.setattr(review, "connected_components", lambda links: counts.append(links.count()) or components(links))
    rows = [(i, "d", None, f"type {'abcdefg'[i % 7] * 3} of size {100 + i // 7} and {'uvw'[i % 3] * 4}") for i in range(420)]
    issues = spark.createDataFrame(rows, "issue_id long, dimension string, identifier string, summary string")
    assert {r.root for r in review.merged_groups(issues).collect()} == {0}
    assert counts and max(counts) < 4 * len(rows), counts
