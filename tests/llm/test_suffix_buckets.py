"""Suffix buckets: order by real bytes, groups over bucket boundaries, lines in very many texts, long texts."""

import random

import numpy as np
import pytest

from corpuslens.llm import suffix_dedup, suffix_runs
from tests.llm.test_operators import brute_repeats, cut_digests, frame

LINE = "this licence line of some ninety bytes stands in very many texts between others that differ."


def hot_texts(seed, n=160):
    """A line shorter than 100 bytes between other words, and a passage of over 100 bytes at two places."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    passage = some(30)
    out = [f"{some(rng.randint(0, 6))} {LINE} {some(rng.randint(0, 6))}" for _ in range(n)]
    out += [f"{some(20)} {passage}{some(9)}" for _ in range(20)] + [f"xx {LINE} yy"] * 12
    rng.shuffle(out)
    return [(i, t, None) for i, t in enumerate(out)]


@pytest.mark.parametrize("many", [3, 1_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_lines_in_very_many_texts(spark, seed, many, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 900)
    rows = hot_texts(seed)
    found = cut_digests(suffix_dedup.remove_repeats(frame(spark, rows).repartition(5)))
    assert found == brute_repeats([(d, t) for d, t, _ in rows])


def test_groups_go_on_in_the_next_bucket(spark, monkeypatch):
    """With many small buckets the answer is right only through the comparison across boundaries."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1_500)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 700)
    rows = hot_texts(3, 60)
    docs, expected = frame(spark, rows).repartition(5), brute_repeats([(d, t) for d, t, _ in rows])
    assert suffix_dedup.bucket_count(docs)[0] > 20
    assert cut_digests(suffix_dedup.remove_repeats(docs)) == expected
    within = lambda marks: marks.where("kind = 1").select("key", "start", "windows", "before")
    monkeypatch.setattr(suffix_dedup, "grouped_suffixes", within)
    assert cut_digests(suffix_dedup.remove_repeats(docs)) != expected


def test_bucket_count_follows_bytes(spark):
    docs = frame(spark, [(1, "x" * (1 << 20), None), (2, None, None)])
    monkey = suffix_dedup.BUCKET_BYTES
    try:
        suffix_dedup.BUCKET_BYTES = 1 << 16
        assert suffix_dedup.bucket_count(docs) == (48, 1 << 20)
    finally:
        suffix_dedup.BUCKET_BYTES = monkey
    assert suffix_dedup.bucket_count(docs)[0] == 4


def test_leads_are_the_bytes_of_the_anchor():
    rng = random.Random(4)
    data = bytes(rng.randrange(256) for _ in range(5000))
    found = suffix_runs.runs([data])
    at = found["start"] + found["before"]
    for i in range(len(at)):
        leads = b"".join(int(found[f"lead{k}"][i]).to_bytes(8, "big") for k in range(4))
        assert leads == data[at[i] : at[i] + 32]
    order = suffix_runs.multikey_order([found[f"lead{k}"] for k in range(4)])
    sorted_suffixes = [data[at[i] : at[i] + 32] for i in order]
    assert sorted_suffixes == sorted(sorted_suffixes)


def test_bucket_of_equals_definition():
    rng = np.random.default_rng(2)
    rows, bounds = rng.integers(0, 4, (3, 400)), rng.integers(0, 4, (3, 30))
    bounds = bounds[:, np.lexsort(bounds[::-1])]
    expected = [sum(tuple(b) <= tuple(r) for b in bounds.T) for r in rows.T]
    assert suffix_dedup._bucket_of(list(rows), list(bounds)).tolist() == expected


def test_windows_of_one_part_share_its_bytes():
    rng = random.Random(6)
    data = bytes(rng.randrange(97, 101) for _ in range(4000))
    r = suffix_runs.runs([data, data])
    pieces = [data[s : s + w + 99] for s, w in zip(r["start"], r["windows"])]
    p = suffix_runs.window_parts(r["windows"], r["before"], pieces)
    assert p["size"].sum() == r["windows"].sum() and p["size"].max() <= suffix_runs.STRIDE
    half = len(p["shared"]) // 2
    assert np.array_equal(p["shared"][:half], p["shared"][half:]) and len(np.unique(p["shared"])) > half * 0.9


def test_a_very_long_text_beside_short_ones(spark):
    rng = random.Random(8)
    long = " ".join(str(rng.randrange(10**9)) for _ in range(70_000))
    rows = [(1, "start " + long[600_000:600_300], None), (2, long, None), (3, long[:700], None)]
    found = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert found == {1: (306, 0), 2: (len(long), 300), 3: (700, 700)}
