"""Language-model scores: long words, frequent long words, the marginal of the given scores."""

import collections
import math
import random
import time

import numpy as np
import public_tokenizers
import pytest

from corpuslens.llm import lm_scoring
from tests.llm.test_operators import frame

PIECE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return lm_scoring.PieceLattice(PIECE)


def as_row(word):
    return np.frombuffer(b" " + word, np.uint8)


@pytest.mark.parametrize("block", [7, 1 << 14])
def test_long_words_equal_the_plain_recursion(lattice, monkeypatch, block):
    monkeypatch.setattr(lm_scoring, "BLOCK", block)
    rng = random.Random(3)
    for size in (1, 2, 40, 700):
        word = bytes(rng.choice(b"theandofor-=\xc3\xa9") for _ in range(size))
        plain = lattice.forward(as_row(word)[None])[:, 0]
        assert np.allclose(lattice._log_sums(as_row(word), False), plain, rtol=1e-9)
        assert math.isclose(lattice._log_sums(as_row(word), True)[0], plain[-1], rel_tol=1e-9)
        one, other = np.zeros(len(lattice.ids)), np.zeros(len(lattice.ids))
        monkeypatch.setattr(lm_scoring, "LONG", 10**9)
        lattice.expected(as_row(word)[None], np.array([3.0]), one)
        lattice._expected_long(as_row(word), 3.0, other)
        assert np.allclose(one, other, rtol=1e-7, atol=1e-12)


def test_a_very_long_word_takes_little_time(lattice):
    word = bytes(random.Random(1).choice(b"abcdefgh") for _ in range(300_000))
    began, uses = time.time(), np.zeros(len(lattice.ids))
    lattice._expected_long(as_row(word), 1.0, uses)
    assert math.isfinite(lattice.marginals([word])[0]) and 30_000 < uses.sum() <= 300_001
    assert time.time() - began < 60


def test_frequent_long_words_are_broadcast_by_digest(spark, monkeypatch):
    rule = "-" * 80
    rows = [(i, f"{rule} title {i} {rule}\nword{i % 5} end", None) for i in range(60)] + [(60, "=" * 900, None), (61, None, None)]
    docs = frame(spark, rows).repartition(3)
    whole = {r.doc_id: r for r in lm_scoring.score(docs, PIECE).collect()}
    words = collections.Counter(w for _, t, _ in rows for w in (t or "").encode().lower().split())
    assert words[rule.encode()] == 120 and len(lm_scoring.hot_key(rule.encode())) == 17
    monkeypatch.setattr(lm_scoring, "HOT", 1)  # everything is joined
    joined = {r.doc_id: r for r in lm_scoring.score(docs, PIECE).collect()}
    for d, r in whole.items():
        same = [(r[c], joined[d][c]) for c in ("base_score", "score", "lattice_score", "n_known")]
        assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in same)


def test_lattice_score_is_the_marginal_of_the_given_scores(spark, lattice):
    rows = [(1, "The theatre of Xyzzy", None), (2, "", None), (3, "the the", None), (4, "theatre", None)]
    found = {r.doc_id: r.lattice_score for r in lm_scoring.score(frame(spark, rows), PIECE).collect()}
    end = found[2]
    for d, text, _ in rows:
        expected = end + lattice.marginals([w for w in text.lower().encode().split()]).sum()
        assert math.isclose(found[d], expected, rel_tol=1e-9)
