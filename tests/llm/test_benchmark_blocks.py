"""Decontamination with large benchmarks, long items and long texts, against brute force."""

import random

import numpy as np
import pytest

from corpuslens.llm import decontaminate
from tests.llm.test_operators import brute_leaks, frame


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.mark.parametrize("block", [300, 4_000, 1 << 22])
@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_and_parts_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(decontaminate, "PART_WORDS", 15)
    monkeypatch.setattr(decontaminate, "SPAN_WORDS", 20)
    monkeypatch.setattr(decontaminate, "HASH_BYTES", 90)
    rng = random.Random(seed)
    items = [(i, words(rng, rng.choice([1, 3, 9, 10, 11, 60]))) for i in range(25)] + [(3, "W1, w2!"), (25, None), (26, "..")]
    texts = [None, "", "--", "w1 w2", words(rng, 500)]
    for i in range(30):
        a, b = rng.choice(items)[1] or "", rng.choice(items)[1] or ""
        texts.append(f"{words(rng, rng.randint(0, 30))} {a} {b} {words(rng, rng.randint(0, 30))}")
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)]).repartition(3)
    benchmark = spark.createDataFrame([(*x, 0) for x in items + items[:4]], "item_id long, text string, n_words long")
    found = decontaminate.decontaminate(docs, benchmark, block_bytes=block)
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == brute_leaks(list(enumerate(texts)), items)


def test_blocks_are_bounded(spark):
    rng = random.Random(5)
    benchmark = spark.createDataFrame([(i, words(rng, 200)) for i in range(400)], "item_id long, text string")
    sizes = [sum(len(b" ".join(w)) for _, w in block) for block in decontaminate.item_blocks(benchmark, 10, 20_000)]
    assert len(sizes) > 10 and max(sizes) <= 40_000
    assert sum(sizes) == sum(len(r.text) for r in benchmark.collect())


def test_an_index_takes_few_bytes_a_word():
    rng = random.Random(7)
    items = [(str(i), decontaminate.words_of(words(rng, 500, 50_000))) for i in range(400)]
    made = decontaminate.Windows(items)
    made.file({k: (token, np.ones(len(token), np.int64)) for k, token in made.known().items()})
    size = len(made.data) + sum(x.nbytes for x in (made.begin, made.finish, made.size, made.owners, made.owned))
    size += sum(x.nbytes for f in made.filed.values() for x in f)
    assert size < 80 * 200_000


def test_a_common_shingle_is_no_filing_place(spark):
    rng = random.Random(9)
    item = " ".join([*["the"] * 4, *(f"rare{i}" for i in range(6))])
    texts = ["the " * 5000, f"x {item} y", "the the the the rare0 rare1", words(rng, 50)]
    found = decontaminate.decontaminate(frame(spark, [(i, t, None) for i, t in enumerate(texts)]), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id: r.n_hit for r in found.collect()} == {0: 0, 1: 10, 2: 0, 3: 0}
