"""The pipeline's near-duplicate stage against brute force over planted near copies."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm import near_copies, simhash


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _brute(texts):
    """Smallest id of each component of pairs of Jaccard 0.8 or more."""
    sets, root = [_shingles(t) for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def _changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return out


def _planted(seed):
    rng, vocabulary = random.Random(seed), [f"w{i}" for i in range(3000)]
    texts = ["one two", "one two", "One  TWO", "three", "a b c d e"]
    for size in (45, 90, 150, 300, 500, 1200):
        for _ in range(4):
            base = rng.choices(vocabulary, k=size)
            texts.append(" ".join(base))
            for percent in (0.01, 0.02, 0.03, 0.06):
                texts.append(" ".join(_changed(rng, base, max(1, int(size * percent)))))
    large = rng.choices(vocabulary, k=80)  # one large group, and a line that unlike texts hold
    line = rng.choices(vocabulary, k=20)
    texts += [" ".join(_changed(rng, large, 1 + i % 3)) for i in range(60)]
    texts += [" ".join(line + rng.choices(vocabulary, k=rng.randint(1, 6))) for _ in range(40)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_equals_brute_force(spark, tmp_path, seed):
    texts = _planted(seed)
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    expected = _brute(texts)
    found = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert found == expected and len(expected) < len(texts) - 60


def test_unlike_texts_stay(spark, tmp_path):
    shared = [f"shared{i}" for i in range(30)]
    texts = [" ".join([*shared, *(f"left{i}" for i in range(9))]), " ".join([*shared, *(f"right{i}" for i in range(9))]), "", None]
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()} == {0, 1, 2}
    assert corpus_pipeline.near_duplicates(spark, docs.where(F.lit(False)), str(tmp_path)).count() == 0


def test_forms_of_phrases_are_not_all_paired(spark):
    """Unlike texts of one pool of phrases: candidates stay far below all pairs, and the links are those of all pairs."""
    rng = random.Random(12)
    pool = [" ".join(f"p{i}w{j}" for j in range(14)) for i in range(40)]
    texts = [" ".join(rng.sample(pool, 9)) for _ in range(1_200)]
    texts += [t.replace("w7", "new", 1) for t in texts[:10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "_key long, text string")
    made = near_copies.sketches(docs).cache()
    met = near_copies.first_round(made, near_copies.SHARE).cache()
    tried = met.where(F.col("kind") == near_copies.PAIR).select("u", "v").distinct()
    held = met.where(F.col("kind") == near_copies.HELD).select("token", F.col("u").alias("key"), "n", "place")
    more = near_copies.remaining(held, made, near_copies.SHARE)
    assert tried.count() + more.count() < 10 * len(texts)  # of 731,000 pairs
    assert {r._key for r in near_copies.kept_keys(docs).collect()} == _brute(texts)


def test_order_of_long_texts_is_bounded(spark):
    texts = [" ".join(f"w{i}" for i in range(30_000))] * 4 + ["a b c d e f"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "_key long, text string")
    token, df, share = near_copies.common_shingles(docs)
    assert share == 1
    assert len(token) == near_copies.SAMPLE_SHINGLES + 2 and set(df.tolist()) == {3, 4}
    assert len(near_copies.common_shingles(docs, most=5)[0]) == 5


def test_budget_beyond_the_keys(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)
