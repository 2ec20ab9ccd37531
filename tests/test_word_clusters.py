"""Clusters of documents by their words against all pairs: copies and near copies."""

import difflib
import os
import random

from corpuslens.plans import registry


def test_word_clusters_equal_brute_force(spark, tmp_path):
    rng, texts = random.Random(9), ["", "a b", "a  b", "a b c"]
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(16, 60))]
        texts.append(" ".join(base))
        texts.append("  ".join(base[:9]) + "\n" + " ".join(base[9:]))  # equal words, other white space
        for n in (1, 2, 6):
            changed = list(base)
            for at in rng.sample(range(len(base)), n):
                changed[at] = f"new{rng.random()}"
            texts += [" ".join(changed)] * rng.randint(1, 3)
    texts += [" ".join(f"own{i}x{j}" for j in range(30)) for i in range(3)]
    rng.shuffle(texts)
    rows = [(i, t, "en", "src") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(os.path.join(tmp_path, "documents.parquet"))
    words, root = [t.split() for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            x, y = sorted((words[a], words[b]), key=len)
            alike = len(x) >= 15 and difflib.SequenceMatcher(None, x, y, autojunk=len(x) >= 80).ratio() >= 0.9
            if (alike or x == y) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    expected = {(i, r, root.count(r)) for i, r in enumerate(root) if root.count(r) > 1}
    found = {tuple(r) for r in registry.queries()["near_dup_word_clusters"](spark, str(tmp_path)).collect()}
    assert found == expected and sum(size == 2 for _, _, size in expected) >= 2
