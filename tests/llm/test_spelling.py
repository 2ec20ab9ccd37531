"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from corpuslens.llm import spelling


def _words(rows):
    counted = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counted[run] += 1
    return {w: n for w, n in counted.items() if n >= 2}


def _edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def _brute(counts):
    form = {}
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and _edits(v, w) == 1] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def _rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcé", k=rng.randint(6, 9))) for _ in range(60)] + ["".join(rng.choices("aÀß×", k=7)) for _ in range(20)]
    rows = [(None, "AAAAAAA aaaaaaa aaaaaaaa"), (1, None), (2, ""), (3, "b" * 3000 + " " + "b" * 2999 + " " + "b" * 3000 + " " + "b" * 2999)]
    weights = [2.0 ** -(i % 12) for i in range(len(base))]
    for i in range(10, 250):
        rows.append((i, " ".join(rng.choices(base, weights, k=60)) + ", " + rng.choice(base).upper()))
    for i, (word, n) in enumerate((("chainword", 900), ("chainwore", 60), ("chainwqre", 4), ("chaiwqre", 2))):
        rows.append((500 + i, " ".join([word] * n)))
    return rows + rows[20:40]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = _rows(seed)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    made = sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()), key=repr)
    assert made == _brute(_words(rows))
    assert any(r[1] for r in made) and any(r[:3] == ("chainwqre", "chainwore", "chainword") for r in made)


def test_refined_parts_lose_nothing(spark):
    """Very many words share their halves: parts are refined down to one code point, and the pairs stay the same."""
    rng = random.Random(3)
    words = sorted({"same" * 3 + "".join(rng.choices("abcd", k=5)) for _ in range(500)} | {"".join(rng.choices("ab", k=9)) for _ in range(200)})
    frame = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    expected = {(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and _edits(a, b) == 1}
    for most in (2, 64):
        found = [(r.word, r.near) for r in spelling.near_words(frame, most, 100).collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_empty_and_distance(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).count() == 0
    for a, b, ok in (("abc", "abc", False), ("abc", "abd", True), ("abc", "ab", True), ("ab", "abc", True), ("abc", "bca", False), ("", "a", True), ("aab", "ab", True), ("abcd", "ab", False)):
        assert spelling.one_apart(a, b) is ok


def test_chain_of_forms(spark):
    table = spark.createDataFrame([(f"w{i}", f"w{i + 1}" if i < 9 else None) for i in range(10)], "word string, form string")
    assert {r.root for r in spelling.roots(table).collect()} == {"w9"}
