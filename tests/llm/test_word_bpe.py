"""Encoding and decoding by the word table against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuslens.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "   ", "plain words, and (more) words!", "It's we'll I'M 'quoted' o'clock''s", "CAPITALS Größe ÀÉ× a÷b ß",
    "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "é ́start Å ﬁ İstanbul ΣΑΣ", "tab\tline\nfeed\x0bvt\x0cff\rcr\x1cfs\x85nel nbsp　wide",
    "1234 3.14 a1b2", "日本語 한국어 😀👍🏽", "word" * 5000, "x" * 3 + " " + "?!" * 2000, '("word")]. ("two', "​zero ﻿bom",
]


def _texts(seed: int = 5) -> list:
    rng = random.Random(seed)
    letters = "abcdefgh ABC.,;:!?()'\"\t\n éÀß×<|>12́ -"
    return ODD + ["".join(rng.choices(letters, k=rng.randint(1, 80))) for _ in range(150)] + ["one same text"] * 20


def _frame(spark, texts):
    rows = [(i if i != 3 else None, t, i, "x") for i, t in enumerate(texts)] + [(5, "a repeated id", 0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, at int, ids string").repartition(3), rows


def _expected(rows):
    library = Tokenizer.from_file(PATH)
    out = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_bytes", [0, 2_000, 1 << 24])
def test_equals_the_library(spark, hot_bytes):
    docs, rows = _frame(spark, _texts())
    made = word_bpe.decode(word_bpe.encode(docs, PATH, hot_bytes), PATH)
    assert sorted(((r.doc_id, bytes(r.ids), r.text) for r in made.collect()), key=repr) == _expected(rows)


def test_each_word_once(spark):
    docs, rows = _frame(spark, _texts())
    table = word_bpe.word_table(docs, PATH).collect()
    assert len({r.word for r in table}) == len(table)
    assert sum(r.n for r in table) == sum(len(word_bpe.words_of(run)) for _, t, *_ in rows for run in (t or "").encode().split())


def test_digests_and_empty(spark):
    docs, rows = _frame(spark, _texts(9))
    expected = [(d, len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, i, t in _expected(rows)]
    assert sorted(map(tuple, word_bpe.digests(docs, PATH).collect()), key=repr) == sorted(expected, key=repr)
    assert word_bpe.digests(docs.where("false"), PATH).count() == 0


def test_other_vocabularies_raise(spark):
    with pytest.raises(ValueError):
        word_bpe.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))


def test_packed_ids():
    for ids in ([], [1, word_bpe.GAP, 65534], [65535, word_bpe.GAP], [70000]):
        keys, tokens, found = word_bpe.unpacked(word_bpe.packed([7, -3], np.array([len(ids), 0]), np.array(ids, "<u4")))
        assert (keys.tolist(), tokens.tolist(), found.tolist()) == ([7, -3], [len(ids), 0], ids)


def test_spans_are_the_words():
    for text in [(t or "").encode() for t in _texts(11)]:
        data, starts, ends = word_bpe.spans(np.frombuffer(text, np.uint8))
        found = [data[a:b].tobytes() for a, b in zip(starts, ends)]
        assert found == [w for run in text.split() for w in word_bpe.words_of(run)]


def test_blocks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(word_bpe, "BLOCK_BYTES", 100)
    keys = [k for ks, _ in word_bpe.text_blocks([pa.RecordBatch.from_pydict({"_key": [1, 2, 3, 4], "text": ["a" * 60, "b" * 60, None, "c" * 300]})]) for k in [ks]]
    assert keys == [[1], [2, 3], [4]]
