"""Binary records: many files a task, files bounded by bytes, long texts."""

import random
import zlib
from array import array

import public_tokenizers
from tokenizers import Tokenizer

from corpuslens.llm import binary_records

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_starts_over_a_thousand_files_a_task(spark, tmp_path):
    rows = [(i, f"word {i} " * (i % 3)) for i in range(4800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = binary_records.encode_to_records(docs, WORD, str(tmp_path / "out"), rows_per_file=1)
    found, start = index.orderBy("doc_id").collect(), 0
    assert max(r.number for r in found) > 1000
    for r in found:
        assert r.start == start
        start += r.n_tokens
    assert len(found) == 4800 and spark.read.parquet(str(tmp_path / "out" / "index" / "whole")).count() == 4800


def test_names_are_compared_as_numbers():
    names = ["part-99999-ab-c1de-c000.txt", "part-100000-ab-c000.txt", "part-00007-u-c999.txt", "part-00007-u-c1000.txt"]
    places = [binary_records.place_of(n) for n in names]
    assert places == [(99999, 0), (100000, 0), (7, 999), (7, 1000)] and sorted(places) == [places[2], places[3], *places[:2]]


def test_files_are_cut_by_bytes(spark, tmp_path):
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta", "x1", "42"]) for _ in range(400_000))
    rows = [(0, "a"), (1, long), (2, "b"), (3, None)] + [(i, "word " * 50) for i in range(4, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    index = binary_records.encode_to_records(docs, WORD, str(tmp_path / "out"), file_bytes=4096)
    largest = 12 + 10 + 4 + 2 * 60  # a short record, about
    sizes = {p.name: p.stat().st_size for p in (tmp_path / "out" / "records").glob("part-*")}
    found = {r.doc_id: r for r in index.collect()}
    assert all(size <= 4096 + largest for name, size in sizes.items() if name != found[1].file)
    ids = [*Tokenizer.from_file(WORD).encode(long, add_special_tokens=False).ids, 2]
    assert (found[1].n_tokens, found[1].ids_crc32) == (len(ids), zlib.crc32(array("I", ids).tobytes()))
    assert found[2].start == found[1].start + len(ids)


def test_many_null_ids_are_parted(spark, tmp_path, monkeypatch):
    """Rows without an id, and of one id, go to several ranges and stay in the order of their texts."""
    monkeypatch.setattr(binary_records, "RANGE_BYTES", 4_000)
    texts = [f"text {i * 7919 % 1000} of many" for i in range(900)]
    rows = [(None, t) for t in texts] + [(5, t) for t in texts[:300]] + [(None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = binary_records.encode_to_records(docs, WORD, str(tmp_path / "out")).orderBy("start").collect()
    assert len({(r.task, r.doc_id) for r in index if r.doc_id is None}) > 3
    library, start = Tokenizer.from_file(WORD), 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for r, (doc_id, text) in zip(index, ordered, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.ids_crc32) == (doc_id, start, zlib.crc32(array("I", ids).tobytes()))
        start += len(ids)
