"""The pipeline's stages on a small table with planted cases."""

import public_tokenizers
import pytest

import corpus_pipeline
from corpuslens.llm.language_id import has_letter

CLEAN = {0: "an entirely plain first document about rivers and stones", 1: "une autre page qui parle de la mer et du vent"}
LEAK = "one two three four five six seven eight nine ten eleven twelve"
SHARED = " ".join(f"shared{i}é" for i in range(30))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    near = " ".join(f"word{i}" for i in range(400))
    rows = [(d, t, "en" if d == 0 else None) for d, t in CLEAN.items()]
    rows += [(2, None, None), (3, "12345 !!", None), (4, near, "en"), (5, near, "en"), (6, f"before {LEAK} after", "fr"), (7, f"left side {SHARED} end seven", "en"), (8, f"other {SHARED} end eight", "en"), (9, "", "fr")]
    spark.createDataFrame([(d, t, g, "src", len(t or "")) for d, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(kept["language_id"]) == {0, 1, 4, 5, 6, 7, 8} and kept["language_id"][1].lang in ("en", "fr")
    # 7 and 8 share 27 of 32 five-word shingles (0.84): by the stage's rule they are near copies, and 8 goes
    assert set(kept["simhash_near_dedup"]) == {0, 1, 4, 6, 7}
    cut = kept["suffix_array_dedup"]
    assert cut[7].text.endswith("end seven") and SHARED in cut[7].text
    assert all(cut[d].text == t for d, t in CLEAN.items())
    assert set(kept["benchmark_decontamination"]) == {0, 1, 4, 7}


def test_run_packs_what_is_left(spark, folder):
    from tokenizers import Tokenizer

    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == {0, 1, 4, 7}
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(CLEAN[0], add_special_tokens=False).ids
    assert [r.length for r in pieces if r.doc_id == 0] == [len(ids) + 1]


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_has_letter():
    assert has_letter("1 é") and not has_letter("12 ?!") and not has_letter(None) and not has_letter("")


@pytest.fixture(scope="module")
def unlike(spark, tmp_path_factory):
    """A passage in two texts that are far below 0.8 alike (7 and 8), and a near copy (10: 391 of 401 shingles)."""
    out = str(tmp_path_factory.mktemp("unlike"))
    near = " ".join(f"word{i}" for i in range(400))
    left, other = (" ".join(f"{side}{i}" for i in range(20)) for side in ("left", "other"))
    rows = [(d, t, "en" if d == 0 else None) for d, t in CLEAN.items()]
    rows += [(4, near, "en"), (6, f"before {LEAK} after", "fr"), (7, f"{left} {SHARED} end seven", "en"), (8, f"{other} {SHARED} end eight", "en")]
    rows += [(10, near.replace("word200", "changed"), "en")]
    spark.createDataFrame([(d, t, g, "src", len(t)) for d, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_of_unlike_texts(spark, unlike):
    docs, kept = spark.read.parquet(f"{unlike}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, unlike)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(kept["simhash_near_dedup"]) == {0, 1, 4, 6, 7, 8}
    cut = kept["suffix_array_dedup"]
    assert SHARED in cut[7].text
    rest = " ".join(f"other{i}" for i in range(19)) + " othereight"  # "19", the spaces and "end" around it repeat as well
    assert (cut[8].text, cut[8].n_chars) == (rest, len(rest))
    assert set(kept["benchmark_decontamination"]) == {0, 1, 4, 7, 8}


def test_odd_rows(spark, tmp_path):
    """Repeated rows, ties, null ids, very long texts and columns whose names the stages use."""
    long = " ".join(f"long{i}" for i in range(60_000))
    rows = [(1, "one text of plain words", "en"), (1, "one text of plain words", "en"), (None, "a text without an id", None), (2, long, "en"), (3, long + " tail", "en"), (4, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, spans int, items string, _row long, key long"
    docs = spark.createDataFrame([(d, t, g, "src", len(t or ""), 1, "x", 5, 6) for d, t, g in rows], names)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS, name
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == [(0, rows[2][1]), (1, rows[0][1]), (2, long)]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {None, 1, 2} and max(r.length for r in pieces) == 1024
