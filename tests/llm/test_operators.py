"""The training-data operators against brute force on small rows: nulls, empty and long texts, ties, repeats."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslens.llm import binary_records, chat, decontaminate, language_id, lm_scoring, media, packing, simhash, suffix_dedup, suffix_runs, token_counts
from corpuslens.llm.common import ChunkEncoder
from corpuslens.llm.components import components

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, media string, spans int, fp string, word string"
rng = random.Random(11)
WORDS = ["the", "of", "and", "theanble", "état", "größe", "niño", "x1", "42", "don't", "--", "漢字", "🙂"]
LONG = " ".join(rng.choice(WORDS) for _ in range(9000))
PASSAGE = " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(60))


def texts():
    body = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 150))) for _ in range(25)]
    out = [None, "", " \n\t", "???", "a", "  two  spaces\n\n", "special <|endoftext|> inside <|startoftext|>", LONG, "ab" * 700, "=" * 1500, "İstanbul ΑΣ", *body]
    out += [f"intro {i} {PASSAGE} outro {i}" for i in range(4)] + [body[3], body[3], body[4] + " tail", LONG[:3000]]
    return out


def frame(spark, rows):
    """Rows (doc_id, text, lang) with extra columns that clash with names used inside."""
    return spark.createDataFrame([(d, t, g, "src", 0, "m", 1, "f", "w") for d, t, g in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return [(i, t, ["en", "fr", None][i % 3]) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# ------------------------------------------------------------------ tokens

ATOMS = ["hello", " world", "'re", "'ll", "'s", "''", "  ", "\n", "\n\n", "\t", " ", "123", "½", "é", "漢字", "🙂", "<|endoftext|>", "<|end", "İ", "Σ", "\x1c", "\x85", "​", "　", "\x00", ".", "!!", "'", "r", "=" * 20, "ﬁ"]


def odd_texts(n):
    return ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunk_encoder_equals_library(path):
    tokenizer, some = Tokenizer.from_file(path), odd_texts(800) + [t for t in texts() if t]
    for text, ids in zip(some, ChunkEncoder(path).encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_prefix_counts_equal_library():
    tokenizer, table, some = Tokenizer.from_file(BYTE), token_counts.PrefixTable(BYTE), odd_texts(300)
    for text, changes in zip(some, table.of_texts(some)):
        for j in range(len(text) + 1):
            expected = len(tokenizer.encode(text[:j], add_special_tokens=False).ids)
            assert token_counts.count_at(changes, len(text[:j].encode())) == expected, repr(text[:j])


def test_token_counts(docs, rows, empty):
    tokenizer = Tokenizer.from_file(BYTE)
    found = {r.doc_id: r for r in token_counts.prefix_token_counts(docs, BYTE).collect()}
    for d, t, _ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (found[d].n_tokens, found[d].n_bytes, found[d].over_limit) == (n, len((t or "").encode()), n > 1024)
        assert token_counts.count_at(found[d].prefix_changes, found[d].cut_bytes) <= 1024
    assert token_counts.prefix_token_counts(empty, BYTE).count() == 0


def test_binary_records_round_trip(spark, docs, rows, empty, tmp_path):
    tokenizer = Tokenizer.from_file(WORD)
    index = binary_records.encode_to_records(docs, WORD, str(tmp_path / "out"), rows_per_file=7)
    found, start = {r.doc_id: r for r in index.collect()}, 0
    for d, t, _ in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (found[d].start, found[d].n_tokens, found[d].ids_crc32) == (start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        content = (tmp_path / "out" / "records" / found[d].file).read_bytes()  # a shuffled read by the index
        _, size, key, read = next(binary_records.records(content[found[d].offset : found[d].offset + found[d].length]))
        assert (key, size, np.frombuffer(read, "<u4").tolist()) == (d, found[d].length, ids)
        start += len(ids)
    assert binary_records.encode_to_records(empty, WORD).count() == 0


def test_binary_records_find_damage():
    record = binary_records.frame(7, array("I", [1, 2, 70000]).tobytes(), 4) + b"\n"
    assert [x[2] for x in binary_records.records(record + binary_records.frame(None, b"", 2) + b"\n")] == [7, None]
    for at in (0, 9, 20, len(record) - 3):
        with pytest.raises((ValueError, struct.error)):
            list(binary_records.records(record[:at] + bytes([record[at] ^ 1]) + record[at + 1 :]))


def test_binary_records_keep_null_and_repeated_ids(spark):
    df = frame(spark, [(None, "a", None), (3, "b", None), (3, "b", None), (1, None, None)])
    found = binary_records.encode_to_records(df, WORD).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 1, 3, 3] and [r.start for r in found] == [0, 2, 3, 5]


def check_layout(pieces, capacity):
    sequences = collections.defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(docs, rows, empty):
    tokenizer = Tokenizer.from_file(BYTE)
    pieces = packing.pack(docs, BYTE, 256).collect()
    expected = {}
    for d, t, _ in rows:
        ids, at, k = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], 0, 0
        while at < len(ids):
            n = (len(ids) - 1) % 256 + 1 if k == 0 else 256
            expected[d, k] = (at, n, zlib.crc32(array("I", ids[at : at + n]).tobytes()))
            at, k = at + n, k + 1
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in pieces} == expected
    assert check_layout(pieces, 256) <= math.ceil(sum(r.length for r in pieces) / 256) * 1.12 + 1
    assert packing.pack(empty, BYTE).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_places_each_piece_once(seed):
    r = random.Random(seed)
    histogram = {n: r.randint(1, 400) for n in r.sample(range(1, 1025), r.randint(1, 300))}
    room, seen = collections.defaultdict(list), collections.Counter()
    for length, lo, hi, first, per, base in packing.best_plan(histogram, 1024):
        seen[length] += hi - lo
        for i in range(hi - lo):
            room[first + i // per].append((base + i % per * length, length))
    assert seen == histogram
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    bound = max(-(-sum(n * c for n, c in histogram.items()) // 1024), sum(c for n, c in histogram.items() if n > 512))
    assert len(room) <= bound * 1.1 + 3


# ------------------------------------------------------------------ language and scoring


def ppm_bits(samples, text, order=3):
    contexts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for x in samples:
        for i, c in enumerate(x):
            for k in range(min(order, i) + 1):
                contexts[k][x[i - k : i]][c] += 1
    total = 0.0
    for i, c in enumerate(text):
        for k in range(min(order, i), -1, -1):
            seen = contexts[k].get(text[i - k : i])
            if not seen:
                continue
            n, q = sum(seen.values()), len(seen)
            if seen[c]:
                total -= math.log2(seen[c] / (n + q))
                break
            total -= math.log2(q / (n + q))
        else:
            total += 8
    return total


def test_context_trees_equal_definition(monkeypatch):
    samples = {"en": [b"the theatre of the thing", b"then"], "fr": ["l'été et la forêt".encode()]}
    model = language_id.ContextTrees(samples)
    some = [b"the", "forêt théâtre ß漢".encode(), b"t", b"zzz the"]
    for block in (1 << 20, 5):  # a text may go on over a block's end
        monkeypatch.setattr(language_id, "BLOCK", block)
        bits = model.code_lengths(some)
        for i, text in enumerate(some):
            assert np.allclose(bits[i], [ppm_bits(samples[k], text) for k in ("en", "fr")], rtol=1e-5)


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 20 and sum(r.lang_pred == r.lang for r in found) / len(found) >= 0.95
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in found)


def test_language_of_odd_rows(docs, rows, empty):
    found = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for d, t, _ in rows:
        if not any(map(str.isalpha, t or "")):
            assert (found[d].lang_pred, found[d].score) == ("und", 0.0)
        else:
            assert found[d].lang_pred in ("en", "fr")
    assert language_id.identify(empty).count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_lattice_sums_all_segmentations():
    model = lm_scoring.PieceLattice(PIECE)
    for word in [b"the", b"andble", "été".encode(), b"x"]:
        data = b" " + word

        def total(i):
            if i == len(data):
                return 1.0
            out, node = 0.0, 0
            for end in range(i + 1, len(data) + 1):
                node = model.child[node, data[end - 1]]
                if np.isfinite(model.logp[node]):
                    out += math.exp(model.logp[node]) * total(end)
            return out

        assert math.isclose(model.marginals([word])[0], math.log10(total(0)), rel_tol=1e-9)


def test_expected_pieces_cover_each_word():
    model = lm_scoring.PieceLattice(PIECE)
    uses = np.zeros(len(model.ids))
    for _, data in model.by_length([b"abc"]):
        model.expected(data, np.ones(1), uses)
    assert 1 <= uses.sum() <= 4 and (uses >= 0).all()


def test_lm_scores(docs, rows, empty):
    found = {r.doc_id: r for r in lm_scoring.score(docs, PIECE).collect()}
    tokens = {d: [*(t or "").encode().lower().split(), None] for d, t, _ in rows}
    train = {d: zlib.crc32(str(d).encode()) % 7 != 2 for d, _, _ in rows}
    c = collections.Counter(w for d in tokens if train[d] for w in tokens[d])
    n, v = sum(c.values()), len(c)
    for d, ws in tokens.items():
        r = found[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert lm_scoring.score(empty, PIECE).count() == 0


def test_lm_words_past_the_broadcast_bound_are_joined(docs, monkeypatch):
    whole = {r.doc_id: r.score for r in lm_scoring.score(docs, PIECE).collect()}
    monkeypatch.setattr(lm_scoring, "HOT", 4)
    joined = {r.doc_id: r.score for r in lm_scoring.score(docs, PIECE).collect()}
    assert whole.keys() == joined.keys() and all(math.isclose(whole[k], joined[k], rel_tol=1e-9) for k in whole)


# ------------------------------------------------------------------ duplicates


def brute_components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs, rows, empty):
    def print_of(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        ones = [sum(xxhash.xxh64_intdigest(s, seed=42) >> b & 1 for s in shingles) for b in range(64)]
        return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))

    prints = {d: print_of(t) for d, t, _ in rows}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = brute_components(prints, links)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {d: (f"{prints[d]:016x}", roots[d]) for d in prints}
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("large", [20, 2_048])
def test_keys_and_chains_have_the_components_of_all_pairs(spark, large, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", large)
    some, r = set(), random.Random(5)
    for _ in range(6):
        center = r.getrandbits(64)
        for _ in range(80):
            x = center
            for _ in range(r.randint(0, 6)):
                x ^= 1 << r.randrange(64)
            some.add(x)
    some = sorted(some)
    pairs = [(a, b) for i, a in enumerate(some) for b in some[i + 1 :] if (a ^ b).bit_count() <= 3]
    differ = np.array([a ^ b for a, b in pairs], np.uint64)
    starts = np.stack([simhash.chains(differ, s) for s in range(5)])
    assert starts.any(axis=0).all() and not starts.all()  # some start passes for each link
    links, buckets = [], collections.defaultdict(list)
    signed = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in some], "fp long")
    for row in simhash.keys(signed).collect():
        buckets[row.key].append(row.fp % (1 << 64))
    for key, members in buckets.items():
        links += [(int(a), int(b)) for u, v in simhash.dealt_links(np.array(members, np.uint64), key >> simhash.KEY_BITS) for a, b in zip(u, v)]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    assert brute_components(some, pairs) == brute_components(some, links)


def test_keys_hold_three_of_four_halves(spark):
    """Fingerprints meet under a key of a start exactly where its first chain is within the budget."""
    r, low = random.Random(7), {}
    some = [r.getrandbits(63)]
    for _ in range(60):
        x = some[0]
        for _ in range(r.randint(0, 4)):
            x ^= 1 << r.randrange(63)
        some.append(x)
    for row in simhash.keys(spark.createDataFrame([(x,) for x in some], "fp long")).collect():
        low.setdefault(row.fp, set()).add(row.key)
    segment = lambda d, s: (d >> simhash.SEGMENTS[s % 5][0] & (1 << simhash.SEGMENTS[s % 5][1] - simhash.SEGMENTS[s % 5][0]) - 1).bit_count()
    for a in some:
        for b in some:
            starts = {key >> simhash.KEY_BITS >> 2 for key in low[a] & low[b]}
            within = {s for s in range(5) if not segment(a ^ b, s) and segment(a ^ b, s + 1) + segment(a ^ b, s + 2) <= 1}
            assert within <= starts and all(not segment(a ^ b, s) for s in starts)


def test_a_large_bucket_without_links_is_no_square():
    import time

    rng = np.random.default_rng(3)
    bucket = np.unique(rng.integers(0, 1 << 25, 60_000).astype(np.uint64) << np.uint64(39))  # equal in the first three segments
    began = time.time()
    simhash.dealt_links(bucket, 0)
    assert time.time() - began < 30


def test_links_through_keys(spark):
    r, some = random.Random(9), set()
    for _ in range(20):
        x = r.getrandbits(64)
        some |= {x, x ^ 1 << 3 ^ 1 << 40, x ^ 7 << 30, x ^ 15 << 7}
    signed = [x - (1 << 64) if x >> 63 else x for x in some]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    pairs = [(a, b) for a in some for b in some if a < b and (a ^ b).bit_count() <= 3]
    assert brute_components(some, pairs) == brute_components(some, [(a.u % (1 << 64), a.v % (1 << 64)) for a in found])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    roots = brute_components({n for e in links for n in e}, links)
    found = {x.node: x.root for x in components(spark.createDataFrame(links, "u long, v long").repartition(5)).collect()}
    assert found == {n: q for n, q in roots.items() if n != q}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_repeats(keyed):
    seen, out = set(), {}
    for key, text in keyed:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[key] = (len(data), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def cut_digests(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()}


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_suffix_dedup(spark, rows, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    near = [(100 + i, PASSAGE[:i * 9] + "*" + PASSAGE[i * 9 :], None) for i in range(20)]
    some = [*rows, *near]
    found = cut_digests(suffix_dedup.remove_repeats(frame(spark, some).repartition(5)))
    assert found == brute_repeats([(d, t) for d, t, _ in sorted(some, key=lambda r: r[0])])


def test_suffix_dedup_reads_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(suffix_runs, "SEGMENT", 64)
    data = bytes(rng.randrange(97, 123) for _ in range(1000))
    parts = list(suffix_runs.segments(data))
    starts = [a + s for a, p in parts for s in range(max(0, len(p) - 99))]
    assert starts == list(range(901)) and all(data[a : a + len(p)] == p for a, p in parts)


def test_suffix_dedup_of_null_and_repeated_ids(spark, empty):
    df = frame(spark, [(None, PASSAGE, None), (5, PASSAGE, None), (5, PASSAGE, None), (5, "short", None)])
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    size = len(PASSAGE.encode())
    assert found == [(False, 0, size, 0), (True, 5, 5, 0), (True, 5, size, size), (True, 5, size, size)]
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_multikey_order():
    a, b = np.random.default_rng(1).integers(0, 4, (2, 500)).astype(np.uint64)
    order = suffix_runs.multikey_order([a, b])
    assert np.array_equal(order, np.lexsort((b, a)))


# ------------------------------------------------------------------ benchmark, chat, media


def brute_leaks(rows, items, size=10):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = split(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(str(item))
    out = {}
    for d, t in rows:
        w, hit, owners = split(t), set(), set()
        for window, who in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    owners |= who
        out[d] = (len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [2_000_000, 100])
def test_decontamination(spark, docs, rows, empty, block):
    items = [(1, PASSAGE[:200]), (2, "Größe, NIÑO"), (3, None), (4, "..."), (5, PASSAGE), (5, "the the"), (10, LONG[500:560]), (None, "état")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(docs, benchmark, block_bytes=block).drop("media")
    named = [("" if i is None else i, t) for i, t in items]
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == brute_leaks([(d, t) for d, t, _ in rows], named)
    assert decontaminate.decontaminate(empty, benchmark).count() == 0
    clean = decontaminate.decontaminate(docs, benchmark.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r.contaminated for r in clean)


CHATS = [
    (1, [("user", "hi"), ("assistant", "hello")]), (2, [("user", "hi")]), (3, [("user", "hi"), ("assistant", "hello"), ("user", "more")]), (4, [("user", "hi"), ("assistant", "hello"), ("user", "more")]),
    (5, [("assistant", "hello"), ("user", "hi")]), (6, [("user", None), (None, "x")]), (7, [("user", "")]), (8, [("user", "h"), ("i", "")]), (None, [("user", "lost")]),
]


def test_chat_collapse(spark):
    rows = [(c, t, r, x, "extra") for c, turns in CHATS for t, (r, x) in enumerate(turns)]
    rng.shuffle(rows)
    found = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ordinal string")).collect()}
    whole = {c: tuple((r or "", x or "") for r, x in turns) for c, turns in CHATS}
    left = {c for c, w in whole.items() if not any(len(v) > len(w) and v[: len(w)] == w for v in whole.values())} - {4}
    form = lambda w: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in w)
    assert found == {c: (len(whole[c]), 2 if c == 3 else 1, form(whole[c])) for c in left}
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_equals_sql(spark, sf):
    import duckdb

    path = f"{sf}/conversations.parquet"
    duckdb.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{path}'")
    assert sorted(map(tuple, chat.format_chats(spark.read.parquet(path)).collect())) == sorted(duckdb.execute(chat.SQL).fetchall())


def test_media(docs, rows, empty):
    found = {r.doc_id: r for r in media.media_columns(docs).collect()}
    for d, t, _ in rows:
        data = (t or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        r = found[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest() and len(r.times) == len(r.hashes) and r.times == sorted(r.times)
    same = [d for d, t, _ in rows if t == rows[14][1]]
    assert len(same) == 3 and len({found[d].feature for d in same}) == 1
    assert media.encode_wav(empty).count() == 0


def test_spectral_peaks_find_a_tone():
    tone = (128 + 100 * np.sin(2 * np.pi * 16 * np.arange(2048) / media.FRAME)).astype(np.uint8)
    _, bins = media.spectral_peaks(tone)
    assert (bins == 16).sum() >= 30
    assert len(media.spectral_peaks(np.full(2048, 255, np.uint8))[0]) == 0


def test_media_arrays_are_those_of_the_payload(spark):
    tone = "".join(chr(97 + i % 8) for i in range(6000))
    docs = spark.createDataFrame([(1, tone), (2, None), (3, tone)], "doc_id long, text string")
    found = {r.doc_id: r for r in media.media_columns(docs).collect()}
    payload = np.frombuffer(tone.encode().ljust(6336, b"\xff"), np.uint8)
    times, hashes = media.pair_hashes(*media.spectral_peaks(payload))
    assert len(times) and (found[1].times, found[1].hashes) == (times.tolist(), hashes.tolist())
    assert (found[3].times, found[3].feature) == (found[1].times, found[1].feature) and found[2].times == []
