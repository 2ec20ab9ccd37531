"""BPE encoding and decoding through a table of distinct words.

A vocabulary that discards white space encodes the runs between white space independently, and runs of letters, of
digits and of marks inside them. So texts are split into words (:func:`words_of`), each distinct word is encoded once
into a table (:func:`word_table`), and its ids are joined back by position (:func:`encode`). Decoding is a join of ids
with the vocabulary's id-to-piece table (:func:`decode`).

The join has two ways, and both are exact. The most frequent words of the table, as many as fit ``HOT_BYTES``, are
broadcast. Each other place is a row (block of texts, place, word) that is joined with the table by a shuffle and comes
back to its block, which is sent as compressed ids with gaps. Hot words are never a key of that join.

Texts are cut at ASCII white space only; white space of other kinds and special strings stay inside a word, which
the library encodes as it would inside the text. Null and empty texts have no ids. Equal rows are encoded each by
itself, null and repeated doc_ids are kept. A word may be as long as its text. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import drop_held, held_in_worker, small_batches, stored
from corpuslens.llm.suffix_dedup import keyed

#: Bytes of the broadcast part of the word table; 28 a word and 4 a token.
HOT_BYTES = 32 << 20
#: Longer words (in bytes) are not broadcast.
HOT_LENGTH = 64
#: Distinct runs after which a counting task gives out what it has.
COUNTED = 400_000
#: Texts and bytes of a block; a longer text is a block of its own.
BLOCK_TEXTS, BLOCK_BYTES = 512, 2 << 20
#: Marks that may be parted from letters and digits: no apostrophe (contractions), no part of special strings.
MARKS = b"""!"#$%&()*+,-./:;=?@[\\]^_`{}~"""
SIMPLE = re.compile(rb"[A-Za-z0-9" + re.escape(MARKS) + rb"]+\Z")
PARTS = re.compile(rb"[A-Za-z]+|[0-9]+|[" + re.escape(MARKS) + rb"]+")
WHITE, LETTER, DIGIT, MARK, ODD = range(5)
KIND = np.full(256, ODD, np.uint8)
KIND[list(b" \t\n\r\x0b\x0c")] = WHITE
KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = LETTER
KIND[list(b"0123456789")] = DIGIT
KIND[list(MARKS)] = MARK
GAP = 0xFFFFFFFF
BLOCKS = "block long, at int, ids binary"


def words_of(run: bytes) -> list[bytes]:
    """The words of a run between white space: letters (A-Z lower-cased), digits and marks, or the run as it is."""
    return [w.lower() for w in PARTS.findall(run)] if SIMPLE.match(run) else [run]


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z lower-cased, and start and end of each word, as ``words_of`` has them."""
    kind = KIND[data]
    solid = kind != WHITE
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    odd = np.concatenate([[0], np.cumsum(kind == ODD)])
    whole = odd[ends] > odd[starts]
    kind[solid] = np.where(np.repeat(whole, ends - starts), ODD, kind[solid])
    low = data + np.where((kind == LETTER) & (data <= 90), 32, 0).astype(np.uint8)
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= kind[1:] != kind[:-1]
    closes[:-1] &= kind[:-1] != kind[1:]
    return low, np.flatnonzero(opens), np.flatnonzero(closes) + 1


_random = np.random.default_rng(1123)
_LANES = [(_random.integers(0, 1 << 64, 256, dtype=np.uint64), np.uint64(int(_random.integers(1 << 62, 1 << 63)) | 1)) for _ in range(2)]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each span, the same wherever its bytes stand."""
    found = []
    for letters, base in _LANES:
        inverse = _powers(np.uint64(pow(int(base), -1, 1 << 64)), len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * _powers(base, len(data)), out=sums[1:])
        x = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        found.append(x ^ x >> np.uint64(29))
    return found


class Vocabulary:
    """The tokenizers library's encoder of one file, and its pieces by id."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.pieces = [self.tokenizer.id_to_token(i) or "" for i in range(size)]

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        return held_in_worker((cls, path), lambda: cls(path))

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]


def check_vocabulary(path: str) -> None:
    """Only vocabularies that lower-case and discard white space encode words independently; others raise."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])}
    if "Lowercase" not in kinds or not spec["model"].get("end_of_word_suffix"):
        raise ValueError("words of this vocabulary are not encoded independently of white space")


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n over all texts of docs(text): counted in each task, then summed by a shuffle."""

    def rows(counted: Counter):
        words: Counter = Counter()
        for run, n in counted.items():
            for word in words_of(run):
                words[word] += n
        pairs = list(words.items())
        for at in range(0, len(pairs), 50_000):
            part = pairs[at : at + 50_000]
            arrays = [pa.array([w.decode("utf-8", "surrogatepass") for w, _ in part]), pa.array([n for _, n in part], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["word", "n"])

    def run(batches):
        drop_held()
        counted: Counter = Counter()
        for batch in small_batches(batches):
            for text in batch.column("text").to_pylist():
                counted.update((text or "").encode("utf-8", "surrogatepass").split())
            if len(counted) > COUNTED:
                yield from rows(counted)
                counted = Counter()
        yield from rows(counted)

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, path: str) -> DataFrame:
    """word, n and ids (little-endian unsigned 32-bit) of each distinct word of docs(text), each encoded once."""

    def run(batches):
        vocabulary = Vocabulary.of(path)
        for batch in small_batches(batches, 4_096):
            ids = vocabulary.encode(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(ids, pa.binary())], names=["word", "n", "ids"])

    return word_counts(docs).mapInArrow(run, "word string, n long, ids binary")


def least_hot(table: DataFrame, most_bytes: int = HOT_BYTES) -> float:
    """The smallest count, in steps of 1/8 power of two, from which on all words of table fit the bytes."""
    step = F.floor(F.log2("n") * 8)
    rows = table.groupBy(step.alias("step")).agg(F.sum(F.length("ids") + 28).alias("bytes")).collect()  # at most 8 * 63 rows
    total, least = 0, float("inf")
    for row in sorted(rows, key=lambda r: -r["step"]):
        total += row["bytes"]
        if total > most_bytes:
            break
        least = row["step"]
    return least


class HotWords:
    """Words by two 64-bit hashes in flat arrays: a lookup is a binary search, and no Python object is kept a word."""

    def __init__(self, words: list[bytes], ids: list[bytes]):
        data = np.frombuffer(b" ".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        first, second = span_hashes(data, starts, starts + sizes)
        order = np.argsort(first)
        self.first, self.second = first[order], second[order]
        lengths = np.array([len(i) // 4 for i in ids], np.int64)[order]
        self.ids = np.concatenate([[GAP], np.frombuffer(b"".join([ids[i] for i in order.tolist()]), "<u4")]).astype("<u4")
        self.lengths, self.starts = lengths, 1 + np.cumsum(lengths) - lengths

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length in ``ids`` of each span's ids; the one gap at 0 for words that are not held."""
        at, size = np.zeros(len(starts), np.int64), np.ones(len(starts), np.int64)
        if len(self.first) and len(starts):
            first, second = span_hashes(data, starts, ends)
            distinct, back = np.unique(first, return_inverse=True)
            place = np.minimum(np.searchsorted(self.first, distinct), len(self.first) - 1)[back]
            ok = (self.first[place] == first) & (self.second[place] == second) & (ends - starts <= HOT_LENGTH)
            at[ok], size[ok] = self.starts[place[ok]], self.lengths[place[ok]]
        return at, size


def hot_words(table: DataFrame, most_bytes: int = HOT_BYTES) -> tuple[HotWords, Column]:
    """The most frequent words of table as far as they fit the bytes, and the condition that a word is one of them."""
    short = F.length(F.col("word").cast("binary")) <= HOT_LENGTH
    least = least_hot(table.where(short), most_bytes)
    if least == float("inf"):
        return HotWords([], []), F.lit(False)
    hot = short & (F.floor(F.log2("n") * 8) >= least)
    rows = table.where(hot).select(F.col("word").cast("binary").alias("word"), "ids").toArrow()
    return HotWords(rows.column("word").to_pylist(), rows.column("ids").to_pylist()), hot


def text_blocks(batches):
    """(keys, texts as bytes) of blocks of neighbouring rows, cut in the same way whenever the same rows come."""
    for batch in small_batches(batches, BLOCK_TEXTS):
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column("_key").to_pylist(), batch.column("text").to_pylist()):
            data = (text or "").encode("utf-8", "surrogatepass")
            if texts and size + len(data) > BLOCK_BYTES:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(key)
            texts.append(data)
            size += len(data)
        if texts:
            yield keys, texts


def _looked_up(batches, hot: HotWords):
    """For each block: keys, bytes, starts and ends of its words, where their ids are, and the words of each text."""
    for keys, texts in text_blocks(batches):
        data, starts, ends = spans(np.frombuffer(b"\n".join(texts), np.uint8))
        at, size = hot.find(data, starts, ends)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        yield keys, data, starts, ends, at, size, np.searchsorted(starts, bounds)


def _cold_rows(docs: DataFrame, hot, name: str) -> DataFrame:
    """word, block, at: the words of docs(_key, text) that are not hot, numbered from 0 in each block."""

    def run(batches):
        held = held_in_worker(("hot", name), lambda: hot.value)
        for keys, data, starts, ends, at, _, _ in _looked_up(batches, held):
            cold, raw = np.flatnonzero(at == 0), data.tobytes()
            words = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[cold].tolist(), ends[cold].tolist())]
            columns = [pa.array(words, pa.string()), pa.array([keys[0]] * len(cold), pa.int64()), pa.array(np.arange(len(cold), dtype=np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "block", "at"])

    return docs.select("_key", "text").mapInArrow(run, "word string, block long, at int")


def _gapped(docs: DataFrame, hot, name: str) -> DataFrame:
    """block, at -1, ids: the ids of a block's texts, packed, with gaps where a word is not hot."""

    def run(batches):
        held = held_in_worker(("hot", name), lambda: hot.value)
        for keys, _, _, _, at, size, words in _looked_up(batches, held):
            ends = np.cumsum(size)
            ids = held.ids[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
            tokens = np.diff(np.concatenate([[0], np.concatenate([[0], ends])[words]]))
            columns = [pa.array([keys[0]], pa.int64()), pa.array([-1], pa.int32()), pa.array([packed(keys, tokens, ids)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "at", "ids"])

    return docs.select("_key", "text").mapInArrow(run, BLOCKS)


def packed(keys: list[int], tokens: np.ndarray, ids: np.ndarray) -> bytes:
    """A block for a shuffle: keys, tokens of each text, its distinct ids from the most frequent one on, and the places
    of its ids among these, low bytes apart from high ones, compressed."""
    import zstandard

    distinct, back, times = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), "<u4")
    rank[order] = np.arange(len(order))
    width = 2 if len(order) <= 1 << 16 else 4
    planes = rank[back].astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    head = np.array([len(keys), len(order), len(ids), width], "<i8").tobytes() + np.array(keys, "<i8").tobytes() + tokens.astype("<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + distinct[order].astype("<u4").tobytes() + planes.tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``packed`` took."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n, kinds, size, width = np.frombuffer(raw, "<i8", 4).tolist()
    keys, tokens = np.frombuffer(raw, "<i8", 2 * n, 32).reshape(2, n)
    distinct = np.frombuffer(raw, "<u4", kinds, 32 + 16 * n)
    planes = np.frombuffer(raw, np.uint8, size * width, 32 + 16 * n + 4 * kinds).reshape(width, size)
    return keys, tokens, distinct[planes.T.copy().view(f"<u{width}").ravel()]


def _filled(batches):
    """key and ids from rows in order of block and place: a block's gapped ids, then the ids for its gaps."""

    def whole(data: bytes, fills: list[bytes]):
        keys, tokens, ids = unpacked(data)
        gaps = np.flatnonzero(ids == GAP)
        if len(gaps) != len(fills):
            raise ValueError("a block's gaps and the words that fill them differ")
        size = np.ones(len(ids), np.int64)
        size[gaps] = [len(f) // 4 for f in fills]
        out = np.repeat(ids, size)
        out[np.repeat(ids == GAP, size)] = np.frombuffer(b"".join(fills), "<u4")
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(tokens)] * 4
        raw, rows = out.tobytes(), []
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            rows.append(raw[a:b])
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rows, pa.binary())], names=["key", "ids"])

    data, fills = None, []
    for batch in batches:
        for at, ids in zip(batch.column("at").to_pylist(), batch.column("ids").to_pylist()):
            if at >= 0:
                fills.append(ids)
                continue
            if data is not None:
                yield whole(data, fills)
            data, fills = ids, []
    if data is not None:
        yield whole(data, fills)


def encode(docs: DataFrame, path: str, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row of docs(doc_id, text)."""
    check_vocabulary(path)
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    table = stored(word_table(rows, path), "words")
    held, is_hot = hot_words(table, hot_bytes)
    hot, name = rows.sparkSession.sparkContext.broadcast(held), uuid.uuid4().hex
    cold = table.where(~is_hot).select("word", "ids")
    fills = _cold_rows(rows, hot, name).join(cold, "word").select("block", "at", "ids")
    parts = _gapped(rows, hot, name).unionByName(fills)
    made = parts.repartition("block").sortWithinPartitions("block", "at").select("at", "ids").mapInArrow(_filled, "key long, ids binary")
    if rows.schema["doc_id"].dataType == rows.schema["_key"].dataType and _same_key(rows):
        return made.select(F.col("key").alias("doc_id"), "ids")
    return made.join(rows.select(F.col("_key").alias("key"), "doc_id"), "key").select("doc_id", "ids")


def _same_key(rows: DataFrame) -> bool:
    """Is the key the doc_id itself? (keyed gives the rows their own ids where these are unique)"""
    return rows.where(~F.col("_key").eqNullSafe(F.col("doc_id"))).isEmpty()


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text: each id joined with its piece, pieces in the order of places.

    The id-to-piece table is that of the vocabulary file and so bounded; it is broadcast as an array, in which an id is
    the place of its piece, so the join is a gather and nothing is shuffled.

    As the library decodes for a vocabulary without decoder: pieces with a space between them, special ones included.
    Ids outside of the vocabulary give nothing. A null list of ids is an empty one.
    """
    held = encoded.sparkSession.sparkContext.broadcast(np.array(Vocabulary(path).pieces, object))

    def run(batches):
        table = held.value
        for batch in small_batches(batches):
            texts = []
            for data in batch.column("ids").to_pylist():
                ids = np.frombuffer(data or b"", "<u4")
                texts.append(" ".join(table[ids[ids < len(table)]].tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""
    made = decode(encode(docs, path), path)
    return made.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
