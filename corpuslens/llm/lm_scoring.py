"""Language-model scores: a subword lattice whose unigram pieces weight all segmentations of a text.

The vocabulary is an existing sentencepiece file. Its scores are merge ranks, taken as Zipf weights 1/(rank+1).
Byte pieces reach every string. The marginal probability of a word sums over all its segmentations by forward
recursion in log space. No piece spans a word boundary, so the lattice of a text factors at its words; the
probability of a text is the product over its words. The end of a text is a token of its own.

``lattice_score`` is this marginal by the given scores alone. ``score`` is the learned model: one expectation
step over all training words (forward-backward on each distinct word, weighted by its count) gives the piece
probabilities, and a word seen in training is one more path: p(w) = (c(w) + s * lattice(w)) / (N + s), where s,
the mass of new words, is the number of training words seen once (Good-Turing). So counts decide the score of a
word that training texts hold, the lattice that of all others.

Spark does the counting: each task counts words of its rows (flushed at a bound), a shuffle adds them up.
Words that make up at least 1/HOT of all tokens (at most HOT of them, whatever the corpus; long ones go by
their digest) are broadcast; every other word of a document is joined with the table of distinct words, where
by construction no key is frequent. Sums return per document.

Null and empty texts have the end token only. With no training rows all counts are 0 (s is then 1). Repeated
rows are scored each by itself. A very long word goes through the lattice in blocks. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import copy
import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import small_batches, split_bucket, stored

#: A word with at least this part of all tokens is broadcast: at most so many words.
HOT = 1 << 15
#: Words of more bytes than this are known by their digest in the broadcast table.
DIGEST_BYTES = 64
#: A task's counts are given out at so many distinct words or bytes of text.
FLUSH, FLUSH_BYTES = 400_000, 1 << 25
#: Longer words go through the lattice one by one, BLOCK places at a time.
LONG, BLOCK = 512, 1 << 14
FIXED = 1 << 20
#: log10 of a word's base, model and lattice probability.
SCORES = ["base", "own", "sub"]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hot_key(word: bytes) -> bytes:
    """The key of a word in the broadcast table; no word holds a space."""
    return word if len(word) <= DIGEST_BYTES else b" " + hashlib.md5(word).digest()


class PieceLattice:
    """Unigram pieces in a byte trie; forward and backward sums over many words at once."""

    def __init__(self, path: str, expected: dict[int, float] | None = None):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        names, ranks = [], []
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i):
                continue
            piece = sp.id_to_piece(i)
            data = bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()
            # white space only opens a word; capitals never occur in lower-cased words
            if data[1:].find(b" ") >= 0 or data == b" " or any(65 <= c <= 90 for c in data):
                if not sp.is_byte(i) or data in (b" ",) or 65 <= data[0] <= 90:
                    continue
            names.append((i, data))
            ranks.append(sp.get_piece_size() if sp.is_byte(i) else max(0.0, -sp.get_score(i)))
        # a word opens with a space: single bytes also exist in that form, so that every word has a path
        size = sp.get_piece_size()
        names += [(size + b, b" " + bytes([b])) for b in range(256)]
        ranks += [size] * 256
        self.ids, self.share = np.array([i for i, _ in names]), 1.0 / (np.array(ranks) + 1.0)
        self.share /= self.share.sum()
        nodes: dict[bytes, int] = {b"": 0}
        edges, self.at = [], {}
        for k, (_, data) in enumerate(names):
            for end in range(1, len(data) + 1):
                head = data[:end]
                if head not in nodes:
                    nodes[head] = len(nodes) + 1  # 1 is the dead node
                    edges.append((nodes[head[:-1]], head[-1], nodes[head]))
            # equal bytes under two ids (a character and its byte piece): one edge with both masses
            self.at.setdefault(nodes[data], []).append(k)
        total = len(nodes) + 1
        self.child = np.ones((total, 256), np.int32)
        a, b, c = np.array(edges).T
        self.child[a, b] = c
        self.piece = np.full(total, -1)
        for node, ks in self.at.items():
            self.piece[node] = ks[0]
        self.deepest = max(len(d) for _, d in names)
        self._weigh(self.share if expected is None else self._learned(expected))

    def _learned(self, expected: dict[int, float]) -> np.ndarray:
        """Expected uses, with a hundredth of their mass spread by the given scores."""
        return np.array([expected.get(i, 0.0) for i in self.ids.tolist()]) + self.share * max(1.0, 0.01 * sum(expected.values()))

    def _weigh(self, weight: np.ndarray) -> None:
        log = np.log(weight / weight.sum())
        self.logp = np.full(len(self.child), -np.inf)
        for node, ks in self.at.items():
            self.logp[node] = np.logaddexp.reduce(log[ks])

    def learned(self, expected: dict[int, float]) -> PieceLattice:
        """The same trie with the piece probabilities of these expected uses."""
        other = copy.copy(self)
        other._weigh(self._learned(expected))
        return other

    def _edges(self, words: np.ndarray):
        """(start, end, nodes) of every span that is a piece in some of the equally long words."""
        n = words.shape[1]
        for i in range(n):
            node = np.zeros(len(words), np.int32)
            for end in range(i + 1, min(n, i + self.deepest) + 1):
                node = self.child[node, words[:, end - 1]]
                if not (node > 1).any():
                    break
                yield i, end, node

    def forward(self, words: np.ndarray) -> np.ndarray:
        """log marginal of each prefix of equally long words (rows of bytes, opening space included)."""
        alpha = np.full((words.shape[1] + 1, len(words)), -np.inf)
        alpha[0] = 0
        for i, end, node in self._edges(words):
            alpha[end] = np.logaddexp(alpha[end], alpha[i] + self.logp[node])
        return alpha

    def expected(self, words: np.ndarray, counts: np.ndarray, into: np.ndarray) -> None:
        """Add the expected uses of each piece, weighted by counts."""
        if words.shape[1] > LONG:
            for word, count in zip(words, counts):
                self._expected_long(word, float(count), into)
            return
        n, alpha = words.shape[1], self.forward(words)
        beta = np.full((n + 1, len(words)), -np.inf)
        beta[n] = 0
        spans = list(self._edges(words))
        for i, end, node in reversed(spans):
            beta[i] = np.logaddexp(beta[i], self.logp[node] + beta[end])
        for i, end, node in spans:
            p = self.piece[node]
            ok = (p >= 0) & np.isfinite(alpha[i]) & np.isfinite(beta[end])
            np.add.at(into, p[ok], counts[ok] * np.exp(alpha[i][ok] + self.logp[node][ok] + beta[end][ok] - alpha[n][ok]))

    def _spans(self, word: np.ndarray, low: int, high: int) -> np.ndarray:
        """Nodes of the spans of one word that start at low to high-1: a row a start, a column a length."""
        node = np.zeros(high - low, np.int32)
        out = np.ones((high - low, self.deepest), np.int32)
        for k in range(min(self.deepest, len(word) - low)):
            last = word[low + k : high + k]
            node = self.child[node[: len(last)], last]
            out[: len(node), k] = node
        return out

    def _log_sums(self, word: np.ndarray, backward: bool) -> np.ndarray:
        """log sums over the segmentations of each prefix of one long word (or of the suffix from each place).

        A place needs the sums of the ``deepest`` places before it only; they are kept scaled.
        """
        n, d = len(word), self.deepest
        value, shift = np.zeros(n + 1), np.zeros(n + 1)
        value[0], state, scale = 1.0, np.zeros(d), 0.0
        state[0] = 1.0  # the sums of the nearest d places, nearest first
        for low in range(0, n, BLOCK):
            high = min(n, low + BLOCK)
            if backward:  # places n-1-low down to n-high: spans that start there
                chance = np.exp(self.logp[self._spans(word, n - high, n - low)])[::-1]
            else:  # places low+1 to high: spans that end there, by length
                first = max(0, low + 1 - d)
                spans = np.exp(self.logp[self._spans(word, first, high)])
                chance = np.zeros((high - low, d))
                for k in range(d):
                    start = np.arange(low, high) - k
                    ok = start >= 0
                    chance[ok, k] = spans[start[ok] - first, k]
            for r in range(high - low):
                now = float(chance[r] @ state)
                state[1:] = state[:-1]
                state[0] = now
                value[low + r + 1], shift[low + r + 1] = now, scale
                if (low + r) % 8 == 7 and (most := state.max()) > 0:
                    state /= most
                    scale += math.log(most)
        with np.errstate(divide="ignore"):
            out = np.log(value) + shift
        return out[::-1] if backward else out

    def _expected_long(self, word: np.ndarray, count: float, into: np.ndarray) -> None:
        alpha, beta = self._log_sums(word, False), self._log_sums(word, True)
        for low in range(0, len(word), BLOCK):
            high = min(len(word), low + BLOCK)
            node = self._spans(word, low, high)
            end = np.minimum(np.arange(low, high)[:, None] + np.arange(1, self.deepest + 1), len(word))
            uses = np.exp(alpha[low:high, None] + self.logp[node] + beta[end] - alpha[-1])
            at = node[uses > 0]
            np.add.at(into, self.piece[at], count * uses[uses > 0])

    @staticmethod
    def by_length(words: list[bytes], most: int = 4096):
        """(row numbers, matrix of bytes) of words of one length, the opening space added."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            size = len(words[order[at]])
            cap, end = max(1, min(most, (1 << 20) // (size + 1))), at
            while end < len(order) and end - at < cap and len(words[order[end]]) == size:
                end += 1
            rows = order[at:end]
            yield rows, np.frombuffer(b"".join(b" " + words[i] for i in rows), np.uint8).reshape(len(rows), size + 1)
            at = end

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word, summed over all segmentations."""
        out = np.zeros(len(words))
        for rows, data in self.by_length(words):
            last = self.forward(data)[-1] if data.shape[1] <= LONG else np.array([self._log_sums(w, False)[-1] for w in data])
            out[rows] = last / math.log(10)
        return out


def count_words(docs: DataFrame) -> DataFrame:
    """word, c (training rows), c_all: over the words of all rows of docs(text, train)."""

    def run(batches):
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        size = 0

        def flush():
            words = list(seen[True].keys() | seen[False].keys())
            if words:
                c, other = ([seen[t][w] for w in words] for t in (True, False))
                columns = [pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array(map(sum, zip(c, other)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "c", "c_all"])
            seen[True].clear()
            seen[False].clear()

        for batch in small_batches(batches):
            for text, train in zip(batch.column("text").to_pylist(), batch.column("train").to_pylist()):
                seen[train].update(words_of(text))
                size += len(text or "")
                if len(seen[True]) + len(seen[False]) > FLUSH or size > FLUSH_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    parts = docs.select("text", "train").mapInArrow(run, "word binary, c long, c_all long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


def learn_pieces(counts: DataFrame, model_path: str) -> dict[int, float]:
    """Expected uses of each piece over the training words; at most one row a piece comes to the driver."""

    def run(batches):
        lattice = PieceLattice(model_path)
        total = np.zeros(len(lattice.ids))
        for batch in small_batches(batches, 50_000):
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            for rows, data in lattice.by_length(words):
                lattice.expected(data, c[rows].astype(float), total)
        used = np.flatnonzero(total)
        uses = pa.array(np.round(total[used] * FIXED), pa.int64(), safe=False)
        yield pa.RecordBatch.from_arrays([pa.array(lattice.ids[used], pa.int64()), uses], names=["piece", "uses"])

    found = counts.where("c > 0").select("word", "c").mapInArrow(run, "piece long, uses long")
    uses = F.sum(F.col("uses").cast("decimal(38,0)")).cast("double").alias("uses")
    return {r["piece"]: r["uses"] / FIXED for r in found.groupBy("piece").agg(uses).collect()}


def score(docs: DataFrame, model_path: str, fold: int = 2, folds: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (split_bucket("doc_id", folds) != fold).alias("train"))
    counts = stored(count_words(rows), "words")
    ends = rows.where("train").count()
    of = lambda c, name: F.sum(c).alias(name)
    s = counts.agg(of("c", "n"), of("c_all", "n_all"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    n, v, new = (s["n"] or 0) + ends, (s["v"] or 0) + (ends > 0), float(max(1, s["once"] or 0))
    weights = spark.sparkContext.broadcast(learn_pieces(counts, model_path))  # at most one entry a piece of the vocabulary

    def lattice(batches):
        given = PieceLattice(model_path)
        model = given.learned(weights.value)
        for batch in small_batches(batches, 50_000):
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float)
            base = np.log10((c + 1) / (n + v + 1))
            with np.errstate(divide="ignore", under="ignore"):
                own = np.logaddexp(np.log(c), np.log(new) + model.marginals(words) * math.log(10)) / math.log(10) - math.log10(n + new)
            columns = [*(batch.column(k) for k in ("word", "c", "c_all")), *map(pa.array, (base, own, given.marginals(words)))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "c", "c_all", *SCORES])

    table = stored(counts.mapInArrow(lattice, "word binary, c long, c_all long, " + ", ".join(f"{k} double" for k in SCORES)), "scored-words")
    least = max(2, -(-(s["n_all"] or 0) // HOT))
    key = F.when(F.octet_length("word") <= DIGEST_BYTES, F.col("word")).otherwise(F.concat(F.lit(b" "), F.unhex(F.md5("word"))))
    frequent = table.where(F.col("c_all") >= least).select(key.alias("key"), (F.col("c") > 0).cast("int").alias("known"), *SCORES)
    hot = spark.sparkContext.broadcast({bytes(r[0]): tuple(r)[1:] for r in frequent.collect()})  # at most HOT entries
    end = (int(ends > 0), math.log10((ends + 1) / (n + v + 1)), math.log10((ends + 1) / (n + new + 1)))
    end = np.array([*end, end[2]])
    told = ["row", "word", "k", "doc_id", "held_out", "n_tokens", "known", *[f"{k}_hot" for k in SCORES]]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.float64()] * len(SCORES)]
    types = ["long", "binary", "long", "long", "boolean", "long", "long", *["double"] * len(SCORES)]

    def split(batches):
        """A row for each document with the sums over frequent words, and a row for each of its other words."""
        known_words, task, at = hot.value, TaskContext.get().partitionId() << 40, 0
        for batch in small_batches(batches, 256):
            out: list[tuple] = []
            for doc_id, text, train in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "train"))):
                words, row = words_of(text), task + at
                at += 1
                known, base, own, sub = end.tolist()
                for word, k in Counter(words).items():
                    got = known_words.get(word if len(word) <= DIGEST_BYTES else hot_key(word))
                    if got is None:
                        out.append((row, word, k, *[None] * (len(told) - 3)))
                    else:
                        known, base, own, sub = known + k * got[0], base + k * got[1], own + k * got[2], sub + k * got[3]
                out.append((row, b" %d" % row, 0, doc_id, not train, len(words) + 1, int(known), base, own, sub))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=told)

    parts = rows.mapInArrow(split, ", ".join(f"{c} {t}" for c, t in zip(told, types)))
    met = parts.join(table.select("word", "c", *SCORES), "word", "left")
    whole = lambda c: F.max(f"{c}_hot") + F.sum(F.coalesce(F.col("k") * F.col(c), F.lit(0.0)))
    return met.groupBy("row").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")],
        (F.max("known") + F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        whole("base").alias("base_score"), whole("own").alias("score"), whole("sub").alias("lattice_score"),
    ).drop("row")
