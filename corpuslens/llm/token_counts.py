"""Exact token counts of every prefix by dynamic programming over byte-pair encodings.

A byte-pair encoding is determined by its last tokens: the encoding of a prefix ends in the one token t
for which the encoding of the shorter prefix before t, followed by t, is a valid encoding, and validity is
a property of neighbouring tokens (their joint bytes encode to just these two). So ``count[i] =
count[i - len(t)] + 1`` runs over the bytes once. The text is first cut where the pre-tokenizer always
cuts (before a space that follows a non-space); the table of each distinct chunk is made once a worker.

The table of a text is stored as one signed byte for each byte of UTF-8: the change of the count at that
place. Its running sum is the count of every prefix, so truncation and budget questions need no second
encoding: see ``count_at`` and ``longest_within``. Inside a character the count covers its bytes so far.

Null and empty texts have no tokens. Special strings count as the library's default has it: one token.
Repeated rows are counted each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import RecentCache, held_in_worker, small_batches, spaced_chunks

#: Fixed value: the pre-tokenization pattern of this family of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = {"'re", "'ve", "'ll"}


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary file: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixTable:
    """Prefix counts for one byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.vocab = {raw(t) for t in spec["model"]["vocab"] if t not in self.specials}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.vocab))
        self.words, self.space = regex.compile(WORDS), regex.compile(r"\s+")
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.joins, self.heads, self.tails = {}, RecentCache(), RecentCache()
        self.short, self.before = {}, (b"", [0], [b""])

    @classmethod
    def of(cls, path: str) -> "PrefixTable":
        return held_in_worker((cls, path), lambda: cls(path))

    def merged(self, data: bytes) -> list[bytes]:
        """The tokens of a few bytes, by merging the pair of lowest rank first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def neighbours(self, a: bytes, b: bytes) -> bool:
        key = (a, b)
        known = self.joins.get(key)
        if known is None:
            if len(self.joins) > 2_000_000:
                self.joins.clear()
            known = self.joins[key] = self.merged(a + b) == [a, b]
        return known

    def counts(self, word: bytes) -> list[int]:
        """Tokens of each prefix of one pre-token, the empty one included.

        Goes on from the prefix that it shares with the word before; short words are remembered.
        """
        n = len(word)
        if n < 4:
            known = self.short.get(word)
            if known is None:
                known = self.short[word] = self._extend(word, 0, [0] * (n + 1), [b""] * (n + 1))[0]
            return known
        before, count, last = self.before
        shared = 0
        for a, b in zip(before, word):
            if a != b:
                break
            shared += 1
        count, last = self._extend(word, shared, count[: shared + 1] + [0] * (n - shared), last[: shared + 1] + [b""] * (n - shared))
        self.before = (word, count, last)
        return count

    def _extend(self, word: bytes, done: int, count: list[int], last: list[bytes]) -> tuple[list[int], list[bytes]]:
        vocab, longest, joins, neighbours = self.vocab, self.longest, self.joins, self.neighbours
        for i in range(done + 1, len(word) + 1):
            for at in range(i - longest if i > longest else 0, i):
                token = word[at:i]
                if token in vocab:
                    if at == 0:
                        count[i], last[i] = 1, token
                        break
                    fits = joins.get((last[at], token))
                    if fits or (fits is None and neighbours(last[at], token)):
                        count[i], last[i] = count[at] + 1, token
                        break
        return count, last

    def changes(self, chunk: str) -> bytes:
        """Changes of the count at each byte of a chunk."""
        out, base, before = [0], 0, ""
        for word in self.words.findall(chunk):
            data = word.encode("utf-8", "surrogatepass")
            count = self.counts(data)
            at = len(out)
            out += [base + c for c in count[1:]]
            if before and word[0].isspace() and before.isspace():  # a prefix that ends here has one run of white space
                head = (before + word[0]).encode()
                for k, c in enumerate(self.counts(head)[len(before.encode()) + 1 :]):
                    out[at + k] = base - self.counts(before.encode())[-1] + c
            if word in CONTRACTIONS:  # a prefix that ends before the last letter is no contraction yet
                out[at + 1] = base + self.counts(data[:1])[-1] + self.counts(data[1:2])[-1]
            base, before = base + count[-1], word
        return bytes([b - a & 255 for a, b in zip(out, out[1:])])

    def sorted_changes(self, chunks: list[str], opening: str) -> list[bytes]:
        """Changes of many chunks, made in sorted order so that shared beginnings are done once."""
        out = [b""] * len(chunks)
        for i in sorted(range(len(chunks)), key=chunks.__getitem__):
            out[i] = self.changes(opening + chunks[i])
        return out

    def ordinary(self, texts: list[str]) -> list[bytes]:
        """Changes for texts without special strings."""
        parts = [spaced_chunks(t) for t in texts]
        tails = self.tails.fill({c for p in parts for c in p[1:]}, lambda cs: self.sorted_changes(cs, " "))
        heads = self.heads.fill({p[0] for p in parts}, lambda cs: self.sorted_changes(cs, ""))
        return [heads[p[0]] + b"".join([tails[c] for c in p[1:]]) for p in parts]

    def whole(self, text: str) -> bytes:
        """Changes for a text with special strings: until its last letter, one reads as ordinary text."""
        pieces, out, at_end = self.special.split(text), [], 0
        for i in range(0, len(pieces), 2):
            if i + 1 == len(pieces):
                out.append(self.ordinary([pieces[i]])[0])
                break
            read = np.frombuffer(self.ordinary([pieces[i] + pieces[i + 1][:-1]])[0], np.int8)
            at_end = int(np.frombuffer(self.ordinary([pieces[i]])[0], np.int8).sum()) + 1
            out += [read.tobytes(), np.int8(at_end - int(read.sum())).tobytes()]
        return b"".join(out)

    def of_texts(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        odd = {i for i, t in enumerate(texts) if self.special and self.special.search(t)}
        plain = iter(self.ordinary([t for i, t in enumerate(texts) if i not in odd]))
        return [self.whole(t) if i in odd else next(plain) for i, t in enumerate(texts)]


def count_at(changes: bytes, n_bytes: int) -> int:
    """Tokens of the first n_bytes bytes."""
    return int(np.frombuffer(changes, np.int8)[:n_bytes].sum(dtype=np.int64))


def longest_within(changes: bytes, budget: int) -> int:
    """The most bytes whose tokens fit the budget (adding a byte can also lower the count)."""
    fits = np.flatnonzero(np.frombuffer(changes, np.int8).cumsum(dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_bytes (longest prefix within the limit) and prefix_changes.

    No shuffle: one pass over the scan.
    """

    def run(batches):
        table = PrefixTable.of(tokenizer_path)
        for batch in small_batches(batches):
            changes = table.of_texts(batch.column("text").to_pylist())
            arrays = [np.frombuffer(c, np.int8) for c in changes]
            total = [int(a.sum(dtype=np.int64)) for a in arrays]
            cut = [len(c) if n <= limit else longest_within(c, limit) for c, n in zip(changes, total)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(c) for c in changes], pa.int64()), pa.array(total, pa.int64()), pa.array([n > limit for n in total]), pa.array(cut, pa.int64()), pa.array(changes, pa.binary())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes", "prefix_changes"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long, prefix_changes binary")
