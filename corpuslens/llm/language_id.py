"""Language identification by prediction with partial matching over bytes.

For each language a tree of byte contexts up to ``order`` bytes holds how often each byte followed. A byte
that its context has seen is coded with c/(n+q) (c: times seen, n: all, q: distinct bytes); an unseen one
pays the escape q/(n+q) and goes to the next shorter context, at last to a uniform 1/256. Statistics are
frozen after fitting, so the code length of a text is a sum of table entries: the trees of all languages
share one trie, each node holding the code length of its last byte in every language, escapes included.
The language with the shortest code wins; ``score`` is its share of 2^-length over the languages.

Fitting reads a bounded sample: about ``rows_per_language`` labelled rows of each language, chosen by a hash
of doc_id (documented bound; the model's size follows from it). Scoring covers every whole text.

Null texts and texts without a letter get ``und`` and score 0. Null languages are not learned from. Without
any labelled row every prediction is ``und``. Ties go to the language that sorts first. Repeated rows are
scored each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import drop_held, small_batches, split_bucket

BLOCK = 1 << 18


class ContextTrees:
    """The frozen statistics of all languages in one trie."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = 3):
        self.order = order
        self.languages = sorted(samples)
        count = len(self.languages)
        joined = {k: np.frombuffer(b"\xff".join(v), np.uint8) for k, v in samples.items()}  # 0xFF is in no UTF-8 text
        used = np.unique(np.concatenate([np.zeros(0, np.uint8), *joined.values()]))
        used = used[used != 255]
        self.code = np.zeros(256, np.uint8)  # 0: a byte never seen, or the end of a text
        self.code[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        # one level a length: keys are parent node * width + symbol, counted by language
        levels, parents, size = [], {k: np.zeros(len(a), np.int64) for k, a in joined.items()}, 1
        symbols = {k: self.code[a].astype(np.int64) for k, a in joined.items()}
        for n in range(1, order + 2):
            keys = {}
            for k, s in symbols.items():
                last = s[n - 1 :]
                node = parents[k][: len(last)]
                keys[k] = np.where((last > 0) & (node >= 0), node * width + last, -1)
            found = np.unique(np.concatenate([np.zeros(0, np.int64), *[x[x >= 0] for x in keys.values()]]))
            counts = np.zeros((len(found), count))
            for j, k in enumerate(self.languages):
                at = np.searchsorted(found, keys[k][keys[k] >= 0])
                counts[:, j] = np.bincount(at, minlength=len(found))
                place = np.searchsorted(found, keys[k])
                parents[k] = np.where(keys[k] >= 0, place + size, -1)
            levels.append((found, counts, size))
            size += len(found)
        self.child = np.zeros((size, width), np.int32)  # node 0 is the root and also "no such node": it has no parent
        for found, _, first in levels:
            self.child[found // width, found % width] = np.arange(first, first + len(found))
        # bits[node]: code length of the node's last byte after the ones before; escape[node]: as a context
        bits, escape = np.zeros((size, count), np.float32), np.zeros((size, count), np.float32)
        for found, counts, first in levels:
            parent, symbol = found // width, found % width
            lo, hi = (parent.min(), parent.max() + 1) if len(parent) else (0, 0)
            total, kinds = np.zeros((hi - lo, count)), np.zeros((hi - lo, count))
            np.add.at(total, parent - lo, counts)
            np.add.at(kinds, parent - lo, counts > 0)
            seen = total > 0
            escape[lo:hi] = np.where(seen, -np.log2(np.where(seen, kinds, 1) / np.where(seen, total + kinds, 1)), 0)
            own = -np.log2(np.where(counts > 0, counts, 1) / np.maximum(total + kinds, 1)[parent - lo])
            shorter = np.full((len(found), count), 8.0)
            if first > 1:
                shorter = bits[self.child[self.shorter[parent], symbol]]
            bits[first : first + len(found)] = np.where(counts > 0, own, escape[parent] + shorter)
            self._suffixes(found, first, width)
        self.bits, self.escape, self.other = bits, escape, escape[0] + 8.0

    def _suffixes(self, found: np.ndarray, first: int, width: int) -> None:
        """Remember, for each new node, the node of its bytes without the first one."""
        if first == 1:
            self.shorter = np.zeros(len(self.child), np.int64)
            return
        parent, symbol = found // width, found % width
        self.shorter[first : first + len(found)] = self.child[self.shorter[parent], symbol]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        k = self.order
        for block in range(0, len(data), BLOCK):
            raw = data[max(0, block - k) : block + BLOCK]
            lead = block - max(0, block - k)
            s = self.code[raw]
            nodes, node = [None], np.zeros(len(s), np.int32)
            for n in range(1, k + 2):
                node = self.child[node[: len(s) - n + 1] if n > 1 else node, s[n - 1 :]]
                if n > 1:
                    node[nodes[-1][: len(node)] == 0] = 0
                nodes.append(node)
            acc = np.zeros((len(s), len(self.languages)), np.float32)
            rest = np.flatnonzero(raw != 255)
            rest = rest[rest >= lead]
            for n in range(k + 1, 0, -1):
                start = rest - (n - 1)
                inside = start >= 0
                node = np.zeros(len(rest), np.int32)
                node[inside] = nodes[n][start[inside]]
                hit = node > 0
                acc[rest[hit]] += self.bits[node[hit]]
                miss = rest[~hit]
                if n == 1:
                    acc[miss] += self.other
                else:
                    context = np.zeros(len(miss), np.int32)
                    ok = inside[~hit]
                    context[ok] = nodes[n - 1][start[~hit][ok]]
                    acc[miss] += np.where((context > 0)[:, None], self.escape[context], 0)
                rest = miss
            first, last = np.searchsorted(ends, block, side="right"), np.searchsorted(ends, min(block + BLOCK, len(data)) - 1, side="right")
            seg = np.concatenate([[lead], ends[first:last] - block + lead]).astype(np.int64)
            out[first : last + 1] += np.add.reduceat(acc.astype(np.float64), seg)
        return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(docs: DataFrame, rows_per_language: int = 300, order: int = 3) -> ContextTrees:
    """Fit on about so many rows (doc_id, text, lang) of each language, chosen by a hash of doc_id."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 20))
    keep = F.lit(False)
    for lang, n in totals.items():
        keep = keep | ((F.col("lang") == lang) & (draw <= F.lit(int(min(1.0, rows_per_language / n) * (1 << 20)))))
    samples: dict[str, list[bytes]] = {}
    for r in labelled.where(keep).select("lang", "text").toLocalIterator() if totals else []:
        if has_letter(r["text"]):
            samples.setdefault(r["lang"], []).append(r["text"].encode("utf-8", "surrogatepass"))
    return ContextTrees(samples, order)


def predict(docs: DataFrame, model: ContextTrees, carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry`` (default: doc_id) with lang_pred, score and bits_per_byte. One pass, no shuffle."""
    carry = carry or ["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c].simpleString().split(":", 1)[1] for c in carry]
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(carry, fields)) + ", lang_pred string, score double, bits_per_byte double"
    at = ["body" if c == "text" else f"c{i}" for i, c in enumerate(carry)]  # the text is sent once

    def run(batches):
        drop_held()
        trees = held.value
        for batch in small_batches(batches, 256):
            texts = batch.column("body").to_pylist()
            known = [bool(trees.languages) and has_letter(t) for t in texts]
            data = [t.encode("utf-8", "surrogatepass") for t, k in zip(texts, known) if k]
            bits = trees.code_lengths(data) if data else np.zeros((0, 1))
            best = bits.argmin(axis=1)
            low = bits[np.arange(len(best)), best]
            share = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
            found = iter([(trees.languages[b], float(p), float(m / len(d))) for b, p, m, d in zip(best, share, low, data)])
            rows = [next(found) if k else ("und", 0.0, 0.0) for k in known]
            lang, score, rate = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in at), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=[*carry, "lang_pred", "score", "bits_per_byte"])

    sent = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(carry, at)], *([] if "text" in carry else [F.col("text").alias("body")]))
    return sent.mapInArrow(run, schema)


def identify(docs: DataFrame, fold: int = 2, folds: int = 4, rows_per_language: int = 300, order: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; rows of the held-out fold are not learned from."""
    model = fit(docs.where(split_bucket("doc_id", folds) != fold), rows_per_language, order)
    scored = predict(docs.withColumn("held_out", split_bucket("doc_id", folds) == fold), model, ["doc_id", "held_out"])
    return scored
