"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item contributes its windows of ``window`` consecutive words (a shorter item is one window). To occur in
a document, a window must have all its shingles of ``shingle`` words there; ordered by rarity, the rarest
one is a sufficient prefix at full containment. So each window is filed under its rarest shingle, and a
document looks up its own shingles: a hit names candidate windows and the place they would start at. The
bounds are positional (the window must start at or after the first word and, by its length, end by the
last), and surviving candidates are verified byte by byte.

Rarity is measured: one pass counts the benchmark's shingles over all documents (one row a shingle and
task, added up by a shuffle). The second pass looks up and verifies. Both look at words as arrays of hashes;
hashes only propose.

Items are normalised and cut on Spark: a long item becomes parts that overlap by a window, so a part is of
bounded size and each window lies in one part. Parts are dealt by hash into blocks, the sizes of the blocks
are checked (a block above twice ``block_bytes`` makes the number of blocks double), and one block at a time
comes to the driver, is indexed and broadcast: about 50 bytes for each word of a block of at most twice
``block_bytes`` of text, whatever the benchmark's size. A larger benchmark takes more passes over the
documents, whose hits are united. Hit words of overlapping windows count once.

Null and empty texts have no words: no hits, and an item without words has no window. Equal items with one id
count once, with different ids each; repeated documents keep a row each. Very long texts are searched in
parts that overlap by a window. With an empty benchmark all documents are clean. Extra columns are ignored or
carried as asked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import drop_held, small_batches, stored
from corpuslens.llm.suffix_runs import prefix_sums, span_hash

#: Bytes that separate words become spaces, capitals A-Z become small letters.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK_BYTES = 4 << 20
#: Words of an item's part, words of a document that are searched at once, bytes of documents that are hashed at once.
PART_WORDS, SPAN_WORDS, HASH_BYTES = 20_000, 50_000, 1 << 19
SPANS = "array<struct<a:long,b:long>>"
FOUND = f"n_words long, spans {SPANS}, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def _pieces(words: list[bytes], size: int, window: int):
    """(place of the first word, words) of parts; each window of these words starts in exactly one part."""
    for at in range(0, max(1, len(words) - window + 1), size):
        yield at, words[at : at + size + window - 1]


class Words:
    """Word lists joined by single spaces in one buffer, with the hashes of their runs of words."""

    def __init__(self, lists: list[list[bytes]]):
        joined = [b" ".join(words) for words in lists]
        self.data = b" ".join(joined)
        size = np.array([len(w) for words in lists for w in words], np.int64)
        self.count = np.array([len(words) for words in lists], np.int64)
        # an empty list stands for a word of no bytes, so that each list has its place in the buffer
        gaps = np.array([len(j) for j in joined], np.int64)
        base = np.cumsum(gaps + 1) - gaps - 1
        own = np.cumsum(self.count) - self.count
        inner = np.cumsum(size + 1) - size - 1
        filled = self.count > 0
        shift = np.zeros(len(lists), np.int64)
        shift[filled] = base[filled] - inner[own[filled]]
        self.list = np.repeat(np.arange(len(lists)), self.count)
        self.start = inner + shift[self.list]
        self.end = self.start + size
        self.place = np.arange(len(size)) - own[self.list]
        self.sums = prefix_sums(np.frombuffer(self.data, np.uint8))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words at which k words of one list begin, and the hashes of these runs."""
        first = np.flatnonzero(self.place + k <= self.count[self.list])
        return first, span_hash(self.sums, self.start[first], self.end[first + k - 1])


class Windows:
    """The distinct windows of a block of items (item, words), as spans of one buffer, filed by shingle."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = 10, shingle: int = 3):
        held = Words([words for _, words in items])
        self.data, self.names = held.data, sorted({item for item, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        owner = np.array([number[item] for item, _ in items], np.int64)
        size = np.minimum(window, held.count)[held.list]
        first = np.flatnonzero(held.place + size <= held.count[held.list])
        size = size[first]
        value = span_hash(held.sums, held.start[first], held.end[first + size - 1])
        order = np.lexsort((first, value))
        same = np.concatenate([[False], value[order][1:] == value[order][:-1]]) if len(order) else np.zeros(0, bool)
        text = lambda i: self.data[held.start[first[i]] : held.end[first[i] + size[i] - 1]]
        for i in np.flatnonzero(same).tolist():  # equal hashes: equal windows but for chance
            same[i] = text(order[i]) == text(order[i - 1])
        group = np.cumsum(~same) - 1
        head = order[~same]
        self.begin, self.finish = held.start[first[head]], held.end[first[head] + size[head] - 1]
        self.size = size[head].astype(np.int16)
        pair = np.unique(np.stack([group, owner[held.list[first[order]]]]), axis=1) if len(order) else np.zeros((2, 0), np.int64)
        self.owners, self.owned = pair[1].astype(np.int32), np.searchsorted(pair[0], np.arange(len(head) + 1))
        # shingles of each window: its number, the place in it, the hash
        self.shingles: dict[int, np.ndarray] = {}
        parts = []
        for n in np.unique(self.size).tolist():
            k = min(shingle, n)
            rows = np.flatnonzero(self.size == n)
            for at in range(n - k + 1):
                word = first[head[rows]] + at
                parts.append((k, rows, np.full(len(rows), at), span_hash(held.sums, held.start[word], held.end[word + k - 1])))
        for k in sorted({p[0] for p in parts}):
            self.shingles[k] = np.stack([np.concatenate([p[i] for p in parts if p[0] == k]).astype(np.uint64) for i in (1, 2, 3)])
        self.filed: dict[int, tuple] = {}

    def known(self) -> dict[int, np.ndarray]:
        """The distinct shingles by their number of words."""
        return {k: np.unique(s[2]) for k, s in self.shingles.items()}

    def file(self, seen: dict[int, tuple[np.ndarray, np.ndarray]]) -> "Windows":
        """File each window under its rarest shingle, by counts of known shingles (hashes, counts); ties go to the first."""
        for k, (window, at, value) in self.shingles.items():
            token, count = seen.get(k, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            place = np.minimum(np.searchsorted(token, value), max(0, len(token) - 1))
            often = np.where(token[place] == value, count[place], 0) if len(token) else np.zeros(len(value), np.int64)
            order = np.lexsort((at, value, often, window))
            best = order[np.concatenate([[True], window[order][1:] != window[order][:-1]])]
            best = best[np.argsort(value[best], kind="stable")]
            self.filed[k] = value[best], at[best].astype(np.int64), window[best].astype(np.int64)
        self.shingles = {}
        return self

    def search(self, lists: list[list[bytes]]) -> list[tuple[np.ndarray, list[int]]]:
        """For each list the spans [from, to) of occurring windows, and the numbers of the items that own one."""
        docs = Words(lists)
        spans, items = [[] for _ in lists], [set() for _ in lists]
        for k, (token, at, window) in self.filed.items():
            word, value = docs.runs(k)
            low, high = (np.searchsorted(token, value, side=s) for s in ("left", "right"))
            hit = np.flatnonzero(high > low)
            times = (high - low)[hit]
            filed = np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            start, number = np.repeat(word[hit], times) - at[filed], window[filed]
            of, size = docs.list[np.repeat(word[hit], times)], self.size[number].astype(np.int64)
            # the window must start and end in the list, and be as long
            ok = (start >= 0) & (docs.list[np.maximum(start, 0)] == of)
            last = start + size - 1
            ok &= (last < len(docs.list)) & (docs.list[np.minimum(last, max(0, len(docs.list) - 1))] == of)
            start, number, of, last = start[ok], number[ok], of[ok], last[ok]
            ok = docs.end[last] - docs.start[start] == self.finish[number] - self.begin[number]
            for s, n, d, e in zip(*(x[ok].tolist() for x in (start, number, of, last))):
                if docs.data[docs.start[s] : docs.end[e]] == self.data[self.begin[n] : self.finish[n]]:
                    place = int(docs.place[s])
                    spans[d].append((place, place + e - s + 1))
                    items[d].update(self.owners[self.owned[n] : self.owned[n + 1]].tolist())
        return list(zip(spans, items))


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def item_parts(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id (as text) and body (words joined by spaces) of the parts of each item; equal ones once."""

    def run(batches):
        for batch in small_batches(batches):
            out = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                out += [(item or "", b" ".join(p)) for _, p in _pieces(words, PART_WORDS, window)] if words else []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ((), ()), (pa.string(), pa.binary()))], names=["item_id", "body"])

    named = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return named.mapInArrow(run, "item_id string, body binary").distinct()


def item_blocks(benchmark: DataFrame, window: int, block_bytes: int):
    """The items (id, words) of each block in turn; only one block is at the driver at a time."""
    parts = stored(item_parts(benchmark, window), "items")
    bytes_of = F.sum(F.octet_length("body")).alias("size")
    total = parts.agg(bytes_of, F.max(F.octet_length("body")).alias("most")).first()
    if not total["size"]:
        return
    blocks = -(-total["size"] // block_bytes)
    block = lambda: F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)).alias("block")
    while parts.groupBy(block()).agg(bytes_of).agg(F.max("size")).first()[0] > max(2 * block_bytes, total["most"]):
        blocks *= 2
    for b in range(blocks):
        rows = parts.where(block() == b).collect()
        if rows:
            yield [(r["item_id"], bytes(r["body"]).split(b" ")) for r in rows]


def _lists(batch, column: str, window: int):
    """(row, place of the first word, number of words of the row, words) of some rows at a time."""
    held, size = [], 0
    for row, text in enumerate(batch.column(column).to_pylist()):
        words = words_of(text)
        for at, part in _pieces(words, SPAN_WORDS, window):
            held.append((row, at, len(words), part))
            size += sum(map(len, part)) + len(part)
            if size >= HASH_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _counted(docs: DataFrame, known: dict[int, np.ndarray], window: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """How often the documents hold each known shingle: sorted hashes and counts, by number of words."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def tally(batches):
        drop_held()
        seen = {k: np.zeros(len(v), np.int64) for k, v in held.value.items()}
        for batch in small_batches(batches):
            for lists in _lists(batch, "body", 1):
                words = Words([x[3] for x in lists])
                for k, token in held.value.items():
                    _, value = words.runs(k)
                    at = np.minimum(np.searchsorted(token, value), len(token) - 1)
                    np.add.at(seen[k], at[token[at] == value], 1)
        for k, count in seen.items():
            used = np.flatnonzero(count)
            columns = [pa.array(np.full(len(used), k, np.int32)), pa.array(held.value[k][used].view(np.int64)), pa.array(count[used])]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "token", "n"])

    found = docs.select(F.col("text").alias("body")).mapInArrow(tally, "k int, token long, n long")
    rows = found.groupBy("k", "token").agg(F.sum("n").alias("n")).toPandas()  # at most one row a shingle of the block
    out = {}
    for k, part in rows.groupby("k"):
        token, n = part["token"].to_numpy(np.int64).view(np.uint64), part["n"].to_numpy(np.int64)
        order = np.argsort(token)
        out[int(k)] = token[order], n[order]
    held.unpersist()
    return out


def _hits(docs: DataFrame, block: list, window: int, shingle: int, carry: list[str], all_rows: bool = True) -> DataFrame:
    """carry, n_words, spans and items of each document (or of each with a hit) for one block."""
    filed = Windows(block, window, shingle)
    ready = docs.sparkSession.sparkContext.broadcast(filed.file(_counted(docs, filed.known(), window)))
    at = ["body" if c == "text" else f"c{i}" for i, c in enumerate(carry)]  # the text is sent once
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry) + f", {FOUND}"
    span_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def look_up(batches):
        drop_held()
        for batch in small_batches(batches):
            n, spans, items = ([make() for _ in range(batch.num_rows)] for make in (int, list, set))
            for lists in _lists(batch, "body", window):
                for (row, place, words, _), (found, owners) in zip(lists, ready.value.search([x[3] for x in lists])):
                    n[row] = words
                    spans[row] += [(a + place, b + place) for a, b in found]
                    items[row] |= owners
            names = ready.value.names
            told = [[{"a": a, "b": b} for a, b in _united(s)] for s in spans]
            owned = [[names[i] for i in sorted(x)] for x in items]
            columns = [*(batch.column(c) for c in at), pa.array(n, pa.int64()), pa.array(told, span_type), pa.array(owned, pa.list_(pa.string()))]
            made = pa.RecordBatch.from_arrays(columns, names=[*carry, "n_words", "spans", "items"])
            yield made if all_rows else made.filter(pa.array([bool(s) for s in spans], pa.bool_()))

    sent = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(carry, at)], *([] if "text" in carry else [F.col("text").alias("body")]))
    return sent.mapInArrow(look_up, schema)


def leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None
) -> DataFrame:
    """carry (default: doc_id), n_words, spans (united hit spans of words) and items (sorted ids) of each document."""
    carry = carry or ["doc_id"]
    blocks = item_blocks(benchmark, window, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _hits(docs, first, window, shingle, carry)
    numbered = stored(docs.select(*carry, *([] if "text" in carry else ["text"]), F.monotonically_increasing_id().alias("_row")), "numbered")
    every = stored(_hits(numbered, first, window, shingle, ["_row"]), "hits")
    for block in (second, *blocks):
        every = every.unionByName(stored(_hits(numbered, block, window, shingle, ["_row"], all_rows=False), "hits"))
    merged = every.groupBy("_row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("raw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    # spans of different blocks may overlap: each goes on with the last one, or opens a new one
    last = lambda done: F.element_at(done, -1)
    on = lambda done, s: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["a"].alias("a"), F.greatest(last(done)["b"], s["b"]).alias("b"))))
    step = lambda done, s: F.when((F.size(done) > 0) & (s["a"] <= F.try_element_at(done, F.lit(-1))["b"]), on(done, s)).otherwise(F.concat(done, F.array(s)))
    united = F.when(F.size("raw") == 0, F.col("raw")).otherwise(F.aggregate("raw", F.slice("raw", 1, 1), step))
    return numbered.select(*carry, "_row").join(merged, "_row").select(*carry, "n_words", united.alias("spans"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = leaks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window, shingle, block_bytes)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["b"] - s["a"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
