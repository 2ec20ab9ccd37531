"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits by majority over the hashes of word shingles. Two fingerprints link when at most
``BUDGET`` bits differ. Equal fingerprints are one class from the start, so only distinct ones are compared.

Candidates: the 64 bits are a ring of five segments. If at most three bits differ, the ring has a segment from
which the differing bits of every chain of consecutive segments stay within the chain's share of the budget
(length * 3 / 5, rounded down: 0, 1, 1, 2, 3 bits). The index holds the first chains: at each start, the first
segment must be equal, and the next two differ in one bit at most, so that of their four halves three are
equal. That makes four keys a start, 20 a fingerprint, of 31 to 33 bits, which at random hardly meet. Two
fingerprints that meet are taken on chain by chain: the bits of three, of four, and only then of all segments.

Buckets are read in key order; inside one, links are found by search from a start to the fingerprints not
yet reached, so a bucket of n gives at most n-1 links however many pairs it holds. The links have the same
components as all pairs would have. A bucket of more than ``LARGE`` fingerprints is dealt by each half of the
segments that its key leaves open, as one of these four halves at least is equal: so its cost is not the square
of its size even if few of them link. A bucket holds distinct fingerprints only (8 bytes each), never documents.

Null and empty texts have no words and fingerprint zero, which links like any other. Repeated rows and ties
keep their row; very long texts are read whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import drop_held, small_batches, stored
from corpuslens.llm.components import components

#: Bounds of the five segments, from the low bit.
SEGMENTS = [(0, 13), (13, 26), (26, 39), (39, 52), (52, 64)]
BUDGET = 3
#: The halves of each segment.
HALVES = [((a, (a + b) // 2), ((a + b) // 2, b)) for a, b in SEGMENTS]
LARGE = 2_048


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """The XXH64 (seed 42) of each word shingle in turn; a shorter text is one shingle, one without words has none."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    k, digest = min(words, len(tokens)), xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as an unsigned number."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority bits over the XXH64 (seed 42) of word shingles; bits are taken as an unsigned number."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry`` (default: doc_id) and fp, the fingerprint as a signed long. No shuffle."""
    carry = carry or ["doc_id"]
    at = [f"c{i}" for i in range(len(carry))]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry) + ", fp long"

    def run(batches):
        drop_held()
        for batch in small_batches(batches):
            fp = np.array([fingerprint(t, words) for t in batch.column("body").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in at), pa.array(fp)], names=[*carry, "fp"])

    return docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(carry, at)], F.col("text").alias("body")).mapInArrow(run, schema)


def _choices() -> list[tuple[int, list[tuple[int, int]]]]:
    """(start, bits that are equal) of each key: the start's segment and three of the halves of the next two."""
    m, out = len(SEGMENTS), []
    for start in range(m):
        halves = [*HALVES[(start + 1) % m], *HALVES[(start + 2) % m]]
        for left_out in range(4):
            out.append((start, [SEGMENTS[start], *(h for i, h in enumerate(halves) if i != left_out)]))
    return out


CHOICES = _choices()
#: A key is the number of its choice above so many bits.
KEY_BITS = 34


def keys(fp: DataFrame) -> DataFrame:
    """A row (key, fp) for each choice of equal bits; the key is the number of the choice and these bits."""
    rows = []
    for i, (_, parts) in enumerate(CHOICES):
        key, place = F.lit(i << KEY_BITS).cast("long"), KEY_BITS
        for a, b in parts:
            place -= b - a
            bits = F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1))
            key = key.bitwiseOR(F.shiftleft(bits, place))
        rows.append(key)
    return fp.select("fp", F.explode(F.array(*rows)).alias("key"))


def chains(differ: np.ndarray, start: int, budget: int = BUDGET) -> np.ndarray:
    """Which differences pass the pigeonring filter from a start: every chain from there keeps to its share.

    Chains are taken on one segment at a time, and only where the ones before kept to theirs.
    """
    m, flat, at, total = len(SEGMENTS), differ.ravel(), None, np.uint8(0)
    for length in range(1, m + 1):
        a, b = SEGMENTS[(start + length - 1) % m]
        left = flat if at is None else flat[at]
        total = total + np.bitwise_count(left & np.uint64((1 << b) - (1 << a)))
        ok = total * m <= length * budget
        at, total = np.flatnonzero(ok) if at is None else at[ok], total[ok]
        if not len(at):
            break
    passes = np.zeros(flat.shape, bool)
    passes[at] = True
    return passes.reshape(differ.shape)


def bucket_links(bucket: np.ndarray, start: int, budget: int = BUDGET) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect a bucket's fingerprints as all pairs that pass the filter from start would: at most n-1."""
    left, out = bucket, []
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            block = max(1, (1 << 18) // len(left))
            now, frontier = frontier[:block], frontier[block:]
            i, j = np.nonzero(chains(now[:, None] ^ left[None, :], start, budget))
            j, first = np.unique(j, return_index=True)
            i = i[first]
            if len(j):
                out.append((now[i], left[j]))
                frontier = np.concatenate([frontier, left[j]])
                left = np.delete(left, j)
    return out


def dealt_links(bucket: np.ndarray, choice: int, budget: int = BUDGET) -> list[tuple[np.ndarray, np.ndarray]]:
    """bucket_links; a large bucket is dealt by the four halves of the two last segments, one of which is equal."""
    start, m = CHOICES[choice][0], len(SEGMENTS)
    if len(bucket) <= LARGE:
        return bucket_links(bucket, start, budget)
    out = []
    for a, b in (*HALVES[(start + 3) % m], *HALVES[(start + 4) % m]):
        value = bucket >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)
        order = np.argsort(value, kind="stable")
        for part in np.split(bucket[order], np.flatnonzero(np.diff(value[order])) + 1):
            if len(part) > 1:
                out += bucket_links(part, start, budget)
    return out


def links(fp: DataFrame, budget: int = BUDGET) -> DataFrame:
    """u, v: links among the distinct fingerprints of fp(fp) with the components of all pairs within budget."""
    if budget > BUDGET:
        raise ValueError(f"the index holds the chains of at most {BUDGET} differing bits")
    bucketed = keys(fp).repartition("key").sortWithinPartitions("key")

    def run(batches):
        drop_held()

        def of(key: np.ndarray, fps: np.ndarray):
            starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            found = []
            pair = starts[sizes == 2]
            made = key[pair] >> KEY_BITS
            for choice in np.unique(made).tolist():
                here = pair[made == choice]
                ok = chains(fps[here] ^ fps[here + 1], CHOICES[choice][0], budget)
                found.append((fps[here[ok]], fps[here[ok] + 1]))
            more = sizes > 2
            for at, size, choice in zip(starts[more].tolist(), sizes[more].tolist(), (key[starts[more]] >> KEY_BITS).tolist()):
                found += dealt_links(fps[at : at + size], choice, budget)
            u, v = (np.concatenate([np.zeros(0, np.uint64), *(f[k] for f in found)]).view(np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        held: list = []  # a bucket may go on in the next batch
        for batch in batches:
            key, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut == 0 and (not held or held[-1][0][-1] == key[-1]):
                held.append((key, fps))
                continue
            held.append((key[:cut], fps[:cut]))
            yield of(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            held = [(key[cut:], fps[cut:])]
        if held:
            yield of(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    return bucketed.select("key", "fp").mapInArrow(run, "u long, v long")


def classes(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """fp, root: the class of each distinct fingerprint of prints(fp)."""
    distinct = stored(prints.select("fp").distinct(), "fingerprints")
    roots = components(links(distinct, budget))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component)."""
    prints = stored(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words), "prints")
    # smallest doc_id by fingerprint, then by component: both sums shrink before they are shuffled
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    tagged = stored(lowest.join(classes(prints, budget), "fp"), "classes")
    by_root = tagged.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = tagged.join(by_root, "root").select("fp", "component_id")
    return prints.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
