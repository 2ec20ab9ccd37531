"""Best-fit packing of token sequences: linear grouping, configurations, substitution, best fit.

Documents are tokenized once; every document longer than the capacity is cut into full pieces, of which
the first may be shorter. The plan is made from the histogram of piece lengths alone (at most ``capacity``
rows, whatever the corpus size):

1. Pieces longer than ``small`` are ordered by length and dealt into groups of equal cardinality; each
   length counts as the largest of its group (linear grouping).
2. Column generation over these few sizes (the pricing problem is a bounded-capacity knapsack) chooses
   configurations, that is, multisets of sizes filling one sequence; whole multiples are used.
3. The real lengths of each group are substituted in order, which leaves room where a length was rounded up.
4. What is left over and the small pieces go to the fullest sequence that still takes them (best fit,
   longest first); new sequences open when none does.

All four steps handle runs of equal sequences, so their cost depends on the number of distinct lengths and
not on the number of documents. The result is a table of runs (length, ranks from..to -> sequences, offset);
each piece finds its place by its length and its rank among the pieces of that length. Ranks are a number
within the scan task plus the count of that length in the tasks before, so no task sees all pieces of a
frequent length.

Null text counts as empty (a document of the end id alone). Repeated rows are packed as separate documents.
An empty table gives an empty result. Null ids are kept. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import ChunkEncoder, small_batches, stored

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, local_rank long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and the piece's rank among those of its length in its task."""

    def run(batches):
        encoder, seen = ChunkEncoder.of(tokenizer_path), defaultdict(int)
        task, end = TaskContext.get().partitionId(), int(end_id).to_bytes(4, "little")
        for batch in small_batches(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist())):
                ids += end
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - start - 1) % capacity + 1 if start == 0 else capacity
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            if rows:
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                names = [c.split()[0] for c in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, PIECES)


# ---------------------------------------------------------------- plan on the histogram


def _knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The configuration of largest value: how often each size is used."""
    width, least = np.array(sizes), min(sizes)
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(width)
    width, worth = width[order], np.asarray(values)[order]
    fits = np.searchsorted(width, np.arange(capacity + 1), side="right")
    for room in range(least, capacity + 1):
        best[room] = best[room - 1]
        gain = best[room - width[: fits[room]]] + worth[: fits[room]]
        j = int(gain.argmax())
        if gain[j] > best[room] + 1e-12:
            best[room], choice[room] = gain[j], order[j]
    uses, room = [0] * len(sizes), capacity
    while room > 0:
        j = choice[room]
        if j < 0:
            room -= 1
        else:
            uses[j] += 1
            room -= sizes[j]
    return float(best[capacity]), uses


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 100) -> list[tuple[list[int], int]]:
    """Configurations and how often each is used, never more of a size than its demand.

    Linear relaxation by column generation, rounded down; the caller places what is left over.
    """
    m = len(sizes)
    if not m:
        return []
    columns = [[capacity // sizes[i] if i == j else 0 for j in range(m)] for i in range(m)]
    basis, need = np.array(columns, dtype=float).T, np.array(demand, dtype=float)
    used = need / np.diag(basis)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        used = inverse @ need
        worth = np.ones(m) @ inverse
        gain, column = _knapsack(sizes, np.maximum(worth, 0), capacity)
        if gain <= 1 + 1e-7:
            break
        step = inverse @ np.array(column, dtype=float)
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        columns[leave] = column
        basis[:, leave] = column
    left, plan = list(demand), []
    for i in np.argsort(-used):
        fits = [left[j] // c for j, c in enumerate(columns[i]) if c]
        times = min(int(used[i] + 1e-6), *fits) if fits else 0
        if times > 0:
            plan.append((columns[i], times))
            left = [a - c * times for a, c in zip(left, columns[i])]
    return plan


def plan_runs(histogram: dict[int, int], capacity: int = 1024, groups: int = 64, small: int | None = None, tight: float = 0.0) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank_from, rank_to, first_sequence, per_sequence, offset).

    The pieces of ``length`` with ranks in [rank_from, rank_to) go, per_sequence at a time, to consecutive
    sequences from first_sequence, the first of each at ``offset``. Configurations that fill less than
    ``tight`` of a sequence are not used; their pieces are left to the best fit.
    """
    small = capacity // 8 if small is None else small
    runs: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[list[int]]] = defaultdict(list)  # free tokens -> [first sequence, count]
    nxt, taken = 0, defaultdict(int)
    if histogram.get(capacity):
        runs.append((capacity, 0, histogram[capacity], 0, 1, 0))
        nxt = taken[capacity] = histogram[capacity]
    large = [(n, histogram[n]) for n in sorted(histogram, reverse=True) if small < n < capacity and histogram[n] > 0]
    total = sum(c for _, c in large)
    # groups: (rounded size, [[length, count left], ...]), of equal cardinality, longest first
    grouped: list[tuple[int, list[list[int]]]] = []
    per, filled = -(-total // max(1, groups)), 0
    for n, c in large:
        while c:
            if not grouped or filled >= per:
                grouped.append((n, []))
                filled = 0
            part = min(c, per - filled)
            grouped[-1][1].append([n, part])
            filled, c = filled + part, c - part
    merged: dict[int, list[list[int]]] = {}
    for size, members in grouped:  # groups that were rounded to one size are one size
        merged.setdefault(size, []).extend(members)
    sizes = list(merged)
    demand = [sum(c for _, c in merged[s]) for s in sizes]
    for column, times in configurations(sizes, demand, capacity):
        slots = [s for s, uses in zip(sizes, column) for _ in range(uses)]
        if sum(slots) < tight * capacity:
            continue
        # substitution: each slot takes the next members of its group; a segment ends where a length ends
        picks = []
        for s in slots:
            pick, want = [], times
            members = merged[s]
            while want:
                n, c = members[0]
                part = min(c, want)
                pick.append((n, taken[n], part))
                taken[n] += part
                want -= part
                if part == c:
                    members.pop(0)
                else:
                    members[0][1] -= part
            picks.append(pick)
        edges = sorted({0, times, *(e for p in picks for e in np.cumsum([x[2] for x in p]).tolist())})
        for a, b in zip(edges, edges[1:]):
            offset = 0
            for pick in picks:
                at = 0
                for n, rank, part in pick:
                    if at <= a < at + part:
                        runs.append((n, rank + a - at, rank + b - at, nxt + a, 1, offset))
                        offset += n
                        break
                    at += part
            room[capacity - offset].append([nxt + a, b - a])
        nxt += times
    rest: dict[int, int] = defaultdict(int)
    for members in merged.values():
        for n, c in members:
            rest[n] += c
    for n, c in histogram.items():
        if n <= small and n < capacity:
            rest[n] += c
    frees = sorted(room)
    for n in sorted(rest, reverse=True):
        left = rest[n]
        while left:
            i = bisect.bisect_left(frees, n)
            if i == len(frees):
                per_sequence = capacity // n
                opened = max(1, left // per_sequence)
                free, first, count = capacity, nxt, opened
                nxt += opened
            else:
                free = frees[i]
                first, count = room[free].pop()
                if not room[free]:
                    del room[free], frees[i]
            k = min(free // n, left)
            use = min(count, left // k)
            runs.append((n, taken[n], taken[n] + use * k, first, k, capacity - free))
            taken[n] += use * k
            left -= use * k
            for f, seq, cnt in ((free - k * n, first, use), (free, first + use, count - use)):
                if cnt and f:
                    if f not in room:
                        bisect.insort(frees, f)
                    room[f].append([seq, cnt])
    return runs


def sequences_of(runs: list[tuple[int, int, int, int, int, int]]) -> int:
    """How many sequences a plan uses."""
    return max((first - (lo - hi) // per for _, lo, hi, first, per, _ in runs), default=0)


def best_plan(histogram: dict[int, int], capacity: int = 1024) -> list[tuple[int, int, int, int, int, int]]:
    """The plan of fewest sequences over a small grid of group counts and fill bounds of configurations."""
    plans = [plan_runs(histogram, capacity, groups, tight=tight) for groups in (32, 64) for tight in (0.98, 0.995, 1.0)]
    return min(plans, key=sequences_of)


# ---------------------------------------------------------------- operator


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece."""
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    runs = best_plan(histogram, capacity)
    ahead = by_task.withColumn("ahead", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n"))
    ranked = pieces.join(ahead.select("length", "task", "ahead"), ["length", "task"]).withColumn("rank", F.col("local_rank") + F.col("ahead"))
    placed = place(ranked, runs)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def place(ranked: DataFrame, runs: list) -> DataFrame:
    """sequence_id and offset of each piece by its length and rank: a search among its length's runs.

    The runs are broadcast: their number follows the number of distinct lengths and groups, not the rows.
    """
    starts: dict[int, list] = defaultdict(list)
    for r in sorted(runs):
        starts[r[0]].append(r[1:])
    found = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for n, rows in starts.items()}
    held = ranked.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for part in np.split(order, cuts):
                if not len(part):
                    continue
                lo, _, first, per, base = held.value[int(length[part[0]])]
                i = np.searchsorted(lo, rank[part], side="right") - 1
                within = rank[part] - lo[i]
                sequence[part] = first[i] + within // per[i]
                offset[part] = base[i] + within % per[i] * length[part]
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long")
