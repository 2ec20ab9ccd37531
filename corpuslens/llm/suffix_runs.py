"""Anchored suffixes of byte strings: the numeric half of the suffix-array deduplication.

Every window of ``LENGTH`` bytes has an anchor: the place of its smallest hashed ``GRAM``-byte string (the
leftmost of equals). Which place that is depends on the window's bytes alone, so equal windows have the same
anchor at the same distance, and only suffixes that start at anchors need sorting: about one in 20.
Neighbouring windows with one anchor form a run; a run of n windows covers n + LENGTH - 1 bytes.

Windows whose anchors stand STRIDE places apart or less share at least LENGTH - STRIDE + 1 bytes around the
anchor: the windows of a run come in parts (a part a stride of distances), and equal windows are in parts
whose shared bytes are equal.
"""

from __future__ import annotations

import numpy as np

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM + 1  # GRAM-byte strings inside a window
LEADS = GRAM // 8  # eight bytes of a suffix are one sort key
STRIDE = 16
SHARED = LENGTH - STRIDE + 1
SEGMENT = 1 << 19
PLACE = np.uint64((1 << 24) - 1)
_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; grown in doublings and kept."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any span of data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of data[start:end], the same wherever these bytes stand."""
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start])


def segments(data: bytes):
    """(offset, bytes) parts of one text; each window of the text starts in exactly one part."""
    for at in range(0, max(1, len(data) - LENGTH + 1), SEGMENT):
        yield at, data[at : at + SEGMENT + LENGTH - 1]


def runs(parts: list[bytes]) -> dict[str, np.ndarray]:
    """The runs of some parts: part (its number), start (of the first window, in the part), windows, before
    (bytes from the start to the anchor), lead0 to lead3 (the GRAM bytes at the anchor, eight to an unsigned number
    whose order is that of the bytes) and whole (hash of all bytes that the run covers)."""
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(parts), np.uint8)
    n = len(data)
    leads = [f"lead{i}" for i in range(LEADS)]
    none = {k: np.zeros(0, np.uint64) for k in (*leads, "whole")} | {k: np.zeros(0, np.int64) for k in ("part", "start", "windows", "before")}
    if n < LENGTH:
        return none
    sums = prefix_sums(data)
    at = np.arange(n - GRAM + 1)
    grams = mix((sums[GRAM:] - sums[: n - GRAM + 1]) * _power(_INVERSE, n + 1)[: n - GRAM + 1])
    low = grams & ~PLACE | at.astype(np.uint64)
    span = 1
    while span * 2 <= REACH:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    extra = REACH - span
    low = np.minimum(low[: len(low) - extra], low[extra:])
    # windows that lie within one part
    starts = np.concatenate([np.arange(e - s, e - LENGTH + 1) for s, e in zip(sizes, ends) if s >= LENGTH]) if (sizes >= LENGTH).any() else np.zeros(0, np.int64)
    if not len(starts):
        return none
    anchor = (low[starts] & PLACE).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    s, a = starts[first], anchor[first]
    count = np.diff(np.concatenate([first, [len(starts)]]))
    part = np.searchsorted(ends, s, side="right")
    lead = np.lib.stride_tricks.sliding_window_view(data, GRAM)[a].view(">u8").astype(np.uint64)
    whole = span_hash(sums, s, s + count + LENGTH - 1) ^ mix(((a - s) << 8 | count).astype(np.uint64) * _BASE)
    found = {"part": part, "start": s - (ends - sizes)[part], "windows": count, "before": a - s, "whole": whole}
    return found | {k: np.ascontiguousarray(lead[:, i]) for i, k in enumerate(leads)}


def window_parts(windows: np.ndarray, before: np.ndarray, data: list[bytes]) -> dict[str, np.ndarray]:
    """The windows of runs (their bytes in data) in parts: run (its number), first (number of the part's first
    window in the run), size, shared (hash of the bytes that all windows of the part share, and its stride), and
    the hashes of all windows, run by run, with their count before each part."""
    sums = prefix_sums(np.frombuffer(b"".join(data), np.uint8))
    sizes = np.array([len(d) for d in data], np.int64)
    base = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(windows)), windows)
    step = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = base[row] + step
    value = span_hash(sums, at, at + LENGTH)
    stride = (before[row] - step) // STRIDE
    head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (stride[1:] != stride[:-1])])) if len(row) else np.zeros(0, np.int64)
    of, k = row[head], stride[head]
    left = base[of] + before[of] - k * STRIDE
    shared = span_hash(sums, left, left + SHARED) ^ mix((k + 1).astype(np.uint64) * _BASE)
    return {"run": of, "first": step[head], "size": np.diff(np.concatenate([head, [len(row)]])), "shared": shared, "hashes": value, "at": head}




def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Sorted order of rows by columns in turn: a later column is looked at only where the earlier ones tie."""
    order = np.argsort(columns[0], kind="stable")
    group = np.concatenate([[0], np.cumsum(np.diff(columns[0][order]) != 0)]) if len(order) else order
    for column in columns[1:]:
        if not len(order):
            break
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        part = order[rows]
        again = np.lexsort((column[part], group[rows]))
        order[rows] = part[again]
        value = column[order]
        group = np.concatenate([[0], np.cumsum((group[1:] != group[:-1]) | (value[1:] != value[:-1]))])
    return order
