"""Suffix-array deduplication: removal of repeated byte strings across and within documents.

A byte goes when a ``LENGTH``-byte string that covers it also starts earlier (in a document of smaller id,
or earlier in the same one). Strings are judged on the input.

1. Each task finds the anchored suffixes of its rows (``suffix_runs``): about one place in 20, chosen so
   that equal strings have their anchors at equal places. Runs that repeat within a block of rows are
   decided there, so a passage that very many documents hold leaves one suffix a block.
2. Splitters, sampled from the suffixes of a bounded sample of text, range-partition the suffixes by their
   32 leading bytes, then by the hash of the whole run and by place: so a suffix that very many documents
   share is split like any other. The number of buckets follows from the number of bytes.
3. Each bucket sorts locally by multikey quicksort, eight bytes a key: a key is looked at only where the keys
   before it tie. Of equal runs the earliest stays, the others are repeats as a whole. Suffixes with equal
   leading bytes but different runs are to be compared window by window.
4. A group may go on in the next bucket: the first and the last group of each bucket are compared across
   boundaries, and those that meet are compared window by window, too.
5. The windows of these runs are hashed, in parts of up to 16 windows with the hash of the bytes that these
   share (85 of 100). Equal windows are in parts of equal shared bytes; a part that stands alone is done.
   Parts meet by a shuffle; where more than ``MANY`` share their bytes (a line in very many documents with
   different text around it) single windows are counted instead, by a sum before and after the shuffle.
6. The repeats of each document are united and cut out.

Past the 32 leading bytes, strings are equal when 64-bit hashes are: of the whole run in addition to the 32
bytes, of the window in addition to that of the shared bytes.

Null text counts as empty. Ids that are null or occur twice are ordered by text (null ids first), each row
is a document of its own. Texts shorter than ``LENGTH`` bytes stay whole; very long ones are read in parts.
An empty table gives an empty result. Extra columns are ignored or carried as asked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import drop_held, small_batches, stored, tidied
from corpuslens.llm.suffix_runs import LEADS, LENGTH, SEGMENT, multikey_order, runs, segments, window_parts

BLOCK_BYTES = 1 << 19
#: Bytes of suffixes that a bucket is meant to hold, and bytes of suffixes for a byte of text.
BUCKET_BYTES, SUFFIX_BYTES = 48 << 20, 3
#: Bytes of text from which splitters are sampled: so many at least, and so many a bucket; one suffix in eight is taken.
SAMPLE_BYTES, SAMPLE_BUCKET_BYTES, SAMPLE_STEP = 4 << 20, 5_000, 8
#: Parts with equal shared bytes up to which they are compared in one task.
MANY = 1_000
#: A group that a bucket shows whole is GROUPED; EDGE and MULTI mark its first and last group (of one run, of several).
REPEAT, GROUPED, EDGE, MULTI = 0, 1, 2, 3
#: Runs whose windows a task holds at once: some 25 windows of some 100 bytes of working memory each.
RUNS = 4_000
LEAD = [f"lead{i}" for i in range(LEADS)]
ORDER = [*LEAD, "whole", "key", "start"]
LEAD_TYPES = ", ".join(f"{c} long" for c in LEAD)
SUFFIX = f"bucket int, {LEAD_TYPES}, whole long, key long, start long, windows short, before short, repeat boolean"
MARK = f"kind byte, {LEAD_TYPES}, key long, start long, windows short, before short"
PART = "shared long, key long, start long, place short, hashes array<long>"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with ``_key``: doc_id where ids are unique, else the row's place in (doc_id, text) order."""
    with tidied(docs.sparkSession):
        ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if (ids["most"] or 0) <= 1 and not ids["nulls"]:
        return docs.withColumn("_key", F.col("doc_id").cast("long"))
    ordered = docs.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    return stored(ordered.withColumn("_key", F.monotonically_increasing_id()), "keyed")


def _blocks(batches):
    """(keys, offsets, parts) of about BLOCK_BYTES each."""
    keys, offsets, parts, size = [], [], [], 0
    for batch in small_batches(batches):
        for key, text in zip(batch.column("_key").to_pylist(), batch.column("text").to_pylist()):
            for at, part in segments(_bytes(text)):
                if len(part) >= LENGTH:
                    keys.append(key)
                    offsets.append(at)
                    parts.append(part)
                    size += len(part)
                if size >= BLOCK_BYTES:
                    yield keys, offsets, parts
                    keys, offsets, parts, size = [], [], [], 0
    if parts:
        yield keys, offsets, parts


def _suffixes(keys: list, offsets: list, parts: list) -> dict[str, np.ndarray]:
    found = runs(parts)
    part = found.pop("part")
    found["key"] = np.array(keys, np.int64)[part]
    found["start"] = found["start"] + np.array(offsets, np.int64)[part]
    return found


def _firsts(order: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """For rows in order: does a new value of these columns begin here?"""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return new


def bucket_count(docs: DataFrame) -> tuple[int, int]:
    """How many buckets docs(text) needs, and the bytes of its texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size * SUFFIX_BYTES // BUCKET_BYTES)), size


def splitters(docs: DataFrame, buckets: int, size: int) -> list[np.ndarray]:
    """Bounds between buckets, a column a sort key, from the suffixes of sampled parts of texts (of SEGMENT characters)."""
    share = min(1.0, max(SAMPLE_BYTES, SAMPLE_BUCKET_BYTES * buckets) / max(1, size))
    drawn = lambda i: F.pmod(F.xxhash64("_key", i, F.lit("splitter")), F.lit(1 << 30)) <= int(share * (1 << 30))
    parts = F.filter(F.sequence(F.lit(0), F.floor(F.coalesce(F.length("text"), F.lit(0)) / SEGMENT).cast("int")), drawn)
    chosen = docs.select("_key", "text", F.explode(parts).alias("i"))
    sample = chosen.select("_key", F.substring(F.col("text"), F.col("i") * SEGMENT + 1, F.lit(SEGMENT)).alias("text"))

    def run(batches):
        drop_held()
        for keys, offsets, parts in _blocks(batches):
            s = _suffixes(keys, offsets, parts)
            yield pa.RecordBatch.from_arrays([pa.array(s[c][::SAMPLE_STEP].view(np.int64)) for c in ORDER], names=ORDER)

    rows = sample.mapInArrow(run, ", ".join(f"{c} long" for c in ORDER)).toPandas()
    columns = [_unsigned(c, rows[c].to_numpy(np.int64)) for c in ORDER]
    order = multikey_order(columns)
    cut = order[np.linspace(0, len(order), buckets + 1)[1:-1].astype(int)] if len(order) else order
    return [c[cut] for c in columns]


def _unsigned(name: str, column: np.ndarray) -> np.ndarray:
    return column if name in ("key", "start") else column.view(np.uint64)


def _bucket_of(rows: list[np.ndarray], bounds: list[np.ndarray]) -> np.ndarray:
    """Number of bounds that are at most the row, key by key; a later key is looked at only where bounds tie."""
    low, high = (np.searchsorted(bounds[0], rows[0], side=s) for s in ("left", "right"))
    for row, bound in zip(rows[1:], bounds[1:]):
        tied = np.flatnonzero(high > low)
        first, last = low[tied], high[tied]
        for i in np.unique(first):
            here = tied[first == i]
            end = last[first == i][0]
            low[here], high[here] = (i + np.searchsorted(bound[i:end], row[here], side=s) for s in ("left", "right"))
    return high


def find_suffixes(docs: DataFrame, bounds: list[np.ndarray]) -> DataFrame:
    """The anchored suffixes of docs(_key, text) with their buckets; repeats within a block are flagged."""
    held = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches):
        drop_held()
        for keys, offsets, parts in _blocks(batches):
            s = _suffixes(keys, offsets, parts)
            order = multikey_order([s[c] for c in ORDER])
            repeat = np.zeros(len(order), bool)
            repeat[order] = ~_firsts(order, [s[c] for c in (*LEAD, "whole")])
            bucket = _bucket_of([s[c] for c in ORDER], held.value)
            bucket[repeat] = np.flatnonzero(repeat) % (len(held.value[0]) + 1)  # decided: only passing through
            for c in (*LEAD, "whole"):
                s[c][repeat] = 0
            found = {"bucket": bucket.astype(np.int32), "repeat": repeat} | {c: s[c].astype(np.int16) for c in ("windows", "before")}
            found |= {c: s[c].view(np.int64) for c in ORDER}
            yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in _names(SUFFIX)], names=_names(SUFFIX))

    return docs.select("_key", "text").mapInArrow(run, SUFFIX)


def sort_buckets(suffixes: DataFrame, buckets: int) -> DataFrame:
    """Marks: whole runs that repeat, suffixes whose group needs comparing, and the groups at the ends of each bucket."""

    def run(batches):
        drop_held()
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        col = {c: table.column(c).to_numpy() for c in table.column_names}
        done, rows = np.flatnonzero(col["repeat"]), np.flatnonzero(~col["repeat"])
        c = {k: _unsigned(k, col[k][rows]) for k in ORDER}
        order = multikey_order([c[k] for k in ORDER])
        class_first, group_first = _firsts(order, [c[k] for k in (*LEAD, "whole")]), _firsts(order, [c[k] for k in LEAD])
        heads = np.flatnonzero(class_first)
        group = np.cumsum(group_first) - 1
        size = np.bincount(group[heads], minlength=group[-1] + 1) if len(order) else np.zeros(0, int)
        many = heads[size[group[heads]] > 1]
        ends = np.unique(group[[0, -1]]) if len(order) else np.zeros(0, int)
        edge = heads[np.searchsorted(group[heads], ends)]  # the first run of the first and of the last group
        places = [order[~class_first], order[many], order[edge]]
        kinds = [np.full(len(places[0]), REPEAT), np.full(len(places[1]), GROUPED), np.where(size[ends] > 1, MULTI, EDGE)]
        picked, kind = np.concatenate([*(rows[p] for p in places), done]), np.concatenate([*kinds, np.full(len(done), REPEAT)]).astype(np.int8)
        for at in range(0, len(picked), 100_000):
            p, k = picked[at : at + 100_000], kind[at : at + 100_000]
            leads = [pa.array(np.where(k >= EDGE, col[name][p], 0)) for name in LEAD]
            yield pa.RecordBatch.from_arrays([pa.array(k), *leads, *(pa.array(col[name][p]) for name in _names(MARK)[1 + LEADS :])], names=_names(MARK))

    return suffixes.repartitionById(buckets, F.col("bucket")).mapInArrow(run, MARK)


def grouped_suffixes(marks: DataFrame) -> DataFrame:
    """Suffixes to compare window by window: groups within a bucket, and those that meet across boundaries."""
    columns = ["key", "start", "windows", "before"]
    edges = marks.where(F.col("kind") >= EDGE)  # two rows a bucket at most
    met = edges.groupBy(*LEAD).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*LEAD)
    across = edges.where(F.col("kind") == EDGE).join(met, LEAD, "left_semi")
    return marks.where(F.col("kind") == GROUPED).select(*columns).union(across.select(*columns))


def parts_of_windows(docs: DataFrame, suffixes: DataFrame) -> DataFrame:
    """The windows of the suffixes' runs in parts: shared, key, start (of the first), place (its anchor's distance), hashes."""
    wanted = suffixes.groupBy("key").agg(F.collect_list(F.struct("start", "windows", "before")).alias("wanted"))
    found = docs.select(F.col("_key").alias("key"), "text").join(wanted, "key")

    def run(batches):
        drop_held()
        for batch in small_batches(batches, 128):
            rows, data = [], []
            for key, text, wanted in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                whole = _bytes(text)
                for w in wanted:
                    rows.append((key, w["start"], w["windows"], w["before"]))
                    data.append(whole[w["start"] : w["start"] + w["windows"] + LENGTH - 1])
                    if len(rows) == RUNS:
                        yield told(rows, data)
                        rows, data = [], []
            if rows:
                yield told(rows, data)

    def told(rows, data):
        key, start, windows, before = np.array(rows, np.int64).T
        p = window_parts(windows, before, data)
        run, first = p["run"], p["first"]
        lists = pa.ListArray.from_arrays(pa.array(np.append(p["at"], len(p["hashes"])).astype(np.int32)), pa.array(p["hashes"].view(np.int64)))
        columns = [p["shared"].view(np.int64), key[run], start[run] + first, (before[run] - first).astype(np.int16)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], names=_names(PART))

    return found.mapInArrow(run, PART)


def _repeated_windows(shared, key, start, place, hashes: pa.ListArray):
    """(key, start, windows) of windows that occur earlier within whole groups of equal shared bytes."""
    sizes = np.diff(hashes.offsets.to_numpy())
    value = hashes.flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    k, s, d = key[row], start[row] + step, place[row] - step
    order = np.lexsort((s, k, value, d, shared[row]))
    late = np.sort(order[~_firsts(order, [shared[row], d, value])])  # row by row, place by place
    if not len(late):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16)
    new = np.concatenate([[True], (row[late][1:] != row[late][:-1]) | (step[late][1:] != step[late][:-1] + 1)])
    head = np.flatnonzero(new)
    return k[late[head]], s[late[head]], np.diff(np.concatenate([head, [len(late)]])).astype(np.int16)


def compare_parts(parts: DataFrame) -> DataFrame:
    """key, start, windows of the repeats among parts of which few share their bytes; a group meets in one task."""

    def run(batches):
        drop_held()
        held: list = []

        def flush(batches):
            table = pa.Table.from_batches(batches).combine_chunks()
            shared, key, start, place = (table.column(c).to_numpy().astype(np.int64) for c in _names(PART)[:-1])
            found = _repeated_windows(shared, key, start, place, table.column("hashes").chunk(0))
            return pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["key", "start", "windows"])

        for batch in small_batches(batches, 2 * RUNS):
            shared = batch.column("shared").to_numpy()
            cut = int(np.searchsorted(shared, shared[-1]))  # the last group may go on
            if cut:
                yield flush([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            elif held and held[-1].column("shared")[0].as_py() != int(shared[0]):
                yield flush(held)
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield flush(held)

    return parts.repartition("shared").sortWithinPartitions("shared").mapInArrow(run, "key long, start long, windows short")


def compare_windows(parts: DataFrame) -> DataFrame:
    """key, start, windows (1) of the repeats among parts of which very many share their bytes: equal windows are
    aggregated before they are shuffled, and no group is ever held."""
    at = F.col("i").cast("long")
    each = parts.select("shared", "key", "start", "place", F.posexplode("hashes").alias("i", "hash"))
    each = each.select("shared", "hash", (F.col("place") - at).alias("place"), "key", (F.col("start") + at).alias("start"))
    names = ["shared", "hash", "place"]
    first = each.groupBy(*names).agg(F.min(F.struct("key", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = each.join(first, names).where((F.col("key") != F.col("first.key")) | (F.col("start") != F.col("first.start")))
    return late.select("key", "start", F.lit(1).cast("short").alias("windows"))


def repeats(docs: DataFrame) -> DataFrame:
    """key, spans: for docs(_key, text), runs of repeated windows (start, windows) of each document with any."""
    buckets, size = bucket_count(docs)
    marks = stored(sort_buckets(find_suffixes(docs, splitters(docs, buckets, size)), buckets), "marks")
    parts = stored(parts_of_windows(docs, grouped_suffixes(marks)), "parts")
    shared = stored(parts.groupBy("shared").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    few = parts.join(shared.where(F.col("n") <= MANY), "shared", "left_semi")
    many = parts.join(shared.where(F.col("n") > MANY), "shared", "left_semi")
    compared = stored(compare_parts(few).union(compare_windows(many)), "compared")
    every = marks.where(F.col("kind") == REPEAT).select("key", "start", "windows").union(compared)
    return every.groupBy("key").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))


def united(spans) -> list[tuple[int, int]]:
    """Byte spans [from, to) covered by runs of windows, merged where they touch."""
    out: list[list[int]] = []
    for start, windows in sorted(spans):
        end = start + windows + LENGTH - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def cut_out(docs: DataFrame, found: DataFrame, carry: list[str], as_text: bool = False) -> DataFrame:
    """carry with n_bytes, n_removed, n_spans, kept (bytes left) of each document.

    As text, the pieces of a character that a cut split are dropped.
    """
    at = ["body" if c == "text" else f"c{i}" for i, c in enumerate(carry)]  # the text is sent once
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry) + ", n_bytes long, n_removed long, n_spans long, kept " + ("string" if as_text else "binary")
    left = docs.select(F.col("_key").alias("key"), *[F.col(f"`{c}`").alias(a) for c, a in zip(carry, at)], *([] if "text" in carry else [F.col("text").alias("body")]))

    def run(batches):
        drop_held()
        for batch in small_batches(batches, 256):
            out = []
            for text, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist()):
                data = _bytes(text)
                gone = united([(s["start"], s["windows"]) for s in spans or ()])
                kept, last = [], 0
                for a, b in gone:
                    kept.append(data[last:a])
                    last = b
                kept.append(data[last:])
                rest = b"".join(kept)
                out.append((len(data), sum(b - a for a, b in gone), len(gone), rest.decode("utf-8", "ignore") if as_text else rest))
            n, removed, count, kept = zip(*out)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in at), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary())], names=[*carry, "n_bytes", "n_removed", "n_spans", "kept"])

    return left.join(found, "key", "left").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """carry (default: doc_id), n_bytes, n_removed, n_spans and kept, what is left as bytes or as text."""
    rows = keyed(docs)
    return cut_out(rows, repeats(rows.select("_key", "text")), carry or ["doc_id"], as_text)

