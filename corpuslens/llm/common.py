"""Helpers shared by the training-data operators: scratch tables and cached tokenization.

Scratch tables are Parquet folders below ``spark.checkpoint.dir``. That folder is shared by all
executors, so a table written there survives the loss of any of them and cuts the lineage. The
folders are removed when the JVM ends.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from array import array
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: With this set, a query's shuffle files go when it ends: a stored table does not need them any more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Chunks that one Python worker remembers; the older half goes when this is reached.
CACHE_ENTRIES = 1_000_000


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a folder of this machine only in local mode without that setting (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "corpuslens-checkpoints")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


@contextmanager
def tidied(spark: SparkSession):
    """The shuffle files of queries that are run in here go when these end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def stored(df: DataFrame, name: str, paths: list | None = None) -> DataFrame:
    """Write df as a scratch table and read it back: computed once, cheap to read again, lineage cut.

    ``paths`` gets the table's path, for ``remove_path`` once nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    if paths is not None:
        paths.append(path)
    with tidied(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def split_bucket(key: str, modulus: int):
    """crc32(key as text) mod modulus, the fold rule of the learned operators; a null key is the text ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def table_dir(sf_dir: str, table: str) -> str:
    return f"{sf_dir.rstrip('/')}/{table}.parquet"


class RecentCache:
    """A dict with bounded size: two generations, of which the older is dropped when the newer is full."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.half = max(1, entries // 2)
        self.new: dict = {}
        self.old: dict = {}

    def fill(self, keys: set, make) -> dict:
        """A dict that has every key of keys; make(list of missing keys) yields their values."""
        if len(self.new) > self.half:
            self.old, self.new = self.new, {}
        missing = keys - self.new.keys()
        if missing and self.old:
            for key in missing & self.old.keys():
                self.new[key] = self.old[key]
            missing -= self.new.keys()
        if missing:
            order = list(missing)
            self.new.update(zip(order, make(order)))
        return self.new


_held: dict = {}


def held_in_worker(key: object, make):
    """make(), kept over this worker's tasks until another key is asked for: a worker serves several operators
    in turn, and the caches of one must not stay beside the working memory of the next."""
    if key not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        if make is None:
            return None
        _held[key] = make()
    return _held[key]


def drop_held() -> None:
    """For tasks that keep nothing: give back what earlier tasks of this worker kept."""
    held_in_worker(None, None)


#: A space after a character that no Unicode definition calls white space.
SPACE_AFTER_WORD = re.compile(r"(?<=\S) ")
#: White space before a space: a plain split at spaces would break a run of white space.
WHITE_RUN = re.compile(r"\s ")
#: Marks that close a word: neither letters, digits nor white space.
CLOSING = re.compile(r"[^\w\s]+$")
#: Characters whose lower case may depend on their place or on normalization.
PAST_LATIN = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: Characters that Python splits at and the tokenizers' \s may not.
ODD_SPACE = re.compile("[\x1c-\x1f\x85]")


def spaced_chunks(text: str) -> list[str]:
    """Cut before each space that follows a non-space. Byte-level BPE never joins text over such a place,
    so the chunks (every one but the first stands for ' ' + chunk) encode independently."""
    return text.split(" ") if WHITE_RUN.search(text) is None else SPACE_AFTER_WORD.split(text)


class ChunkEncoder:
    """Token ids of whole texts through the tokenizers library, each distinct chunk encoded once a worker.

    ``kind`` is 'spaced' (byte-level BPE with leading spaces) or 'dropped' (white space is discarded).
    Texts in which a special token or an odd space occurs go to the library whole. Ids come as
    little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec["pre_tokenizer"]
        self.kind = "spaced" if pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and not spec.get("normalizer") else "dropped"
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.heads, self.tails = RecentCache(), RecentCache()
        # ids that open (spaced) or end (dropped) a word
        ends = spec["model"].get("end_of_word_suffix")
        shows = (lambda t: t[:1] == "Ġ") if self.kind == "spaced" else (lambda t: t.endswith(ends)) if ends else None
        self.bounded = None
        if shows:
            self.bounded = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.bounded[i] = shows(token)

    @classmethod
    def of(cls, path: str) -> "ChunkEncoder":
        """One encoder a worker process and vocabulary; its cache lasts over the worker's tasks."""
        return held_in_worker((cls, path), lambda: cls(path))

    def _ids(self, chunks: list[str], opening: str = "", have: dict | None = None) -> list[bytes]:
        """Ids of opening + chunk for each chunk. Pre-tokenization always parts letters from closing marks,
        and a word of letters alone shows its bounds in its ids, so such words are encoded many at a time."""
        cores, marks = [], []
        for c in chunks:
            mark = CLOSING.search(c)
            at = mark.start() if mark and not PAST_LATIN.search(c) and c[: mark.start()].isalpha() else len(c)
            cores.append(c[:at])
            marks.append(c[at:])
        have = have or {}
        known: dict[str, bytes] = {c: have[c] for c in cores if c in have}
        distinct = [c for c in dict.fromkeys(cores) if c not in known]
        bounded = self.bounded is not None and (opening or self.kind == "dropped")
        words = [c for c in distinct if c.isalpha() and not PAST_LATIN.search(c)] if bounded else []
        plain = list(set(distinct).difference(words))
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            found = self.tokenizer.encode_batch_fast([opening + c for c in part], add_special_tokens=False)
            known.update(zip(part, [array("I", e.ids).tobytes() for e in found]))
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([opening + " ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(self.bounded[ids])
            cuts = (np.append(at[1:], len(ids)) if self.kind == "spaced" else at + 1) * 4
            if len(cuts) != len(part):
                raise ValueError("the bounds of words do not show in their ids")
            data, last = ids.tobytes(), 0
            for word, cut in zip(part, cuts.tolist()):
                known[word], last = data[last:cut], cut
        closing = {m: array("I", self.tokenizer.encode(m, add_special_tokens=False).ids).tobytes() if m else b"" for m in set(marks)}
        return [known[core] + closing[m] for core, m in zip(cores, marks)]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null is the empty text."""
        out: list[bytes | None] = [None] * len(texts)
        parts: list[list[str] | None] = [None] * len(texts)
        need: set[str] = set()
        for i, text in enumerate(texts):
            if not text:
                out[i] = b""
            elif (self.special and self.special.search(text)) or (self.kind == "dropped" and ODD_SPACE.search(text)):
                out[i] = self._whole(text)
            else:
                if self.kind == "spaced":
                    p = spaced_chunks(text)
                else:  # this vocabulary lower-cases; doing so first leaves fewer distinct chunks
                    p = (text if PAST_LATIN.search(text) else text.lower()).split()
                parts[i] = p
                need.update(p)
        if self.kind == "dropped":
            known = self.tails.fill(need, lambda chunks: self._ids(chunks, "", self.tails.new))
            return [b"".join([known[c] for c in p]) if p is not None else o for p, o in zip(parts, out)]
        known = self.tails.fill(need, lambda chunks: self._ids(chunks, " ", self.tails.new))
        first = self.heads.fill({p[0] for p in parts if p is not None}, self._ids)
        return [first[p[0]] + b"".join([known[c] for c in p[1:]]) if p is not None else o for p, o in zip(parts, out)]


def small_batches(batches, rows: int = 512):
    """Arrow batches of at most so many rows, so that what a step holds at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
