"""Length-delimited binary records of token ids with masked checksums, and a separate offset index.

A record is: payload length (8 bytes, little endian), masked checksum of these 8 bytes (4), payload,
masked checksum of the payload (4), one line feed. The payload is doc_id (8), a byte for the width of an
id (2 or 4) and the ids. A null doc_id has its own flag byte. The checksum is zlib's CRC-32, rotated right
by 15 bits plus a constant, so that a checksum of data that holds checksums stays meaningful. The line feed
is what Spark's text writer puts after each row: with it the files are written by Spark itself, on any file
system it reaches, with its commit protocol, and never through the driver or a local disk.

Documents are range-partitioned by doc_id; files in the order of (task, number within the task) hold ascending
ids. Both are numbers in a file's name and are compared as numbers (as text, c1000 would come before c999).
A file ends at ``file_bytes`` or ``rows_per_file``, whichever comes first, so it is larger than ``file_bytes``
by one record at most; reading takes a whole file at a time. The index (file, task, number, offset, length,
doc_id, n_tokens, ids_crc32, start) is built from the written files and stored as Parquet beside them: a
shuffled read sorts or samples the index and fetches records by file and offset.

Null text counts as empty (the end id alone). Repeated rows are records of their own, in text order where
ids tie. Null ids come first. A very long text is one record, in a file that ends with it. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import ChunkEncoder, scratch_dir, small_batches

MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
KEY = struct.Struct("<?qB")
FILE_BYTES = 1 << 24
#: Bytes of text in a range of ids, which one task encodes.
RANGE_BYTES = 256 << 20
#: Spark's file names: the task that wrote a file and the file's number within the task.
FILE_NAME = re.compile(r"part-(\d+)-.*?(?:-c(\d+))?(?:\.\w+)?$")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record without its line feed; ids are little-endian unsigned 32-bit."""
    if width == 2:
        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    payload = KEY.pack(doc_id is None, doc_id or 0, width) + ids
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked_crc(size)) + payload + struct.pack("<I", masked_crc(payload))


def records(content: bytes):
    """(offset, record length, doc_id, ids as 32-bit bytes) of each record of a file; a bad checksum raises."""
    at, end = 0, len(content)
    while at < end:
        size, head_crc = HEAD.unpack_from(content, at)
        if masked_crc(content[at : at + 8]) != head_crc:
            raise ValueError(f"record at {at}: the length's checksum is wrong")
        payload = content[at + 12 : at + 12 + size]
        (crc,) = struct.unpack_from("<I", content, at + 12 + size)
        if len(payload) != size or masked_crc(payload) != crc:
            raise ValueError(f"record at {at}: the payload's checksum is wrong")
        no_id, doc_id, width = KEY.unpack_from(payload)
        ids = payload[KEY.size :]
        if width == 2:
            ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
        yield at, size + 17, None if no_id else doc_id, ids
        at += size + 17


def place_of(name: str) -> tuple[int, int]:
    """(task, number) of a file, as numbers."""
    task, number = FILE_NAME.fullmatch(name).groups()
    return int(task), int(number or 0)


def write_records(
    docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 2, rows_per_file: int = 10_000, file_bytes: int = FILE_BYTES
) -> None:
    """Encode and write. Each row that goes to the writer is the content of one file."""

    def run(batches):
        encoder = ChunkEncoder.of(tokenizer_path)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 65_536 else 4
        end = int(end_id).to_bytes(4, "little")
        content = lambda: pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.binary())], names=["content"])
        held, size = [], 0
        for batch in small_batches(batches):
            ids = encoder.encode(batch.column("text").to_pylist())
            for doc_id, of in zip(batch.column("doc_id").to_pylist(), ids):
                held.append(frame(doc_id, of + end, width))
                size += len(held[-1])
                if size >= file_bytes or len(held) >= rows_per_file:
                    yield content()
                    held, size = [], 0
        if held:
            yield content()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # ranges follow the bytes of text; equal and null ids are parted by how their texts begin, in the order of texts
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spread = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    begins = F.substring("text", 1, 64)
    ordered = rows.repartitionByRange(spread, F.col("doc_id"), begins).sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    files.write.options(lineSep="\n", maxRecordsPerFile=1, compression="none").text(out)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, task, number, offset, length, doc_id, n_tokens, ids_crc32, ids of every record below path, checksums verified."""
    schema = "file string, task long, number long, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, ids binary"
    kinds = [pa.string(), *[pa.int64()] * 7, pa.binary()]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                name = name.rsplit("/", 1)[-1]
                task, number = place_of(name)
                found = records(content.as_py())
                while part := list(islice(found, 512)):
                    rows = [(name, task, number, at, size, doc_id, len(ids) // 4, zlib.crc32(ids), ids) for at, size, doc_id, ids in part]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def with_starts(index: DataFrame) -> DataFrame:
    """index with start: the tokens of all records before, in the order of task, number and offset.

    Sums go up in three steps, so that no task sees all records or all files: tasks (as many rows as the writer
    had partitions), files within a task, records within a file.
    """
    before = lambda c, w: F.sum(c).over(w) - F.col(c)
    files = index.groupBy("task", "number").agg(F.sum("n_tokens").alias("of_file"))
    tasks = files.groupBy("task").agg(F.sum("of_file").alias("of_task"))
    at_task = tasks.select("task", before("of_task", Window.orderBy("task")).alias("at_task"))
    at_file = files.select("task", "number", before("of_file", Window.partitionBy("task").orderBy("number")).alias("at_file"))
    inside = before("n_tokens", Window.partitionBy("task", "number").orderBy("offset"))
    placed = index.withColumn("inside", inside).join(at_file, ["task", "number"]).join(at_task, "task")
    return placed.withColumn("start", F.col("at_task") + F.col("at_file") + F.col("inside")).drop("at_task", "at_file", "inside")


def index_records(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Write the offset index below index_path and return it as read back."""
    parts = f"{index_path}/parts"
    read_records(spark, path).drop("ids").write.parquet(parts)
    with_starts(spark.read.parquet(parts)).write.parquet(f"{index_path}/whole")
    return spark.read.parquet(f"{index_path}/whole")


def encode_to_records(
    docs: DataFrame, tokenizer_path: str, out: str | None = None, end_id: int = 2, rows_per_file: int = 10_000, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write the documents as records below out (a scratch folder if None), and return the index read back."""
    spark = docs.sparkSession
    out = out or scratch_dir(spark, "records")
    write_records(docs, tokenizer_path, f"{out}/records", end_id, rows_per_file, file_bytes)
    return index_records(spark, f"{out}/records", f"{out}/index")
