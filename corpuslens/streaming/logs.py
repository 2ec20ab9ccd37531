"""An append-only event log as folders of JSON lines behind a manifest: append, read as a stream, retain and compact.

A log is a folder with data folders and manifests. A manifest is a small table that names the data folders that count;
the highest complete one holds, so a reader never sees half of an append or of a compaction, and a writer that dies
leaves a folder that no manifest names. One writer at a time appends or compacts.

Lines that do not parse, or lack an id or a time, do not stop a reader: they are rows with ``damaged`` set, which are
counted and left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.streaming.events import instant, versions

LOG = "id string, at timestamp_ntz, kind string, unit string, digest string"


def checked(lines: DataFrame) -> DataFrame:
    """The rows of JSON lines (a column value): LOG, ``damaged`` and the line itself where it is damaged.

    Lines of white space only are no rows.
    """
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", LOG).alias("r"), "value")
    # a line that is no object gives null fields, as one that lacks them
    damaged = F.coalesce(F.col("r.id").isNull() | F.col("r.at").isNull(), F.lit(True))
    return parsed.select("r.*", damaged.alias("damaged"), F.when(damaged, F.col("value")).alias("line"))


def read_log(spark: SparkSession, path: str, most_files: int | None = 64, damaged: bool = False) -> DataFrame:
    """A folder of JSON-lines files as a stream of log rows, ``at`` as an instant; with ``damaged``, damaged lines too."""
    rows = checked(spark.readStream.option("maxFilesPerTrigger", most_files or 2**31 - 1).text(path))
    rows = rows.withColumn("at", instant("at"))
    return rows if damaged else rows.where(~F.col("damaged")).drop("damaged", "line")


def folders(spark: SparkSession, root: str) -> list[str]:
    """The data folders of the last complete manifest, one name an append or compaction."""
    done = versions(spark, f"{root}/manifest")
    return [r["folder"] for r in spark.read.schema("folder string").json(f"{root}/manifest/v{done[-1]}").orderBy("folder").collect()] if done else []


def _commit(spark: SparkSession, root: str, names: list[str]) -> None:
    done = versions(spark, f"{root}/manifest")
    spark.createDataFrame([(n,) for n in names], "folder string").coalesce(1).write.json(f"{root}/manifest/v{done[-1] + 1 if done else 0}")


def append(rows: DataFrame, root: str) -> None:
    """Add rows, JSON text in a column value, to the log."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    rows.select("value").write.text(f"{root}/data/{name}")
    _commit(spark, root, [*folders(spark, root), name])


def read(spark: SparkSession, root: str) -> DataFrame:
    """The log's rows, damaged ones included, as ``checked`` has them."""
    names = folders(spark, root)
    lines = spark.read.text([f"{root}/data/{n}" for n in names]) if names else spark.createDataFrame([], "value string")
    return checked(lines)


def compacted(spark: SparkSession, root: str, most: int | None = None, lines_per_file: int = 1_000_000) -> None:
    """Rewrite the log as few files in order of time, without damaged lines, repeated ids, or all but the last ``most`` rows.

    The new folder counts once its manifest is complete; the old ones are deleted after that.
    """
    old, name = folders(spark, root), uuid.uuid4().hex
    rows = read(spark, root).where(~F.col("damaged")).drop("damaged", "line")
    once = rows.groupBy("id").agg(F.max(F.struct("at", "kind", "unit", "digest")).alias("r")).select("id", "r.*")
    if most is not None:
        # the last ones by a threshold on time, so that no task sorts them all
        once = once.orderBy(F.desc("at"), F.desc("id")).limit(most)
    text = once.repartitionByRange(max(1, -(-once.count() // lines_per_file)), "at", "id").sortWithinPartitions("at", "id")
    text.select(F.to_json(F.struct("id", "at", "kind", "unit", "digest")).alias("value")).write.text(f"{root}/data/{name}")
    _commit(spark, root, [name])
    for n in old:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/{n}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
