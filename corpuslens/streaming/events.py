"""Structured Streaming over the event log: windows, sessions, and a state machine of findings.

Streams read Parquet folders with a fixed schema, take watermarks on event time and write in update or
complete mode; each has a batch twin with the same rows, which the queries' SQL checks.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpuslens.operators.graph import scratch_path

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def instant(column: str) -> Column:
    """A time without zone as the instant of its UTC reading, whatever the session's zone: watermarks need instants."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {column})"))


def without_zone(column: str) -> Column:
    """The UTC reading of an instant as a time without zone, whatever the session's zone."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({column}), {EPOCH})")


def read_events(spark: SparkSession, sf_dir: str, most_files: int | None = 64) -> DataFrame:
    """The events table (a file or a folder of part files) as a stream; the time column as an instant, as watermarks need one."""
    reader = spark.readStream.schema(EVENTS)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    # as a pattern, the path may name a file too
    return reader.parquet(f"{sf_dir.rstrip('/')}/events.parque[t]").withColumn("ts", instant("ts"))


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, time without zone."""
    return spark.read.schema(EVENTS).parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, event_type, n and total of each window; rows later than the watermark are dropped in append mode."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return windows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start and n of overlapping windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """user_id, start, end and n of bursts of events without a longer gap."""
    found = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


OUT = "user_id long, status string, reopened int"


def advanced(status: str, reopened: int, kinds) -> tuple[str, int]:
    """A finding after events in order: an error opens or reopens it, a purchase resolves it."""
    for kind in kinds:
        if kind == "error":
            reopened += status == "resolved"
            status = "open"
        elif kind == "purchase" and status == "open":
            status = "resolved"
    return status, reopened


#: Groups that users are dealt to; a call of the machine serves a group, as it costs far more than its users' events.
USER_GROUPS = 1_024


class FindingMachine(StatefulProcessor):
    """A group of users' findings: what is settled, and the events that a late one may still come before, a value each.

    Each batch adds its events and gives out its users' findings with all of their events in order. A timer on event time
    folds the events that the watermark has passed into the settled part and frees them, so the state holds what can
    still be late, not the history. Events that come twice (same time and id) count once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "user array<string>, status array<string>, reopened array<int>")
        self.waiting = handle.getValueState("waiting", "user array<string>, at array<long>, event_id array<long>, kind array<string>")

    def _settled(self) -> dict:
        user, status, reopened = self.settled.get() or ([], [], [])
        return dict(zip(user, zip(status, reopened)))

    def _waiting(self) -> dict:
        user, at, event_id, kind = self.waiting.get() or ([], [], [], [])
        return dict(zip(zip(user, at, event_id), kind))

    def _wait(self, events: dict) -> None:
        if events:
            self.waiting.update((*map(list, zip(*events)), list(events.values())))
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        settled, waiting, kinds, last = self._settled(), self._waiting(), {}, 0
        for part in rows:
            for user, at, event_id, kind in zip(*(part[c].tolist() for c in ("user", "at", "event_id", "event_type"))):
                kinds[user] = []
                if kind in ("error", "purchase"):
                    waiting[user, at, event_id] = kind
                    last = max(last, at)
        if last:
            self._wait(waiting)
            self.handle.registerTimer(last // 1000 + 1)
        for (user, _, _), kind in sorted(waiting.items(), key=lambda e: e[0][1:]):
            if user in kinds:
                kinds[user].append(kind)
        found = [(user, *advanced(*settled.get(user, ("new", 0)), own)) for user, own in kinds.items()]
        ids = pd.array([None if user is None else int(user) for user, _, _ in found], "Int64")
        yield pd.DataFrame({"user_id": ids, "status": [f[1] for f in found], "reopened": [int(f[2]) for f in found]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, settled, waiting = timerValues.getCurrentWatermarkInMs() * 1000, self._settled(), self._waiting()
        for (user, at, _), kind in sorted(waiting.items(), key=lambda e: e[0][1:]):
            if at < mark:
                settled[user] = advanced(*settled.get(user, ("new", 0)), [kind])
        if settled:
            self.settled.update((list(settled), [v[0] for v in settled.values()], [int(v[1]) for v in settled.values()]))
        self._wait({k: kind for k, kind in waiting.items() if k[1] >= mark})
        yield from ()

    def close(self) -> None:
        pass


def finding_states(events: DataFrame, late: str = "1 day", groups: int = USER_GROUPS) -> DataFrame:
    """user_id, status, reopened after each micro-batch, with events in order of time whatever batch they come in.

    Events may be late by as much as ``late`` behind the latest one; later ones are dropped. Needs the RocksDB store:
    see ``rocksdb``.
    """
    group, user = F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("group"), F.col("user_id").cast("string").alias("user")
    rows = events.withWatermark("ts", late).select(group, user, "ts", F.unix_micros("ts").alias("at"), "event_id", "event_type")
    return rows.groupBy("group").transformWithStateInPandas(FindingMachine(), OUT, "Update", "EventTime")


STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that timers and maps of state need, while queries are started inside."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before is not None else spark.conf.unset(STORE)


def as_files(events: DataFrame, files: int, name: str, late: str = "12 hours") -> str:
    """The events as a folder of so many files in about the order of time, as a log that is written over time: an
    event is in the file of its time or, for a part of them, in that of up to ``late`` later. Times are kept."""
    spark, path = events.sparkSession, scratch_path(events.sparkSession, name)
    delay = F.expr(f"INTERVAL {late}") * F.when(F.pmod(F.xxhash64("event_id"), F.lit(4)) == 0, F.pmod(F.xxhash64("event_id", F.lit(1)), F.lit(100)) / 100.0).otherwise(0.0)
    arrives = events.withColumn("_arrives", F.col("ts") + delay)
    arrives.repartitionByRange(files, "_arrives").drop("_arrives").write.parquet(path)
    return path


def in_order_of_name(spark: SparkSession, path: str, schema: str, name: str) -> DataFrame:
    """The part files of a folder as a stream, one a micro-batch, in the order of their names."""
    listed = sorted(r["p"] for r in spark.read.schema(schema).parquet(path).select(F.input_file_name().alias("p")).distinct().collect())
    fs = spark._jvm.org.apache.hadoop.fs
    for i, file in enumerate(listed):
        at = fs.Path(file)
        # the stream takes files from the oldest one on
        at.getFileSystem(spark._jsc.hadoopConfiguration()).setTimes(at, 1_000_000_000_000 + 1000 * i, -1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream: DataFrame, name: str, mode: str, key: str | None = None) -> DataFrame:
    """All that is available now, through the stream engine, as a stored table; in update mode the last row of each key."""
    spark, path, batches = stream.sparkSession, scratch_path(stream.sparkSession, name), []

    def store(df: DataFrame, batch: int) -> None:
        at = f"{path}/{batch}"
        df.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(at)
        batches[:] = [at] if mode == "complete" else [*batches, at]

    query = stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", scratch_path(spark, f"{name}-progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    found = spark.read.parquet(*batches)
    if key:
        rest = [c for c in stream.columns if c != key]
        found = found.groupBy(key).agg(F.max_by(F.struct(*rest), "_batch").alias("last")).select(key, "last.*")
    return found.select(*stream.columns)


def on_time(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """tumbling_counts for append mode: a window is given out once, when the watermark has passed its end, and rows
    that come later than that are dropped; the state of closed windows is freed."""
    return tumbling_counts(events, width, late)


def appended(stream: DataFrame, name: str) -> DataFrame:
    """All that is available now in append mode, as a stored table: the stream's own file sink, nothing at the driver."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, name)
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, f"{name}-progress"))
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


SNAPSHOT = "unit string, digest string, at timestamp, id string, result string, batch long"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the complete snapshots below root, from storage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    done = [p.getName() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("v")) for n in done if n.startswith("v"))


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The last complete snapshot below root."""
    done = versions(spark, root)
    return spark.read.schema(SNAPSHOT).parquet(f"{root}/v{done[-1]}") if done else spark.createDataFrame([], SNAPSHOT)


def recomputed(changes: DataFrame, root: str, progress: str, result: Column) -> DataFrame:
    """The snapshot of units after a stream of changes (unit, digest, at, id): a unit's content is that of its greatest
    (at, id), whatever batch that comes in, and only units whose digest differs from the snapshot's are recomputed.

    ``result`` is a column made from unit and digest. A batch reads the last complete snapshot before it, from
    storage, and writes the next one, which is complete when its success mark is. A batch that runs again, after a
    failure or a restart with the same folders, finds its own snapshot and does nothing, or makes the same one. Only
    the last two snapshots are kept. Nothing is held at the driver.
    """
    spark = changes.sparkSession

    def step(rows: DataFrame, batch: int) -> None:
        done = versions(spark, root)
        if batch in done:
            return
        before = [v for v in done if v < batch]
        last = rows.groupBy("unit").agg(F.max(F.struct("at", F.col("id").cast("string").alias("id"), "digest")).alias("new"))
        if before:
            old = spark.read.schema(SNAPSHOT).parquet(f"{root}/v{before[-1]}").select("unit", F.struct("at", "id", "digest").alias("old"), "result", "batch")
        else:
            old = spark.createDataFrame([], "unit string, old struct<at:timestamp,id:string,digest:string>, result string, batch long")
        both = old.join(last, "unit", "full").withColumn("now", F.greatest("old", "new"))
        same = F.col("old.digest").eqNullSafe(F.col("now.digest")) & F.col("old").isNotNull()
        flat = both.select("unit", "now.digest", "now.at", "now.id", F.col("result").alias("_result"), F.col("batch").alias("_batch"), same.alias("_same"))
        made = flat.withColumn("result", F.when(F.col("_same"), F.col("_result")).otherwise(result)).withColumn("batch", F.when(F.col("_same"), F.col("_batch")).otherwise(batch))
        made.select("unit", "digest", "at", "id", "result", F.col("batch").cast("long").alias("batch")).write.mode("overwrite").parquet(f"{root}/v{batch}")
        for v in before[:-1]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v{v}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    changes.writeStream.foreachBatch(step).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return snapshot(spark, root)


def phase_by_batch(events: DataFrame, name: str, phase) -> DataFrame:
    """batch, n, n_open, phase: the lifecycle phase after each micro-batch, a column made from its counts."""
    spark, path = events.sparkSession, scratch_path(events.sparkSession, name)

    def step(rows: DataFrame, batch: int) -> None:
        counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_open"))
        counts.select(F.lit(batch).cast("long").alias("batch"), "n", "n_open", phase.alias("phase")).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = events.writeStream.foreachBatch(step).option("checkpointLocation", scratch_path(spark, f"{name}-progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("n long, n_open long, phase string, batch long").parquet(path)
