"""Streams: JSON-lines logs with damaged lines, late rows in append mode, incremental recomputation, phases."""

import json

import pytest
from pyspark.sql import functions as F

from corpuslens.plans import registry
from corpuslens.streaming import events, logs


def test_windows_do_not_depend_on_the_session_zone(spark, sf):
    run = registry.queries()["event_counts_tumbling"]
    expected = sorted(map(str, run(spark, sf).collect()))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert sorted(map(str, run(spark, sf).collect())) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def _log(folder, name, rows):
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def _row(i, at, unit="u", digest="d"):
    return {"id": f"e{i}", "at": at, "kind": "scan", "unit": unit, "digest": digest}


def test_damaged_lines_are_skipped(spark, tmp_path):
    _log(tmp_path, "a.json", [_row(1, "2024-01-01 00:00:00"), "{broken", "", '{"id": "e2"}', "[1, 2]"])
    _log(tmp_path, "b.json", ['"text"', _row(3, "2024-01-02 00:00:00"), json.dumps(_row(4, "no time"))])
    found = events.appended(logs.read_log(spark, str(tmp_path)), "log").collect()
    assert sorted(r.id for r in found) == ["e1", "e3"]


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    import os
    import time

    days = ["2024-01-01 10:00:00", "2024-01-02 10:00:00", "2024-01-05 10:00:00", "2024-01-01 11:00:00", "2024-01-09 10:00:00"]
    for i, at in enumerate(days):  # a file a micro-batch, in order of time
        _log(tmp_path, f"{i}.json", [_row(i, at)])
        os.utime(tmp_path / f"{i}.json", (time.time() - 100 + i, time.time() - 100 + i))
    log = logs.read_log(spark, str(tmp_path), 1).select(F.col("at").alias("ts"), F.col("kind").alias("event_type"), F.lit(1.0).alias("value"))
    found = events.appended(events.on_time(log), "on-time").select(events.without_zone("start").alias("day"), "n").collect()
    counts = {str(r.day)[:10]: r.n for r in found}
    # the row of the first day that came after its window had closed is not counted; the last day's window is still open
    assert counts == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-05": 1}


def test_only_changed_units_are_recomputed(spark, tmp_path):
    import os
    import time

    batches = [
        [_row(1, "2024-01-01 00:00:00", "a", "1"), _row(2, "2024-01-01 00:00:00", "b", "1"), _row(3, "2024-01-01 01:00:00", "b", "2")],
        [_row(4, "2024-01-02 00:00:00", "a", "1"), _row(5, "2024-01-02 00:00:00", "c", "7")],
        [_row(6, "2024-01-03 00:00:00", "b", "3")],
    ]
    for i, rows in enumerate(batches):
        _log(tmp_path, f"{i}.json", rows)
        os.utime(tmp_path / f"{i}.json", (time.time() - 100 + i, time.time() - 100 + i))
    found = _recomputed(spark, tmp_path).collect()
    assert {(r.unit, r.digest, r.result, r.batch) for r in found} == {("a", "1", "a-1", 0), ("b", "3", "b-3", 2), ("c", "7", "c-7", 1)}


def _recomputed(spark, folder, result=None):
    log = logs.read_log(spark, f"{folder}/*.json", 1)
    made = F.concat("unit", F.lit("-"), "digest") if result is None else result
    return events.recomputed(log, f"{folder}/snapshots", f"{folder}/progress", made)


def _file(folder, i, rows):
    import os
    import time

    _log(folder, f"{i}.json", rows)
    os.utime(folder / f"{i}.json", (time.time() - 100 + i, time.time() - 100 + i))


def test_late_changes_do_not_replace_newer_ones(spark, tmp_path):
    _file(tmp_path, 0, [_row(1, "2024-01-01 10:00:00", "u", "new"), _row(2, "2024-01-01 10:00:00", "v", "first")])
    _file(tmp_path, 1, [_row(3, "2024-01-01 05:00:00", "u", "old"), _row(2, "2024-01-01 10:00:00", "v", "first")])
    found = {r.unit: (r.digest, r.batch) for r in _recomputed(spark, tmp_path).collect()}
    assert found == {"u": ("new", 0), "v": ("first", 0)}


def test_restart_goes_on_from_the_last_snapshot(spark, tmp_path):
    """A query that fails in a batch, and one that is started anew with the same folders, end where a batch job would."""
    _file(tmp_path, 0, [_row(1, "2024-01-01 00:00:00", "a", "1"), _row(2, "2024-01-01 00:00:00", "b", "1")])
    _file(tmp_path, 1, [_row(3, "2024-01-02 00:00:00", "b", "2")])
    with pytest.raises(Exception):
        _recomputed(spark, tmp_path, F.when(F.col("digest") == "2", F.raise_error(F.lit("killed"))).otherwise(F.col("digest")))
    assert events.versions(spark, f"{tmp_path}/snapshots") == [0]
    found = {(r.unit, r.digest, r.batch) for r in _recomputed(spark, tmp_path).collect()}
    assert found == {("a", "1", 0), ("b", "2", 1)}
    _file(tmp_path, 2, [_row(4, "2024-01-01 12:00:00", "b", "late"), _row(5, "2024-01-03 00:00:00", "c", "1")])
    found = {(r.unit, r.digest, r.batch) for r in _recomputed(spark, tmp_path).collect()}
    assert found == {("a", "1", 0), ("b", "2", 1), ("c", "1", 2)}
    assert {(r.unit, r.digest) for r in _recomputed(spark, tmp_path).collect()} == {("a", "1"), ("b", "2"), ("c", "1")}
    assert events.versions(spark, f"{tmp_path}/snapshots") == [1, 2]


def test_machine_takes_events_in_order_of_time(spark, tmp_path):
    """Events in many files, late by hours, give each user the finding of all events in order; passed ones are freed."""
    import random

    rng, rows = random.Random(2), []
    for user in range(4):
        for i in range(60):
            rows.append((user * 100 + i, 1_700_000_000 + rng.randrange(30 * 86_400), user, rng.choice(["error", "purchase", "view"])))
    rows.append((999, 1_700_000_000, 9, "view"))
    frame = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string")
    table = frame.select("event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("").alias("props"))
    path = events.as_files(table, 8, "test-log")
    stream = events.in_order_of_name(spark, path, events.EVENTS, "log").withColumn("ts", events.instant("ts"))
    with events.rocksdb(spark):
        found = events.drained(events.finding_states(stream, "1 day"), "test-states", "update", "user_id").collect()
    expected = {9: ("new", 0)}
    for user in range(4):
        kinds = [k for _, _, k in sorted((at, e, k) for e, at, u, k in rows if u == user)]
        expected[user] = events.advanced("new", 0, kinds)
    assert {r.user_id: (r.status, r.reopened) for r in found} == expected


def test_log_behind_a_manifest(spark, tmp_path):
    root = f"{tmp_path}/log"
    assert logs.folders(spark, root) == [] and logs.read(spark, root).count() == 0
    lines = [json.dumps(_row(i, f"2024-01-{i + 1:02} 00:00:00")) for i in range(20)] + ["{broken"]
    for part in (lines[:10], lines[10:], lines[5:12]):
        logs.append(spark.createDataFrame([(x,) for x in part], "value string"), root)
    assert logs.read(spark, root).count() == 28 and logs.read(spark, root).where("damaged").count() == 1
    spark.createDataFrame([("{}",)], "value string").write.text(f"{root}/data/torn")  # no manifest names it
    logs.compacted(spark, root, most=8)
    kept = logs.read(spark, root).collect()
    assert sorted(r.id for r in kept) == sorted(f"e{i}" for i in range(12, 20)) and len(logs.folders(spark, root)) == 1


def test_phase_of_each_batch(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    phase = F.when(F.col("n_open") * 5 > F.col("n"), "triage").otherwise("execute")
    found = events.phase_by_batch(events.read_events(spark, str(tmp_path), 2), "phases", phase).collect()
    assert sorted(r.batch for r in found) == [0, 1, 2] and sum(r.n for r in found) == spark.read.parquet(f"{sf}/events.parquet").count()
    assert all(r.phase == ("triage" if r.n_open * 5 > r.n else "execute") for r in found)
