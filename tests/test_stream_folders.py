"""Streams over an events table that is a folder of part files."""

import pytest

from corpuslens.plans import registry
from corpuslens.streaming import events


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet(f"{sf}/events.parquet").repartition(70).write.parquet(f"{out}/events.parquet")
    return out


@pytest.mark.parametrize("name", ["event_counts_tumbling", "event_counts_sliding", "event_sessions", "finding_state_machine"])
def test_folder_gives_the_rows_of_the_file(spark, sf, folder, name):
    run = registry.queries()[name]
    expected = sorted(map(tuple, run(spark, sf).collect()))
    assert expected and sorted(map(tuple, run(spark, folder).collect())) == expected


def test_one_last_row_a_user_over_many_batches(spark, folder):
    with events.rocksdb(spark):
        states = events.finding_states(events.read_events(spark, folder, 35), "4000 days")
        found = events.drained(states, "states", "update", "user_id").collect()
    assert found and len({r.user_id for r in found}) == len(found)
