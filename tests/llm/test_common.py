"""The worker caches and the scratch tables."""

from corpuslens.llm import common


def test_recent_cache_stays_bounded_and_right():
    cache, made = common.RecentCache(10), []

    def make(keys):
        made.extend(keys)
        return [k * 2 for k in keys]

    for start in range(0, 100, 3):
        keys = set(range(start, start + 3)) | {0}
        found = cache.fill(keys, make)
        assert all(found[k] == k * 2 for k in keys)
        assert len(cache.new) + len(cache.old) <= 20
    assert made.count(0) == 1  # used again and again, so it is never dropped


def test_worker_holds_one_cache():
    a = common.held_in_worker("a", lambda: [1])
    assert common.held_in_worker("a", lambda: [2]) is a
    assert common.held_in_worker("b", lambda: [3]) == [3]
    assert common.held_in_worker("a", lambda: [4]) == [4]
    common.drop_held()
    assert not common._held


def test_stored_tables_read_back_and_keep_settings(spark):
    before = spark.conf.get(common.CLEANUP, None)
    df = common.stored(spark.range(5).repartition(2), "numbers")
    assert sorted(r.id for r in df.collect()) == list(range(5)) and df.count() == 5
    assert spark.conf.get(common.CLEANUP, None) == before


def test_spaced_chunks_rebuild_the_text():
    for text in ["a b", " a  b ", "\n a", "a\n b", "", "a", "  "]:
        assert " ".join(common.spaced_chunks(text)) == text
