"""Cohesion: one shuffle by file, no rounds over the links of all files; files that go on in a later batch."""

from corpuslens.operators import blocks


def test_one_shuffle_and_batches(spark):
    files, n = 40, 12
    units = [(f"f{f}", f"n{i % 6}_{i}") for f in range(files) for i in range(n)] + [(None, "lost")]
    calls = [(f"f{f}", f"n{i % 6}_{i}", f"n{(i - 1) % 6}_{i - 1}") for f in range(files) for i in range(n) if i % 3]
    imports = [(p, u, root) for p, u in units for root in ("os", None)]
    frames = spark.createDataFrame(units, "path string, name string"), spark.createDataFrame(calls, "path string, src string, dst string"), spark.createDataFrame(imports, "path string, name string, root string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = blocks.cohesion(*frames)
        assert sorted(tuple(r) for r in found.collect()) == sorted((f"f{f}", n, 4, 3, 6, 1) for f in range(files))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
