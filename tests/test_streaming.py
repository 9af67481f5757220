import pytest

from larkspur.streaming import errors as stream


@pytest.fixture
def source(spark, tmp_path):
    schema = "id long, ts long, surface string, kind string, message string"
    path = str(tmp_path / "in")

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    put([(1, 1000, "build", "k", "x 123456"), (2, 2000, "build", "k", "x 999999"), (3, 500, "test", "k", "y")])
    return put, lambda: stream.read(spark, path, schema, 1)


def test_dedup_state_over_batches(spark, source, tmp_path):
    put, read = source
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream.upsert(stream.dedup_counts(read()), out, "dedup_hash", state).awaitTermination(120)
    put([(4, 9000, "build", "k", "x 111111"), (5, 100, "test", "k", "y")])
    stream.upsert(stream.dedup_counts(read()), out, "dedup_hash", state).awaitTermination(120)
    got = {r.id: (r["count"], r.first_ts, r.last_ts) for r in stream.latest(spark, out, "dedup_hash").collect()}
    assert got == {1: (3, 1000, 9000), 3: (2, 500, 500)}


def test_windows_and_first_reports(spark, source):
    _, read = source
    rows = stream.run_to_table(stream.windowed(read(), "1 second"), "w1", "complete")
    assert sorted((r.surface, r.n) for r in rows.collect()) == [("build", 1), ("build", 1), ("test", 1)]
    assert sorted(r.id for r in stream.run_to_table(stream.first_reports(read()), "f1").collect()) in ([1, 3], [2, 3])


def test_debounce(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([("a", False, 0), ("a", True, 400), ("a", False, 2000), ("b", True, 10)], "path string, removed boolean, ts long").write.parquet(path)
    rows = stream.run_to_table(stream.debounce(stream.read(spark, path, "path string, removed boolean, ts long")), "d1", "complete")
    assert sorted((r.path, r.removed, r.n) for r in rows.collect()) == [("a", False, 1), ("a", True, 2), ("b", True, 1)]


def test_correlate(spark, tmp_path):
    for name, rows in (("e", [(1, 60_000)]), ("v", [(7, 31_000), (8, 90_000), (9, 90_001), (10, 29_999)])):
        spark.createDataFrame(rows, "id long, ts long").write.parquet(str(tmp_path / name))
    e, v = (stream.read(spark, str(tmp_path / n), "id long, ts long") for n in "ev")
    assert sorted(r.event_id for r in stream.run_to_table(stream.correlate(e, v), "c1").collect()) == [7, 8]


def test_debounce_splits_at_a_whole_gap(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([("a", False, 0), ("a", True, 499), ("a", False, 999), ("b", True, 0), ("b", True, 500)], "path string, removed boolean, ts long").write.parquet(path)
    rows = stream.run_to_table(stream.debounce(stream.read(spark, path, "path string, removed boolean, ts long")), "d2", "complete")
    assert sorted((r.path, r.n) for r in rows.collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 1)]


def test_dedup_takes_the_least_id_of_all_parts(spark, source, tmp_path):
    put, read = source
    put([(-1, 7000, "build", "k", "x 222222")])
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        rows = stream.run_to_table(stream.dedup_counts(read()), "dd1", "update").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    last = {r.dedup_hash: (r.id, r.first_ts, r.last_ts, r["count"]) for r in sorted(rows, key=lambda r: r["count"])}
    assert sorted(last.values()) == [(-1, 7000, 7000, 3), (3, 500, 500, 1)]
