import pytest

from larkspur.operators import sink
from larkspur.sources import reports

NOW = 1_700_000_000_000


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame([("01A", NOW - 60000, "h", "l1", "v1", 5), ("01B", NOW - 10000, "h", "l2", "v2", 5)], "run_id string, started_at long, git_head string, lockfile_hash string, vite_dep_hash string, port int")


@pytest.fixture(scope="module")
def errors(spark):
    rows = [(1, NOW - 5000, "rejection", "TypeError", "x is 123456", "01A"), (2, NOW - 500, "vitest", None, "failed", "01Z"), (3, NOW - 400, "rejection", "TypeError", "x is 999999", "01B")]
    return sink.record(spark.createDataFrame(rows, "id long, ts long, surface string, kind string, message string, run_id string"))


@pytest.fixture(scope="module")
def events(spark):
    rows = [(1, NOW - 8000, "hmr-update", '{"files": ["src/a.ts"]}'), (2, NOW - 2000, "test-pass", None), (3, NOW - 1000, "full-reload", None), (4, NOW - 40000, "hmr-update", '{"files": ["b.ts"]}')]
    return spark.createDataFrame(rows, "id long, ts long, kind string, data string")


def test_record(errors):
    got = {r.id: (r["count"], r.first_ts, r.last_ts, r.run_id) for r in errors.collect()}
    assert got == {1: (2, NOW - 5000, NOW - 400, "01B"), 2: (1, NOW - 500, NOW - 500, "01Z")}


def test_queries(errors, events, runs):
    assert [r.id for r in sink.since(errors, 1).collect()] == [2] and sink.cursor(errors).first().cursor == 2
    assert [r.id for r in sink.last(errors, 5).collect()] == [1, 2] and sink.last(errors, 5, "vitest").count() == 1
    assert sink.find(errors, "X IS", 5).count() == 1 and sink.find(errors, "%", 5).count() == 0
    assert {(r.error_id, r.event_id) for r in sink.correlate(errors, events).collect()} == {(e, v) for e in (1, 2) for v in (1, 2, 3)}
    assert {r.id: r.run_id for r in sink.run_of(errors, runs).collect()} == {1: "01B", 2: "01B"}
    d = sink.env_diff(runs).first()
    assert d.previous == "01A" and d.changed == ["lockfile_hash: l1 -> l2", "vite_dep_hash: v1 -> v2"]
    assert sink.test_status(errors, events).first().passing is False
    assert [r.id for r in sink.hmr(events, "a.ts").collect()] == [3, 1] and [r.id for r in sink.hmr(events).collect()] == [3, 1, 4]
    assert [r.id for r in sink.show(errors, events, runs, 1)["events"].collect()] == [1, 2, 3]
    assert sink.test_status(errors.limit(0), events.limit(0)).first().passing is None


def test_retention(errors, events):
    assert [r.id for r in sink.retain(events, NOW, 10000, 2, "ts").collect()] == [2, 3]
    assert sink.retain_errors(errors, NOW).count() == 2 and sink.retain_errors(errors, NOW + 8 * sink.DAY).count() == 0


def test_envelopes(spark):
    lines = ['{"surface":"vitest","message":"m","ts":1,"stack":"Error\\n    at f (src/a.ts:3:4)\\n    at b.ts:1:2\\nfoo@c.js:5:6\\nnoise"}', '{"type":"event","kind":"test-pass","ts":2}', '{"type":"run","runId":"r","startedAt":3}', '{"type":"odd"}', '{"surface":"odd","message":"x"}', "nope"]
    got = reports.envelopes(spark.createDataFrame([(x,) for x in lines], "text string"))
    assert [got[k].count() for k in ("errors", "events", "runs", "rejected")] == [1, 1, 1, 3]
    frames = got["errors"].first().frames
    assert [(f.func, f.file, f.line, f.column) for f in frames] == [("f", "src/a.ts", 3, 4), (None, "b.ts", 1, 2), ("foo", "c.js", 5, 6)]
    mapping = spark.createDataFrame([("a", 1, 0, "s1", 10, 1), ("a", 1, 8, "s2", 20, 2)], "file string, line int, column int, src string, src_line int, src_column int")
    mapped = reports.map_frames(spark.createDataFrame([("a", 1, 5), ("a", 1, 9), ("a", 2, 1)], "file string, line int, column int"), mapping)
    assert {(r.line, r.column): r.mapped_file for r in mapped.collect()} == {(1, 5): "s1", (1, 9): "s2", (2, 1): None}


def test_compiler_output(spark):
    text = ["src/a(1).ts(3,4): error TS2339: no x", "src/b.ts(1,1): error TS2339: no y", "src/b.ts(2,1): error TS2322: bad", "noise", "x.ts: warning"]
    rows = sink.diagnostics(spark.createDataFrame([(x,) for x in text], "text string"))
    assert rows.count() == 3 and rows.filter("file = 'src/a(1).ts' AND line = 3").count() == 1
    assert {(r.code, r.n) for r in sink.diagnostic_groups(rows).collect()} == {("TS2339", 2), ("TS2322", 1)}
    assert sink.diagnostic_summary(rows).first().summary == "3 errors in 2 files"
    from pyspark.sql import functions as F

    out = spark.createDataFrame([("\n".join(map(str, range(1, 151))) + "\n",)], "o string").select(reports.tail_lines(F.col("o")).alias("t")).first()["t"]
    assert out.split("\n") == [str(i) for i in range(51, 151)]


def test_runner_summary(spark):
    tree = '{"name":"f","type":"suite","tasks":[{"name":"a","type":"test","state":"pass"},{"name":"s","type":"suite","tasks":[{"name":"b","type":"test","state":"fail"}]}]}'
    got = reports.test_summary(spark.createDataFrame([(tree,)], "tree string")).first()
    assert (got.passed, got.failed, got.failures) == (1, 1, ["b"])
