import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as fn
from larkspur.functions import vectors


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "message, want",
    [("see https://a.b/c?d=1, now", "see <url>, now"), ("at 2024-01-02T10:11:12Z done", "at <ts> done"), ("id deadbeef01 (0x1234567)", "id <hex> (0x<num>)"), ("  a \n\t b  ", "a b"),
     ("n 1234 12345 1234567 12345678", "n 1234 <num> <num> <hex>"), ("abcdef12x abcdef12-x", "abcdef12x <hex>-x"), ("", "")],
)
def test_normalize_message(spark, message, want):
    assert one(spark, fn.normalize_message(F.col("m")), m=message) == want


def test_dedup_hash(spark):
    import hashlib

    frames = "array(named_struct('mapped_file','src/a.ts','mapped_line',3,'file','x','line',9), named_struct('mapped_file',null,'mapped_line',null,'file','node_modules/y','line',1), named_struct('mapped_file',null,'mapped_line',null,'file','b.ts','line',null))"
    got = spark.range(1).select(fn.dedup_hash(F.lit("vitest"), F.lit(None).cast("string"), F.lit("x 123456"), F.expr(frames)).alias("h")).first()["h"]
    assert got == hashlib.sha256(b"vitest\n\nx <num>\nsrc/a.ts:3\nb.ts:0").hexdigest()


@pytest.mark.parametrize("text, want", [("5m", 300000), ("30s", 30000), ("2h", 7200000), ("1d", 86400000), ("45", 45000), ("nope", None), ("", None), ("1w", None)])
def test_durations(text, want):
    assert fn.duration_ms(text) == want


def test_recall_durations():
    assert fn.duration_ms("1w", True) == 604800000 and fn.duration_ms("30s", True) is None and fn.duration_ms("45", True) is None
    assert fn.time_ms("1h", 10_000_000) == 6_400_000 and fn.time_ms("1970-01-01T00:00:01Z", 0) == 1000 and fn.time_ms("x", 0) is None


@pytest.mark.parametrize("name, want", [("loginUser", ["login", "user"]), ("HTTPServer_name-x", ["http", "server", "name", "x"]), ("a.b:c#d", ["a", "b", "c", "d"]), ("", [])])
def test_ident_words(spark, name, want):
    assert one(spark, fn.ident_words(F.col("n")), n=name) == want


def test_lines(spark):
    assert one(spark, fn.lines(F.col("t")), t="a\r\nb\n") == ["a", "b"]
    assert one(spark, fn.lines(F.col("t")), t="a\n\nb") == ["a", "", "b"]


def test_paths(spark):
    assert one(spark, fn.normalize_path(F.col("p")), p="a/./b/../c//d") == "a/c/d"
    assert one(spark, fn.dirname(F.col("p")), p="a/b/c.rs") == "a/b" and one(spark, fn.dirname(F.col("p")), p="c") == ""
    assert one(spark, fn.lang_of(F.col("p")), p="x/y.TSX") == "tsx" and one(spark, fn.lang_of(F.col("p")), p="Makefile") is None
    assert [one(spark, fn.under(F.col("p"), "src/foo"), p=x) for x in ("src/foo", "src/foo/a", "src/foobar")] == [True, True, False]


def test_snippets_and_chunks(spark):
    text = "x" * 200 + "needle\n" + "y" * 200
    got = one(spark, fn.snippet(F.col("t"), "needle", 10), t=text)
    assert got == "…" + "x" * 10 + "needle " + "y" * 9 + "…"
    windows = one(spark, fn.chunk_windows(F.col("t")), t="x" * 4000)
    assert windows[0].start == 0 and windows[-1].end == 4000 and len(windows) >= 3 and all(a.end > b.start for a, b in zip(windows, windows[1:], strict=False))
    assert one(spark, fn.chunk_windows(F.col("t")), t="") == []


@pytest.mark.parametrize("text, want", [("<system-reminder>x", "orchestrator"), ("  <task-notification>done", "orchestrator"), ("fix the login bug", "human"), ("Caveat: The messages below", "orchestrator")])
def test_intent(spark, text, want):
    assert one(spark, fn.intent(F.col("t")), t=text) == want


def test_queries():
    assert fn.query_words("never use cd, use absolute paths instead, avoid cd in shell commands")[:4] == ["never", "use", "cd", "absolute"]
    assert "in" not in fn.query_words("a cd in b")
    exact, words = fn.tokenize_task("fix `login_user` in the auth flow")
    assert exact == ["login_user"] and words == ["login_user", "auth", "flow"]
    with pytest.raises(ValueError):
        fn.tokenize_task("the of")
    assert "Thing" in fn.word_pattern("thing") and "THING" in fn.word_pattern("thing")


def test_misc(spark):
    assert one(spark, fn.evaluating_chain(F.col("m")), m="x (evaluating 'a.b.c')") == ["a", "b", "c"]
    assert one(spark, fn.evaluating_chain(F.col("m")), m="null (reading 'c')") == ["c"]
    assert one(spark, fn.humanize(F.col("m")), m="loginUser") == "Login User flow"
    assert one(spark, fn.to_ms(F.col("m")), m=5) == 5000 and one(spark, fn.age(F.col("m")), m=7_300_000) == "2h"
    assert one(spark, fn.estimate_tokens(F.col("m")), m="éé") == 1
    got = spark.sql("SELECT map('password', 'x', 'a', repeat('b', 300)) AS v").select(fn.redact(F.col("v")).alias("o")).first()["o"]
    assert got["password"] == "[redacted]" and len(got["a"]) == 256


def test_vectors(spark):
    row = spark.sql("SELECT array(0.5f, -1.0f, 0.25f) AS a, array(0f, 0f) AS z")
    got = row.select(vectors.quantize(F.col("a")).alias("p"), vectors.quantize(F.col("z")).alias("z"), vectors.cosine(F.col("a"), F.col("a")).alias("c")).first()
    assert got.p.q == [64, -127, 32] and got.z.scale == 1 and abs(got.c - 1) < 1e-9
