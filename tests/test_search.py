import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.operators import search
from larkspur.plans import grams
from larkspur.plans import regex as rx

CORPUS = ["fn handleClick() {}", "openMenu(); closeMenu()", "const MAX_FILE_SIZE = 4;", "let my_test = ab;", "ERROR: bad", "abcdefghijkl", "ghijkl", "handle.foo()", "", "über Straße"]
PATTERNS = ["handleClick", "handleClick|openMenu", r"fn \w+_test", "(?i)error", "(abcdef)?ghijkl", "MAX_FILE_SIZE", r"handle.*\(\)", "ab", r"\w+", "(abc|def)+ghi", "[hH]andle[CD]lick", "(?i)straße", "a{2,3}b", "x*ghi+jkl"]


def gram_set(text, extractor):
    return set(grams.sparse_grams(text)) if extractor.kind == "sparse" else {text[i : i + 3] for i in range(len(text) - 2)}


@pytest.mark.parametrize("kind", ["trigram", "sparse"])
@pytest.mark.parametrize("pattern", PATTERNS)
def test_plans_never_miss(kind, pattern):
    ex = grams.Extractor(kind)
    plan = rx.plan_pattern(pattern, ex)
    for text in CORPUS:
        if re.search(pattern, text):
            assert rx.holds(plan, gram_set(text, ex)), text


@settings(max_examples=200, deadline=None)
@given(st.text("abcd(|)*+?", max_size=12), st.lists(st.text("abcd", max_size=20), max_size=6))
def test_plans_never_miss_random(pattern, texts):
    try:
        plan = rx.plan_pattern(pattern)
    except ValueError:
        return
    for t in texts:
        if re.search(pattern, t):
            assert rx.holds(plan, {t[i : i + 3] for i in range(len(t) - 2)})


def brute_sparse(text, least, most):
    w = [grams.crc_weight(text[i : i + 2]) for i in range(len(text) - 1)]
    return {(i, j + 2) for i in range(len(w)) for j in range(i + 1, len(w)) if least <= j + 2 - i <= most and all(w[k] < min(w[i], w[j]) for k in range(i + 1, j))}


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=40))
def test_sparse_grams_by_definition(text):
    spans = list(grams.sparse_spans(text, 3, 8))
    assert set(spans) == brute_sparse(text, 3, 8) and len(spans) <= 2 * len(text)


@settings(max_examples=100, deadline=None)
@given(st.text("abcdefg", max_size=30), st.text("abcdefg", min_size=1, max_size=12), st.text("abcdefg", max_size=30))
def test_sparse_cover_is_sound(a, literal, b):
    assert set(grams.cover_sparse(literal)) <= set(grams.sparse_grams(a + literal + b))


@pytest.mark.parametrize("bad", ["(", "(?=x)y", r"(a)\1", "(?i:x)"])
def test_plans_refuse(bad):
    with pytest.raises(ValueError):
        rx.plan_pattern(bad)


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(3)
    rows = [(f"src/d{i % 4}/f{i}.rs", "\n".join(rng.choice(CORPUS) for _ in range(6))) for i in range(40)] + [("src/foobar", "needle\0hidden needle"), ("src/foo", "needle\r\nx\n"), ("bin", "a\0needle" + "x" * 9000)]
    return spark.createDataFrame(rows, "path string, content string")


@pytest.mark.parametrize("pattern", PATTERNS[:12])
@pytest.mark.parametrize("kind", ["trigram", "sparse"])
def test_index_equals_scan(files, pattern, kind):
    ex = grams.Extractor(kind)
    with_, without = (sorted(map(tuple, search.search(files, pattern, i, extractor=ex).collect())) for i in (search.postings(files, ex), None))
    assert with_ == without


def test_lines_prefixes_pages(files):
    got = sorted(map(tuple, search.search(files, "needle", prefixes=["src/foo"]).collect()))
    assert got == [("src/foo", 1, "needle")]
    rows = search.search(files, "e")
    first, second = search.page(rows, ["path", "line"], 0, 10), search.page(rows, ["path", "line"], 10, 10)
    assert first.truncated and first.rows.count() == 10
    assert not set(map(tuple, first.rows.collect())) & set(map(tuple, second.rows.collect()))
    assert not search.page(rows, ["path", "line"], 0, rows.count()).truncated


def test_written_index(spark, files, tmp_path):
    path = str(tmp_path / "ix")
    search.write_index(files, path, partitions=3)
    index = search.open_index(spark, path)
    assert search.search(files, "openMenu", index).count() == search.search(files, "openMenu").count() > 0
    with pytest.raises(ValueError):
        search.open_index(spark, path, grams.Extractor("sparse"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab cdeéß漢😀", max_size=30)), max_size=6))
def test_grams_of_columns_are_those_of_strings(texts):
    col = pa.array(["skipped", *texts], pa.string()).slice(1)
    sparse = grams.distinct_grams(col, 3, 8, True).to_pylist()
    three = grams.distinct_grams(col).to_pylist()
    for t, a, b in zip(texts, sparse, three, strict=True):
        assert sorted(a) == sorted(set(grams.sparse_grams(t or ""))) and sorted(b) == sorted({t[i : i + 3] for i in range(len(t) - 2)} if t else [])


def test_stored_index_is_written_once_and_pushes_the_filter(spark, files, tmp_path):
    files.write.parquet(str(tmp_path / "files"))
    stored = spark.read.parquet(str(tmp_path / "files"))
    first = search.stored_index(stored)
    assert first.inputFiles() == search.stored_index(stored).inputFiles()
    assert search.search(stored, "openMenu", first).count() == search.search(files, "openMenu").count() > 0
    plan = search.candidates(first, rx.plan_literal("openMenu"), stored)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
    spark.read.parquet(str(tmp_path / "files")).limit(3).write.parquet(str(tmp_path / "less"))
    assert search.stored_index(spark.read.parquet(str(tmp_path / "less"))).inputFiles() != first.inputFiles()


def test_signature(spark, files):
    a = search.signature(files).first()[0]
    assert a == search.signature(files.repartition(7)).first()[0] != search.signature(files.limit(5)).first()[0]


def test_posting_algebra():
    have = {1: {"a", "b", "c"}, 2: {"b", "c", "d"}, 3: {"c", "e"}}
    g = rx.Gram
    assert [k for k, v in have.items() if rx.holds(rx.conj([g("b"), g("c")]), v)] == [1, 2]
    assert [k for k, v in have.items() if rx.holds(rx.disj([g("a"), g("e")]), v)] == [1, 3]
    assert rx.disj([g("a"), rx.All()]) == rx.All() and rx.conj([rx.All(), g("a")]) == g("a") and rx.conj([]) == rx.All()


def test_candidates_read_the_plan_only(files):
    plan = rx.plan_literal("openMenu")
    text = search.candidates(search.postings(files), plan, files)._jdf.queryExecution().optimizedPlan().toString()
    assert "IN (" in text or "INSET" in text


from pyspark.sql import functions as F  # noqa: E402


def test_index_shuffles_texts_and_no_postings(spark, files, tmp_path, monkeypatch):
    plans = []
    real = search._cut
    monkeypatch.setattr(search, "_cut", lambda dealt, ex: plans.append(dealt) or real(dealt, ex))
    monkeypatch.setattr(search, "SHARD", 1 << 10)
    search.write_index(files, str(tmp_path / "ix"))
    index = search.open_index(spark, str(tmp_path / "ix"))
    assert sorted(map(tuple, index.select("gram", "path").collect())) == sorted(map(tuple, search.postings(files).select("gram", "path").collect()))
    per_file = index.withColumn("f", F.input_file_name()).groupBy("f").agg(F.collect_set("path").alias("p")).collect()
    assert len(per_file) > 3 and sum(len(r.p) for r in per_file) == len({p for r in per_file for p in r.p})  # a file's postings lie in one shard
    assert plans[0].columns == ["path", "content"]


def test_grams_of_files_come_piece_by_piece(monkeypatch):
    monkeypatch.setattr(grams, "PIECE", 100)
    texts = ["abcdef " * 10, "x" * 300, "", None, "ghi jkl " * 9, "漢字かな" * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(list("abcdef")), pa.array(texts, pa.string())], ["path", "content"])
    got = list(grams.grams_of_files(3, 8, True)(iter([batch])))
    assert len(got) > 3 and [p for b in got for p in b.column(0).to_pylist()] == list("abcdef")
    assert [sorted(g) for b in got for g in b.column(1).to_pylist()] == [sorted(set(grams.sparse_grams(t or ""))) for t in texts]


def test_index_holds_lists_of_paths(spark, files, tmp_path):
    """A row for each posting took most of the time of writing an index."""
    search.write_index(files, str(tmp_path / "ix"), partitions=2)
    rows = spark.read.parquet(str(tmp_path / "ix" / "postings")).withColumn("f", F.input_file_name())
    assert rows.count() == rows.select("f", "gram").distinct().count() < search.open_index(spark, str(tmp_path / "ix")).count() / 4
    for part in (tmp_path / "ix" / "postings").glob("*.parquet"):
        held = [r.gram.encode() for r in spark.read.parquet(str(part)).coalesce(1).collect()]
        assert held == sorted(held)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab cdeéß漢😀\0", max_size=30)), max_size=6), st.sampled_from(["quick", "sparse", "many characters"]))
def test_inverted_lists_are_the_grams_of_texts(texts, way):
    ex, want = grams.Extractor("sparse" if way == "sparse" else "trigram"), {}
    for i, t in enumerate(texts):
        for g in gram_set(t or "", ex):
            want.setdefault(g, []).append(i)
    with pytest.MonkeyPatch.context() as patch:
        if way == "many characters":  # more than 64 bits have room for
            patch.setattr(grams, "_inverted_trigrams", lambda texts: None)
        values, first, row = grams.inverted(pa.array(["skipped", *texts], pa.string()).slice(1), sparse=way == "sparse")
    ends = [*first.tolist()[1:], len(row)]
    assert list(zip(values.to_pylist(), [row[a:b].tolist() for a, b in zip(first, ends)])) == sorted(want.items(), key=lambda x: x[0].encode())


def test_inverted_lists_come_in_bounded_rows_and_batches(monkeypatch):
    for name, most in (("SHARD", 200), ("LIST", 4), ("BATCH", 16)):
        monkeypatch.setattr(grams, name, most)
    texts = [f"abcdef {i}" for i in range(90)] + [None, "", "漢字かな"]
    batch = pa.RecordBatch.from_arrays([pa.array([f"p{i}" for i in range(93)]), pa.array(texts, pa.string())], ["path", "content"])
    monkeypatch.setattr(grams, "PIECE", 100)
    got = list(grams.lists_of_files()(iter([batch.slice(0, 50), batch.slice(50)])))
    rows = [(g, p) for b in got for g, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for p in ps]
    assert sorted(rows) == sorted((g, f"p{i}") for i, t in enumerate(texts) for g in {(t or "")[k : k + 3] for k in range(len(t or "") - 2)})
    assert max(len(ps) for b in got for ps in b.column(1).to_pylist()) <= 4 and max(sum(map(len, b.column(1).to_pylist())) for b in got) <= 16
