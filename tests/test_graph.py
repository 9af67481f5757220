import random

import pytest

from larkspur.operators import extract, graph, rescue, targets
from larkspur.service import Service

FILES = [
    ("a.ts", "export function greet() { return 1 }\nexport function farewell() {}\n"),
    ("b.ts", "import { greet as hello, greet } from './a';\nfunction main() {\n  greet();\n  other.greet();\n}\n"),
    ("c.rs", "fn helper() {}\nfn run() {\n    helper();\n}\n#[cfg(test)]\nmod tests {\n    fn t() { run(); }\n}\nstruct S;\nimpl S {\n    fn new() -> S { helper(); S }\n}\n"),
    ("d.ts", "import * as ns from './a';\nfunction use() { ns.farewell(); missing(); }\n"),
    ("pkg/m.py", "from .util import tool\nclass K:\n    def go(self):\n        self.stop()\n        tool()\n    def stop(self):\n        pass\n"),
    ("pkg/util.py", "def tool():\n    return 1\n"),
    ("broken.py", "def ("),
    ("m/Main.java", "import m.util.Box;\npublic class Main {\n  public int go(int x) {\n    return helper(x);\n  }\n  private int helper(int x) { return x; }\n}\n"),
    ("m/util/Box.java", "package m.util;\npublic class Box {}\n"),
    ("g/main.go", "package main\nimport \"x/g/lib\"\ntype T struct {}\nfunc (t *T) Go() { helper() }\nfunc helper() {}\n"),
    ("g/lib/l.go", "package lib\nfunc L() {}\n"),
]


@pytest.fixture(scope="module")
def service(spark):
    return Service(spark, spark.createDataFrame(FILES, "path string, content string"))


def edges_of(service):
    return {(r.src, r.dst, r.tier) for r in service.graph["edges"].collect()}


def test_symbols(service):
    uids = {r.uid for r in service.graph["symbols"].collect()}
    assert {"a.ts#greet#function", "c.rs#S::new#method", "pkg/m.py#K.go#method", "m/Main.java#Main.go#method", "g/main.go#T.Go#method", "g/main.go#T#struct"} <= uids
    assert not any("tests" in u or "#t#" in u or "broken" in u for u in uids)


def test_resolution(service):
    edges = edges_of(service)
    assert ("b.ts#main#function", "a.ts#greet#function", "exact") in edges
    assert ("b.ts#main#function", "a.ts#greet#function", "probable") in edges  # other.greet()
    assert ("c.rs#run#function", "c.rs#helper#function", "exact") in edges
    assert ("d.ts#use#function", "a.ts#farewell#function", "probable") in edges  # a namespace binds no name
    assert ("pkg/m.py#K.go#method", "pkg/m.py#K.stop#method", "exact") in edges  # self
    assert ("pkg/m.py#K.go#method", "pkg/util.py#tool#function", "probable") in edges
    assert {r["name"] for r in service.graph["open_calls"].collect()} >= {"missing"}


def test_imports(service):
    got = {(r.file, r.spec): r.target for r in service.graph["file_imports"].collect()}
    assert got == {("b.ts", "./a"): "a.ts", ("d.ts", "./a"): "a.ts", ("pkg/m.py", ".util"): "pkg/util.py", ("m/Main.java", "m.util.Box"): "m/util/Box.java", ("g/main.go", "x/g/lib"): "g/lib/l.go"}


@pytest.mark.parametrize(
    "lang, path, spec, want",
    [("ts", "a/b.ts", "../c", ("exact", "c.ts")), ("ts", "a.ts", "react", None), ("rust", "src/a.rs", "crate::b::C", ("exact", "src/b/C.rs")), ("rust", "src/x/a.rs", "super::b", ("exact", "src/b.rs")), ("rust", "a.rs", "std::io", None),
     ("python", "p/q/m.py", "..util.x", ("exact", "p/util/x.py")), ("python", "m.py", "a.b", ("exact", "a/b.py")), ("go", "m.go", "h/x/y", ("folder", "h/x/y")), ("java", "M.java", "a.b.*", ("folder", "a/b"))],
)
def test_import_rules(lang, path, spec, want):
    got = graph.import_candidates(lang, path, spec)
    assert (got[0] if got else None) == want


def test_decisions(spark):
    symbols = [("s1", "f1", "n", "function", 5), ("s2", "f1", "n", "method", 1), ("s3", "f2", "n", "class", 1), ("s4", "f3", "only", "function", 1), ("s5", "f3", "only", "method", 9), ("s6", "f4", "v", "enum", 1), ("s7", "f2", "two", "function", 1), ("s8", "f3", "two", "function", 1)]
    calls = [(1, "f1", "n", None, "c"), (2, "f1", "n", "obj", "c"), (3, "f9", "n", None, "c"), (4, "f8", "n", None, "c"), (5, "f9", "only", "self", "c"), (6, "f9", "v", None, "c"), (7, "f1", "n", None, None), (8, "f7", "two", None, "c"), (9, "f6", "two", "x", "c")]
    imports = [("f8", "f2", "n"), ("f7", "f2", "two"), ("f7", "f3", "two"), ("f6", "f3", "two")]
    got = graph.resolve_calls(
        spark.createDataFrame(calls, "call_id int, file string, name string, receiver string, caller string"),
        spark.createDataFrame(symbols, "uid string, file string, name string, kind string, start_line int"), spark.createDataFrame(imports, "file string, target string, binding string"),
    )
    assert {tuple(r) for r in got.collect()} == {(1, "s1", "exact"), (2, "s1", "probable"), (4, "s3", "exact"), (5, "s4", "probable"), (9, "s8", "probable")}


def test_impact_and_trace(spark):
    edges = spark.createDataFrame([("beta", "alpha", "calls", "exact"), ("gamma", "beta", "calls", "probable"), ("gamma", "alpha", "other", "exact"), ("alpha", "alpha", "calls", "exact")], "src string, dst string, kind string, tier string")
    start = spark.createDataFrame([("alpha",)], "id string")
    rows = graph.impact(edges, start)
    assert {(r.id, r.depth, r.tier) for r in rows.collect()} == {("beta", 1, "exact"), ("gamma", 2, "probable")}
    files = spark.createDataFrame([("beta", 1), ("gamma", 2)], "id string, file_id int")
    s = graph.impact_summary(rows, files, None, True).first()
    assert (s.depth1, s.depth2, s.depth3, s.n_files, s.risk) == (1, 1, 0, 2, "MEDIUM")
    t = graph.trace(edges, "gamma", "alpha").first()
    assert t.found and t.path == ["gamma", "beta", "alpha"]
    assert graph.trace(edges, "alpha", "gamma").first().found is False
    assert graph.trace(edges, "alpha", "alpha").first().depth == 0


def test_impact_depth_is_distance(spark):
    rng = random.Random(4)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(120)}
    edges = spark.createDataFrame([(a, b, "calls", "exact") for a, b in pairs if a != b], "src int, dst int, kind string, tier string")
    got = {r.id: r.depth for r in graph.impact(edges, spark.createDataFrame([(0,)], "id int"), 3, False).collect()}
    far, level = {0: 0}, [0]
    for d in (1, 2, 3):
        level = [b for a, b in pairs if a in level and b not in far and not far.update({b: d})]
    assert got == {k: v for k, v in far.items() if v}


def test_processes_and_clusters(spark):
    rng = random.Random(6)
    pairs = sorted({(rng.randrange(80), rng.randrange(80)) for _ in range(160)})
    pairs = [(a, b // 40 * 40 + a % 40 if rng.random() < 0.1 else (a // 40) * 40 + b % 40) for a, b in pairs]
    pairs = [(a, b) for a, b in pairs if a != b]
    edges = spark.createDataFrame([(a, b, "calls", "exact" if b % 3 else "probable") for a, b in pairs], "src int, dst int, kind string, tier string")
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    labels = {r.id: r.label for r in graph.label_propagation(edges).collect()}
    assert labels == graph.propagate(near)
    entries = edges.groupBy("src").count().selectExpr("src AS id", "count AS out_degree")
    steps = {}
    for r in graph.processes(edges, entries, most=10).collect():
        steps.setdefault(r.process_id, []).append((r.step, r.id))
    calls = {}
    for a, b in sorted(set(pairs), key=lambda e: (e[0], e[1] % 3 == 0, e[1])):
        calls.setdefault(a, []).append(("", b))
    top = sorted(((-r.out_degree, r.id) for r in entries.collect()))
    want, seen = [], set()
    for _, e in top[:40]:
        w = graph.walk(e, calls)
        if len(w) >= 3 and tuple(sorted(w)) not in seen:
            seen.add(tuple(sorted(w)))
            want.append(w)
    assert [[i for _, i in sorted(s)] for _, s in sorted(steps.items())] == want[:10]


def test_clusters_of_service(service):
    assert service.clusters().count() >= 1
    assert service.graph_stats()["symbols"] > 10


def test_service(service):
    assert [r.path for r in service.uses("greet").collect()] == ["b.ts", "b.ts"]
    assert service.symbol("a.ts#greet#function").count() == 1 and service.symbol("S::new").count() == 1
    assert service.trace("main", "greet").first().found
    got = service.impact("greet")
    assert got["summary"].first().depth1 == 1 and not got["envelope"].first().lower_bound
    rows = {r.path: r.tier for r in service.targets("fix `greet` in main").collect()}
    assert rows["a.ts"] == "P0" and "b.ts" in rows
    text, layer, left = service.context("greet", 2000)
    assert layer == "L2" and left == 0 and "export function greet()" in text
    small = service.context("greet", 7)
    assert small[1] == "L0" and small[2] > 0 and "elided" in small[0]
    assert service.search("greet").rows.count() == 4 and service.status()["files"] == len(FILES)
    assert service.processes().count() >= 0


def test_change_impact(service, spark):
    got = service.changes(spark.createDataFrame([(1, "a.ts", 1, 1)], "hunk_id int, file_id string, a int, b int")).first()
    assert (got.n_symbols, got.n_callers, got.risk) == (1, 1, "LOW")


def test_rescue(spark):
    rows = [("p", 0, "oid0000000", "b2", "good calc totals"), ("p", 1, "oid1111111", "b1", "rework calc"), ("p", 2, "oid2222222", "b0", "first"), ("q", 0, "x", "b", "fine"), ("q", 1, "y", "c", "older"), ("r", 0, "z", "b", "bad rework")]
    df = spark.createDataFrame(rows, "path string, idx int, oid string, blob string, subject string")
    got = {r.path: (r.oid, r.reason, r.dirty) for r in rescue.plan(df, ["REWORK"], spark.createDataFrame([("q",)], "path string")).collect()}
    assert got["p"] == ("oid2222222", "last version before suspect commit oid1111", False)
    assert got["q"] == ("y", "newest version whose content differs from HEAD", True) and got["r"][0] is None


def loop_tiers(rows, limit):
    out, p0, p2 = [], 0, 0
    for path, score, fam, exact in sorted(rows, key=lambda r: (-r[1], r[0])):
        if len(out) >= limit:
            break
        lexical = fam & 7
        if lexical and p0 < min(5, limit) and (exact or fam.bit_count() >= 2 and fam & 3):
            p0 += 1
            out.append((path, "P0"))
        elif lexical:
            out.append((path, "P1"))
        elif p2 < -(-limit // 4):
            p2 += 1
            out.append((path, "P2"))
    return sorted(out)


@pytest.mark.parametrize("limit", [1, 3, 8, 20, 100])
def test_tiers_match_the_loop(spark, limit):
    rng = random.Random(limit)
    rows = [(f"f{i}", rng.randrange(30) / 100, rng.randrange(1, 32), rng.random() < 0.1) for i in range(80)]
    got = targets.tiers(spark.createDataFrame(rows, "path string, score double, families int, exact boolean"), limit)
    assert sorted((r.path, r.tier) for r in got.collect()) == loop_tiers(rows, limit)


def test_scanner_survives_anything():
    for lang in ("ts", "rust", "go", "java", "python"):
        for source in ("", "}{", "fn", "class", "'\"`/*", "function f( {" * 50):
            extract.extract_file("x", source, lang)


def _overlap_rows():
    rng = random.Random(9)
    hunks = [(i // 2 if i < 20 else i, i % 3, a, a + rng.randrange(-1, 90)) for i in range(60) for a in [rng.randrange(300)]]
    spans = [(i // 2 if i < 10 else i, i % 3, a, a + rng.randrange(120)) for i in range(40) for a in [rng.randrange(300)]]
    return hunks, spans


def _ranges(spark, hunks, spans):
    return spark.createDataFrame(hunks, "hunk_id int, file_id int, a int, b int"), spark.createDataFrame(spans, "id int, file_id int, start int, end int")


def test_overlapping_pairs_come_once_without_a_shuffle_of_pairs(spark):
    hunks, spans = _overlap_rows()
    for h, s in ((hunks, spans), (hunks[20:], spans[10:])):
        got = sorted(map(tuple, graph.overlapping(*_ranges(spark, h, s)).collect()))
        assert got == sorted({(x[0], y[0]) for x in h for y in s if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]})
    plan = graph.overlapping(*_ranges(spark, hunks[20:], spans[10:]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_smallest_enclosing_meets_spans_once_a_line(spark):
    rng = random.Random(5)
    points = [(i % 90, i % 3, rng.randrange(-5, 320)) for i in range(100)]
    _, spans = _overlap_rows()
    spans += [(100 + i, f, a, b) for i, (_, f, a, b) in enumerate(spans[:9])]
    df = graph.smallest_enclosing(spark.createDataFrame(points, "point_id int, file_id int, line int"), _ranges(spark, [], spans)[1])
    want = {}
    for p, f, line in points:
        for i, g, a, b in spans:
            if f == g and a <= line <= b:
                want[p] = min(want.get(p, (b - a, i)), (b - a, i))
    assert {r.point_id: r.id for r in df.collect()} == {p: i for p, (_, i) in want.items()}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    lines = plan[plan.rindex("Join Inner, ") :]  # the join on slots, the deepest
    assert lines.count("Aggregate") == 2  # distinct lines, equal spans


def test_touched_makes_no_pairs(spark):
    hunks, spans = _overlap_rows()
    df = graph.touched(*_ranges(spark, hunks, spans))
    assert sorted(r.id for r in df.collect()) == sorted({y[0] for x in hunks for y in spans if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]})
    assert "Join LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()


def test_processes_keep_bounded_rows_of_a_hub(spark, monkeypatch):
    pairs = [(0, b) for b in range(1, 3000)] + [(b, 3000 + b) for b in range(1, 3000)] + [(5, 1), (5, 2), (5, 6)]
    edges = spark.createDataFrame([(a, b, "calls", "probable" if b % 2 else "exact") for a, b in pairs] + [(0, 1, "calls", "exact")], "src int, dst int, kind string, tier string")
    near = {}
    for a, b in sorted(set(pairs), key=lambda e: (e[0], e[1] % 2 == 1 and e != (0, 1), e[1])):
        near.setdefault(a, []).append(("", b))
    groups = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: groups.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    rows = graph.processes(edges, spark.createDataFrame([(0, 9), (5, 3)], "id int, out_degree int"), most=5).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.process_id, r.step)):
        got.setdefault(r.process_id, []).append(r.id)
    assert [got[k] for k in sorted(got)] == [graph.walk(0, near), graph.walk(5, near)]
    assert sum("WindowGroupLimit" in g or "row_number" in g for g in groups) == 6  # a level's callees are cut to those that can matter


def test_change_impact_counts_processes_of_symbols_and_callers(spark):
    hunks, spans = _ranges(spark, [(1, 1, 5, 6)], [(1, 1, 1, 9), (2, 2, 1, 9), (3, 3, 1, 9)])
    edges = spark.createDataFrame([(2, 1, "calls", "exact"), (3, 2, "calls", "exact")], "src int, dst int, kind string, tier string")
    members = spark.createDataFrame([(i, m) for i, m in enumerate([1, 1, 2, 2, 2, 1, 1, 2, 2, 3, 3])], "process_id int, id int")
    got = graph.change_impact(hunks, spans, edges, members).first()
    assert (got.n_symbols, got.n_callers, got.n_processes, got.risk) == (1, 1, 9, "HIGH")


def test_change_impact_query_has_processes(spark, data):
    from larkspur.queries import ORACLE_SQL, QUERIES

    assert QUERIES["change_impact"](spark, data).first()["n_processes"] > 0 and "0::BIGINT AS n_processes" not in ORACLE_SQL["change_impact"]


def test_trace_takes_the_smallest_path_and_reads_the_calls_once(spark, tmp_path):
    pairs = [(0, 2), (0, 1), (0, 2), (1, 5), (2, 4), (2, 5), (5, 9), (4, 9), (9, 0), (1, 6), (6, 7)]
    edges = spark.createDataFrame([(a, b, "calls", "exact") for a, b in pairs], "src int, dst int, kind string, tier string")
    reads = spark.sparkContext.accumulator(0)
    counted = spark.createDataFrame(edges.rdd.map(lambda r: reads.add(1) or r), edges.schema)
    got = graph.trace(counted, 0, 9).first()
    assert (got.found, got.depth, list(got.path), got.furthest) == (True, 3, [0, 1, 5, 9], None)
    assert reads.value == len(pairs)
    got = graph.trace(edges, 0, 77).first()
    assert (got.found, got.depth, got.path, got.furthest) == (False, None, None, 7)
    assert graph.trace(edges, 7, 1).first().furthest is None
