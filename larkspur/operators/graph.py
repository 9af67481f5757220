"""The code graph: imports, call resolution, impact, paths, processes, clusters, changes."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as fn
from larkspur.operators.lineage import cut, kept

CALLABLE = ["function", "method", "class", "struct"]
SELF = ["self", "Self", "this", "crate", "super"]
RISKS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
# How names and paths of tests look (case doesn't count, _ is any character).
TEST_NAMES = ["test_%", "test%", "%_test", "%Test", "%_tests", "%Tests", "it_%", "it%", "spec_%", "should_%", "expect_%"]
TEST_PATHS = [
    "tests/%", "%/tests/%", "test/%", "%/test/%", "%/__tests__/%", "benches/%", "%/benches/%", "%.test.ts", "%.test.tsx", "%.spec.ts", "%.spec.tsx",
    "%_test.go", "test_%.py", "%/test_%.py",
]


def kind_priority(kind: Column) -> Column:
    out = F.lit(len(CALLABLE))
    for i, k in enumerate(CALLABLE):
        out = F.when(kind == k, i).otherwise(out)
    return out


def distinct_uids(symbols: DataFrame, order: str) -> DataFrame:
    """One row for each uid: the last one."""
    return symbols.withColumn("_r", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


# Resolution ---------------------------------------------------------------------------------------------------------------


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """call_id, dst, tier: to which symbol a call goes, if that can be told.

    calls(call_id, file, name, receiver, caller); symbols(uid, file, name, kind, start_line); imports(file, target, binding).
    A candidate in the caller's file is exact; else one in the single file from which the caller imports that name (several
    files leave the call open); else one whose name lives in a single file, as probable. A receiver other than the instance
    or module itself makes exact probable. A call outside of any symbol stays open. Few numbers for each name and file stand
    for all candidates, so a common name's symbols never meet its calls pair by pair."""
    best = F.min(F.struct(kind_priority(F.col("kind")).alias("p"), F.col("start_line"), F.col("uid")))
    by_file = symbols.filter(F.col("kind").isin(CALLABLE)).groupBy("name", "file").agg(best.alias("best"))
    by_name = by_file.groupBy("name").agg(F.count("*").alias("n_files"), F.min("best").alias("any"))
    taken = imports.select("file", "target", F.col("binding").alias("name")).distinct()
    imported = taken.join(by_file.withColumnRenamed("file", "target"), ["target", "name"]).groupBy("file", "name").agg(F.count("*").alias("n_imported"), F.min("best").alias("bound"))
    own = by_file.withColumnRenamed("best", "own")
    inside = calls.filter(F.col("caller").isNotNull())
    met = inside.join(own, ["name", "file"], "left").join(imported, ["name", "file"], "left").join(by_name, "name", "left")
    real = F.col("receiver").isNotNull() & ~F.col("receiver").isin(SELF)
    exact = F.when(real, "probable").otherwise("exact")
    choice = (
        F.when(F.col("own").isNotNull(), F.struct(F.col("own.uid").alias("dst"), exact.alias("tier")))
        .when(F.col("n_imported") == 1, F.struct(F.col("bound.uid").alias("dst"), exact.alias("tier")))
        .when(F.col("n_imported") > 1, None)
        .when(F.col("n_files") == 1, F.struct(F.col("any.uid").alias("dst"), F.lit("probable").alias("tier")))
    )
    return met.withColumn("choice", choice).filter("choice IS NOT NULL").select("call_id", "choice.dst", "choice.tier")


def unresolved(calls: DataFrame, resolved: DataFrame) -> DataFrame:
    return calls.join(resolved, "call_id", "left_anti")


def envelope(open_calls: DataFrame, names: DataFrame) -> DataFrame:
    """name, unresolved_same_name, lower_bound: whether open calls of a name may hide callers."""
    n = open_calls.groupBy("name").agg(F.count("*").alias("n"))
    out = names.select("name").distinct().join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("unresolved_same_name"))
    return out.withColumn("lower_bound", F.col("unresolved_same_name") > 0)


#: Lines of a slot: spans and hunks meet in slots on equality.
WIDTH = 32


def _slots(rows: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each slot of lines that the range first to last touches."""
    return rows.withColumn("slot", F.explode(F.sequence(F.floor(F.col(first) / WIDTH), F.floor(F.col(last) / WIDTH))))


def smallest_enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """point_id, id: the smallest span (file_id, start, end, id) around each point (file_id, line, point_id).

    Spans are cut into slots; a line looks into its own slot only, and once, however many points lie on it. Equal spans count
    as one, that of the smallest id, so what meets is bounded by lines and different ranges, and points join one row a line."""
    own = spans.groupBy("file_id", "start", "end").agg(F.min("id").alias("id"))
    lines = points.select("file_id", "line").distinct().withColumn("slot", F.floor(F.col("line") / WIDTH))
    met = lines.join(_slots(own, "start", "end"), ["file_id", "slot"]).filter("line BETWEEN start AND end")
    sized = met.groupBy("file_id", "line", (F.col("end") - F.col("start")).alias("size")).agg(F.min("id").alias("id"))
    best = sized.groupBy("file_id", "line").agg(F.min_by("id", "size").alias("id"), F.min("size").alias("size"))
    return points.join(best, ["file_id", "line"]).groupBy("point_id").agg(F.min(F.struct("size", "id"))["id"].alias("id"))


def overlapping(hunks: DataFrame, spans: DataFrame) -> DataFrame:
    """hunk_id, id of spans that share a line with a hunk (file_id, a, b).

    A pair of ranges is taken in the first slot that both touch, so it comes once and pairs need no shuffle. Only those of
    ids that have several rows, which may come from several ranges, are made distinct."""
    parts = int(hunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(h: DataFrame, s: DataFrame) -> DataFrame:
        first = lambda rows, a, b: rows.withColumn("first", F.floor(F.least(a, b) / WIDTH))
        # Dealt in a fixed number of parts: the pairs, not the rows that are read, are the work.
        h = _slots(first(h, "a", "b"), "a", "b").repartition(parts, "file_id", "slot")
        pairs = h.join(_slots(first(s, "start", "end").withColumnRenamed("first", "own"), "start", "end"), ["file_id", "slot"])
        return pairs.filter("a <= end AND start <= b AND slot = greatest(first, own)").select("hunk_id", "id")

    def several(rows: DataFrame, key: str) -> DataFrame:
        return cut(rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n")).filter("n > 1").select("_k"))

    def split(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        return tuple(rows.join(keys, rows[key].eqNullSafe(keys["_k"]), how) for how in ("left_anti", "left_semi"))

    again_h, again_s = several(hunks, "hunk_id"), several(spans, "id")
    if again_h.isEmpty() and again_s.isEmpty():
        return met(hunks, spans)
    (one_h, many_h), (one_s, many_s) = split(hunks, "hunk_id", again_h), split(spans, "id", again_s)
    return met(one_h, one_s).unionByName(met(many_h, spans).unionByName(met(one_h, many_s)).distinct())


def touched(hunks: DataFrame, spans: DataFrame) -> DataFrame:
    """id of spans that share a line with any hunk (file_id, a, b): equal hunks count once, and a span stops at its first."""
    h = _slots(hunks.select("file_id", "a", "b").distinct(), "a", "b").withColumnRenamed("file_id", "_f").withColumnRenamed("slot", "_s")
    on = (F.col("file_id") == F.col("_f")) & (F.col("slot") == F.col("_s")) & (F.col("a") <= F.col("end")) & (F.col("start") <= F.col("b"))
    return _slots(spans, "start", "end").join(h, on, "left_semi").select("id").distinct()


# Imports ------------------------------------------------------------------------------------------------------------------

_JS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


def import_candidates(lang: str, path: str, spec: str) -> list[tuple[str, str]]:
    """(how, path) in order of preference, how being exact, suffix (a path that ends so) or folder (a file of that folder)."""
    folder = path.rpartition("/")[0]
    join = lambda *p: "/".join(x for x in p if x)

    def normal(p: str) -> str:
        out: list[str] = []
        for part in p.split("/"):
            if part == "..":
                out = out[:-1]
            elif part not in ("", "."):
                out.append(part)
        return "/".join(out)

    up = lambda d, n: "/".join(d.split("/")[: max(0, len(d.split("/")) - n)]) if d else ""
    if lang in ("ts", "tsx", "js"):
        if not spec.startswith("."):
            return []
        base = normal(join(folder, spec))
        return [("exact", base)] * (f".{base.rpartition('.')[2]}" in _JS) + [("exact", base + e) for e in _JS] + [("exact", f"{base}/index{e}") for e in _JS]
    if lang == "python":
        dots = len(spec) - len(spec.lstrip("."))
        parts = [s for s in spec.split(".") if s]
        if dots:
            base = join(up(folder, dots - 1), "/".join(parts))
            return [("exact", f"{base}.py"), ("exact", join(base, "__init__.py"))]
        tries = [f"{'/'.join(parts[:k])}{end}" for k in range(len(parts), 0, -1) for end in (".py", "/__init__.py")]
        return [(how, t) for t in tries for how in ("exact", "suffix")]
    if lang == "rust":
        parts = [s for s in spec.split(" as ")[0].split("{")[0].strip().strip(":").split("::") if s and s != "*"]
        if not parts or parts[0] in ("std", "core", "alloc"):
            return []
        roots = ["src", "", folder]
        if parts[0] == "crate":
            roots, parts = ["src", ""], parts[1:]
        elif parts[0] == "self":
            roots, parts = [folder], parts[1:]
        elif parts[0] == "super":
            n = next((i for i, s in enumerate(parts) if s != "super"), len(parts))
            roots, parts = [up(folder, n)], parts[n:]
        out = []
        for k in range(len(parts), 0, -1):
            mod = "/".join(parts[:k])
            out += [("exact", join(r, mod) + end) for r in roots for end in (".rs", "/mod.rs")] + [("suffix", f"{mod}.rs")]
        return out
    if lang == "go":
        parts = [s for s in spec.split("/") if s]
        return [("folder", "/".join(parts[-n:])) for n in range(len(parts), 0, -1)]
    if lang == "java":
        if spec.endswith(".*"):
            return [("folder", spec[:-2].replace(".", "/"))]
        return [("suffix", spec.replace(".", "/") + ".java"), ("suffix", spec.rpartition(".")[2] + ".java")]
    return []


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file, spec, target: the file that an import means, by its language's rules; imports(file, spec), files(path).

    Candidates are spelled out for each import; whole paths, endings and folders of files are then joined on equality."""

    @F.pandas_udf("array<struct<at: int, how: string, key: string>>")
    def tries(lang: pd.Series, path: pd.Series, spec: pd.Series) -> pd.Series:
        return pd.Series([[{"at": i, "how": h, "key": k} for i, (h, k) in enumerate(import_candidates(a or "", b, c or ""))] for a, b, c in zip(lang, path, spec, strict=True)])

    wanted = imports.select("file", "spec", F.explode(tries(fn.lang_of(F.col("file")), "file", "spec")).alias("t")).select("file", "spec", "t.*")
    wanted = wanted.withColumn("ext", fn.lang_of(F.col("file")))
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    folder = F.split(fn.dirname(F.col("path")), "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(folder)), lambda i: F.array_join(F.slice(folder, i, F.size(folder)), "/"))
    known = files.select("path").distinct().withColumn("ext", fn.lang_of(F.col("path")))
    exact = known.select("ext", F.lit("exact").alias("how"), F.col("path").alias("key"), "path")
    suffix = known.select("ext", F.lit("suffix").alias("how"), F.explode(ends).alias("key"), "path")
    inside = known.select("ext", F.lit("folder").alias("how"), F.explode(folders).alias("key"), "path")
    keys = exact.unionByName(suffix).unionByName(inside).filter("key <> ''").groupBy("how", "key", "ext").agg(F.min("path").alias("target"))
    js = F.col("ext").isin("ts", "tsx", "js")
    same = lambda df: df.withColumn("ext", F.when(js, "js").otherwise(F.col("ext")))
    keys = same(keys).groupBy("how", "key", "ext").agg(F.min("target").alias("target"))
    met = same(wanted).join(keys, ["how", "key", "ext"])
    return met.groupBy("file", "spec").agg(F.min_by("target", "at").alias("target"))


# Traversal ----------------------------------------------------------------------------------------------------------------


def _step(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    return frontier.join(edges, frontier["id"] == edges["src"]).groupBy("dst").agg(F.min("tier").alias("tier"), F.min("src").alias("via"))


def impact(edges: DataFrame, start: DataFrame, depth: int = 3, upstream: bool = True) -> DataFrame:
    """id, depth, tier, via: what reaches the start nodes (id) over calls, or is reached, at its smallest depth up to 3.

    Level by level: a frontier meets the edges on their key, what is known is taken away, the rest is the next frontier."""
    calls = edges.filter("kind = 'calls'")
    way = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "tier") if upstream else calls.select("src", "dst", "tier")
    frontier, seen, out = start.select("id").distinct(), start.select("id").distinct(), []
    for d in range(1, max(1, min(depth, 3)) + 1):
        new = _step(frontier, way).join(seen, F.col("dst") == F.col("id"), "left_anti").select(F.col("dst").alias("id"), F.lit(d).alias("depth"), "tier", "via")
        out.append(new)
        frontier = new.select("id")
        seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, out)


def top_per_depth(rows: DataFrame, limit: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("depth").orderBy("id"))).filter(F.col("_r") <= limit).drop("_r")


def risk(d1: Column, processes: Column, lower_bound: Column) -> Column:
    """LOW to CRITICAL by direct dependents and processes, one step up if callers may be hidden."""
    base = F.when((d1 > 50) | (processes > 20), 3).when((d1 > 15) | (processes > 8), 2).when(d1 > 3, 1).otherwise(0)
    level = F.least(F.lit(3), base + F.when(lower_bound, 1).otherwise(0))
    return F.element_at(F.array(*[F.lit(r) for r in RISKS]), level + 1)


def impact_summary(rows: DataFrame, files: DataFrame, processes: DataFrame | None, lower_bound: bool) -> DataFrame:
    """depth1, depth2, depth3, n_files, n_processes, risk. files(id, file_id); processes(process_id, id)."""
    at = [F.count(F.when(F.col("depth") == d, 1)).alias(f"depth{d}") for d in (1, 2, 3)]
    sums = rows.join(files, "id", "left").agg(*at, F.countDistinct("file_id").alias("n_files"))
    n = rows.sparkSession.createDataFrame([(0,)], "n_processes long") if processes is None else processes.join(rows.select("id"), "id", "left_semi").agg(F.countDistinct("process_id").alias("n_processes"))
    return sums.crossJoin(n).withColumn("risk", risk(F.col("depth1"), F.col("n_processes"), F.lit(lower_bound)))


def trace(edges: DataFrame, source, target, most: int = 8) -> DataFrame:
    """found, depth, path, furthest: a shortest path over calls and has_method, the smallest by nodes; without one, depth and
    path are null and furthest is the first node of those that lie deepest (null if the start leads nowhere). The edges are
    written once, two columns of them; a level is the ids of its new nodes, and a path is read off the levels at the end."""
    kind = dict(edges.dtypes)["src"]
    way = kept(edges.filter("kind IN ('calls', 'has_method')").select("src", "dst"), "trace")
    spark = edges.sparkSession
    one = lambda v: spark.createDataFrame([(v,)], f"id {kind}")
    levels = [one(source)]
    seen = levels[0]
    for d in range(most + 1):
        if d and not levels[d].filter(F.col("id") == target).isEmpty() or source == target:
            return one(target).select(F.lit(True).alias("found"), F.lit(d).alias("depth"), F.array(*[F.lit(v).cast(kind) for v in _smallest_path(way, levels, target)]).alias("path"), F.lit(None).cast(kind).alias("furthest"))
        if d == most:
            break
        near = levels[d].join(way, F.col("id") == F.col("src")).select("dst").filter("dst IS NOT NULL").distinct()
        new = cut(near.join(seen.select(F.col("id").alias("k")), F.col("dst") == F.col("k"), "left_anti").select(F.col("dst").alias("id")))
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionByName(new)
    last = levels[-1].orderBy("id").limit(1)
    none = F.lit(None)
    return last.select(F.lit(False).alias("found"), none.cast("int").alias("depth"), none.cast(f"array<{kind}>").alias("path"), (F.col("id") if len(levels) > 1 else none.cast(kind)).alias("furthest"))


def _smallest_path(way: DataFrame, levels: list[DataFrame], target) -> list:
    """The smallest by nodes of the shortest paths to target, which is on the last level: the nodes on any of them are found
    backwards, level by level; forwards, the smallest of them that the last node leads to is taken."""
    on = [levels[-1].filter(F.col("id") == target)]
    for level in reversed(levels[1:-1]):
        before = way.join(on[0].select(F.col("id").alias("k")), F.col("dst") == F.col("k"), "left_semi").select(F.col("src").alias("k")).distinct()
        on.insert(0, cut(level.join(before, F.col("id") == F.col("k"), "left_semi")))
    path = [levels[0].first()[0]]
    for nodes in on if len(levels) > 1 else []:
        after = way.filter(F.col("src") == path[-1]).select(F.col("dst").alias("k"))
        path.append(nodes.join(after, F.col("id") == F.col("k"), "left_semi").agg(F.min("id")).first()[0])
    return path


def entry_points(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, out_degree of nodes(id, name, path) that call, aren't called, and aren't tests by name or path."""
    calls = edges.filter("kind = 'calls'")
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    called = calls.select(F.col("dst").alias("id")).distinct()
    like = lambda c, forms: reduce(lambda a, b: a | b, [F.ilike(F.col(c), F.lit(p)) for p in forms])
    own = nodes.filter(~like("name", TEST_NAMES) & ~like("path", TEST_PATHS)).select("id")
    return out.join(called, "id", "left_anti").join(own, "id", "left_semi")


def advance(order: list, level: list, near: dict, branches: int) -> tuple[list, list]:
    """order and level after one more level of a breadth-first walk: of each node's callees, the first few that are new."""
    seen, order, after = set(order), list(order), []
    for at in level:
        fresh = [n for _, n in near.get(at, ()) if n not in seen]
        for n in list(dict.fromkeys(fresh))[:branches]:
            seen.add(n)
            order.append(n)
            after.append(n)
    return order, after


def walk(entry, near: dict, depth: int = 6, branches: int = 3) -> list:
    """The nodes that a breadth-first walk from entry meets: of each node's callees, the first few that are new.

    near(id) holds (tier, id), exact tiers first."""
    order, level = [entry], [entry]
    for _ in range(depth):
        order, level = advance(order, level, near, branches)
    return order


def processes(edges: DataFrame, entries: DataFrame, most: int = 100, depth: int = 6, branches: int = 3, least: int = 3) -> DataFrame:
    """process_id, step, id: walks from the busiest entry points, those of few steps or of the same nodes as another dropped.

    All walks go on by a level at a time: the edges are read once a level, and only those of nodes where walks stand are kept.
    A walk has met at most 1 + branches + branches^2 ... nodes, so of a node's callees no more than these and branches further
    ones can matter, and an entry's work is bounded whatever the graph is."""
    kind = dict(edges.dtypes)["src"]
    top = cut(entries.orderBy(F.desc("out_degree"), "id").limit(max(16, 4 * most)).select(F.col("id").cast(kind).alias("entry"), "out_degree"))
    calls = edges.filter("kind = 'calls' AND dst IS NOT NULL").select("src", "dst", (F.col("tier") != "exact").cast("int").alias("late"))
    shape = f"entry {kind}, steps array<{kind}>, level array<{kind}>"

    def run(walks: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for s, d, late in sorted(zip(met["src"], met["dst"], met["late"], strict=True), key=lambda e: (e[0], e[2], e[1])):
            near.setdefault(s, []).append((late, d))
        rows = [(r.entry, *advance(list(r.steps), list(r.level), near, branches)) for r in walks.itertuples()]
        return pd.DataFrame(rows, columns=["entry", "steps", "level"], dtype=object)

    walks = top.select("entry", F.array("entry").alias("steps"), F.array("entry").alias("level"))
    for d in range(depth):
        at = walks.select("entry", F.explode("level").alias("src"))
        met = calls.join(F.broadcast(at.select("src").distinct()), "src", "left_semi").groupBy("src", "dst").agg(F.min("late").alias("late"))
        first = F.row_number().over(Window.partitionBy("src").orderBy("late", "dst"))
        met = met.withColumn("_r", first).filter(F.col("_r") <= sum(branches**k for k in range(d + 2)) + branches).drop("_r")
        own = at.join(met, "src").select(F.col("entry").alias("_e"), "src", "dst", "late")
        walks = cut(walks.groupBy("entry").cogroup(own.groupBy("_e")).applyInPandas(run, shape))
    walks = walks.filter(F.size("steps") >= least).select("entry", "steps").join(top, "entry")
    first = Window.partitionBy(F.array_sort("steps")).orderBy(F.desc("out_degree"), "entry")
    kept = walks.withColumn("_r", F.row_number().over(first)).filter("_r = 1").orderBy(F.desc("out_degree"), "entry").limit(most)
    numbered = kept.withColumn("process_id", F.row_number().over(Window.orderBy(F.desc("out_degree"), "entry")) - 1)
    return numbered.select("process_id", F.posexplode("steps").alias("step", "id"))


# Clusters -----------------------------------------------------------------------------------------------------------------


def propagate(near: dict, passes: int = 10) -> dict:
    """Labels by asynchronous propagation in order of id: the most frequent one among neighbours, the smallest of equals."""
    label = {n: n for n in near}
    for _ in range(passes):
        changed = False
        for n in sorted(near):
            counts: dict = {}
            for m in near[n]:
                counts[label[m]] = counts.get(label[m], 0) + 1
            if counts:
                best = min(counts, key=lambda x: (-counts[x], x))
                changed |= best != label[n]
                label[n] = best
        if not changed:
            break
    return label


def connected(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """id, root: components of an undirected graph, by the least label among neighbours and the label's own label."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    now, last = both.select(F.col("src").alias("id")).distinct().withColumn("root", F.col("id")), None
    for _ in range(rounds):
        near = both.join(now, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("root").alias("m"))
        step = now.join(near, F.col("id") == F.col("src"), "left").select("id", F.least("root", "m").alias("root"))
        jump = step.select(F.col("id").alias("k"), F.col("root").alias("far"))
        now = step.join(jump, F.col("root") == F.col("k")).select("id", F.col("far").alias("root"))
        now = cut(now)
        mark = now.agg(F.sum(F.xxhash64("id", "root").cast("decimal(38,0)"))).first()[0]
        if mark == last:
            return now
        last = mark
    raise RuntimeError("the components didn't settle")


def label_propagation(edges: DataFrame, passes: int = 10) -> DataFrame:
    """id, label. Labels never leave a component, so each component is one group's work."""
    roots = connected(edges)
    kind = dict(edges.dtypes)["src"]
    own = edges.select("src", "dst").join(roots, F.col("src") == F.col("id")).select("root", "src", "dst")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for s, d in zip(pdf["src"], pdf["dst"], strict=True):
            near.setdefault(s, []).append(d)
            near.setdefault(d, []).append(s)
        label = propagate(near, passes)
        return pd.DataFrame({"id": list(label), "label": list(label.values())})

    return own.groupBy("root").applyInPandas(run, f"id {kind}, label {kind}")


def clusters(labels: DataFrame, edges: DataFrame, nodes: DataFrame, least: int = 3) -> DataFrame:
    """cluster, size, cohesion, dir, keywords of labelled nodes(id, name, path); small ones make up the cluster misc (null)."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    own = labels.join(sizes, "label").select("id", F.when(F.col("n") >= least, F.col("label")).alias("cluster"))
    a, b = (own.select(F.col("id").alias(k), F.col("cluster").alias(f"c{k}")) for k in ("src", "dst"))
    ends = edges.select("src", "dst").join(a, "src").join(b, "dst")
    touch = ends.select(F.explode(F.array(F.struct(F.col("csrc").alias("cluster"), F.col("csrc").eqNullSafe(F.col("cdst")).alias("i")), F.struct(F.col("cdst").alias("cluster"), F.col("csrc").eqNullSafe(F.col("cdst")).alias("i")))).alias("t")).select("t.*")
    inner, outer = F.floor(F.sum(F.col("i").cast("int")) / 2), F.sum((~F.col("i")).cast("int"))
    cohesion = touch.groupBy("cluster").agg((inner / F.greatest(F.lit(1), inner + outer)).alias("cohesion"))
    member = own.join(nodes, "id")
    out = member.groupBy("cluster").agg(F.count("*").alias("size"))
    dirs = top_value(member.select("cluster", fn.dirname(F.col("path")).alias("dir")), ["cluster"], "dir")
    words = keywords(member.select("cluster", "name"), ["cluster"])
    same = lambda x, y: x["cluster"].eqNullSafe(y["cluster"])
    for other in (cohesion, dirs, words):
        other = other.withColumnRenamed("cluster", "_c")
        out = out.join(other, out["cluster"].eqNullSafe(other["_c"]), "left").drop("_c")
    return out.withColumn("cohesion", F.coalesce("cohesion", F.lit(0.0)))


def top_value(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, the smallest of equals."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))["v"].alias(value))


def keywords(rows: DataFrame, keys: list[str], k: int = 5, least: int = 2) -> DataFrame:
    """keywords: the k most frequent words of names, by count and then alphabet, comma-joined."""
    words = rows.select(*keys, F.explode(fn.ident_words(F.col("name"))).alias("word")).filter(F.length("word") >= least)
    n = words.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))).filter(F.col("r") <= k)
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), ",").alias("keywords"))


# Neighbours, changes ------------------------------------------------------------------------------------------------------


def neighbor_files(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """file_id, reason: files one call away from seeds(id, pos), seeds' own files left out; a file's first reason stands:
    by seed, callers before callees, then neighbour."""
    calls = edges.filter("kind = 'calls'").select("src", "dst").distinct()
    into = seeds.join(calls, seeds["id"] == calls["dst"]).select("pos", "id", F.lit(0).alias("way"), F.col("src").alias("other"))
    out = seeds.join(calls, seeds["id"] == calls["src"]).select("pos", "id", F.lit(1).alias("way"), F.col("dst").alias("other"))
    where, name = nodes.select(F.col("id").alias("other"), "file_id"), nodes.select("id", F.col("name").alias("seed_name"))
    met = into.unionByName(out).join(where, "other").join(name, "id")
    own = nodes.join(seeds.select("id"), "id", "left_semi").select("file_id").distinct()
    reason = F.concat(F.when(F.col("way") == 0, "calls ").otherwise("called by "), F.col("seed_name"))
    return met.join(own, "file_id", "left_anti").groupBy("file_id").agg(F.min(F.struct("pos", "way", "other", reason.alias("reason")))["reason"].alias("reason"))


def change_impact(hunks: DataFrame, spans: DataFrame, edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """n_symbols, n_callers, n_processes, risk of changed lines: hunks(hunk_id, file_id, a, b), spans(id, file_id, start, end).

    Processes, members(process_id, id), count if a changed symbol or one of its callers is a step of them."""
    changed = cut(touched(hunks, spans))
    callers = impact(edges, changed, 1)
    n = changed.agg(F.count("*").alias("n_symbols")).crossJoin(callers.agg(F.count("*").alias("n_callers")))
    p = changed.sparkSession.createDataFrame([(0,)], "n_processes long") if members is None else members.join(changed.unionByName(callers.select("id")), "id", "left_semi").agg(F.countDistinct("process_id").alias("n_processes"))
    return n.crossJoin(p).withColumn("risk", risk(F.col("n_callers"), F.col("n_processes"), F.lit(False)))


def compact_edges(edges: DataFrame, nodes: DataFrame, most: int = 20) -> DataFrame:
    """kind, items: distinct (name, path, tier) at the other end of edges, the first few of each kind."""
    rows = edges.join(nodes, edges["dst"] == nodes["id"]).select("kind", "name", "path", "tier").distinct()
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("name", "path", "tier"))).filter(F.col("r") <= most)
    return top.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("name", "path", "tier"))).alias("items"))
