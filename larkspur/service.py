"""The engine's requests as methods: one object over a session, a tree of files and its derived tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as fn
from larkspur.operators import extract, graph, recall, search, sink, targets
from larkspur.plans.grams import Extractor

SEARCH_LIMIT, SEARCH_MOST, PAGE_BYTES, LINE_BYTES = 100, 10_000, 64 << 10, 4096
CONTEXT_TOKENS, CONTEXT_ITEMS, EDGE_LIMIT, TRACE_DEPTH, CLUSTER_LIMIT = 2000, 41, 20, 8, 50


class Service:
    """Code requests over files(path, content); what is derived from them is made at first use."""

    def __init__(self, spark: SparkSession, files: DataFrame, extractor: Extractor | None = None, index: DataFrame | None = None):
        self.spark, self.files, self.extractor = spark, files, extractor or Extractor()
        self.index = index if index is not None else search.postings(files, self.extractor)

    @cached_property
    def graph(self) -> dict[str, DataFrame]:
        return {k: v.cache() for k, v in extract.build_graph(self.files).items()}

    @cached_property
    def nodes(self) -> DataFrame:
        s = self.graph["symbols"]
        return s.select(F.col("uid").alias("id"), "name", F.col("file").alias("path"), F.col("file").alias("file_id"), "kind", "start_line", "end_line", "sig")

    @cached_property
    def _processes(self) -> DataFrame:
        edges = self.graph["edges"]
        return graph.processes(edges, graph.entry_points(edges, self.nodes)).cache()

    @cached_property
    def _labels(self) -> DataFrame:
        return graph.label_propagation(self.graph["edges"]).cache()

    def ping(self) -> str:
        return "pong"

    def status(self) -> dict:
        return {"files": self.files.count(), "extractor": self.extractor.id, "signature": search.signature(self.files).first()["signature"]}

    def search(self, pattern: str, offset: int = 0, limit: int = SEARCH_LIMIT, prefixes: list[str] = ()) -> search.Page:
        """A page of matching lines, cut at the byte limits of a page and a line."""
        rows = search.search(self.files, pattern, self.index, prefixes, self.extractor).withColumn("text", F.left("text", F.lit(LINE_BYTES)))
        page = search.page(rows, ["path", "line"], offset, max(1, min(limit, SEARCH_MOST)))
        kept = recall.prefix_within(page.rows, F.octet_length("text"), ["path", "line"], PAGE_BYTES)
        return search.Page(kept, page.truncated or kept.count() < page.rows.count(), offset)

    def symbol(self, name: str) -> DataFrame:
        """Symbols by name, or by uid if it holds a #; several are an answer."""
        hit = F.col("uid") == name if "#" in name else (F.col("name") == name) | (F.col("qualified") == name)
        return self.graph["symbols"].filter(hit).orderBy("kind", "uid").limit(50)

    def uses(self, name: str, callers: bool = True, offset: int = 0, limit: int = EDGE_LIMIT) -> DataFrame:
        """Who calls the symbols of that name, or whom they call."""
        own = self.symbol(name).select("uid")
        near, far = ("dst", "src") if callers else ("src", "dst")
        edges = self.graph["edges"].join(own, F.col(near) == F.col("uid"), "left_semi")
        met = edges.join(self.nodes, F.col(far) == F.col("id"))
        return met.select("name", "path", "tier", "site_line").orderBy("path", "site_line", "name").offset(offset).limit(limit)

    def impact(self, name: str, depth: int = 3, upstream: bool = True, limit: int = 50) -> dict[str, DataFrame]:
        own = self.symbol(name).select(F.col("uid").alias("id"))
        rows = graph.impact(self.graph["edges"], own, depth, upstream)
        hidden = graph.envelope(self.graph["open_calls"], self.symbol(name))
        lower = hidden.filter("lower_bound").limit(1).count() > 0
        return {"rows": graph.top_per_depth(rows, limit), "summary": graph.impact_summary(rows, self.nodes.select("id", "file_id"), self._processes, lower), "envelope": hidden}

    def trace(self, source: str, target: str, most: int = TRACE_DEPTH) -> DataFrame:
        a, b = (self.symbol(x).select("uid").first() for x in (source, target))
        if a is None or b is None:
            raise ValueError("no such symbol")
        return graph.trace(self.graph["edges"], a["uid"], b["uid"], most)

    def processes(self, most: int = 100) -> DataFrame:
        return self._processes.filter(F.col("process_id") < most)

    def clusters(self, limit: int = CLUSTER_LIMIT) -> DataFrame:
        return graph.clusters(self._labels, self.graph["edges"], self.nodes).orderBy(F.desc("size"), "cluster").limit(limit)

    def changes(self, hunks: DataFrame) -> DataFrame:
        """The impact of changed lines: hunks(hunk_id, file_id as path, a, b)."""
        spans = self.nodes.select("id", "file_id", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
        return graph.change_impact(hunks, spans, self.graph["edges"], self._processes.select("process_id", "id"))

    def targets(self, task: str, limit: int = 20) -> DataFrame:
        exact, words = fn.tokenize_task(task)
        symbols = self.nodes.select("path", "name")
        lines = self.files.select("path", F.posexplode(fn.lines(F.col("content"))).alias("line", "text"))
        channels = {"symbol": targets.symbol_rank(symbols, words, exact)}
        if words:
            channels |= {"filename": targets.filename_rank(self.files, words), "content": targets.content_rank(lines, words)}
        seeds = targets.lexical_seeds(channels)
        at = self.nodes.join(seeds, "path").select("id", "pos")
        near = graph.neighbor_files(self.graph["edges"], self.nodes, at)
        channels["graph"] = targets._ranked(near.select(F.col("file_id").alias("path")), ["path"])
        return targets.tiers(targets.fuse(channels), limit)

    def context(self, name: str, budget: int = CONTEXT_TOKENS, layer: str = "L2", items: int = CONTEXT_ITEMS) -> tuple[str, str, int]:
        """A symbol and its neighbours in the graph as text within a budget of tokens."""
        own = self.symbol(name).select(F.col("uid").alias("id"))
        edges = self.graph["edges"]
        near = edges.join(own, F.col("dst") == F.col("id")).select(F.col("src").alias("n"), F.lit(1).alias("o")).unionByName(edges.join(own, F.col("src") == F.col("id")).select(F.col("dst").alias("n"), F.lit(2).alias("o")))
        every = own.select(F.col("id").alias("n"), F.lit(0).alias("o")).unionByName(near).groupBy("n").agg(F.min("o").alias("o"))
        picked = every.join(self.nodes, F.col("n") == F.col("id")).orderBy("o", "id").limit(items)
        body = F.array_join(F.slice(F.split("content", "\n"), F.col("start_line"), F.least(F.lit(60), F.col("end_line") - F.col("start_line") + 1)), "\n")
        rows = picked.join(self.files.select("path", "content"), "path").withColumn("snippet", body)
        rows = targets._ranked(rows, ["o", "id"]).withColumnRenamed("rank", "pos")
        return targets.fit_context(rows, budget, layer)

    def graph_stats(self) -> dict[str, int]:
        return {k: v.count() for k, v in self.graph.items()}


class Recall:
    """Requests over turns(turn_id, session_id, seq, role, text) and sessions."""

    def __init__(self, turns: DataFrame, sessions: DataFrame, chunks: DataFrame | None = None, embed=None):
        self.turns, self.sessions, self.chunks, self.embed = turns, sessions, chunks, embed

    def search(self, pattern: str, limit: int = 20, **filters) -> DataFrame:
        word, human, role = (filters.pop(k, None) for k in ("word", "human", "role"))
        known = recall.filter_sessions(self.sessions, **filters, subagents=True) if filters else self.sessions
        found = recall.search(self.turns, pattern, bool(word), bool(human), role).join(known.select("session_id", "agent", "cwd"), "session_id")
        return found.select("turn_id", "session_id", "agent", "cwd", "seq", "role", "snippet").orderBy(F.desc("turn_id")).limit(limit)

    def maxtest(self, terms: list[str]) -> tuple[DataFrame, DataFrame]:
        counts = recall.term_counts(self.turns, terms[:10]).cache()
        return counts.orderBy("n_sessions", "pos"), recall.pin(self.turns, terms[:10], counts)

    def ask(self, question: str, k: int = 10) -> DataFrame:
        """The best sessions for a question by words and, where there are vectors, by meaning."""
        words = fn.query_words(question)
        human = self.turns.filter(recall.human_only())
        counts = {r["term"]: r["n_turns"] for r in recall.term_counts(human, [w.lower() for w in words]).collect()}
        costs = {w: counts[w.lower()] if len(w) >= 3 else None for w in words}
        import math

        weights = {w: max(0.1, math.log(recall.MOST_COUNT / (1 + (5000 if costs[w] is None else costs[w])))) for w in recall.choose_words(words, costs)}
        if not weights:
            raise ValueError("the question names nothing to look for")
        channels = [(recall.lexical(human, weights), recall.LEXICAL_WEIGHT)]
        if self.chunks is not None:
            one = self.turns.sparkSession.createDataFrame([(question,)], "q string").select((self.embed or recall.stub_embedder())(F.col("q")).alias("v")).first()["v"]
            near = recall.knn(self.chunks, one, recall.KNN_CHUNKS)
            channels.append((recall.nearest_turns(near, self.chunks), recall.SEMANTIC_WEIGHT))
        return recall.group_sessions(recall.fuse(channels), human, k).orderBy(F.desc("score"), F.desc("turn_id"))

    def show(self, session_id, first: int = 0, last: int = 1 << 30) -> DataFrame:
        return recall.turn_range(self.turns, session_id, first, last)

    def status(self) -> DataFrame:
        return recall.agent_status(self.sessions)


class ErrorLog:
    """Requests over deduplicated errors, events and runs."""

    def __init__(self, errors: DataFrame, events: DataFrame, runs: DataFrame):
        self.errors, self.events, self.runs = errors, events, runs

    def last(self, n: int = 10, surface: str | None = None) -> DataFrame:
        return sink.last(self.errors, n, surface)

    def since(self, cursor: int) -> DataFrame:
        return sink.since(self.errors, cursor)

    def show(self, error_id: int) -> dict[str, DataFrame]:
        return sink.show(self.errors, self.events, self.runs, error_id)

    def query(self, needle: str, limit: int = 50) -> DataFrame:
        return sink.find(self.errors, needle, limit)

    def hmr(self, file: str | None = None) -> DataFrame:
        return sink.hmr(self.events, file)

    def env(self) -> DataFrame:
        return sink.env_diff(self.runs)

    def test(self) -> DataFrame:
        return sink.test_status(self.errors, self.events)

    def cursor(self) -> int:
        return sink.cursor(self.errors).first()["cursor"]

    def gc(self, now_ms: int) -> tuple[DataFrame, DataFrame]:
        return sink.retain_errors(self.errors, now_ms), sink.retain_events(self.events, now_ms)
