"""Recall over conversations: sessions, filters, search, term ranking, the lexical and vector channels, fusion, packing."""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as fn
from larkspur.functions import vectors

RRF_K, LEXICAL_WEIGHT, SEMANTIC_WEIGHT = 60.0, 2.0, 1.0
LEXICAL_LIMIT, PER_WORD, MOST_WORDS, MOST_UNCOSTED, MOST_COUNT, KNN_CHUNKS = 200, 20_000, 8, 2, 50_000, 600


# Sessions -----------------------------------------------------------------------------------------------------------------


def rollup(turns: DataFrame) -> DataFrame:
    """session_id, turn_count, first_prompt, title: the first human turn names a session, else the first turn."""
    human = (F.col("role") == "user") & (fn.intent(F.col("text")) == "human")
    return turns.groupBy("session_id").agg(
        F.count("*").alias("turn_count"), F.min(F.when(human, F.struct("seq", "text")))["text"].alias("first_prompt"),
        fn.title_of(F.coalesce(F.min(F.when(human, F.struct("seq", "text")))["text"], F.min(F.struct("seq", "text"))["text"])).alias("title"),
    )


def agent_status(sessions: DataFrame, ingest: DataFrame | None = None) -> DataFrame:
    """agent, sessions, turns and, with ingest(agent, last_ingest_at), the last ingest."""
    out = sessions.groupBy("agent").agg(F.count("*").alias("sessions"), F.coalesce(F.sum("turn_count"), F.lit(0)).alias("turns"))
    return out if ingest is None else out.join(ingest.groupBy("agent").agg(F.max("last_ingest_at").alias("last_ingest")), "agent", "left")


def link_parents(sessions: DataFrame) -> DataFrame:
    """sessions with parent_id: the session that parent names, of the same agent, if it isn't a subagent's itself."""
    top = sessions.filter(~F.col("is_subagent")).select(F.col("agent").alias("_agent"), F.col("source_id").alias("_source"), F.col("session_id").alias("parent_id"))
    return sessions.join(top, (F.col("agent") == F.col("_agent")) & (F.col("parent") == F.col("_source")), "left").drop("_agent", "_source")


def filter_sessions(sessions: DataFrame, agent=None, cwd=None, since=None, until=None, subagents: bool = False) -> DataFrame:
    """Sessions that overlap [since, until], by agent and folder; those of subagents only if asked for."""
    out = sessions
    if agent is not None:
        out = out.filter(F.col("agent") == agent)
    if cwd is not None:
        out = out.filter(F.startswith("cwd", F.lit(cwd)))
    if since is not None:
        out = out.filter(F.col("ts_last") >= since)
    if until is not None:
        out = out.filter(F.col("ts_first") <= until)
    return out if subagents else out.filter(~F.col("is_subagent"))


def by_prefix(sessions: DataFrame, prefix: str, most: int = 20) -> DataFrame:
    """Sessions whose id starts so; several are an answer, not an error."""
    return sessions.filter(F.startswith(F.col("session_id").cast("string"), F.lit(prefix))).orderBy("session_id").limit(most)


def turn_range(turns: DataFrame, session_id, first: int, last: int) -> DataFrame:
    return turns.filter((F.col("session_id") == session_id) & F.col("seq").between(first, last)).orderBy("seq")


def human_only() -> Column:
    """Turns that aren't a user's, or that a human wrote."""
    return (F.col("role") != "user") | (fn.intent(F.col("text")) == "human")


def number_turns(turns: DataFrame, order: str) -> DataFrame:
    return turns.withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy(order)) - 1)


def append_turns(known: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New turns numbered on from the last known one of their session."""
    last = known.groupBy("session_id").agg((F.max("seq") + 1).alias("base"))
    at = F.row_number().over(Window.partitionBy("session_id").orderBy(order)) - 1
    return new.join(last, "session_id", "left").withColumn("seq", at + F.coalesce("base", F.lit(0))).drop("base")


# Search -------------------------------------------------------------------------------------------------------------------


def search(turns: DataFrame, pattern: str, word: bool = False, human: bool = False, role: str | None = None) -> DataFrame:
    """Turns that match, once each, with a snippet. Ordering and paging are up to the caller."""
    pattern = fn.whole_word(pattern) if word else pattern
    out = turns.filter(F.regexp_like("text", F.lit(pattern)))
    if human:
        out = out.filter(human_only())
    if role is not None:
        out = out.filter(F.col("role") == role)
    return out.withColumn("snippet", fn.snippet(F.col("text"), pattern))


def tail(turns: DataFrame, high_water: int, found: DataFrame) -> DataFrame:
    """Turns that an index found, and all that came after it was built."""
    old = turns.filter(F.col("turn_id") <= high_water).join(found.select("turn_id"), "turn_id", "left_semi")
    return old.unionByName(turns.filter(F.col("turn_id") > high_water))


def term_counts(turns: DataFrame, terms: list[str]) -> DataFrame:
    """term, pos, n_turns, n_sessions for whole-word literal terms: one pass over the turns for all of them."""
    import re

    hits = [F.struct(F.lit(t).alias("term"), F.lit(i).alias("pos"), F.regexp_like("text", F.lit(fn.whole_word(re.escape(t)))).alias("hit")) for i, t in enumerate(terms)]
    rows = turns.select("session_id", F.explode(F.filter(F.array(*hits), lambda h: h["hit"])).alias("h"))
    sums = rows.groupBy("h.term", "h.pos").agg(F.count("*").alias("n_turns"), F.countDistinct("session_id").alias("n_sessions"))
    every = turns.sparkSession.createDataFrame(list(enumerate(terms)), "pos int, term string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return F.broadcast(every).join(sums, ["term", "pos"], "left").select("term", "pos", zero("n_turns"), zero("n_sessions"))


def pin(turns: DataFrame, terms: list[str], counts: DataFrame, most: int = 10) -> DataFrame:
    """session_id: sessions that hold the two rarest terms that occur (or the only one), newest first."""
    import re

    rare = [r["term"] for r in counts.filter("n_sessions > 0").orderBy("n_sessions", "pos").limit(2).collect()]
    have = [turns.filter(F.regexp_like("text", F.lit(fn.whole_word(re.escape(t))))).select("session_id") for t in rare]
    if not have:
        return turns.select("session_id").limit(0)
    return reduce(lambda a, b: a.intersect(b), have).distinct().orderBy(F.desc("session_id")).limit(most)


# Channels -----------------------------------------------------------------------------------------------------------------


def choose_words(words: list[str], counts: dict[str, int | None]) -> list[str]:
    """The rarest words worth a search: of those that can't be counted two, none that are everywhere."""
    costed = sorted((counts[w], i, w) for i, w in enumerate(words) if counts.get(w) is not None and counts[w] <= MOST_COUNT)
    uncosted = [w for w in words if counts.get(w) is None][:MOST_UNCOSTED]
    return [w for _, _, w in costed][: MOST_WORDS - len(uncosted)] + uncosted


def lexical(turns: DataFrame, weights: dict[str, float], limit: int = LEXICAL_LIMIT, pattern=fn.word_pattern) -> DataFrame:
    """turn_id, score, rank: turns by the sum of the weights of the words that they hold, newest first among equals."""
    score = reduce(lambda a, b: a + b, [F.when(F.regexp_like("text", F.lit(pattern(w))), F.lit(v)).otherwise(F.lit(0.0)) for w, v in weights.items()])
    top = turns.withColumn("score", score).filter("score > 0").select("turn_id", "score").orderBy(F.desc("score"), F.desc("turn_id")).limit(limit)
    return ranked(top, [F.desc("score"), F.desc("turn_id")])


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """rows with rank from 0; rows must be few (a top-k)."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def knn(rows: DataFrame, query: list[float], k: int, allowed: DataFrame | None = None, metric: str = "dot", id_: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """id, score: the k nearest by exact product (or cosine), ties to the smaller id."""
    if allowed is not None:
        rows = rows.join(allowed.select(id_), id_, "left_semi")
    q = F.array(*[F.lit(float(x)) for x in query])
    score = vectors.dot(F.col(vector), q) if metric == "dot" else vectors.cosine(F.col(vector), q)
    return rows.select(id_, score.alias("score")).orderBy(F.desc("score"), id_).limit(k)


def knn_quantized(rows: DataFrame, query: list[float], k: int, id_: str = "chunk_id") -> DataFrame:
    """The same over rows with `packed` as `vectors.quantize` gives it."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(id_, vectors.quantized_dot(q, F.col("packed")).alias("score")).orderBy(F.desc("score"), id_).limit(k)


def nearest_turns(near: DataFrame, chunks: DataFrame, limit: int = LEXICAL_LIMIT) -> DataFrame:
    """turn_id, rank: the first distinct turns of a ranking of chunks."""
    own = near.join(chunks.select("chunk_id", "turn_id"), "chunk_id").groupBy("turn_id").agg(F.max("score").alias("score"))
    return ranked(own.orderBy(F.desc("score"), "turn_id").limit(limit), [F.desc("score"), "turn_id"])


def fuse(channels: list[tuple[DataFrame, float]], id_: str = "turn_id", k: float = RRF_K) -> DataFrame:
    """id, score: reciprocal rank fusion of (id, rank from 0) with weights."""
    parts = [c.select(id_, (F.lit(w) / (k + F.col("rank") + 1)).alias("part")) for c, w in channels]
    return reduce(DataFrame.unionByName, parts).groupBy(id_).agg(F.sum("part").alias("score"))


def group_sessions(fused: DataFrame, turns: DataFrame, k: int) -> DataFrame:
    """session_id, turn_id, score, extra_hits: the best turn of each of the first k sessions of a ranking.

    extra_hits counts a session's further turns seen before the k-th session turns up."""
    rows = ranked(fused.join(turns.select("turn_id", "session_id"), "turn_id"), [F.desc("score"), F.desc("turn_id")])
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("rank")))
    opened = first.withColumn("groups", F.sum((F.col("n") == 1).cast("int")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    close = opened.agg(F.coalesce(F.min(F.when((F.col("groups") == k) & (F.col("n") == 1), F.col("rank"))), F.max("rank")).alias("close"))
    seen = opened.crossJoin(F.broadcast(close)).filter("rank <= close")
    return seen.groupBy("session_id").agg(F.min_by("turn_id", "rank").alias("turn_id"), F.max("score").alias("score"), (F.count("*") - 1).alias("extra_hits"))


# Embedding ----------------------------------------------------------------------------------------------------------------


def embeddable() -> Column:
    """Turns worth a vector: no tools', no orchestrator's, and no user's turns in a subagent's session (is_subagent)."""
    user = F.col("role") == "user"
    return (F.col("role") != "tool") & ~(user & (fn.intent(F.col("text")) == "orchestrator")) & ~(user & F.col("is_subagent"))


def chunks(turns: DataFrame, width: int = 1500, overlap: int = 200) -> DataFrame:
    """turn_id, chunk_seq, start, text: overlapping windows of each turn."""
    rows = turns.select("turn_id", "text", F.posexplode(fn.chunk_windows(F.col("text"), width, overlap)).alias("chunk_seq", "w"))
    return rows.select("turn_id", "chunk_seq", F.col("w.start").alias("start"), F.col("text").substr(F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("text"))


def stub_embedder(dims: int = 16):
    """A deterministic embedder for tests and for places without a model: hashed character trigrams, unit length."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t):
            v = np.zeros(dims)
            for i in range(max(0, len(t or "") - 2)):
                h = zlib.crc32(t[i : i + 3].encode())
                v[h % dims] += 1 if h & 1024 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).astype("float32")

        return texts.map(one)

    return embed


def backfill(pending: DataFrame, embed=None, model: str = "stub-16") -> DataFrame:
    """turn_id, chunk_seq, start, model, embedding of turns that have none yet."""
    return chunks(pending).select("turn_id", "chunk_seq", "start", F.lit(model).alias("model"), (embed or stub_embedder())(F.col("text")).alias("embedding"))


def check_model(vectors_: DataFrame, model: str, dims: int) -> None:
    """ValueError if vectors are of another model or length."""
    other = vectors_.filter((F.col("model") != model) | (F.size("embedding") != dims)).limit(1).collect()
    if other:
        raise ValueError(f"vectors of {other[0]['model']} in a store of {model}")


# Packing ------------------------------------------------------------------------------------------------------------------


def prefix_within(rows: DataFrame, size: Column, order: list, budget: int, keys: list[str] = ()) -> DataFrame:
    """Rows, in order, as long as their sizes add up to no more than the budget; it stops at the first that doesn't fit."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_run", F.sum(size).over(w)).filter(F.col("_run") <= budget).drop("_run")


def pack(groups: list[dict], budget: int, header=lambda g: f"## {g['session_id']}") -> str:
    """A text of at most budget tokens from few ranked groups (session_id, snippet, turns): headers with snippets of all
    that fit, then whole turns while there is room; what doesn't fit is left out and the next is tried."""
    cost = lambda s: -(-len(s.encode()) // 4)
    out, spent = [], 0
    for g in groups:
        part = f"{header(g)}\n{g['snippet']}\n"
        if spent + cost(part) <= budget:
            out.append([part])
            spent += cost(part)
            for t in g.get("turns", []):
                line = f"{t['role']}: {t['text']}\n"
                if spent + cost(line) <= budget:
                    out[-1].append(line)
                    spent += cost(line)
    return "".join(s for part in out for s in part)
