import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import recall
from larkspur.service import Recall


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(10 * s + i, s, i, ["user", "assistant", "tool"][i % 3], f"{w} number {i} of {s}") for s, w in enumerate(["fix login", "<system-reminder> login", "parse config", "login config"]) for i in range(4)]
    return spark.createDataFrame(rows, "turn_id long, session_id long, seq int, role string, text string")


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [(s, "a", f"src{s}", None if s < 3 else "src0", f"/w/{s}", s * 10, s * 10 + 5, 4, s == 3) for s in range(4)]
    return spark.createDataFrame(rows, "session_id long, agent string, source_id string, parent string, cwd string, ts_first long, ts_last long, turn_count long, is_subagent boolean")


def test_knn(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.7, 0.7, 0.0])], "chunk_id long, embedding array<float>")
    assert [r.chunk_id for r in recall.knn(rows, [1, 0, 0], 2).collect()] == [1, 3]
    assert [r.chunk_id for r in recall.knn(rows, [1, 0, 0], 2, allowed=rows.filter("chunk_id > 1")).collect()] == [3, 2]
    from larkspur.functions import vectors

    packed = rows.select("chunk_id", vectors.quantize(F.col("embedding")).alias("packed"))
    assert [r.chunk_id for r in recall.knn_quantized(packed, [1, 0, 0], 3).collect()] == [1, 3, 2]


def test_fusion(spark):
    channel = lambda ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "turn_id long, rank int")
    fused = recall.fuse([(channel([5, 1, 2]), 2.0), (channel([9, 5, 3]), 1.0)])
    assert fused.orderBy(F.desc("score"), F.desc("turn_id")).first().turn_id == 5
    alone = recall.fuse([(channel([5, 1, 2]), 2.0), (channel([]), 1.0)])
    assert [r.turn_id for r in alone.orderBy(F.desc("score")).collect()] == [5, 1, 2]


def test_grouping_matches_a_loop(spark):
    rng = random.Random(1)
    owner = {t: rng.randrange(12) for t in range(80)}
    score = {t: rng.randrange(20) for t in owner}
    turns = spark.createDataFrame(list(owner.items()), "turn_id long, session_id long")
    fused = spark.createDataFrame([(t, float(s)) for t, s in score.items()], "turn_id long, score double")
    best, extra = {}, {}
    for t in sorted(owner, key=lambda t: (-score[t], -t)):
        s = owner[t]
        if s in best:
            extra[s] += 1
        else:
            best[s], extra[s] = t, 0
            if len(best) == 5:
                break
    got = recall.group_sessions(fused, turns, 5).collect()
    assert {r.session_id: (r.turn_id, r.extra_hits) for r in got} == {s: (best[s], extra[s]) for s in best}


def test_sessions(turns, sessions):
    r = {x.session_id: x for x in recall.rollup(turns).collect()}
    assert r[0].title == "fix login number 0 of 0" and r[1].first_prompt is None and r[1].turn_count == 4
    assert {x.session_id: x.parent_id for x in recall.link_parents(sessions).collect()} == {0: None, 1: None, 2: None, 3: 0}
    assert [x.session_id for x in recall.filter_sessions(sessions, since=12, until=25).collect()] == [1, 2]
    assert recall.filter_sessions(sessions, subagents=True).count() == 4
    got = recall.append_turns(turns, turns.filter("session_id = 0").drop("seq"), "turn_id").collect()
    assert sorted(x.seq for x in got) == [4, 5, 6, 7]


def test_requests(turns, sessions):
    r = Recall(turns, sessions)
    assert [x.turn_id for x in r.search("login", limit=3).collect()] == [33, 32, 31]
    assert "snippet" in r.search("login").columns and r.search("login", human=True, role="user").filter("session_id = 1").count() == 0
    counts, pinned = r.maxtest(["login", "config", "zzz"])
    assert [(x.term, x.n_turns, x.n_sessions) for x in counts.collect()] == [("zzz", 0, 0), ("config", 8, 2), ("login", 12, 3)]
    assert [x.session_id for x in pinned.collect()] == [3]
    assert r.ask("where was the login config?", 2).first().session_id == 3
    chunks = recall.backfill(turns.filter("role <> 'tool'")).withColumn("chunk_id", F.col("turn_id"))
    assert Recall(turns, sessions, chunks).ask("where was the login config?").count() >= 1
    recall.check_model(chunks, "stub-16", 16)
    with pytest.raises(ValueError):
        recall.check_model(chunks, "other", 16)


def test_packing(turns):
    kept = recall.prefix_within(turns, F.lit(10), ["turn_id"], 25)
    assert kept.count() == 2
    groups = [{"session_id": i, "snippet": "s" * 40, "turns": [{"role": "user", "text": "t" * 30}]} for i in range(5)]
    text = recall.pack(groups, 40)
    assert -(-len(text.encode()) // 4) <= 40 and text.startswith("## 0")
    assert recall.choose_words(["a", "b", "c", "d"], {"a": 5, "b": 60000, "c": 1, "d": None}) == ["c", "a", "d"]
