"""Small cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import itertools
import random
import sys
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import common, graph, op1_topk, op2_mixing_lm, op3_chat, op4_decontamination, op5_surrogates, op6_jaccard, op7_warc, op8_licences, op9_mixing, op10_language, sigtree

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 6))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def table(spark, texts, **extra):
    rows = [(i, t, ["en", "fr"][i % 2], f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name, v in extra.items():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(v))
    return df


def odd_texts():
    long = prose(30000)
    return [None, "", "a", "A b", "  \t\n ", "x y z", "X Y  z", prose(40), long, long, "ÉCOLE été", "\x00\x01", "word " * 300]


# 1 ------------------------------------------------------------------------------------------------------------------------


def brute_topk(rows, k):
    out = {}
    for q, v in rows:
        if v is None:
            continue
        scored = sorted({(-sum(a * b for a, b in zip(v, w)), c) for c, w in rows if w is not None and c != q and len(w) == len(v)})[:k]
        out[q] = [(c, -s) for s, c in scored]
    return out


def test_topk_matches_brute_force(spark):
    vectors = [(i, [rng.randint(-9, 9) / 8 for _ in range(6)]) for i in range(60)]
    vectors += [(60 + i, list(vectors[0][1])) for i in range(20)] + [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (92, [float("nan")] * 6), (93, [1.0, 2.0]), vectors[3], (94, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, 7) for i, v in vectors], "vec_id long, embedding array<float>, rank int")
    q = op1_topk.quantised(df)
    got = {}
    for r in op1_topk.search(q, q, k=5, shard_rows=7, group_rows=30).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ok = [(i, [int(np.floor(256 * np.float32(x))) for x in v]) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    want = brute_topk(ok, 5)
    assert got == {k: v for k, v in want.items() if v}


def test_topk_large_values_and_empty():
    big = np.array([[1 << 40, -(1 << 40)], [1 << 61, 1]], np.int64)
    exact = [[int(a[0]) * int(b[0]) + int(a[1]) * int(b[1]) for b in big] for a in big]
    assert op1_topk.products(big, big).tolist() == [[max(-(2**63 - 1), min(2**63 - 1, x)) for x in r] for r in exact]
    assert op1_topk.products(np.zeros((0, 2), np.int64), big).shape == (0, 2)


def test_topk_repeated_rows_take_one_place(spark):
    """In one shard: a row seven times, among equal vectors and among the best of other ones."""
    rows = [(1, [5, 0])] * 7 + [(i, [5, 0]) for i in range(2, 9)] + [(20, [9, 9])] * 4 + [(i, [4, i % 3]) for i in range(30, 36)]
    df = spark.createDataFrame(rows, "vec_id long, q array<long>")
    got = {}
    for r in op1_topk.search(df, df, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_topk(rows, 5)


def test_topk_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    q = op1_topk.quantised(df)
    assert op1_topk.search(q, q).collect() == []


# 2 ------------------------------------------------------------------------------------------------------------------------


def brute_base(rows):
    from collections import Counter
    from math import log10

    counts = Counter()
    for _, t, held in rows:
        if not held:
            counts.update([*brute.spaced(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t, held in rows:
        tokens = [*brute.spaced(t), None]
        out.append((d, held, len(tokens), sum(counts[x] > 0 for x in tokens), n, round(sum(log10((counts[x] + 1) / (n + v + 1)) for x in tokens), 6)))
    return sorted(out, key=repr)


def test_lm_base_and_score(spark):
    texts = [*odd_texts()[:8], *(prose(120) for _ in range(40))]
    rows = [(i, t, i % 7 == 2) for i, t in enumerate(texts)] + [(3, "A b", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = op2_mixing_lm.score(df, chunk_chars=3000, range_chars=5000).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == brute_base(rows)
    assert all(r.score < 0 and abs(r.score + r.bits * np.log10(2)) < 1e-6 for r in got)
    new = [r for r in got if r.held_out and r.n_bytes > 200]
    assert new and all(r.bits / r.n_bytes < 5 for r in new)  # far below 8 bits a byte


def lm_model():
    raw = np.frombuffer(prose(3000).encode(), np.uint8).astype(np.int64)
    keys, n = np.unique((raw[1:-1] | raw[:-2] << 8) * 257 + raw[2:], return_counts=True)
    return op2_mixing_lm.Code(keys, n), [np.random.RandomState(1).randint(-60, 60, 1 << b).astype(np.int8) for b in op2_mixing_lm.BITS]


def test_lm_codes_are_complete():
    code, _ = lm_model()
    assert np.allclose((2.0 ** -code.length.astype(float)).reshape(-1, 257).sum(1), 1) and len(code.length) > 20 * 257


def lm_bits(symbols, code, predictors, begin=(0,), expected=None):
    return op2_mixing_lm.code_lengths(symbols, np.array(begin), np.zeros(len(begin), int), code, predictors, expected)[0].sum()


def test_lm_probabilities_add_up():
    """Over all symbols that can follow, the chances that the coder gives are a distribution."""
    code, predictors = lm_model()
    for text in (b"", b"some text", b"x " * 40):
        head = np.frombuffer(text, np.uint8).astype(np.uint16)
        for hope in (-1, ord("e")):
            hoped = np.append(np.full(len(head), -1), hope).astype(np.int16), np.full(len(head) + 1, 3, np.int16)
            before = lm_bits(head, code, predictors) if text else 0
            total = sum(2.0 ** -(lm_bits(np.append(head, s).astype(np.uint16), code, predictors, expected=hoped) - before) for s in range(257))
            assert abs(total - 1) < 1e-3


def slow_bits(text, code, predictors, hoped=None):
    """The coder by its description: decision by decision, in lanes that go in step and share the text's weights and map."""
    m, symbols = op2_mixing_lm, [*text.lower(), 256]
    cut = [symbols[i : i + m.LANE] for i in range(0, len(symbols), m.LANE)]
    places, at, paths = [], 0, []
    for lane in cut:
        _, kept = m.contexts(np.array(lane, np.uint16), np.array([0]))
        path = []
        for i, s in enumerate(lane):
            tree = code.tree[(lane[i - 1] if i else 0) | (lane[i - 2] << 8 if i > 1 else 0)]
            a, n = code.start[tree + s], code.length[tree + s]
            want, right = (-1, 0) if hoped is None else hoped[at + i]
            for d in range(n):
                x = [float(p[c[i] ^ code.node[a + d] % m.LINE]) for c, p in zip(kept, predictors)]
                gate, last = sum(abs(x[-1]) > least * m.SCALE for least in m.SURE), m.BIAS
                if want >= 0:
                    b = code.start[tree + want]
                    if d < code.length[tree + want] and (code.node[b : b + d + 1] == code.node[a : a + d + 1]).all():
                        gate, last = m.MATCHED, (2 * int(code.bit[b + d]) - 1) * m.SCALE * (1 + min(right, 16) / 4)
                path.append(([*x, last], gate, min(d, m.DEPTHS - 1), int(code.bit[a + d])))
        at += len(lane)
        paths.append(path)
    weights = {(g, d): [w / m.SCALE for w in m.WEIGHTS[g]] for g in range(m.LEVELS) for d in range(m.DEPTHS)}
    refined = {(g, q): 1 / (1 + np.exp(8 - (q + 0.5) * 16 / m.BUCKETS)) for g in range(m.LEVELS) for q in range(m.BUCKETS)}
    bits, order = 0.0, sorted(range(len(paths)), key=lambda i: -len(paths[i]))
    for step in range(max(map(len, paths))):
        change = []
        for i in order:
            if step < len(paths[i]):
                x, gate, depth, y = paths[i][step]
                t = min(max(sum(a * b for a, b in zip(weights[gate, depth], x)), -7.99), 7.99)
                q, p = int((t + 8) * m.BUCKETS / 16), 1 / (1 + np.exp(-t))
                own = refined[gate, q]
                chance = p + (own - p) * m.MAP_SHARE
                bits -= np.log2(chance if y else 1 - chance)
                rate = m.RATE / m.SCALE**2 * max(0.15, 1 / (1 + step / 256)) * (y - p)
                change.append(((gate, depth), [a + rate * b for a, b in zip(weights[gate, depth], x)], (gate, q), own + (y - own) * m.MAP_RATE))
        for w, new, q, value in change:
            weights[w], refined[q] = new, value
    return bits


def test_lm_score_follows_the_description():
    code, predictors = lm_model()
    for n, hopes in ((0, 0), (2, 0), (40, 1), (400, 0), (500, 1)):
        text = prose(n).encode()
        raw = np.frombuffer(text, np.uint8)
        hoped = np.full(len(raw) + 1, -1, np.int16), np.zeros(len(raw) + 1, np.int16)
        if hopes:
            some = np.arange(len(raw)) % 3 > 0
            hoped[0][:-1][some] = np.where(np.arange(len(raw)) % 7 == 2, ord("a"), raw)[some]
            hoped[1][:-1][some] = 5
        got = op2_mixing_lm.text_bits(raw, np.array([0, len(raw)]), code, predictors, hoped)[0]
        assert abs(got - slow_bits(text, code, predictors, list(zip(*map(np.ndarray.tolist, hoped))))) < 0.002 * got, n


def test_lm_score_does_not_depend_on_neighbours(monkeypatch):
    code, predictors = lm_model()
    texts = [prose(n) for n in (3, 900, 50, 2000)] + ["", prose(30000)]
    one = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        one.append(op2_mixing_lm.text_bits(raw, np.array([0, len(raw)]), code, predictors)[0])
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    both = op2_mixing_lm.text_bits(raw, np.cumsum([0, *(len(t.encode()) for t in texts)]), code, predictors)
    assert np.allclose(one, both, rtol=1e-5)


def test_lm_state_goes_on_in_long_texts(monkeypatch):
    """A text in one lane a batch costs about what it costs whole: weights and map aren't thrown away in between."""
    code, predictors = lm_model()
    raw = np.frombuffer(prose(4000).encode(), np.uint8)
    whole = op2_mixing_lm.text_bits(raw, np.array([0, len(raw)]), code, predictors)[0]
    monkeypatch.setattr(op2_mixing_lm, "BATCH", 1)
    seen = []
    real = op2_mixing_lm.code_lengths
    monkeypatch.setattr(op2_mixing_lm, "code_lengths", lambda *a: seen.append(a[-1] is not None) or real(*a))
    lanes = list(op2_mixing_lm.lanes(raw, np.array([0, len(raw)]), 1))
    assert len(lanes) == -(-(len(raw) + 1) // op2_mixing_lm.LANE) and np.concatenate([x[0] for x in lanes])[-1] == 256
    monkeypatch.setattr(op2_mixing_lm, "lanes", lambda *a: iter(lanes))
    one = op2_mixing_lm.text_bits(raw, np.array([0, len(raw)]), code, predictors)[0]
    assert seen == [False] + [True] * (len(lanes) - 1) and one < whole * 1.05


def test_lm_goes_through_a_text_in_order(monkeypatch):
    """Contexts reach over the whole of a text, and each decision is coded with the changes of all before it."""
    code, predictors = lm_model()
    for n, hopes in ((300, 1), (1500, 0)):
        text = prose(n).encode()
        raw = np.frombuffer(text, np.uint8)
        hoped = np.full(len(raw) + 1, -1, np.int16), np.zeros(len(raw) + 1, np.int16)
        hoped[0][: len(raw) : 1 + 2 * hopes] = raw[:: 1 + 2 * hopes] if hopes else -1
        got = op2_mixing_lm.text_bits(raw, np.array([0, len(raw)]), code, predictors, hoped)[0]
        with monkeypatch.context() as one_lane:
            one_lane.setattr(op2_mixing_lm, "LANE", 1 << 40)
            want = slow_bits(text, code, predictors, list(zip(*map(np.ndarray.tolist, hoped))))
        assert abs(got - want) < 1e-4 * want, n


def test_lm_pieces_of_a_text_are_the_text(monkeypatch):
    """However a text is cut in memory, its contexts and its code length are those of the whole."""
    m, (code, predictors) = op2_mixing_lm, lm_model()
    texts = ["ab cd", "", prose(400) + "x" * 700 + " \t" + prose(100), "a", "y" * 300, prose(150)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    hoped = np.append(np.where(np.arange(len(raw)) % 4 == 1, raw, -1), -1).astype(np.int16), np.arange(len(raw) + 1).astype(np.int16) % 9

    def seen():
        parts = [(s, *m.contexts(s, b, tail)) for s, b, tail in m.tailed(raw, off, 1000)]
        return [np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), *(np.concatenate([x[2][k] for x in parts]) for k in range(3))]

    whole, bits = seen(), m.text_bits(raw, off, code, predictors, hoped)
    monkeypatch.setattr(m, "WINDOW", 64)
    monkeypatch.setattr(m, "LEAST_STEPS", 50)
    monkeypatch.setattr(m, "TRAIN_BATCH", 37)
    assert np.allclose(m.text_bits(raw, off, code, predictors, hoped), bits, rtol=1e-5)
    for lane in (1, 3, 64, 1000):
        monkeypatch.setattr(m, "LANE", lane)
        assert all((a == b).all() for a, b in zip(seen(), whole, strict=True)), lane
        assert np.allclose(m.text_bits(raw, off, code, predictors, hoped), bits, rtol=1e-5), lane


def test_lm_very_many_short_texts_go_in_batches():
    """Each lane has its weights and map, so that only so many go at a time."""
    code, predictors = lm_model()
    texts = ["", "a", "b c"] * 12000
    raw, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    parts = list(op2_mixing_lm.lanes(raw, off))
    assert sum(len(x[1]) for x in parts) == len(texts) and max(len(x[1]) for x in parts) <= 1 << 14
    bits = op2_mixing_lm.text_bits(raw, off, code, predictors).reshape(-1, 3)
    assert np.allclose(bits, bits[0], rtol=1e-5)


def test_lm_windows_stay_small(monkeypatch):
    """However many texts go side by side, what is laid out for the coder at a time fits a cache, and is all there is."""
    m, (code, predictors) = op2_mixing_lm, lm_model()
    texts = [prose(20 + i % 30) for i in range(5000)]
    raw, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    seen, real = [], m.decisions
    monkeypatch.setattr(m, "decisions", lambda code, path: seen.append(code.length[path].sum()) or real(code, path))
    m.text_bits(raw, off, code, predictors)
    symbols = np.concatenate([code.tree[m.contexts(s, b, t)[0]] + s for s, b, t in m.tailed(raw, off, 1 << 16)])
    assert max(seen) <= 1 << 17 and sum(seen) == code.length[symbols].sum()


def test_lm_next_symbols_of_lanes():
    """A lane's next symbols have `most` decisions at most, but one symbol always goes, and none behind its end."""
    size = np.random.RandomState(3).randint(1, 14, 3000)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    place = np.unique(np.random.RandomState(4).randint(0, 2990, 200))
    stop = np.append(place[1:], 3000)
    for most in (1, 2, 7, 64, 1000, 1 << 17):
        want = [max([p + 1, *(u for u in range(p + 1, s + 1) if ends[u] - ends[p] <= most)]) for p, s in zip(place, stop)]
        assert op2_mixing_lm._upto(ends, place, stop, most).tolist() == want, most


def test_lm_chunks_have_texts_of_like_length():
    base, chunks = op2_mixing_lm._dealing([(0, 5, 0), (10, 50, 1600), (11, 250_000, 300), (24, 3, 9000), (26, 1, 9000)], 3000)
    assert [(base[x], chunks[x]) for x in (26, 24, 11, 10, 0)] == [(0, 3), (3, 3), (6, 3), (6, 3), (6, 3)]


def test_lm_partitions_add_up(spark):
    """Tables and trees are the same however many partitions have counted, added in one step or in two."""
    texts = spark.createDataFrame([(prose(50),) for _ in range(60)], "text string")
    one, many = op2_mixing_lm.train(texts.coalesce(1), 1), op2_mixing_lm.train(texts.repartition(9), 9)
    assert dict(one[1]) == dict(many[1]) and (one[0].length == many[0].length).all() and (one[0].bit == many[0].bit).all()


def test_lm_tables_count_every_decision(monkeypatch):
    """Symbols that are alike are put together before they are counted; the tables are those of one decision after the other."""
    from types import SimpleNamespace

    m, texts = op2_mixing_lm, [prose(300), "", "Ab ab\tab", prose(40), "é" * 30]
    raw, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    keys = np.concatenate([pair.astype(np.int64) * 257 + s for s, b, tail in m.tailed(raw, off, 500) for pair in [m.contexts(s, b, tail)[0]]])
    keys, n = np.unique(keys, return_counts=True)
    code = m.Code(keys, n)
    want = [np.zeros(2 << b, np.int64) for b in m.BITS]
    for t in texts:
        symbols = np.array([*t.encode().translate(m.FOLD), 256], np.uint16)
        pair, kept = m.contexts(symbols, np.array([0]))
        for i, path in enumerate(code.tree[pair] + symbols):
            for d in range(code.start[path], code.start[path] + code.length[path]):
                for table, context in zip(want, kept, strict=True):
                    table[int(context[i] ^ code.node[d] % m.LINE) * 2 + int(code.bit[d])] += 1
    monkeypatch.setattr(m, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    for most in (1, 600, 1 << 21):
        monkeypatch.setattr(m, "COUNT_BATCH", max(4, most))
        monkeypatch.setattr(m, "TRAIN_BATCH", min(most + 100, 1 << 18))
        counted = [pa.Table.from_batches([x]) for x in m._count(SimpleNamespace(value=code), 1)(iter([pa.record_batch({"text": texts})]))]
        blocks = [(x["block"][0].as_py(), m._finish(x)["data"][0].as_py()) for x in counted]
        got = m.tables([*m._pair_blocks(code, keys, n), *blocks])
        assert all((a == m._stretched(b)).all() for a, b in zip(got, want, strict=True)), most


def test_lm_matches_grow_with_the_corpus(spark):
    """A held-out copy of a training text costs far less than a text of its kind; a training text doesn't match itself."""
    texts = [prose(200) for _ in range(30)]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(100, texts[3], True), (101, prose(200), True), (102, texts[5], False)]
    for settings in ({}, {"chunk_chars": 3000, "range_chars": 2000}):
        got = {r.doc_id: r.bits / r.n_bytes for r in op2_mixing_lm.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), **settings).collect()}
        alone = sum(got[i] for i in range(30) if i not in (3, 5)) / 28
        assert got[100] < 0.97 * alone and got[5] < 0.97 * alone and abs(got[5] - got[102]) < 1e-6 and got[101] > alone
        assert min(got[i] for i in range(30) if i != 5) > 0.85 * alone


def test_lm_held_out_bits(spark, data):
    """From few documents a byte of new ones costs less than half of what it takes."""
    got = [r for r in op2_mixing_lm.op2_mixing_lm(spark, data).collect() if r.held_out]
    assert sum(r.bits for r in got) < 3 * sum(r.n_bytes for r in got)


def test_lm_empty_table(spark):
    assert op2_mixing_lm.score(spark.createDataFrame([], "doc_id long, text string, held_out boolean")).collect() == []


# 3 ------------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<s>\\[INST]", "", None, "é\n\n", "[/INST]</s>" * 5, " [INST"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, ["user", "assistant", None, "[INST]x"][(t + (c % 3 == 0)) % 4 if t > 1 else t % 2], nasty[(c % 2) * t % len(nasty)], "x"))
    rows += [(1000 + i, t, "user", f"same {t}", "x") for i in range(30) for t in range(3)] + [(None, 0, "user", "no id", "x"), (7, 0, "user", "again", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")
    want = {}
    for c, t, r, x, _ in rows:
        want.setdefault(c, []).append((t, r or "", x or ""))
    import hashlib

    for settings in ({}, {"pack_chars": 50, "pack_convs": 3}, {"piece_chars": 20, "piece_turns": 4}, {"piece_turns": 1, "pack_convs": 2}):
        got = {r.conv_id: r for r in op3_chat.read_all(op3_chat.format_all(df, **settings)).collect()}
        assert set(got) == set(want)
        for c, turns in want.items():
            turns = sorted(turns)
            said = "".join(x for _, r, x in turns if r == "assistant")
            assert got[c].n_turns == len(turns)
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_pack_shares_turns():
    tree = op3_chat.Tree()
    tree.add(1, [("user", "hi"), ("assistant", "a")])
    tree.add(2, [("user", "hi"), ("assistant", "b"), ("user", "c")])
    tree.add(3, [("user", "hi"), ("assistant", "a")])
    pack = tree.pack()
    assert pack["text"].count("hi") == 1 and len(pack["nodes"]) == 4
    b = pack["nodes"][2]
    assert b["position"] == pack["nodes"][1]["position"] and b["attends"] == [{"start": 0, "end": pack["nodes"][0]["end"]}]
    assert pack["nodes"][3]["attends"] == [{"start": 0, "end": pack["nodes"][0]["end"]}, {"start": b["start"], "end": b["end"]}]
    assert [c["last"] for c in pack["convs"]] == [1, 3, 1]


def test_chat_long_conversations_share_pieces(spark):
    same = [("user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(20)]
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate(same + [("user", f"own {c}")] * (c + 1))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs = op3_chat.format_all(df.coalesce(1), piece_turns=8)
    text = "".join(p.text for p in packs.collect())
    assert all(text.count(x + "</s>") == 1 for _, x in same) and all(p.chained for p in packs.collect())
    assert sorted(c.piece for p in packs.collect() for c in p.convs) == sorted([0, 1, 2] * 3)
    got = {r.conv_id: r for r in op3_chat.read_all(packs).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {0: 21, 1: 22, 2: 23}


def test_chat_broken_output_is_noticed():
    with pytest.raises(ValueError):
        list(op3_chat.parse("[INST] user [/INST]text"))
    with pytest.raises(ValueError):
        list(op3_chat.parse("x[INST] user [/INST]text</s>"))


def test_chat_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op3_chat.read_all(op3_chat.format_all(df)).collect() == []


# 4 ------------------------------------------------------------------------------------------------------------------------


def brute_hits(text, items, window):
    words, hit, found = brute.alnum(text), set(), set()
    for item, t in items:
        w = brute.alnum(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[i : i + n]:
                    hit.update(range(at, at + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination_matches_brute_force(spark, block):
    import hashlib

    items = [(1, prose(30)), (2, "aa bb"), (3, None), (4, "..."), (10, prose(12)), (5, prose(25)), (1, "zz")]
    texts = odd_texts()[:9] + [f"{prose(5)} {items[0][1].upper()} {prose(4)}", f"{prose(3)}, {' '.join(items[4][1].split()[1:11])}!", "Aa-BB aa bb aa", " ".join(items[5][1].split()[:9]), "zz"]
    texts += [f"{prose(50)} {' '.join(items[0][1].split()[3:20])} {prose(9)} {items[5][1]}" for _ in range(3)]
    docs, bench = table(spark, texts, matches="x", item_id=1), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in op4_decontamination.digest(op4_decontamination.matches(docs, bench, block_bytes=block)).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute_hits(t, items, 10)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (n, hit, len(found), hit > 0), t
        assert got[i].items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
    kept = op4_decontamination.remove(docs, bench, block_bytes=block)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if not brute_hits(t, items, 10)[1]}


def test_decontamination_longest_match(spark):
    item = [f"w{i}" for i in range(40)]
    docs = table(spark, [f"x {' '.join(item[5:30])} y"])
    m = op4_decontamination.matches(docs, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).first()["matches"]
    assert [(x.start, x.n_words, x.item_id, x.item_start) for x in m] == [(1, 25, "9", 5)]


def test_decontamination_suffix_array_and_longest_matches():
    for _ in range(60):
        docs = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        docs += docs[:2]  # equal suffixes
        shard = op4_decontamination.Shard([d.encode() for d in docs])
        numbers = shard.numbers.tolist()
        assert shard.array.tolist() == sorted((p for p, n in enumerate(numbers) if n), key=lambda p: (numbers[p : numbers.index(0, p)], p))
        items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))) for i in range(4)]
        want = set()
        for i, item in items:
            t = item.split()
            for d, x in enumerate(map(str.split, docs)):
                for p, q in itertools.product(range(len(x)), range(len(t))):
                    n = 0
                    while p + n < len(x) and q + n < len(t) and x[p + n] == t[q + n]:
                        n += 1
                    if n >= min(3, len(t)) and not (p and q and x[p - 1] == t[q - 1]):
                        want.add((d, p, n, i, q))
        assert set(map(tuple, op4_decontamination.longest(shard, op4_decontamination.test_suffixes(items, 3)).tolist())) == want


def test_decontamination_long_texts_and_matches():
    text = " ".join(f"w{i % 700}" for i in range(5000)).encode()
    piece, op4_decontamination.PIECE_BYTES = op4_decontamination.PIECE_BYTES, 64
    try:
        shard = op4_decontamination.Shard([b"", text, b"w1"])
    finally:
        op4_decontamination.PIECE_BYTES = piece
    assert shard.counts.tolist() == [0, 5000, 1]
    suffixes = op4_decontamination.test_suffixes([("x", text.decode())], 10)
    assert [1, 0, 5000, 0, 0] in op4_decontamination.longest(shard, suffixes).tolist()


def test_decontamination_repeated_rows_in_any_number_of_blocks(spark):
    a, b = prose(30), prose(30)
    rows = [(1, a), (1, a), (1, b), (None, a), (None, b), (None, b), (2, None), (3, prose(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([("x", a), ("y", b), ("z", prose(30))], "item_id string, text string")
    one, many = (sorted(map(repr, op4_decontamination.digest(op4_decontamination.matches(docs, tests, block_bytes=n)).collect())) for n in (1 << 20, 10))
    assert one == many and len(one) == len(rows)


def test_decontamination_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = table(spark, ["a b", None])
    assert {r.contaminated for r in op4_decontamination.digest(op4_decontamination.matches(docs, none)).collect()} == {False}
    assert op4_decontamination.remove(docs, none).count() == 2
    assert op4_decontamination.matches(docs.limit(0), none).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------------------


def test_surrogates_are_permutations():
    for n in (1, 2, 3, 10, 97, 1000):
        out = [op5_surrogates.permute(x, n, b"k") for x in range(n)]
        assert sorted(out) == list(range(n)) and (n == 1 or all(a != b for a, b in enumerate(out)))
        assert [op5_surrogates.permute(y, n, b"k", True) for y in out] == list(range(n))


@pytest.mark.parametrize(
    "kind, entity",
    [("email", "John.Doe+x@acme-corp.co.uk"), ("phone", "+1 (017) 555-7713"), ("ip", "192.168.1.7"), ("ip", "8.8.8.8"), ("card", "4111 1111-1111 1111"), ("iban", "DE89 3704 0044 0532 0130 00"),
     ("ssn", "123-45-6789"), ("secret", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"), ("secret", "hunter2-X"), ("titled", "Mary Smith"), ("titled", "Анна Иванова"), ("named", "Hans Müller")],
)
def test_surrogates_keep_type(kind, entity):
    new = op5_surrogates.surrogate(kind, entity)
    assert new != entity and len(new.split()) == len(entity.split()) and op5_surrogates.surrogate(kind, entity) == new
    assert op5_surrogates.surrogate(kind, entity, b"other") != new
    if kind in ("email", "phone", "card", "iban", "ip"):
        assert [k for _, _, k in op5_surrogates.detect(new)] == [kind]
    if kind == "ip" and entity.startswith("192.168"):
        assert new.startswith("192.168.")
    if kind in ("titled", "named"):
        first = next(names for names in op5_surrogates.FIRST_NAMES if entity.split()[0] in names)
        assert new.split()[0] in first and new[-1] == entity[-1]


def test_surrogates_distinct_and_coreferent(spark):
    mails = [f"u{i}@mail{i % 9}.example.com" for i in range(400)]
    texts = [f"write to {m} or {m.upper()}, not {mails[0]}." for m in mails] + [None, "", "order 1234567890123456 v1.2.3.4.5", "plain"]
    out = op5_surrogates.anonymize(table(spark, texts, _text="clash"))
    rows = {r.doc_id: r for r in out.collect()}
    assert op5_surrogates.collisions(out).count() == 0
    first = {rows[i]["_entities"][-1]["surrogate"] for i in range(400)}
    assert len(first) == 1
    assert len({rows[i]["_entities"][0]["surrogate"] for i in range(400)}) == 400
    assert all(rows[i]["_entities"][0]["surrogate"].upper() == rows[i]["_entities"][1]["surrogate"] for i in range(400))
    assert not any(m in rows[i].text for i, m in enumerate(mails))
    assert [rows[400 + i].text for i in range(4)] == texts[400:]
    assert op5_surrogates.anonymize(table(spark, [])).count() == 0


def test_surrogates_later_mentions():
    text = "Mary Smith came. Later Smith left with Mary; Smithson stayed. Dr. Ivanka Petrova saw Petrova."
    new, pairs = op5_surrogates.replace(text, op5_surrogates.detect(text))
    words = new.replace(".", "").replace(";", "").split()
    first, last = words[0], words[1]
    assert {"Mary", "Smith", "Petrova"}.isdisjoint(words) and words[4] == last and words[7] == first and words[8] == "Smithson"
    assert words[-1] == words[12] and len(pairs) == 5


def test_surrogates_that_collide_are_drawn_again(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "call 555-123-4567 or 555-765-4321", "x"), (2, "555-765-4321 and a@b.example.org", None), (3, None, "y")], "doc_id long, text string, _entities string")
    real = op5_surrogates.surrogate
    monkeypatch.setattr(op5_surrogates, "surrogate", lambda kind, entity, key, attempt: "555-000-0000" if kind == "phone" and not attempt else real(kind, entity, key, attempt))
    out = op5_surrogates.distinct_surrogates(docs)
    assert out.columns == ["doc_id", "text", "_entities", "__entities"]
    rows = {r.doc_id: r["__entities"] for r in out.collect()}
    phones = {(e.digest, e.surrogate) for r in rows.values() for e in r if e.kind == "phone"}
    assert len(phones) == 2 == len({s for _, s in phones}) and rows[3] == []


# 6 ------------------------------------------------------------------------------------------------------------------------


def near(text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


def jaccard_texts():
    passage = prose(60)
    texts = odd_texts()[:8]
    for n in (4, 12, 60, 200):
        base = prose(n)
        texts += [base, base.upper(), *(near(base, e) for e in (1, 1, 2, 3, n // 12, n // 8, n // 5))]
    texts += [f"{prose(30)} {passage} {prose(30)}" for _ in range(12)] + [passage] * 5
    chain = prose(150)
    for _ in range(12):
        texts.append(chain)
        chain = near(chain, 2)
    return texts


@pytest.mark.parametrize("k, percent, settings", [(3, 90, {"most_tokens": 900, "range_chars": 3000}), (5, 80, {})])
def test_jaccard_matches_brute_force(spark, k, percent, settings):
    texts = jaccard_texts()
    docs = table(spark, texts, n=1, root="x", set_id=3, key=2).repartition(3)
    want = brute.components(list(enumerate(texts)), k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op6_jaccard.join(docs, k, percent, **settings).collect()}
    assert got == want
    kept = op6_jaccard.keep_one(docs, k, percent)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, (_, c) in want.items() if d == c}


def test_jaccard_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A  b c d")]
    got = op6_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(-1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert op6_jaccard.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_jaccard_rows_without_doc_id_link(spark):
    words = prose(200).split()
    text, other = " ".join(words), " ".join([*words[:90], "zzzz", *words[91:]])
    for a, b in ((None, 5), (None, None)):
        rows = [(a, text), (b, other), (None, "a b c"), (7, "d e f")]
        got = [(r.doc_id, r.n_links, r.component_id) for r in op6_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        least = min((x for x in (a, b) if x is not None), default=None)
        assert sorted(got, key=repr) == sorted([(a, 1, least), (b, 1, least), (None, 0, None), (7, 0, 7)], key=repr)


def test_jaccard_large_classes_and_groups(spark, monkeypatch):
    """With a low bound on what may be broadcast, hot and other keys go both ways and give the same."""
    texts = jaccard_texts() + ["the same words in each of them"] * 40
    docs = table(spark, texts).repartition(3)
    one = sorted(map(tuple, op6_jaccard.join(docs, 3, 80).collect()))
    monkeypatch.setattr("larkspur.llm.common.HOT", 20)
    assert sorted(map(tuple, op6_jaccard.join(docs, 3, 80, most_tokens=900, range_chars=100).collect())) == one


def test_jaccard_counts_every_link(spark):
    """Against all pairs of rows, with exact copies, chains, and groups cut into blocks."""
    texts = jaccard_texts()
    sets = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if (w := [x.lower() for x in brute.spaced(t)]) else set() for t in texts]
    want = {i: sum(i != j and bool(a) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    assert max(want.values()) > 3
    for settings in ({"most_tokens": 900, "range_chars": 3000},):
        got = {r.doc_id: r.n_links for r in op6_jaccard.join(table(spark, texts).repartition(3), 3, 80, **settings).collect()}
        assert got == want


def test_signature_trees_lose_no_pair():
    rs = np.random.RandomState(3)
    sets = []
    for _ in range(40):
        base = rs.choice(100000, rs.randint(1, 60), replace=False)
        for _ in range(rs.randint(1, 6)):
            own = base.copy()
            own[: len(own) // 12] = rs.choice(100000, len(own) // 12)
            sets.append(np.unique(own).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sets = [np.sort(s) for s in sets]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sigtree.similar(sets[i], sets[j], 80)}
    assert {tuple(sorted(p)) for p in sigtree.links(sets, None, 80, every=True)} == want
    half = len(sets) // 2
    across = {(i, half + j) for i, j in sigtree.links(sets[:half], sets[half:], 80, every=True)}
    assert across == {(i, j) for i, j in want if i < half <= j}
    few = sigtree.links(sets, None, 80)
    forest, full = sigtree.Forest(len(sets)), sigtree.Forest(len(sets))
    for i, j in few:
        forest.join(i, j)
    for i, j in want:
        full.join(i, j)
    assert (forest.flat() == full.flat()).all() and len(few) < len(sets)


def test_components(spark):
    edges = [(i + 1, i) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)] + [(200 + i, 200) for i in range(1, 30)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90, **{200 + i: 200 for i in range(1, 30)}}


# 7 ------------------------------------------------------------------------------------------------------------------------


def test_warc_revisits_and_odd_rows(spark):
    rows = [(5, "http://a/b c", "x", 1), (3, None, "x", 1), (9, "http://a/é", None, 1), (10, "u", "", 1), (11, "u", "\r\n\r\nHTTP/1.1 200 OK\r\n\r\nWARC/1.1", 1), (3, "u", "x", 1), (None, "u", "x", 1), (12, "u", "é" * 50000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size int").repartition(3)
    got = {}
    for r in op7_warc.read(op7_warc.archive(pages)).collect():
        got.setdefault(r.page_id, []).append((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))
    x, empty = op7_warc.digest(b"x"), op7_warc.digest(b"")
    assert got[5] == [(1, x, "revisit", 3)] and got[3] == [(1, x, "response", None)] * 2
    assert got[9] == [(0, empty, "response", None)] and got[10] == [(0, empty, "revisit", 9)]
    assert got[None] == [(1, x, "revisit", 3)]
    assert got[12] == [(100000, op7_warc.digest(("é" * 50000).encode()), "response", None)] and got[11][0][2] == "response"
    again = {r.record_type for r in op7_warc.read(op7_warc.archive(pages, least=2)).collect()}
    assert again == {"response"}
    assert op7_warc.read(op7_warc.archive(pages.limit(0))).count() == 0


def test_arc_versions_round_trip(tmp_path, spark):
    records = [op7_warc.page_record(i, f"http://h/{i}", "<html>\n1 0 x\n" * i) for i in range(4)]
    for version in (1, 2):
        raw = op7_warc.arc_file("a.arc", version, records)
        assert [(r.url, r.date, r.block) for r in op7_warc.read_arc(raw)] == [(r.url, r.date, r.block) for r in records]
        (tmp_path / f"v{version}.arc").write_bytes(raw)
    with pytest.raises(ValueError):
        list(op7_warc.read_arc(raw[:-20]))
    with pytest.raises(ValueError):
        list(op7_warc.read_arc(b"filedesc://x 0 0 text/plain nine\n"))
    done = op7_warc.convert_files(spark, str(tmp_path / "*.arc"))
    assert op7_warc.export(done, str(tmp_path / "out")) == 2
    got = list(op7_warc.read_warc((tmp_path / "out" / "v2.warc.gz").read_bytes()))
    assert got[0].headers["WARC-Type"] == "warcinfo" and got[0].headers["WARC-Filename"] == "v2.arc" and b"Archive-length" in got[0].block
    got = got[1:]
    assert [g.headers["WARC-Target-URI"] for g in got] == [r.url for r in records] and got[3].block == records[3].block
    assert got[0].headers["WARC-Date"] == "2000-01-01T00:00:00Z"


def test_warc_types_and_references():
    dns = op7_warc.convert(op7_warc.ArcRecord("dns:example.com", "1.2.3.4", "20010203", "text/dns", b"20010203\nexample.com. 1 IN A 1.2.3.4"))
    assert dns.headers["WARC-Type"] == "resource" and dns.headers["Content-Type"] == "text/dns" and dns.headers["WARC-Date"] == "2001-02-03T00:00:00Z"
    first, second = (op7_warc.page_record(i, f"http://h/{i}", "x") for i in (3, 8))
    a, b = op7_warc.convert(first), op7_warc.convert(second, (3, "http://h/3"))
    assert b.headers["WARC-Type"] == "revisit" and b.headers["WARC-Refers-To"] == a.headers["WARC-Record-ID"]
    assert (b.headers["WARC-Refers-To-Target-URI"], b.headers["WARC-Refers-To-Date"]) == (a.headers["WARC-Target-URI"], a.headers["WARC-Date"])
    assert next(op7_warc.read_warc(op7_warc.member(b))).block.endswith(b"\r\n\r\n")


# 8 ------------------------------------------------------------------------------------------------------------------------


def test_licences(spark):
    texts = odd_texts() + [
        "x\nReleased under the MIT License.\ny", "MIT license mit LICENSE", "the general public license and Apache-License", "licence: mit", "licensed under CC-BY NC 4.0",
        "this work licensed under the gnu general public license version", " ".join(VOCABULARY[:100]) + " permission is hereby granted free of charge to any person obtaining a copy of this software and documentation files " + prose(90),
        "license", "public license general",
    ]
    docs = table(spark, texts, words=1, labels="x", h=2)
    got = {r.doc_id: r for r in op8_licences.scan(docs.unionByName(docs)).collect()}
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for i, t in enumerate(texts):
        w = brute.alnum(t)
        at = sorted(j for p in phrases for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
        base = sorted({label for p, label in phrases.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()})
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(base)), t
        assert set(base) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    n = len(odd_texts())
    assert [got[n + k].labels for k in range(9)] == ["mit", "mit", "apache,gpl", "", "cc-by-nc", "gpl", "mit", "", ""]
    assert op8_licences.scan(docs.limit(0)).count() == 0


def test_licences_over_line_ends(spark):
    wrapped = [
        ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"),
        ("bsd", " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"),
        ("gpl", "# you can redistribute it and/or modify\r\n# it under the terms of the GNU General Public License as published by\r\n# the Free Software Foundation"),
        ("mpl", "// This Source Code Form is subject to the terms of the Mozilla\n// Public License, v. 2.0."),
    ]
    texts = [t for _, t in wrapped] + [prose(n) + "\n" + t + "\n" + prose(500) for n in (31, 45, 64, 1000) for _, t in wrapped]
    texts.append("Redistribution and use in source and binary forms\n" + "zzz\n" * 70 + "with or without modification, are permitted provided that the following conditions are met")
    texts.append("ich mit dir\nzu\nLicensed under the Apache License, Version 2.0.")
    got = {r.doc_id: r for r in op8_licences.scan(table(spark, texts), phrases=[]).collect()}
    assert [got[i].labels for i in range(len(texts))] == [label for label, _ in wrapped] * 5 + ["", "apache"]
    assert all(got[i].score >= 0.8 for i in range(20)) and got[20].score == 0


# 9 ------------------------------------------------------------------------------------------------------------------------


def water(sizes, cap):
    """Targets by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_mixing_targets_and_quotas(spark):
    texts = [prose(rng.randint(0, 60)) for _ in range(300)] + [None, "", " "]
    rows = [(i, t, None if i % 13 == 0 else ["zz", "Zé", "a", "tiny"][0 if i % 3 else i % 4] if i % 50 else "tiny") for i, t in enumerate(texts)]
    rows += [(999, "", "hollow"), (5, texts[5], "zz")]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, source string, target double, size int")
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.spaced(t))
    want = water(sizes, 3)
    source = {i: s for i, _, s in rows}
    got = op9_mixing.mix(df, block_docs=16).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.size == len(brute.spaced(dict((i, t) for i, t, _ in rows)[r.doc_id])) and r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert sorted(map(tuple, op9_mixing.mix(df.repartition(5), block_docs=16).collect())) == sorted(map(tuple, got))


def test_mixing_draw(spark):
    texts = [prose(rng.randint(1, 60)) for _ in range(200)]
    df = table(spark, texts, shard=1)
    quota = {r.doc_id: r.taken for r in op9_mixing.mix(df, block_docs=8).collect()}
    rows = op9_mixing.draw(df, block_docs=8, shards=5).collect()
    drawn = {}
    for r in rows:
        drawn[r.doc_id] = drawn.get(r.doc_id, 0) + r.taken_words
        assert r.text == texts[r.doc_id]
    assert drawn == {d: n for d, n in quota.items() if n}
    assert len({(r.doc_id, r["pass"]) for r in rows}) == len(rows)
    assert {r.shard for r in rows} <= set(range(8)) and len({r.shard for r in rows}) >= 4
    assert op9_mixing.mix(df.limit(0)).count() == 0 and op9_mixing.draw(df.limit(0)).count() == 0


def test_mixing_draw_of_repeated_rows_and_clashing_columns(spark):
    """Rows that share a doc_id keep their own sizes; alike ones are drawn as often as they are there; a shard is one partition."""
    rows = [(i % 20, prose(rng.randint(1, 40)), ["a", "b", None][i % 3], i, "x") for i in range(120)]
    rows += [rows[5]] * 4 + [(None, "u v w", "a", 1, "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Shard int, shard_in string").repartition(4)
    taken = sum(r.taken for r in op9_mixing.mix(df, block_docs=4).collect())
    out = op9_mixing.draw(df, block_docs=4, shards=8)
    assert out.columns == ["doc_id", "text", "source", "Shard_in_in", "shard_in", "pass", "taken_words", "shard", "place"]
    got = out.rdd.mapPartitionsWithIndex(lambda i, part: ((i, r) for r in part)).collect()
    assert sum(r.taken_words for _, r in got) == taken and all(r.taken_words <= len(r.text.split()) for _, r in got)
    where, last = {}, {}
    for i, r in got:
        assert where.setdefault(r.shard, i) == i and last.get(r.shard, r.place) <= r.place
        last[r.shard] = r.place
    assert sorted((r.doc_id or -1, r.text, r["pass"], r.shard) for _, r in got) == sorted((r.doc_id or -1, r.text, r["pass"], r.shard) for r in op9_mixing.draw(df.repartition(3), block_docs=4, shards=8).collect())


def test_mixing_quotas_by_shard_and_source(spark):
    """The counts at the leaves are what the tree's halving gives, and every drawn block is dealt once."""
    df = table(spark, [prose(rng.randint(1, 60)) for _ in range(200)])
    _, drawn = op9_mixing.plan(df, block_docs=4)
    out = op9_mixing.tickets(drawn, 8).collect()
    want = {(d.skey, d.block, p) for d in drawn.collect() for p in range(d.passes + (d.part > 0))}
    assert {(r.skey, r.block, r["pass"]) for r in out} == want and len(out) == len(want)
    sizes = [sum(r.shard == s for r in out) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(want)
    by_source = {}
    for r in out:
        by_source.setdefault(r.skey, []).append(r.shard)
    assert all(len(set(shards)) > 1 for shards in by_source.values() if len(shards) > 8)


def test_mixing_rows_come_from_the_deal(spark, monkeypatch):
    df = table(spark, [prose(rng.randint(1, 60)) for _ in range(200)] + ["", None])
    full = {r.doc_id: (r.taken, r.copies) for r in op9_mixing.mix(df, block_docs=8).collect()}
    deal = op9_mixing.tickets
    monkeypatch.setattr(op9_mixing, "tickets", lambda *a, **b: deal(*a, **b).filter("shard % 2 = 0"))
    half = {r.doc_id: (r.taken, r.copies) for r in op9_mixing.mix(df, block_docs=8).collect()}
    drawn = {}
    for r in op9_mixing.draw(df, block_docs=8).collect():
        assert r.shard % 2 == 0
        drawn[r.doc_id] = drawn.get(r.doc_id, 0) + r.taken_words
    assert {d: n for d, (n, _) in half.items() if n} == drawn
    assert all(half[d][0] <= full[d][0] and half[d][1] <= full[d][1] for d in full)
    assert 0 < sum(n for n, _ in half.values()) < sum(n for n, _ in full.values())


# 10 -----------------------------------------------------------------------------------------------------------------------


def slow_cost(text, grams):
    """The cost of a text by the definition, from counts of (context, byte) of orders 0 to 3."""
    from math import log2

    raw = b"\0\0\0" + text.encode().lower()
    total = 0.0
    for i in range(3, len(raw)):
        for k in (3, 2, 1, 0):
            seen = grams[k].get(raw[i - k : i])
            if seen is None:
                continue
            t, d = sum(seen.values()), len(seen)
            if raw[i] in seen:
                total -= log2(seen[raw[i]] / (t + d))
                break
            total -= log2(d / (t + d))
        else:
            total += 8
    return total


def test_language_costs_follow_the_definition():
    learned = {"aa": [prose(80) for _ in range(5)], "bb": ["zut alors xyz " * 9, "é"]}
    counts = {}
    for lang, texts in learned.items():
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        code, n = np.unique(op10_language.grams(raw, np.cumsum([0, *(len(t.encode()) for t in texts)]))[0], return_counts=True)
        counts[lang] = (code, n)
    model = op10_language.fit(counts)
    for text in (prose(30), "zut zut qqq\x7f", "é", "a"):
        raw = np.frombuffer(text.encode(), np.uint8)
        got = model.lengths(op10_language.grams(raw, np.array([0, len(raw)]))[0]).sum(0)
        for j, lang in enumerate(model.languages):
            grams = [{} for _ in range(4)]
            for t in learned[lang]:
                r = b"\0\0\0" + t.encode()
                for i in range(3, len(r)):
                    for k in range(4):
                        one = grams[k].setdefault(r[i - k : i], {})
                        one[r[i]] = one.get(r[i], 0) + 1
            assert abs(slow_cost(text, grams) - got[j]) < 1e-2, (text, lang)


def _peak_mb(run) -> tuple[float, object]:
    """The most that Python and numpy held during run(), and what it returned."""
    tracemalloc.start()
    try:
        out = run()
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_language_holds_the_costs_of_a_piece():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghij klmno", k=n)) for n in (40_000, 1_500_000, 7, *[30_000] * 20)]
    seen = {x: np.unique(op10_language.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, 5000]))[0], return_counts=True) for x, t in (("l1", texts[0]), ("l2", texts[1]), ("l3", texts[3]), ("l4", texts[4]))}
    model = op10_language.fit(seen)

    class shared:  # noqa: N801
        value = model

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    peak, got = _peak_mb(lambda: pa.Table.from_batches(op10_language._predict(shared)(iter([batch]))).to_pydict())
    assert got["doc_id"] == [*range(len(texts))] and peak < 50
    for text, lang, bits in zip(texts, got["lang_pred"], got["bits_per_byte"], strict=True):
        raw = np.frombuffer(text.encode(), np.uint8)
        whole = model.lengths(op10_language.grams(raw, np.array([0, len(raw)]))[0]).sum(0, dtype=np.float64)
        assert lang == model.languages[whole.argmin()] and bits == pytest.approx(whole.min() / len(raw))


def test_word_hashes_hold_a_piece():
    words = [b"w%d" % (i % 1000) for i in range(700_000)]
    text = np.frombuffer(b" ".join(words), np.uint8)
    data, first, last = op6_jaccard.word_spans(text, np.array([0, len(text)]))
    op6_jaccard._powers.clear()
    peak, got = _peak_mb(lambda: op6_jaccard.span_hashes(data, first, last))
    assert (got == np.resize(got[:1000], len(got))).all() and len(set(got[:1000].tolist())) == 1000
    assert peak < 40  # the hashes, and those before they are mixed, are most of it


def test_slices_release_what_was_freed(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1), raising=False)
    batches = [pa.RecordBatch.from_arrays([pa.array(["abc"] * 10)], ["text"])] * 3
    assert sum(b.num_rows for b in common.slices(iter(batches), "text", 9)) == 30 and calls == [1]


def test_language_predictions(spark):
    en, fr = (lambda: " ".join(rng.choice(["the", "thing", "nation", "with"]) for _ in range(30))), (lambda: " ".join(rng.choice(["le", "été", "ment", "aux"]) for _ in range(30)))
    rows = [(i, [en, fr][i % 2](), ["en", "fr"][i % 2]) for i in range(200)] + [(900, None, "en"), (901, "", None), (902, "123 !?", "fr"), (903, "the thing", None), (1, "x", "en")]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = op10_language.train(df.filter("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in op10_language.identify(df, model).collect()}
    assert all(got[i].lang_pred == ["en", "fr"][i % 2] for i in range(0, 200, 5))
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = op10_language.keep_language(df, model)
    assert kept.columns == df.columns and {900, 901, 902}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() == len(rows) - 3
    none = op10_language.train(df.limit(0))
    assert none is None and {r.lang_pred for r in op10_language.identify(df, none).collect()} == {"und"}


def test_language_learns_every_language(spark):
    """More languages than one table holds, the rarest with texts of over 20,000 characters only."""
    rows = []
    for n in range(70):
        words = ["".join(chr(0x4E00 + 40 * n + rng.randrange(40)) for _ in range(3)) for _ in range(20)]
        text = lambda k: " ".join(rng.choice(words) for _ in range(k))  # noqa: B023, E731
        rows += [(100 * n + i, text(40), f"l{n:02}") for i in range(4)] if n < 69 else [(100 * n, text(6000), f"l{n:02}")]
        rows.append((100 * n + 50, text(30), None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op10_language.train(df)
    assert list(model.languages) == [f"l{n:02}" for n in range(70)]
    assert all(r.lang_pred == f"l{r.doc_id // 100:02}" for r in op10_language.identify(df, model).collect())


def test_language_held_out_accuracy(spark, data):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = [r for r in op10_language.op10_language(spark, data).collect() if r.held_out]
    assert np.mean([docs[r.doc_id] == r.lang_pred for r in got]) > 0.95


# Pipeline -----------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    kept = {d: t for d, t in before.items() if t and any(c.isalpha() for c in t)}
    groups = brute.components(sorted(kept.items()), 5, 80)
    kept = {d: t for d, t in kept.items() if groups[d][1] == d}
    grams = {tuple(w[i : i + 10]) for _, t in bench for w in [brute.alnum(t)] for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(g) for g in grams}
    kept = {d: t for d, t in kept.items() if not any(tuple(w[i : i + n]) in grams for w in [brute.alnum(t)] for n in sizes for i in range(len(w) - n + 1))}
    rows = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in rows} <= set(kept)
    for r in rows:
        spans = op5_surrogates.detect(kept[r.doc_id])
        assert r.text == op5_surrogates.replace(kept[r.doc_id], spans)[0]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns, name
        assert stage(spark, docs.limit(0), data).count() == 0


def test_arrow_buffers():
    from larkspur.llm.common import slices, utf8

    col = pa.array(["aé", None, "", "xyz"])
    raw, off, valid = utf8(col.slice(1, 3))
    assert [raw[a:b].tobytes() for a, b in zip(off, off[1:])] == [b"", b"", b"xyz"] and valid.tolist() == [False, True, True]
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 1, 9, 0, 2)])], ["t"])
    assert [b.num_rows for b in slices(iter([batch]), "t", 6)] == [2, 1, 2]


def test_coder_steps_stay_out_of_python():
    """A step of the coder calls no Python function: one call for each decision took a good part of its time."""
    code, predictors = lm_model()

    def calls(n):
        seen, raw = [], np.frombuffer(b"abc de " * n, np.uint8)
        sys.setprofile(lambda frame, event, arg: seen.append(1) if event == "call" else None)
        try:
            op2_mixing_lm.text_bits(raw, np.array([0, len(raw)]), code, predictors)
        finally:
            sys.setprofile(None)
        return len(seen)

    calls(100)
    assert calls(400) < calls(100) + 300
