"""The catalogue: the engine's operators on the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur import adapters
from larkspur.functions import text as fn
from larkspur.functions import vectors
from larkspur.operators import graph, recall, rescue, search, sink, targets
from larkspur.operators.lineage import kept
from larkspur.plans import regex as rx
from larkspur.plans.grams import Extractor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Pieces of SQL that several queries share.
FILES = "files AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, text AS content FROM documents)"
LINES = f"""{FILES},
cut AS (SELECT path, CASE WHEN content LIKE '%' || chr(10) THEN content[:-2] ELSE content END AS c FROM files),
lines AS (SELECT path, unnest(range(1, len(string_split(c, chr(10))) + 1)) AS line, unnest(string_split(c, chr(10))) AS text FROM cut)"""
TURNS = "turns AS (SELECT conv_id * 1000 + turn AS turn_id, conv_id AS session_id, turn AS seq, role, text FROM conversations)"
SESSIONS = """sessions AS (SELECT conv_id AS session_id, 'agent' || conv_id % 3 AS agent, '/work/repo' || conv_id % 12 AS cwd, conv_id * 60 AS ts_first,
 conv_id * 60 + count(*) * 10 AS ts_last, count(*) AS turn_count, conv_id % 5 = 0 AS is_subagent FROM conversations GROUP BY conv_id)"""
REPORTS = """reports AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS ts, event_type AS surface, 'user' || user_id % 7 AS kind,
 'failed on ' || props || ' for user ' || user_id AS message, strftime(ts, '%Y-%m-%d') AS run_id, value FROM events)"""
SYMBOLS = """symbols AS (SELECT p_partkey AS id, p_name AS name, p_partkey % 100 AS file_id,
 CASE WHEN p_size % 4 = 0 THEN 'class' WHEN p_size % 4 = 1 THEN 'method' ELSE 'function' END AS kind, p_partkey * 7 % 500 AS "start", p_partkey * 7 % 500 + p_size AS "end" FROM part)"""
EDGES = """edges AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, 'calls' AS kind, CASE WHEN a.l_returnflag = 'N' THEN 'exact' ELSE 'probable' END AS tier, a.l_linenumber AS site_line
 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"""


def _index(files):
    return search.stored_index(files)


def _word(w: str) -> str:
    """A whole word with ASCII boundaries, the same in both engines."""
    return f"(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])"


# Code search --------------------------------------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT path, line, text FROM lines WHERE contains(text, 'thation')")
def search_literal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir)
    return search.search(files, "thation", _index(files))


@query(f"WITH {LINES} SELECT path, line, text FROM lines WHERE regexp_matches(text, 'th[ae]n?ing [a-z]+\\.')")
def search_regex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir)
    return search.search(files, r"th[ae]n?ing [a-z]+\.", _index(files))


@query(f"WITH {LINES} SELECT path, line, text FROM lines WHERE contains(text, 'ement') AND (path LIKE 'src1/%' OR path LIKE 'src3/fr/%')")
def search_path_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(adapters.files(spark, sf_dir), "ement", prefixes=["src1", "src3/fr/"])


@query(f"WITH {LINES} SELECT path, line, text FROM lines WHERE contains(text, 'ation') ORDER BY path, line LIMIT 25 OFFSET 50")
def search_page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.search(adapters.files(spark, sf_dir), "ation")
    return search.page(rows, ["path", "line"], 50, 25).rows


@query(f"WITH {LINES} SELECT path, line, text FROM lines WHERE regexp_matches(text, '(?i)licen[sc]e(d)?')")
def search_case_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir)
    return search.search(files, "(?i)licen[sc]e(d)?", _index(files))


@query(f"WITH {FILES} SELECT count(*) AS n_candidates, count(*) FILTER (contains(content, 'bleing')) AS n_matches, 0 AS n_missed FROM files WHERE contains(content, 'ble') AND contains(content, 'lei') AND contains(content, 'ein') AND contains(content, 'ing')")
def index_equals_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the index, how many match, and how many matches it misses: none."""
    files = adapters.files(spark, sf_dir)
    found = search.candidates(_index(files), rx.plan_literal("bleing"), files).withColumn("c", F.lit(1))
    rows = files.select("path", F.contains("content", F.lit("bleing")).alias("m")).join(found, "path", "left")
    return rows.agg(F.count("c").alias("n_candidates"), F.count_if("m").alias("n_matches"), F.count_if(F.col("m") & F.col("c").isNull()).alias("n_missed"))


_GRAMS = f"""WITH {FILES}, grams AS (SELECT path, unnest(list_distinct(list_transform(range(1, len(content) - 1), lambda i: substr(content, i::BIGINT, 3)))) AS gram FROM files WHERE len(content) >= 3)"""


@query(f"{_GRAMS} SELECT gram, count(*) AS df FROM grams GROUP BY gram")
def gram_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.document_frequency(_index(adapters.files(spark, sf_dir)))


@query(f"{_GRAMS} SELECT gram, count(*) AS n, min(path) AS first_path FROM grams GROUP BY gram ORDER BY n DESC, gram LIMIT 20")
def gram_postings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first path is looked up for the top grams only: a least string for each gram would sort all postings."""
    index = _index(adapters.files(spark, sf_dir))
    top = [r["gram"] for r in search.document_frequency(index).orderBy(F.desc("df"), "gram").limit(20).collect()]
    lists = index.filter(F.col("gram").isin(top)).groupBy("gram").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))
    return lists.orderBy(F.desc("n"), "gram").limit(20)


@query()
def sparse_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.document_frequency(search.postings(adapters.files(spark, sf_dir), Extractor("sparse")))


@query(f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(content, '(?:th|sh)e[ar]tion|queêt?re')")
def regex_plan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that match, by way of the plan's candidates."""
    files, pattern = adapters.files(spark, sf_dir), "(?:th|sh)e[ar]tion|queêt?re"
    found = search.candidates(_index(files), rx.plan_pattern(pattern), files)
    return files.join(found, "path", "left_semi").filter(F.regexp_like("content", F.lit(pattern))).select("path")


def _layers(spark, sf_dir):
    f = adapters.files(spark, sf_dir).select("doc_id", "path")
    base = f.filter("doc_id % 10 < 8")
    status = f.filter("doc_id % 7 = 0").select(F.when(F.col("doc_id") % 3 == 0, "D").when(F.col("doc_id") % 3 == 1, "M").otherwise("A").alias("status"), "path")
    changed, gone = search.reconcile(status)
    return base, changed, gone, f.filter("doc_id % 11 = 0")


_LAYERS = f"""WITH {FILES}, base AS (SELECT path FROM files WHERE doc_id % 10 < 8), st AS (SELECT path, CASE doc_id % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'M' ELSE 'A' END AS s FROM files WHERE doc_id % 7 = 0),
changed AS (SELECT path FROM st WHERE s <> 'D'), gone AS (SELECT path FROM st WHERE s <> 'A'), overlay AS (SELECT path FROM files WHERE doc_id % 11 = 0)"""


@query(f"{_LAYERS} SELECT path, CASE WHEN path IN (FROM overlay) THEN 'overlay' WHEN path IN (FROM changed) THEN 'delta' ELSE 'base' END AS layer FROM (((FROM base) EXCEPT (FROM gone)) UNION (FROM changed) UNION (FROM overlay))")
def live_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, changed, gone, overlay = _layers(spark, sf_dir)
    return search.live(base, changed, gone, overlay)


@query(f"{_LAYERS} SELECT path FROM (((FROM base) EXCEPT (FROM gone)) UNION (FROM changed) UNION (FROM overlay))")
def layered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.layered_candidates(*_layers(spark, sf_dir))


@query(f"{_LAYERS}, l AS (SELECT path, CASE WHEN path IN (FROM overlay) THEN 'overlay' WHEN path IN (FROM changed) THEN 'delta' ELSE 'base' END AS layer FROM (((FROM base) EXCEPT (FROM gone)) UNION (FROM changed) UNION (FROM overlay))) SELECT layer, count(*) AS n_files FROM l GROUP BY layer")
def freshness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.freshness(search.live(*_layers(spark, sf_dir)))


@query()
def content_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.signature(adapters.files(spark, sf_dir))


# Recall -------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {TURNS} SELECT session_id, count(*) AS turn_count, min(struct_pack(seq := seq, text := text)) FILTER (role = 'user')['text'] AS first_prompt,
 left(regexp_replace(trim(coalesce(min(struct_pack(seq := seq, text := text)) FILTER (role = 'user')['text'], min(struct_pack(seq := seq, text := text))['text']), ' \t\r\n'), '[\r\n]+', ' ', 'g'), 120) AS title
 FROM turns GROUP BY session_id""".replace("\t", "' || chr(9) || '").replace("' \r", "' \r"))
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.rollup(adapters.turns(spark, sf_dir))


@query(f"WITH {SESSIONS} SELECT agent, count(*) AS sessions, sum(turn_count)::BIGINT AS turns FROM sessions GROUP BY agent")
def agent_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.agent_status(adapters.sessions(spark, sf_dir))


@query(f"WITH {SESSIONS} SELECT * FROM sessions WHERE agent = 'agent1' AND starts_with(cwd, '/work/repo1') AND ts_last >= 600 AND ts_first <= 4800 AND NOT is_subagent")
def session_filter_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.filter_sessions(adapters.sessions(spark, sf_dir), agent="agent1", cwd="/work/repo1", since=600, until=4800)


@query(f"WITH {SESSIONS} SELECT * FROM sessions WHERE starts_with(session_id::VARCHAR, '1') ORDER BY session_id LIMIT 20")
def session_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.by_prefix(adapters.sessions(spark, sf_dir), "1")


@query(f"WITH {TURNS} SELECT * FROM turns WHERE session_id = 3 AND seq BETWEEN 1 AND 4")
def turn_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.turn_range(adapters.turns(spark, sf_dir), 3, 1, 4)


@query(f"WITH {TURNS} SELECT turn_id, session_id, seq, role FROM turns WHERE regexp_matches(text, '{_word('ing')}') ORDER BY turn_id DESC LIMIT 50")
def recall_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recall.search(adapters.turns(spark, sf_dir), _word("ing"))
    return found.select("turn_id", "session_id", "seq", "role").orderBy(F.desc("turn_id")).limit(50)


def _intent(text: str) -> str:
    heads = " OR ".join(f"starts_with(regexp_replace({text}, '^\\s+', ''), '{p}')" for p in fn.ORCHESTRATOR_PREFIXES)
    return f"CASE WHEN {heads} OR {' OR '.join(f'contains({text}, {chr(39)}{m}{chr(39)})' for m in fn.ORCHESTRATOR_MARKERS)} THEN 'orchestrator' ELSE 'human' END"


_OPENINGS = [*fn.ORCHESTRATOR_PREFIXES, *(f"see {m} " for m in fn.ORCHESTRATOR_MARKERS), "<user-prompt-submit-hook>", "", "  <system-reminder>"]
_OPENED = "replace(['" + "','".join(_OPENINGS) + f"'][1 + turn_id % {len(_OPENINGS)}] || text, chr(13), '')"


@query(f"WITH {TURNS} SELECT turn_id, {_intent(_OPENED)} AS intent FROM turns")
def intent_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with every prefix and marker, and some that are none, put before them."""
    opening = F.element_at(F.array(*[F.lit(x) for x in _OPENINGS]), (F.col("turn_id") % len(_OPENINGS) + 1).cast("int"))
    return adapters.turns(spark, sf_dir).select("turn_id", fn.intent(F.replace(F.concat(opening, "text"), F.lit("\r"), F.lit(""))).alias("intent"))


@query(f"WITH {TURNS} SELECT turn_id FROM turns WHERE contains(text, 'tion') AND (role <> 'user' OR {_intent('text')} = 'human')")
def recall_search_human_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.search(adapters.turns(spark, sf_dir), "tion", human=True).select("turn_id")


_TERMS = ["thing", "ment", "que", "zzz", "sch"]


@query(f"""WITH {TURNS}, t AS (SELECT unnest({_TERMS}) AS term, unnest(range({len(_TERMS)}))::INT AS pos)
SELECT term, pos, count(turn_id) AS n_turns, count(DISTINCT session_id) AS n_sessions FROM t LEFT JOIN turns ON regexp_matches(' ' || regexp_replace(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]', ' ', 'g') || ' ', ' ' || term || ' ') GROUP BY ALL""")
def recall_maxtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.term_counts(adapters.turns(spark, sf_dir), _TERMS)


@query(f"""WITH {TURNS}, w AS (SELECT session_id, ' ' || regexp_replace(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]', ' ', 'g') || ' ' AS x FROM turns),
n AS (SELECT term, pos, count(DISTINCT session_id) AS n FROM (SELECT unnest({_TERMS}) AS term, unnest(range({len(_TERMS)})) AS pos) JOIN w ON contains(x, ' ' || term || ' ') GROUP BY ALL),
top AS (SELECT term FROM n ORDER BY n, pos LIMIT 2)
SELECT session_id FROM w JOIN top ON contains(x, ' ' || term || ' ') GROUP BY session_id HAVING count(DISTINCT term) = (SELECT count(*) FROM top) ORDER BY session_id DESC LIMIT 10""")
def recall_maxtest_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = adapters.turns(spark, sf_dir)
    return recall.pin(turns, _TERMS, recall.term_counts(turns, _TERMS))


_WEIGHTS = {"thing": 2.5, "tion": 0.75, "ement": 1.25}
_LEXICAL = f"""lex0 AS (SELECT turn_id, {" + ".join(f"CASE WHEN regexp_matches(text, '{_word(w)}') THEN {v}::DOUBLE ELSE 0::DOUBLE END" for w, v in _WEIGHTS.items())} AS score FROM turns),
lex AS (SELECT turn_id, score, row_number() OVER (ORDER BY score DESC, turn_id DESC) - 1 AS rank FROM lex0 WHERE score > 0 ORDER BY rank LIMIT 200)"""


def _lexical(spark, sf_dir):
    return recall.lexical(adapters.turns(spark, sf_dir), _WEIGHTS, pattern=_word)


@query(f"WITH {TURNS}, {_LEXICAL} SELECT turn_id, score, rank FROM lex")
def recall_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir)


_DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"
_SEMANTIC = f"""near AS (SELECT vec_id, {_DOT} AS s FROM embeddings e, {_Q} ORDER BY s DESC, vec_id LIMIT 200),
sem AS (SELECT turn_id, row_number() OVER (ORDER BY max(s) DESC, turn_id) - 1 AS rank FROM near JOIN turns ON turn_id = vec_id // 4 * 1000 + vec_id % 4 GROUP BY turn_id)"""
_FUSED = f"{TURNS}, {_LEXICAL}, {_SEMANTIC}, fused AS (SELECT turn_id, sum(p) AS score FROM (SELECT turn_id, 2.0::DOUBLE / (61 + rank) AS p FROM lex UNION ALL SELECT turn_id, 1.0::DOUBLE / (61 + rank) FROM sem) GROUP BY turn_id)"


def _fused(spark, sf_dir):
    """The lexical channel and that of vectors, four of which stand for a conversation's first four turns."""
    vectors_ = adapters.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    chunks = vectors_.select("chunk_id", (F.floor(F.col("chunk_id") / 4) * 1000 + F.col("chunk_id") % 4).alias("turn_id"))
    chunks = chunks.join(adapters.turns(spark, sf_dir).select("turn_id"), "turn_id", "left_semi")
    sem = recall.nearest_turns(recall.knn(vectors_, _query_vector(spark, sf_dir), recall.LEXICAL_LIMIT), chunks)
    return recall.fuse([(_lexical(spark, sf_dir), recall.LEXICAL_WEIGHT), (sem, recall.SEMANTIC_WEIGHT)])


@query(f"WITH {_FUSED} SELECT turn_id, round(score, 6) AS score FROM fused")
def recall_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("turn_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_FUSED}, r AS (SELECT f.turn_id, session_id, score, row_number() OVER (ORDER BY round(score, 12) DESC, f.turn_id DESC) AS rank FROM fused f JOIN turns USING (turn_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rank) AS n FROM r), o AS (SELECT *, sum((n = 1)::INT) OVER (ORDER BY rank) AS g FROM n),
c AS (SELECT coalesce(min(rank) FILTER (g = 10 AND n = 1), max(rank)) AS c FROM o)
SELECT session_id, min_by(turn_id, rank) AS turn_id, round(max(score), 6) AS score, count(*) - 1 AS extra_hits FROM o, c WHERE rank <= c GROUP BY session_id""")
def recall_grouped_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = adapters.turns(spark, sf_dir)
    fused = _fused(spark, sf_dir).withColumn("score", F.round("score", 12))
    return recall.group_sessions(fused, turns, 10).withColumn("score", F.round("score", 6))


def _query_vector(spark, sf_dir) -> list[float]:
    return adapters.table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


@query(f"SELECT vec_id, round({_DOT}, 6) AS score FROM embeddings e, {_Q} ORDER BY {_DOT} DESC, vec_id LIMIT 10")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recall.knn(adapters.table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, id_="vec_id")
    return found.withColumn("score", F.round("score", 6))


@query(f"SELECT vec_id, round({_DOT}, 6) AS score FROM embeddings e, {_Q} WHERE label = 2 ORDER BY {_DOT} DESC, vec_id LIMIT 10")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "embeddings")
    found = recall.knn(e, _query_vector(spark, sf_dir), 10, allowed=e.filter("label = 2"), id_="vec_id")
    return found.withColumn("score", F.round("score", 6))


@query("""SELECT vec_id, round(scale, 6) AS scale, list_sum(list_transform(embedding, lambda x: greatest(-127, least(127, round(x::DOUBLE / scale)))))::BIGINT AS q_sum
FROM (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS scale FROM embeddings)""")
def knn_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantised store; its ranking is compared with the exact one in the tests."""
    packed = adapters.table(spark, sf_dir, "embeddings").select("vec_id", vectors.quantize(F.col("embedding")).alias("p"))
    return packed.select("vec_id", F.round("p.scale", 6).alias("scale"), F.aggregate("p.q", F.lit(0), lambda s, x: s + x).cast("long").alias("q_sum"))


@query(f"""WITH {TURNS}, r AS (SELECT turn_id, session_id, seq, sum(ceil(octet_length(encode(text)) / 4.0)) OVER (PARTITION BY session_id ORDER BY seq) AS spent FROM turns)
SELECT turn_id, session_id, seq FROM r WHERE spent <= 300""")
def context_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = recall.prefix_within(adapters.turns(spark, sf_dir), fn.estimate_tokens(F.col("text")), ["seq"], 300, ["session_id"])
    return kept.select("turn_id", "session_id", "seq")


@query(f"""WITH {LINES}, p AS (SELECT * FROM lines WHERE contains(text, 'ation') ORDER BY path, line LIMIT 100)
SELECT path, line FROM (SELECT path, line, sum(octet_length(encode(text))) OVER (ORDER BY path, line) AS run FROM p) WHERE run <= 65536""")
def byte_cap_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.search(adapters.files(spark, sf_dir), "ation").orderBy("path", "line").limit(search.LIMIT)
    return recall.prefix_within(rows, F.octet_length("text"), ["path", "line"], 65536).select("path", "line")


@query(f"""WITH {TURNS} SELECT turn_id, unnest(range(CASE WHEN length(text) = 0 THEN 0 ELSE 1 + ceil(greatest(0, length(text) - 201) // 400)::INT END)) AS chunk_seq, length(text) AS n FROM turns""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recall.chunks(adapters.turns(spark, sf_dir), width=600, overlap=200)
    sizes = adapters.turns(spark, sf_dir).select("turn_id", F.length("text").alias("n"))
    return rows.select("turn_id", F.col("chunk_seq").cast("long").alias("chunk_seq")).join(sizes, "turn_id").select("turn_id", "chunk_seq", "n")


# Error log ----------------------------------------------------------------------------------------------------------------

_HASH = "sha256(surface || chr(10) || kind || chr(10) || regexp_replace(message, '([^0-9A-Fa-f])[0-9]{5,7}($|[^\\p{L}\\p{N}])', '\\1<num>\\2', 'g'))"
_ERRORS = f"""{REPORTS}, errors AS (SELECT {_HASH} AS dedup_hash, min(id) AS id, min_by(ts, id) AS first_ts, max_by(ts, id) AS last_ts, count(*) AS count, max_by(run_id, id) AS run_id,
 min_by(surface, id) AS surface, min_by(kind, id) AS kind, min_by(message, id) AS message FROM reports WHERE surface = 'error' GROUP BY dedup_hash)"""


def _errors(spark, sf_dir):
    return sink.record(adapters.errors(spark, sf_dir).filter("surface = 'error'"))


@query(f"WITH {_ERRORS} SELECT dedup_hash, id, first_ts, last_ts, count, run_id, surface, kind, message FROM errors")
def error_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir)


@query(f"WITH {_ERRORS} SELECT id, count FROM errors WHERE id > 2000 ORDER BY id LIMIT 200")
def error_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.since(_errors(spark, sf_dir), 2000).select("id", "count")


@query(f"WITH {_ERRORS} SELECT id, last_ts FROM errors ORDER BY last_ts DESC, id DESC LIMIT 20")
def error_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.last(_errors(spark, sf_dir), 20, "error").select("id", "last_ts")


@query(f"WITH {REPORTS} SELECT surface, max_by(id, struct_pack(ts := ts, id := id)) AS id, max(ts) AS ts FROM reports GROUP BY surface")
def error_last_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.latest_by(adapters.errors(spark, sf_dir).select("surface", "id", "ts"), "surface").select("surface", "id", "ts")


@query(f"WITH {_ERRORS} SELECT id FROM errors WHERE contains(lower(message), 'user 42') OR contains(lower(kind), 'user 42') ORDER BY last_ts DESC, id DESC LIMIT 50")
def error_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.find(_errors(spark, sf_dir), "USER 42", 50).select("id")


@query(f"WITH {_ERRORS} SELECT e.id AS error_id, r.id AS event_id, r.ts - e.last_ts AS gap_ms FROM errors e JOIN reports r ON abs(r.ts - e.last_ts) <= 30000 WHERE r.surface <> 'error'")
def error_correlated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.correlate(_errors(spark, sf_dir), adapters.errors(spark, sf_dir).filter("surface <> 'error'"))


@query(f"WITH {REPORTS}, y AS (SELECT id FROM reports WHERE ts >= (SELECT max(ts) FROM reports) - 10 * 86400000) SELECT id FROM y ORDER BY id DESC LIMIT 300")
def retention_newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.errors(spark, sf_dir)
    now = rows.agg(F.max("ts")).first()[0]
    return sink.retain(rows, now, 10 * sink.DAY, 300, "ts").select("id")


_RUNS = f"""{REPORTS}, runs AS (SELECT run_id, min(ts) AS started_at, max(id)::VARCHAR AS git_head, (count(*) % 2)::VARCHAR AS lockfile_hash, 'same' AS vite_dep_hash, 3000 AS port FROM reports GROUP BY run_id)"""


def _runs(spark, sf_dir):
    return adapters.errors(spark, sf_dir).groupBy("run_id").agg(F.min("ts").alias("started_at"), F.max("id").cast("string").alias("git_head"), (F.count("*") % 2).cast("string").alias("lockfile_hash"), F.lit("same").alias("vite_dep_hash"), F.lit(3000).alias("port"))


@query(f"""WITH {_RUNS}, l AS (SELECT *, lag(run_id) OVER w AS previous, lag(git_head) OVER w AS g, lag(lockfile_hash) OVER w AS h FROM runs WINDOW w AS (ORDER BY started_at, run_id))
SELECT run_id, previous, array_to_string(list_filter([CASE WHEN g <> git_head THEN 'git_head: ' || g || ' -> ' || git_head END, CASE WHEN h <> lockfile_hash THEN 'lockfile_hash: ' || h || ' -> ' || lockfile_hash END], lambda x: x IS NOT NULL), ';') AS changed
FROM l ORDER BY started_at DESC, run_id DESC LIMIT 1""")
def env_diff_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.env_diff(_runs(spark, sf_dir)).withColumn("changed", F.array_join("changed", ";"))


@query(f"WITH {REPORTS} SELECT max(ts) FILTER (surface = 'error') AS failed_at, max(ts) FILTER (surface = 'purchase') AS passed_at, max(ts) FILTER (surface = 'purchase') >= max(ts) FILTER (surface = 'error') AS passing FROM reports")
def test_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.errors(spark, sf_dir)
    failed = rows.filter("surface = 'error'").withColumnRenamed("ts", "last_ts")
    return sink.test_status(failed, rows.drop("kind").withColumn("kind", F.col("surface")), "error", "purchase")


@query(f"WITH {REPORTS} SELECT id, regexp_replace(message, '([^0-9A-Fa-f])[0-9]{{5,7}}($|[^\\p{{L}}\\p{{N}}])', '\\1<num>\\2', 'g') AS message FROM reports")
def normalize_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.errors(spark, sf_dir).select("id", fn.normalize_message(F.col("message")).alias("message"))


@query(f"WITH {REPORTS} SELECT id, {_HASH} AS dedup_hash FROM reports")
def dedup_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.errors(spark, sf_dir).select("id", fn.dedup_hash(F.col("surface"), F.col("kind"), F.col("message")).alias("dedup_hash"))


# Code graph ---------------------------------------------------------------------------------------------------------------

_IMPACT = f"""{SYMBOLS}, {EDGES}, s AS (SELECT id FROM symbols WHERE id IN (1, 2, 3)),
d1 AS (SELECT DISTINCT src AS id FROM edges JOIN s ON dst = s.id WHERE src NOT IN (FROM s)),
d2 AS (SELECT DISTINCT src AS id FROM edges JOIN d1 ON dst = d1.id WHERE src NOT IN (FROM s) AND src NOT IN (FROM d1)),
d3 AS (SELECT DISTINCT src AS id FROM edges JOIN d2 ON dst = d2.id WHERE src NOT IN (FROM s) AND src NOT IN (FROM d1) AND src NOT IN (FROM d2)),
reach AS (SELECT id, 1 AS depth FROM d1 UNION ALL SELECT id, 2 FROM d2 UNION ALL SELECT id, 3 FROM d3)"""


def _impact(spark, sf_dir):
    return graph.impact(adapters.edges(spark, sf_dir), adapters.symbols(spark, sf_dir).filter("id IN (1, 2, 3)").select("id"))


@query(f"WITH {_IMPACT} SELECT id, depth FROM reach")
def impact_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impact(spark, sf_dir).select("id", "depth")


@query(f"""WITH {_IMPACT}, c AS (SELECT count(*) FILTER (depth = 1) AS depth1, count(*) FILTER (depth = 2) AS depth2, count(*) FILTER (depth = 3) AS depth3, count(DISTINCT file_id) AS n_files FROM reach JOIN symbols USING (id))
SELECT *, 0::BIGINT AS n_processes, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][1 + least(3, CASE WHEN depth1 > 50 THEN 3 WHEN depth1 > 15 THEN 2 WHEN depth1 > 3 THEN 1 ELSE 0 END + 1)] AS risk FROM c""")
def impact_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact_summary(_impact(spark, sf_dir), adapters.symbols(spark, sf_dir).select("id", "file_id"), None, True)


@query(f"""WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges), r AS (SELECT 1::BIGINT AS id, 0 AS d UNION SELECT dst, d + 1 FROM r JOIN e ON src = id WHERE d < 6)
SELECT min(d) FILTER (id = 700) IS NOT NULL AS found, min(d) FILTER (id = 700) AS depth, CASE WHEN min(d) FILTER (id = 700) IS NULL THEN arg_min(id, struct_pack(d := -d, i := id)) FILTER (d > 0 AND d = least_d) END AS furthest
FROM (SELECT id, d, min(d) OVER (PARTITION BY id) AS least_d FROM r)""")
def trace_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trace(adapters.edges(spark, sf_dir), 1, 700, 6).select("found", "depth", "furthest")


_SYMBOL_FORMS = ["%s", "test_%s", "%s_test", "%s_tests", "Run%sTests", "it_%s", "spec_%s", "should_%s", "expect_%s", "mock_%s", "latest %s"]
_PATH_FORMS = ["src/f%s.rs", "tests/f%s.rs", "a/tests/f%s.rs", "latest/f%s.rs", "a/test/f%s.rs", "a/__tests__/f%s.ts", "benches/f%s.rs", "a/f%s.test.tsx", "a/f%s.spec.ts", "f%s_test.go", "a/test_%s.py", "fixtures/f%s.rs", "a/f%s.test.js"]
_NAMED = "SELECT id, " + ", ".join(
    "CASE " + " ".join(f"WHEN id % {len(forms)} = {i} THEN replace('{f}', '%s', {value})" for i, f in enumerate(forms)) + f" END AS {name}"
    for name, forms, value in (("name", _SYMBOL_FORMS, "name"), ("path", _PATH_FORMS, "file_id::VARCHAR"))
) + " FROM symbols"


def _form(forms: list[str], value):
    """Each symbol in one of the forms, by its id."""
    out = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        out = F.when(F.col("id") % len(forms) == i, F.replace(F.lit(f), F.lit("%s"), value)).otherwise(out)
    return out


@query(f"""WITH {SYMBOLS}, {EDGES}, o AS (SELECT src AS id, count(*) AS out_degree FROM edges GROUP BY src)
SELECT id, out_degree FROM o WHERE id NOT IN (SELECT dst FROM edges WHERE dst % 3 > 0) AND id IN (SELECT id FROM ({_NAMED}) WHERE NOT ({" OR ".join(f"name ILIKE '{p}'" for p in graph.TEST_NAMES)}) AND NOT ({" OR ".join(f"path ILIKE '{p}'" for p in graph.TEST_PATHS)}))""")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls into every third part don't count, as in the whole graph everything is called."""
    nodes = adapters.symbols(spark, sf_dir).select("id", _form(_SYMBOL_FORMS, F.col("name")).alias("name"), _form(_PATH_FORMS, F.col("file_id").cast("string")).alias("path"))
    edges = adapters.edges(spark, sf_dir)
    return graph.entry_points(edges.withColumn("dst", F.when(F.col("dst") % 3 > 0, F.col("dst"))), nodes)


@query(f"""WITH {SYMBOLS}, {EDGES}, seeds AS (SELECT id, row_number() OVER (ORDER BY id) AS pos FROM symbols WHERE id IN (1, 51, 101, 151)),
m AS (SELECT pos, 0 AS way, src AS other, seeds.id FROM seeds JOIN edges ON dst = seeds.id UNION SELECT pos, 1, dst, seeds.id FROM seeds JOIN edges ON src = seeds.id)
SELECT o.file_id, arg_min(CASE way WHEN 0 THEN 'calls ' ELSE 'called by ' END || s.name, struct_pack(pos := pos, way := way, other := other)) AS reason
FROM m JOIN symbols o ON o.id = m.other JOIN symbols s ON s.id = m.id WHERE o.file_id NOT IN (SELECT file_id FROM symbols JOIN seeds USING (id)) GROUP BY o.file_id""")
def neighbor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = adapters.symbols(spark, sf_dir)
    seeds = nodes.filter("id IN (1, 51, 101, 151)").select("id", F.row_number().over(Window.orderBy("id")).alias("pos"))
    return graph.neighbor_files(adapters.edges(spark, sf_dir), nodes, seeds)


def _calls(spark, sf_dir):
    """Calls, symbols and imports out of line items: names are few, so that they clash within files and between them."""
    sym = adapters.symbols(spark, sf_dir).select(F.col("id").alias("uid"), F.col("file_id").alias("file"), F.concat(F.lit("n"), (F.col("id") % 137).cast("string")).alias("name"), "kind", F.col("start").alias("start_line"))
    li = adapters.table(spark, sf_dir, "lineitem")
    file = F.col("l_suppkey") % 100
    calls = li.select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")) * 100 + file).alias("call_id"), file.alias("file"), F.concat(F.lit("n"), (F.col("l_partkey") % 300).cast("string")).alias("name"),
        F.when(F.col("l_linenumber") == 1, "self").when(F.col("l_linenumber") == 2, "obj").alias("receiver"), F.when(F.col("l_linenumber") != 5, file).alias("caller"),
    ).distinct()
    imports = adapters.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("file"), (F.col("o_orderkey") % 100).alias("target"), F.concat(F.lit("n"), (F.col("o_orderkey") % 137).cast("string")).alias("binding"))
    return calls, sym, imports


_CALLS = f"""{SYMBOLS}, sym AS (SELECT id AS uid, file_id AS file, 'n' || id % 137 AS name, kind, "start" AS start_line, CASE kind WHEN 'function' THEN 0 WHEN 'method' THEN 1 ELSE 2 END AS p FROM symbols),
calls AS (SELECT DISTINCT ((l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey) * 100 + l_suppkey % 100 AS call_id, l_suppkey % 100 AS file, 'n' || l_partkey % 300 AS name, CASE l_linenumber WHEN 1 THEN 'self' WHEN 2 THEN 'obj' END AS receiver, CASE WHEN l_linenumber <> 5 THEN l_suppkey % 100 END AS caller FROM lineitem),
imports AS (SELECT DISTINCT o_custkey % 100 AS file, o_orderkey % 100 AS target, 'n' || o_orderkey % 137 AS name FROM orders),
cand AS (SELECT c.call_id, c.receiver, s.uid, s.file, s.file = c.file AS own, EXISTS (FROM imports i WHERE i.file = c.file AND i.target = s.file AND i.name = c.name) AS imp, struct_pack(p := s.p, l := s.start_line, u := s.uid) AS o
         FROM calls c JOIN sym s ON c.name = s.name WHERE c.caller IS NOT NULL),
agg AS (SELECT call_id, receiver, arg_min(uid, o) FILTER (own) AS t0, count(DISTINCT file) FILTER (imp) AS n1, arg_min(uid, o) FILTER (imp) AS t1, count(DISTINCT file) AS n2, arg_min(uid, o) AS t2 FROM cand GROUP BY call_id, receiver),
resolved AS (SELECT call_id, CASE WHEN t0 IS NOT NULL THEN t0 WHEN n1 = 1 THEN t1 WHEN n1 > 1 THEN NULL WHEN n2 = 1 THEN t2 END AS dst,
 CASE WHEN (t0 IS NOT NULL OR n1 = 1) AND (receiver IS NULL OR receiver = 'self') THEN 'exact' ELSE 'probable' END AS tier FROM agg)"""


@query(f"WITH {_CALLS} SELECT call_id, dst, tier FROM resolved WHERE dst IS NOT NULL")
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve_calls(*_calls(spark, sf_dir))


@query(f"""WITH {_CALLS}, n AS (SELECT name, count(*) AS n FROM calls WHERE call_id NOT IN (SELECT call_id FROM resolved WHERE dst IS NOT NULL) GROUP BY name)
SELECT DISTINCT s.name, coalesce(n.n, 0) AS unresolved_same_name, coalesce(n.n, 0) > 0 AS lower_bound FROM sym s LEFT JOIN n USING (name)""")
def envelope_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, sym, imports = _calls(spark, sf_dir)
    return graph.envelope(graph.unresolved(calls, graph.resolve_calls(calls, sym, imports)), sym)


@query(f"""WITH {SYMBOLS}, p AS (SELECT o_orderkey AS point_id, o_custkey % 100 AS file_id, o_orderkey % 550 AS line FROM orders)
SELECT point_id, arg_min(id, struct_pack(s := "end" - "start", i := id)) AS id FROM p JOIN symbols USING (file_id) WHERE line BETWEEN "start" AND "end" GROUP BY point_id""")
def smallest_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_custkey") % 100).alias("file_id"), (F.col("o_orderkey") % 550).alias("line"))
    return graph.smallest_enclosing(points, adapters.symbols(spark, sf_dir).select("file_id", "start", "end", "id"))


_HUNKS = """hunks AS (SELECT o_orderkey AS hunk_id, o_custkey % 100 AS file_id, o_orderkey % 500 AS a, o_orderkey % 500 + o_custkey % 9 AS b FROM orders)"""


def _hunks(spark, sf_dir):
    a = F.col("o_orderkey") % 500
    return adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hunk_id"), (F.col("o_custkey") % 100).alias("file_id"), a.alias("a"), (a + F.col("o_custkey") % 9).alias("b"))


@query(f'WITH {SYMBOLS}, {_HUNKS} SELECT DISTINCT hunk_id, id FROM hunks JOIN symbols USING (file_id) WHERE a <= "end" AND "start" <= b')
def hunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.overlapping(_hunks(spark, sf_dir), adapters.symbols(spark, sf_dir).select("file_id", "start", "end", "id"))


# Walks go node by node in the order they were met, as a queue; w has a row for each node that a walk has gone on from.
_PROCESSES = """g AS MATERIALIZED (SELECT src, list(dst ORDER BY late, dst) AS near FROM (SELECT src, dst, min((tier <> 'exact')::INT) AS late FROM edges GROUP BY src, dst) GROUP BY src),
top AS MATERIALIZED (SELECT src AS entry, count(*) AS out_degree FROM edges GROUP BY src ORDER BY out_degree DESC, entry LIMIT 80),
w AS (SELECT entry, out_degree, [entry] AS steps, [0] AS depths, 1 AS i FROM top UNION ALL
 SELECT entry, out_degree, list_concat(steps, n), list_concat(depths, list_transform(n, lambda x: d + 1)), i + 1
 FROM (SELECT w.*, depths[i] AS d, coalesce(list_filter(near, lambda x: NOT list_contains(steps, x))[1:3], []) AS n FROM w LEFT JOIN g ON g.src = steps[i] WHERE i <= len(steps) AND depths[i] < 6)),
walks AS (SELECT entry, out_degree, arg_max(steps, i) AS steps FROM w GROUP BY entry, out_degree),
firsts AS (SELECT *, row_number() OVER (PARTITION BY list_sort(steps) ORDER BY out_degree DESC, entry) AS r FROM walks WHERE len(steps) >= 3),
processes AS (SELECT entry AS process_id, unnest(steps) AS id FROM (SELECT * FROM firsts WHERE r = 1 ORDER BY out_degree DESC, entry LIMIT 20))"""


@query(f"""WITH RECURSIVE {SYMBOLS}, {EDGES}, {_HUNKS}, c AS (SELECT DISTINCT id FROM hunks JOIN symbols USING (file_id) WHERE a <= "end" AND "start" <= b),
u AS (SELECT DISTINCT src FROM edges WHERE dst IN (FROM c) AND src NOT IN (FROM c)), {_PROCESSES}, n AS (SELECT (SELECT count(*) FROM c) AS n_symbols, (SELECT count(*) FROM u) AS n_callers, (SELECT count(DISTINCT process_id) FROM processes WHERE id IN (FROM c) OR id IN (FROM u)) AS n_processes)
SELECT *, CASE WHEN n_callers > 50 OR n_processes > 20 THEN 'CRITICAL' WHEN n_callers > 15 OR n_processes > 8 THEN 'HIGH' WHEN n_callers > 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM n""")
def change_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The impact of all hunks as one change, on the processes of processes_bfs."""
    spans, edges = adapters.symbols(spark, sf_dir).select("file_id", "start", "end", "id"), kept(adapters.edges(spark, sf_dir), "edges")
    return graph.change_impact(_hunks(spark, sf_dir), spans, edges, _processes(edges).select("process_id", "id"))


def _processes(edges):
    return graph.processes(edges, edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree")), most=20)


@query()
def processes_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _processes(kept(adapters.edges(spark, sf_dir), "edges"))


def _islands(spark, sf_dir):
    """Edges within blocks of 50 parts, so that there are many components."""
    return adapters.edges(spark, sf_dir).withColumn("dst", F.floor(F.col("src") / 50) * 50 + F.col("dst") % 50).filter("src <> dst")


@query()
def clusters_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_propagation(_islands(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES}, i AS (SELECT DISTINCT src, src // 50 * 50 + dst % 50 AS dst FROM edges), b AS (SELECT src, dst FROM i WHERE src <> dst UNION SELECT dst, src FROM i WHERE src <> dst),
r AS (SELECT DISTINCT src AS id, src AS far FROM b UNION SELECT r.id, b.dst FROM r JOIN b ON r.far = b.src) SELECT id, min(far) AS root FROM r GROUP BY id""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected(_islands(spark, sf_dir))


_IDENT = "list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g')), '[\\s_\\-.:#]+'), lambda w: w <> '')"


@query(f"SELECT p_partkey AS id, array_to_string({_IDENT.format('p_name')}, ' ') AS words FROM part")
def ident_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(fn.ident_words(F.col("p_name")), " ").alias("words"))


@query(f"""WITH w AS (SELECT p_brand AS brand, unnest({_IDENT.format('p_name || p_type')}) AS word FROM part), n AS (SELECT brand, word, count(*) AS n FROM w WHERE length(word) >= 2 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, word) AS r FROM n) SELECT brand, string_agg(word, ',' ORDER BY r) AS keywords FROM r WHERE r <= 5 GROUP BY brand""")
def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.keywords(adapters.table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.concat("p_name", "p_type").alias("name")), ["brand"])


@query("""WITH n AS (SELECT l_suppkey % 50 AS key, left(l_shipdate::DATE::VARCHAR, 7) AS dir, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT key, arg_min(dir, struct_pack(n := -n, d := dir)) AS dir FROM n GROUP BY key""")
def dominant_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("key"), F.date_format("l_shipdate", "yyyy-MM").alias("dir"))
    return graph.top_value(rows, ["key"], "dir")


@query("""WITH c AS (SELECT o_custkey AS id, count(*) AS d1, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_custkey)
SELECT id, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][1 + least(3, CASE WHEN d1 > 50 OR p > 20 THEN 3 WHEN d1 > 15 OR p > 8 THEN 2 WHEN d1 > 3 THEN 1 ELSE 0 END + (id % 2 = 0)::INT)] AS risk FROM c""")
def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("d1"), F.countDistinct("o_orderpriority").alias("p"))
    return c.select("id", graph.risk(F.col("d1"), F.col("p"), F.col("id") % 2 == 0).alias("risk"))


# Targets ------------------------------------------------------------------------------------------------------------------

_KEYWORDS = ["src3", "fr", "thing"]
_FILENAME = f"""{FILES}, s1 AS (SELECT path, score, row_number() OVER (ORDER BY score DESC, path) - 1 AS rank FROM (
 SELECT path, (string_split(path, '/')[1] IN {tuple(_KEYWORDS)})::INT + (string_split(path, '/')[2] IN {tuple(_KEYWORDS)})::INT AS score FROM files) WHERE score > 0)"""


@query(f"WITH {_FILENAME} SELECT path, score, rank FROM s1")
def filename_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.filename_rank(adapters.files(spark, sf_dir), _KEYWORDS)


_CONTENT = f"""{LINES}, k AS (SELECT unnest({_KEYWORDS}) AS kw), h AS (SELECT path, kw, row_number() OVER (PARTITION BY kw ORDER BY path, line) AS r FROM lines JOIN k ON contains(lower(text), kw)),
per AS (SELECT path, kw, least(count(*), 50) AS n FROM h WHERE r <= 500 GROUP BY ALL),
s3 AS (SELECT path, n_keywords, total, row_number() OVER (ORDER BY n_keywords DESC, total DESC, path) - 1 AS rank FROM (SELECT path, count(*) AS n_keywords, sum(n)::BIGINT AS total FROM per GROUP BY path))"""


def _lines(spark, sf_dir):
    return adapters.files(spark, sf_dir).select("path", F.posexplode(fn.lines(F.col("content"))).alias("line", "text"))


@query(f"WITH {_CONTENT} SELECT path, n_keywords, total, rank FROM s3")
def content_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.content_rank(_lines(spark, sf_dir), _KEYWORDS)


_GRAPH = f"s4 AS (SELECT path, row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS rank FROM (SELECT vec_id, {_DOT} AS s FROM embeddings e, {_Q} ORDER BY s DESC, vec_id LIMIT 40) JOIN files ON doc_id = vec_id)"
_FUSE = f"""{_CONTENT}, {_FILENAME[len(FILES) + 2:]}, {_GRAPH}, parts AS (SELECT path, 3.0::DOUBLE / (61 + rank) AS p, 1 AS f FROM s1 UNION ALL SELECT path, 1.5::DOUBLE / (61 + rank), 4 FROM s3 UNION ALL SELECT path, 1.0::DOUBLE / (61 + rank), 8 FROM s4),
fused AS (SELECT path, sum(p) AS score, bit_or(f) AS families FROM parts GROUP BY path)"""


def _channels(spark, sf_dir):
    files = adapters.files(spark, sf_dir)
    top = recall.knn(adapters.table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 40, id_="vec_id")
    near = recall.ranked(top.join(files.select("path", F.col("doc_id").alias("vec_id")), "vec_id"), [F.desc("score"), "vec_id"]).select("path", "rank")
    return {"filename": targets.filename_rank(files, _KEYWORDS), "content": targets.content_rank(_lines(spark, sf_dir), _KEYWORDS), "graph": near}


@query(f"WITH {_FUSE} SELECT path, round(score, 6) AS score, families FROM fused")
def rrf_three_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.fuse(_channels(spark, sf_dir)).select("path", F.round("score", 6).alias("score"), "families")


@query(f"""WITH {_FUSE}, kinds AS (SELECT *, CASE WHEN families & 7 <> 0 AND bit_count(families) >= 2 AND families & 3 <> 0 THEN 0 WHEN families & 7 <> 0 THEN 1 ELSE 2 END AS kind FROM fused),
n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, path) AS n FROM kinds), t AS (SELECT *, CASE WHEN kind = 0 AND n <= 5 THEN 'P0' WHEN kind < 2 THEN 'P1' WHEN n <= 10 THEN 'P2' END AS tier FROM n)
SELECT path, tier, round(score, 6) AS score FROM t WHERE tier IS NOT NULL ORDER BY t.score DESC, path LIMIT 40""")
def targets_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.tiers(targets.fuse(_channels(spark, sf_dir)), 40)


# Rescue -------------------------------------------------------------------------------------------------------------------

_VERSIONS = """v AS (SELECT o_custkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS idx, 'c' || o_orderkey AS oid,
 floor(o_totalprice / 100000)::BIGINT::VARCHAR AS blob, contains(lower(o_orderpriority), 'urgent') AS suspect FROM orders)"""


def _versions(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders")
    idx = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))) - 1
    rows = o.select(F.col("o_custkey").alias("path"), idx.alias("idx"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("oid"), F.floor(F.col("o_totalprice") / 100000).cast("string").alias("blob"), F.col("o_orderpriority").alias("subject"))
    return rescue.flag_suspects(rows, ["URGENT"])


@query(f"""WITH {_VERSIONS}, s AS (SELECT path, max(idx) FILTER (suspect) AS oldest, arg_min(blob, idx) AS head FROM v GROUP BY path),
b AS (SELECT path, max(oid) FILTER (idx = oldest + 1) AS before, arg_min(oid, idx) FILTER (blob <> head) AS other FROM v JOIN s USING (path) GROUP BY path)
SELECT path, coalesce(before, other) AS oid FROM b""")
def last_good_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescue.recommend(_versions(spark, sf_dir)).select("path", "oid")


@query(f"WITH {_VERSIONS}, s AS (SELECT path, arg_min(blob, idx) AS head FROM v GROUP BY path) SELECT path, arg_min(oid, idx) FILTER (blob <> head) AS oid FROM v JOIN s USING (path) GROUP BY path")
def first_differing_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescue.recommend(_versions(spark, sf_dir).withColumn("suspect", F.lit(False))).select("path", "oid")

