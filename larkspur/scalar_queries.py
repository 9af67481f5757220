"""The catalogue's queries on scalar functions and small operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import adapters
from larkspur.functions import text as fn
from larkspur.functions import vectors
from larkspur.operators import graph, recall
from larkspur.queries import EDGES, FILES, REPORTS, SESSIONS, TURNS, query


@query(f"WITH {FILES} SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files")
def path_dirname(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.files(spark, sf_dir).select("path", fn.dirname(F.col("path")).alias("dir"))


@query(f"WITH {FILES} SELECT path, source || '/' || doc_id AS normal FROM files JOIN documents USING (doc_id)")
def path_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """./source//lang/../doc_id is source/doc_id."""
    f = adapters.table(spark, sf_dir, "documents")
    twisted = F.concat(F.lit("./"), "source", F.lit("//"), "lang", F.lit("/../"), F.col("doc_id").cast("string"))
    return f.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), fn.normalize_path(twisted).alias("normal"))


@query(f"WITH {TURNS} SELECT turn_id, left(text, 40) AS text, length(text) > 40 AS truncated FROM turns")
def cap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.turns(spark, sf_dir).select("turn_id", fn.cap(F.col("text"), 40).alias("c")).select("turn_id", "c.text", "c.truncated")


@query(f"WITH {TURNS} SELECT turn_id, ceil(octet_length(encode(text)) / 4.0)::BIGINT AS tokens FROM turns")
def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.turns(spark, sf_dir).select("turn_id", fn.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"WITH {REPORTS} SELECT id, strftime(make_timestamp(ts * 1000), '%Y-%m-%d %H:%M') AS stamp FROM reports")
def format_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.errors(spark, sf_dir).select("id", fn.format_ms(F.col("ts")).alias("stamp"))


@query("""WITH a AS (SELECT event_id AS id, event_id * event_id * 37 // 1000 AS s FROM events)
SELECT id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' ELSE s // 86400 || 'd' END AS age FROM a""")
def age_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return adapters.table(spark, sf_dir, "events").select(i.alias("id"), fn.age(i * i * 37).alias("age"))


@query(f"WITH {SESSIONS} SELECT session_id, regexp_extract(cwd, '([^/]*)$', 1) || '-' || left(sha256(cwd), 12) AS key FROM sessions")
def project_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.sessions(spark, sf_dir).select("session_id", fn.project_key(F.col("cwd")).alias("key"))


@query(f"WITH {TURNS}, {SESSIONS} SELECT turn_id, '[' || agent || '] [' || regexp_extract(cwd, '([^/]*)$', 1) || '] ' || role || ': ' || left(text, 30) AS header FROM turns JOIN sessions USING (session_id)")
def embed_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.turns(spark, sf_dir).join(adapters.sessions(spark, sf_dir), "session_id")
    return rows.select("turn_id", fn.embed_header(F.col("agent"), F.col("cwd"), F.col("role"), F.left("text", F.lit(30))).alias("header"))


@query("SELECT o_custkey AS id, round(greatest(0.1, ln(50000.0 / (1 + count(*)))), 9) AS weight FROM orders GROUP BY o_custkey")
def word_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = adapters.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return n.select("id", F.round(fn.word_weight(F.col("n")), 9).alias("weight"))


@query("SELECT p_partkey AS id, list_filter(string_split(p_name || '.' || p_brand, '.'), lambda w: true) AS chain FROM part")
def evaluating_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("x is not a function (evaluating '"), "p_name", F.lit("."), "p_brand", F.lit("') at y"))
    return adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), fn.evaluating_chain(message).alias("chain"))


@query(f"WITH {FILES}, e AS (SELECT path, ['ts', 'rs', 'py', 'GO', 'java', 'mjs', 'txt', 'tsx'][1 + doc_id % 8] AS ext FROM files) SELECT path, CASE lower(ext) WHEN 'ts' THEN 'ts' WHEN 'tsx' THEN 'tsx' WHEN 'mjs' THEN 'js' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'py' THEN 'python' END AS lang FROM e")
def language_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in ("ts", "rs", "py", "GO", "java", "mjs", "txt", "tsx")]), (F.col("doc_id") % 8 + 1).cast("int"))
    return adapters.files(spark, sf_dir).select("path", fn.lang_of(F.concat("path", F.lit("."), ext)).alias("lang"))


@query(f"WITH {TURNS} SELECT turn_id, row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) - 1 AS seq FROM turns")
def turn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.turns(spark, sf_dir).drop("seq").withColumn("at", -F.col("turn_id"))
    return recall.number_turns(rows, "at").select("turn_id", "seq")


@query(f"WITH {TURNS}, k AS (SELECT session_id, max(seq) + 1 AS base FROM turns WHERE seq < 2 GROUP BY session_id) SELECT turn_id, coalesce(base, 0) + row_number() OVER (PARTITION BY session_id ORDER BY turn_id) - 1 AS seq FROM turns LEFT JOIN k USING (session_id) WHERE turns.seq >= 2")
def next_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns from the third on, appended to the first two."""
    rows = adapters.turns(spark, sf_dir)
    return recall.append_turns(rows.filter("seq < 2"), rows.filter("seq >= 2").drop("seq"), "turn_id").select("turn_id", "seq")


@query(f"WITH {EDGES}, d AS (SELECT DISTINCT dst AS id, site_line AS depth FROM edges) SELECT id, depth FROM (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY id) AS r FROM d) WHERE r <= 7")
def top_per_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.edges(spark, sf_dir).select(F.col("dst").alias("id"), F.col("site_line").alias("depth")).distinct()
    return graph.top_per_depth(rows, 7)


_SCALED = "list_transform(e.embedding, lambda x: greatest(-127, least(127, round(x::DOUBLE / e.scale)))::DOUBLE)"


@query(f"""WITH e AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS scale FROM embeddings), q AS (SELECT embedding FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(e.scale * list_sum(list_transform(list_zip({_SCALED}, q.embedding), lambda p: p[1] * p[2]::DOUBLE)), 5) AS score FROM e, q""")
def quantized_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.table(spark, sf_dir, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.filter("vec_id = 0").first()["embedding"]])
    return e.select("vec_id", F.round(vectors.quantized_dot(q, vectors.quantize(F.col("embedding"))), 5).alias("score"))


@query(f"""WITH {FILES}, k AS (SELECT unnest(string_split_regex(lower('fix the `login_user` in the Auth flow, please add file retries'), '[^a-z0-9_]+')) AS word)
SELECT DISTINCT word FROM k WHERE length(word) >= 3 AND word NOT IN ({", ".join(f"'{w}'" for w in fn.TASK_STOP_WORDS)})""")
def task_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, words = fn.tokenize_task("fix the `login_user` in the Auth flow, please add file retries")
    return spark.createDataFrame([(w,) for w in words], "word string")
