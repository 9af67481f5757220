"""Streaming operators run over what the tables hold now, with the SQL that gives the same rows in one batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import adapters
from larkspur.queries import REPORTS, _HASH
from larkspur.streaming import errors as stream


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of reports, oldest file first."""
    schema = adapters.table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    return e.select(
        F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("surface"),
        F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string")).alias("kind"),
        F.concat(F.lit("failed on "), F.col("props"), F.lit(" for user "), F.col("user_id").cast("string")).alias("message"),
    )


def _name(query: str) -> str:
    return f"{query}_{uuid.uuid4().hex}"


def stream_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream.run_to_table(stream.dedup_counts(_reports(spark, sf_dir)), _name("dedup"), "update")
    return out.groupBy("dedup_hash").agg(F.max(F.struct("count", "id", "last_ts")).alias("r")).select("dedup_hash", "r.count", "r.id", "r.last_ts")


def stream_windowed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream.run_to_table(stream.windowed(_reports(spark, sf_dir), "1 day"), _name("windows"), "complete")
    return out.select(F.unix_millis("start").alias("start"), "surface", "n")


def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a kind's reports at most a minute apart; the last report of a burst counts."""
    changes = _reports(spark, sf_dir).select(F.col("kind").alias("path"), (F.col("surface") == "error").alias("removed"), "ts")
    out = stream.run_to_table(stream.debounce(changes, "1 minute"), _name("bursts"), "complete")
    return out.select("path", F.unix_millis("start").alias("start"), "n")


QUERIES = {f.__name__: f for f in (stream_dedup_counts, stream_windowed_errors, stream_debounce)}
ORACLE_SQL = {
    "stream_dedup_counts": f"WITH {REPORTS} SELECT {_HASH} AS dedup_hash, count(*) AS count, min(id) AS id, max(ts) AS last_ts FROM reports GROUP BY dedup_hash",
    "stream_windowed_errors": f"WITH {REPORTS} SELECT ts // 86400000 * 86400000 AS start, surface, count(*) AS n FROM reports GROUP BY ALL",
    "stream_debounce": f"""WITH {REPORTS}, g AS (SELECT kind AS path, ts, (ts - lag(ts) OVER (PARTITION BY kind ORDER BY ts, id) >= 60000)::INT AS new, id FROM reports),
s AS (SELECT path, ts, sum(coalesce(new, 0)) OVER (PARTITION BY path ORDER BY ts, id) AS k FROM g) SELECT path, min(ts) AS start, count(*) AS n FROM s GROUP BY path, k""",
}
