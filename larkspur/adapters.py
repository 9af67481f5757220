"""The driver's tables as the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, content: documents as files source/lang/doc_id."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.col("text").alias("content"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turn_id, session_id, seq, role, text: conversations; turn ids order turns by session and place."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, agent, cwd, ts_first, ts_last: an invented but fixed place and time for each conversation."""
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turn_count"))
    start = F.col("conv_id") * 60
    return s.select(
        F.col("conv_id").alias("session_id"),
        F.concat(F.lit("agent"), (F.col("conv_id") % 3).cast("string")).alias("agent"),
        F.concat(F.lit("/work/repo"), (F.col("conv_id") % 12).cast("string")).alias("cwd"),
        start.alias("ts_first"), (start + F.col("turn_count") * 10).alias("ts_last"), "turn_count",
        (F.col("conv_id") % 5 == 0).alias("is_subagent"),
    )


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts (ms), surface, kind, message, run_id: events as reports; those of type error are the errors."""
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("id"), ms.alias("ts"), F.col("event_type").alias("surface"), F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string")).alias("kind"),
        F.concat(F.lit("failed on "), F.col("props"), F.lit(" for user "), F.col("user_id").cast("string")).alias("message"),
        F.date_format(F.col("ts"), "yyyy-MM-dd").alias("run_id"), "value",
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, file_id, start, end: parts as symbols, dealt to 100 files; sizes give spans."""
    p = table(spark, sf_dir, "part")
    start = (F.col("p_partkey") * 7 % 500).cast("int")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 100).alias("file_id"),
        F.when(F.col("p_size") % 4 == 0, "class").when(F.col("p_size") % 4 == 1, "method").otherwise("function").alias("kind"),
        start.alias("start"), (start + F.col("p_size")).alias("end"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, kind, tier, site_line: a call graph over parts, from all line items.

    A part calls the part of the next line of its order; the return flag gives the tier."""
    li = table(spark, sf_dir, "lineitem")
    a, b = li.alias("a"), li.alias("b")
    on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1)
    calls = a.join(b, on).select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst"), F.col("a.l_returnflag").alias("flag"), F.col("a.l_linenumber").alias("site_line"))
    tier = F.when(F.col("flag") == "N", "exact").otherwise("probable")
    return calls.filter("src <> dst").select("src", "dst", F.lit("calls").alias("kind"), tier.alias("tier"), "site_line")
