"""The error log: deduplicated errors, events and runs; queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as fn

SINCE_LIMIT, WINDOW_MS = 200, 30_000
DAY = 86_400_000
KEEP_ERRORS, KEEP_EVENTS, ERROR_AGE, EVENT_AGE = 5_000, 20_000, 7 * DAY, 3 * DAY
#: Kinds of events that say whether an edit was applied.
HMR_KINDS = ["hmr-update", "full-reload", "dep-optimized", "server-start"]
RUN_FIELDS = ["git_head", "lockfile_hash", "vite_dep_hash", "port"]


def record(reports: DataFrame, by_event_time: bool = False) -> DataFrame:
    """id, first_ts, last_ts, count, run_id, surface, kind, message, dedup_hash: reports with equal hashes as one error.

    The first report gives id and content; the last to arrive gives last_ts and run_id, or with by_event_time, the latest."""
    frames = F.col("frames") if "frames" in reports.columns else None
    hashed = reports.withColumn("dedup_hash", fn.dedup_hash(F.col("surface"), F.col("kind"), F.col("message"), frames))
    latest = F.struct("ts", "id") if by_event_time else F.col("id")
    return hashed.groupBy("dedup_hash").agg(
        F.min("id").alias("id"), F.min_by("ts", "id").alias("first_ts"), F.max_by("ts", latest).alias("last_ts"), F.count("*").alias("count"),
        F.max_by("run_id", latest).alias("run_id"), F.min_by("surface", "id").alias("surface"), F.min_by("kind", "id").alias("kind"), F.min_by("message", "id").alias("message"),
    )


def last(errors: DataFrame, n: int, surface: str | None = None) -> DataFrame:
    rows = errors if surface is None else errors.filter(F.col("surface") == surface)
    return rows.orderBy(F.desc("last_ts"), F.desc("id")).limit(n)


def since(errors: DataFrame, cursor: int, limit: int = SINCE_LIMIT) -> DataFrame:
    """Errors first seen after the cursor, in order; a repeat of an older error is not among them."""
    return errors.filter(F.col("id") > cursor).orderBy("id").limit(limit)


def since_ts(errors: DataFrame, ts: int, limit: int = SINCE_LIMIT) -> DataFrame:
    return errors.filter(F.col("last_ts") >= ts).orderBy("last_ts", "id").limit(limit)


def cursor(errors: DataFrame) -> DataFrame:
    return errors.agg(F.coalesce(F.max("id"), F.lit(0)).alias("cursor"))


def find(errors: DataFrame, needle: str, limit: int, columns: list[str] | None = None) -> DataFrame:
    """Errors that hold the text, whatever its case, in any of the columns; newest first."""
    held = F.lit(False)
    for c in columns or [c for c in ("message", "kind", "stack_raw", "extra") if c in errors.columns]:
        held = held | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(needle.lower())), F.lit(False))
    return errors.filter(held).orderBy(F.desc("last_ts"), F.desc("id")).limit(limit)


def correlate(errors: DataFrame, events: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Pairs (error_id, event_id, gap_ms) of errors and events at most window_ms apart.

    A band join: both sides fall into slots of the window's width, an error into its neighbours' too, so the join is one
    on equality; what meets in a slot is then compared."""
    slot = lambda ts: F.floor(ts / window_ms)
    e = errors.select(F.col("id").alias("error_id"), F.col("last_ts").alias("at"))
    e = e.withColumn("slot", F.explode(F.sequence(slot(F.col("at")) - 1, slot(F.col("at")) + 1)))
    v = events.select(F.col("id").alias("event_id"), F.col("ts").alias("ts"), slot(F.col("ts")).alias("slot"))
    pairs = e.join(v, "slot").withColumn("gap_ms", F.col("ts") - F.col("at"))
    return pairs.filter(F.abs("gap_ms") <= window_ms).select("error_id", "event_id", "gap_ms")


def run_of(errors: DataFrame, runs: DataFrame) -> DataFrame:
    """error id, run_id: the error's own run if it is one of the two newest, else the newest."""
    newest = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(2).select("run_id", "started_at")
    top = newest.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("newest"))
    own = errors.select("id", F.col("run_id").alias("own")).join(F.broadcast(newest.select(F.col("run_id").alias("r"))), F.col("own") == F.col("r"), "left")
    return own.crossJoin(F.broadcast(top)).select("id", F.coalesce("r", "newest").alias("run_id"))


def show(errors: DataFrame, events: DataFrame, runs: DataFrame, error_id: int) -> dict[str, DataFrame]:
    """The error, the events around its last report, and its run."""
    one = errors.filter(F.col("id") == error_id)
    near = correlate(one, events).select(F.col("event_id").alias("id"))
    return {"error": one, "events": events.join(near, "id", "left_semi").orderBy("ts", "id"), "run": run_of(one, runs).join(runs, "run_id")}


def hmr(events: DataFrame, file: str | None = None, read: int = 50, keep: int = 20) -> DataFrame:
    """The last events about applied edits; with a file, updates that don't touch it are left out."""
    rows = events.filter(F.col("kind").isin(HMR_KINDS)).orderBy(F.desc("ts"), F.desc("id")).limit(read)
    if file is not None:
        files = F.from_json(F.to_json("data") if dict(events.dtypes)["data"] != "string" else F.col("data"), "files array<string>")["files"]
        rows = rows.filter((F.col("kind") != "hmr-update") | F.coalesce(F.exists(files, lambda f: F.contains(f, F.lit(file))), F.lit(False)))
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(keep)


def env_diff(runs: DataFrame, fields: list[str] = RUN_FIELDS) -> DataFrame:
    """run_id, previous, changed: the newest run against the one before it, field by field."""
    order = Window.orderBy("started_at", "run_id")
    newest = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(2)
    held = newest.withColumn("before", F.lag(F.struct("run_id", *fields)).over(order)).orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    differs = [F.when(F.col("before").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"before.{f}")), F.concat(F.lit(f"{f}: "), text(F.col(f"before.{f}")), F.lit(" -> "), text(F.col(f)))) for f in fields]
    return held.select("run_id", F.col("before.run_id").alias("previous"), F.array_compact(F.array(*differs)).alias("changed"))


def test_status(errors: DataFrame, events: DataFrame, surface: str = "vitest", passed: str = "test-pass") -> DataFrame:
    """passing: whether the last pass is no older than the last failure; null without either."""
    fail = errors.filter(F.col("surface") == surface).agg(F.max("last_ts").alias("failed_at"))
    good = events.filter(F.col("kind") == passed).agg(F.max("ts").alias("passed_at"))
    return fail.crossJoin(good).select(
        "failed_at", "passed_at",
        F.when(F.col("failed_at").isNull() & F.col("passed_at").isNull(), None).when(F.col("failed_at").isNull(), True).when(F.col("passed_at").isNull(), False).otherwise(F.col("passed_at") >= F.col("failed_at")).alias("passing"),
    )


def retain(rows: DataFrame, now_ms: int, age_ms: int, newest: int, ts: str) -> DataFrame:
    """Rows that are young enough and among the newest by id. The threshold is the newest-th id, found by a top-k."""
    young = rows.filter(F.col(ts) >= now_ms - age_ms)
    floor = young.select("id").orderBy(F.desc("id")).limit(newest).agg(F.min("id").alias("least"))
    return young.join(F.broadcast(floor), F.col("id") >= F.col("least")).drop("least")


def retain_errors(errors: DataFrame, now_ms: int) -> DataFrame:
    return retain(errors, now_ms, ERROR_AGE, KEEP_ERRORS, "last_ts")


def retain_events(events: DataFrame, now_ms: int) -> DataFrame:
    return retain(events, now_ms, EVENT_AGE, KEEP_EVENTS, "ts")


def latest_by(rows: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The newest row of each key."""
    at = F.struct(*[F.col(c) for c in (ts, "id")], F.struct(*[c for c in rows.columns if c != key]).alias("row"))
    return rows.groupBy(key).agg(F.max(at).alias("m")).select(key, "m.row.*")


def duplicates(frames: Column) -> Column:
    """Packages of a stack that lie at more than one path."""
    return F.filter(F.transform(frames, lambda f: f["pkg"]), lambda p: F.size(p["dup_paths"]) > 1)


def diagnostics(lines: DataFrame) -> DataFrame:
    """file, line, column, code, message of compiler output (text); other lines are dropped."""
    part = lambda i: F.regexp_extract("text", fn.DIAGNOSTIC, i)
    hit = lines.filter(F.regexp_like("text", F.lit(fn.DIAGNOSTIC)))
    return hit.select(part(1).alias("file"), part(2).cast("int").alias("line"), part(3).cast("int").alias("column"), part(4).alias("code"), part(5).alias("message"))


def diagnostic_groups(rows: DataFrame, most: int = 50) -> DataFrame:
    """code, n, places: diagnostics by code, with the first places in order."""
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("file", "line", "column")))
    place = F.when(F.col("r") <= most, F.struct("r", F.concat_ws(":", "file", F.col("line").cast("string")).alias("place")))
    return ranked.groupBy("code").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(place)), lambda x: x["place"]).alias("places"))


def diagnostic_summary(rows: DataFrame) -> DataFrame:
    n, files = F.count("*"), F.countDistinct("file")
    return rows.agg(F.concat(n.cast("string"), F.when(n == 1, " error in ").otherwise(" errors in "), files.cast("string"), F.when(files == 1, " file").otherwise(" files")).alias("summary"))
