"""Reports of errors, events and runs, compiler output and stack traces, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur import schemas
from larkspur.functions import text as fn

_BODY = (
    f"ts BIGINT, surface STRING, kind STRING, message STRING, stack STRING, frames ARRAY<{schemas.FRAME}>, runId STRING, data STRING, "
    "values MAP<STRING, STRING>, startedAt BIGINT, gitHead STRING, lockfileHash STRING, viteDepHash STRING, port INT"
)


def envelopes(lines: DataFrame) -> dict[str, DataFrame]:
    """errors, events, runs and rejected of JSON lines (text); the type is error unless given; an unknown type or surface, or
    what isn't JSON, is rejected with a reason."""
    parsed = lines.select("text", F.from_json("text", f"type STRING, {_BODY}").alias("r")).withColumn("kind", F.coalesce("r.type", F.lit("error")))
    known = F.coalesce(F.col("r.surface"), F.lit("reported")).isin(schemas.SURFACES + ["vite", "vitest", "tsc", "browser"])
    reason = (
        F.when(F.get_json_object("text", "$").isNull(), "not JSON")
        .when(~F.col("kind").isin("error", "event", "run"), "unknown type")
        .when((F.col("kind") == "error") & ~known, "unknown surface")
        .when((F.col("kind") == "error") & F.col("r.message").isNull(), "no message")
    )
    rows = parsed.withColumn("reason", reason)
    good = lambda kind: rows.filter(F.col("reason").isNull() & (F.col("kind") == kind))
    return {
        "errors": good("error").select("r.ts", F.coalesce("r.surface", F.lit("reported")).alias("surface"), F.col("r.kind").alias("kind"), "r.message", F.col("r.stack").alias("stack_raw"), F.coalesce("r.frames", parse_stack(F.col("r.stack"))).alias("frames"), F.col("r.runId").alias("run_id"), "r.values"),
        "events": good("event").select("r.ts", F.col("r.kind").alias("kind"), F.col("r.runId").alias("run_id"), F.col("r.data").alias("data")),
        "runs": good("run").select(F.col("r.runId").alias("run_id"), F.col("r.startedAt").alias("started_at"), F.col("r.gitHead").alias("git_head"), F.col("r.lockfileHash").alias("lockfile_hash"), F.col("r.viteDepHash").alias("vite_dep_hash"), F.col("r.port").alias("port")),
        "rejected": rows.filter("reason IS NOT NULL").select("text", "reason"),
    }


# The forms of a frame in stack traces of two engines.
_NAMED = r"^\s*at (?:async )?(.+?) \((.+?):(\d+):(\d+)\)\s*$"
_BARE = r"^\s*at (?:async )?([^()\s]+?):(\d+):(\d+)\s*$"
_OTHER = r"^\s*([^@\s]*)@(.+?):(\d+):(\d+)\s*$"


def parse_stack(stack: Column) -> Column:
    """The frames of a stack trace; lines that are none are dropped; null without any."""

    def frame(line: Column) -> Column:
        def of(pattern: str, func: int | None, file: int) -> Column:
            part = lambda i: F.regexp_extract(line, pattern, i)
            name = F.nullif(part(func), F.lit("")) if func else F.lit(None)
            return F.struct(
                F.trim(line).alias("raw"), name.cast("string").alias("func"), part(file).alias("file"), part(file + 1).cast("int").alias("line"), part(file + 2).cast("int").alias("column"),
                F.lit(None).cast("string").alias("mapped_file"), F.lit(None).cast("int").alias("mapped_line"), F.lit(None).cast("int").alias("mapped_column"), F.lit(None).cast(schemas.PACKAGE).alias("pkg"),
            )

        is_ = lambda p: F.regexp_like(line, F.lit(p))
        return F.when(is_(_NAMED), of(_NAMED, 1, 2)).when(is_(_BARE), of(_BARE, None, 1)).when(is_(_OTHER), of(_OTHER, 1, 2))

    frames = F.filter(F.transform(F.split(stack, "\n"), frame), lambda f: f.isNotNull())
    return F.when(F.size(frames) > 0, frames)


def map_frames(frames: DataFrame, mapping: DataFrame) -> DataFrame:
    """frames(file, line, column) with their places in the sources: mapping(file, line, column, src, src_line, src_column),
    the last entry at or before the column of the line, by one aggregate over the line's entries."""
    key = ["file", "line"]
    each = frames.join(mapping.withColumnRenamed("column", "from_column"), key, "left")
    fits = F.when(F.col("from_column") <= F.col("column"), F.struct("from_column", "src", "src_line", "src_column"))
    best = each.groupBy(*frames.columns).agg(F.max(fits).alias("m"))
    return best.select(*frames.columns, F.col("m.src").alias("mapped_file"), F.col("m.src_line").alias("mapped_line"), F.col("m.src_column").alias("mapped_column"))


def tail_lines(output: Column, n: int = 100) -> Column:
    """The last n lines of a command's output."""
    rows = fn.lines(output)
    return F.array_join(F.slice(rows, F.greatest(F.lit(1), F.size(rows) - n + 1), n), "\n")


_TASK = "name STRING, type STRING, state STRING, file STRING, error STRING"


def test_summary(files: DataFrame, depth: int = 6, most: int = 50) -> DataFrame:
    """passed, failed, failures (first `most` names) of a test runner's trees: files(tree) as JSON with nested tasks."""
    schema = _TASK
    for _ in range(depth):
        schema = f"{_TASK}, tasks ARRAY<STRUCT<{', '.join(part.replace(' ', ': ', 1) for part in _top(schema))}>>"
    level = files.select(F.from_json("tree", schema).alias("t"))
    flat = level.select("t.name", "t.type", "t.state")
    for _ in range(depth):
        level = level.filter("t.tasks IS NOT NULL").select(F.explode("t.tasks").alias("t"))
        flat = flat.unionByName(level.select("t.name", "t.type", "t.state"))
        if "tasks" not in level.schema["t"].dataType.names:
            break
    tests = flat.filter("type = 'test'")
    failed = F.sort_array(F.collect_list(F.when(F.col("state") == "fail", F.col("name"))))
    return tests.agg(F.count_if(F.col("state") == "pass").alias("passed"), F.count_if(F.col("state") == "fail").alias("failed"), F.slice(failed, 1, most).alias("failures"))


def _top(ddl: str) -> list[str]:
    """The fields of a DDL, split at commas that stand outside of brackets."""
    out, depth = [""], 0
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [p.strip() for p in out]


def duplicate_packages(packages: DataFrame) -> DataFrame:
    """name, paths of packages(name, path) that lie at more than one path."""
    return packages.groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("paths")).filter(F.size("paths") > 1)
