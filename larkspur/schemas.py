"""Schemas of the engine's relations, as DDL."""

from __future__ import annotations

FILES = "doc_id BIGINT, path STRING, content STRING"
LINES = "path STRING, line INT, text STRING"
SYMBOLS = "uid STRING, path STRING, name STRING, qualified STRING, kind STRING, start_line INT, end_line INT, sig STRING"
IMPORTS = "path STRING, spec STRING, bindings ARRAY<STRING>"
CALLS = "call_id BIGINT, path STRING, name STRING, receiver STRING, caller STRING, site_line INT"
EDGES = "src STRING, dst STRING, kind STRING, tier STRING, site_line INT"
SESSIONS = "session_id STRING, agent STRING, cwd STRING, parent STRING, title STRING, ts_first BIGINT, ts_last BIGINT, turn_count BIGINT, is_subagent BOOLEAN"
TURNS = "session_id STRING, seq INT, role STRING, text STRING, ts BIGINT, ts_source STRING, intent_source STRING"
PACKAGE = "STRUCT<name: STRING, version: STRING, path: STRING, dup_paths: ARRAY<STRING>>"
FRAME = f"STRUCT<raw: STRING, func: STRING, file: STRING, line: INT, column: INT, mapped_file: STRING, mapped_line: INT, mapped_column: INT, pkg: {PACKAGE}>"
ERRORS = f"ts BIGINT, surface STRING, kind STRING, message STRING, frames ARRAY<{FRAME}>, run_id STRING, extra STRING"
EVENTS = "ts BIGINT, kind STRING, run_id STRING, data STRING"
RUNS = "run_id STRING, started_at BIGINT, head STRING, lock_hash STRING, deps_hash STRING, node STRING"
#: Sources of a turn's time, best first.
TS_SOURCES = ["iso", "unixms", "mtime", "absent"]
SURFACES = ["exception", "rejection", "console", "http", "ws", "hmr", "build", "typecheck", "test", "process", "reported"]
SYMBOL_KINDS = ["function", "method", "class", "struct", "enum", "interface", "trait", "module", "type"]
