"""Chat stores of seven agents as two tables, sessions and turns, by an adapter for each.

An adapter finds its units (files or databases) and reads one into sessions with turns, from a byte or row on if it can go
on where it stopped. `read_store` deals the units to tasks; `classify` says what an incremental pass has to do for a unit.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import re
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as fn

TURNS = "agent STRING, session_id STRING, source_path STRING, cwd STRING, is_subagent BOOLEAN, parent STRING, ts_source STRING, seq INT, role STRING, text STRING, truncated BOOLEAN, ts BIGINT, byte_start BIGINT"
RESULT_CAP, INPUT_CAP = 4000, 2000


@dataclass
class Session:
    id: str
    path: str
    cwd: str | None = None
    parent: str | None = None
    ts_source: str = "iso"
    turns: list[tuple] = field(default_factory=list)  # (role, text, truncated, ts, byte_start)

    def add(self, role: str, text: str, ts: int | None, at: int | None = None, cap: int | None = None) -> None:
        if text.strip():
            self.turns.append((role, text[:cap] if cap else text, cap is not None and len(text) > cap, ts, at))


def iso_ms(text) -> int | None:
    from datetime import datetime

    try:
        return int(datetime.fromisoformat(str(text).replace("Z", "+00:00")).timestamp() * 1000) if text else None
    except ValueError:
        return None


def to_ms(v: int | None) -> int | None:
    return None if v is None else v if v > 10**12 else v * 1000


def json_lines(path: str, start: int = 0) -> Iterator[tuple[int, dict]]:
    """(byte, record) of the complete lines from a byte on; what isn't JSON is passed over, a last line without its end left."""
    with open(path, "rb") as f:
        f.seek(start)
        for line in f:
            if not line.endswith(b"\n"):
                return
            try:
                record = json.loads(line)
            except ValueError:
                record = None
            if isinstance(record, dict):
                yield start, record
            start += len(line)


def parts_text(content, kinds=("text",)) -> str:
    """The text of a message: a string, or the texts of its parts, line by line."""
    if isinstance(content, str):
        return content
    parts = content if isinstance(content, list) else []
    return "\n".join(str(p.get("text") or "") for p in parts if isinstance(p, dict) and p.get("type") in kinds and p.get("text"))


def result_text(part: dict) -> str:
    return parts_text(part.get("content"))


def tail_hash(path: str, end: int, size: int = 4096) -> str | None:
    """A hash of the last bytes before `end`: if it still holds, the file was only added to."""
    try:
        with open(path, "rb") as f:
            f.seek(max(0, end - size))
            return hashlib.sha1(f.read(end - max(0, end - size))).hexdigest()
    except OSError:
        return None


class Adapter:
    agent, pattern = "", ""

    def units(self, root: str) -> list[str]:
        return sorted(glob.glob(os.path.join(root, self.pattern), recursive=True))

    def read(self, path: str, start: int = 0) -> list[Session]:
        raise NotImplementedError


class StoreA(Adapter):
    """A JSONL file for each session, those of subagents in a folder of their own; thinking is passed over."""

    agent, pattern = "claude", "projects/**/*.jsonl"

    def read(self, path: str, start: int = 0) -> list[Session]:
        stem = os.path.basename(path).removesuffix(".jsonl")
        m = re.search(r"([^/]+)/subagents/[^/]+$", path)
        s = Session(f"{m[1]}/{stem}" if m else stem, path, parent=m[1] if m else None)
        for at, r in json_lines(path, start):
            if r.get("type") not in ("user", "assistant"):
                continue
            s.cwd = s.cwd or r.get("cwd")
            content, ts = (r.get("message") or {}).get("content"), iso_ms(r.get("timestamp"))
            parts = [p for p in content if isinstance(p, dict)] if isinstance(content, list) else []
            if r["type"] == "user":
                s.add("user", parts_text(content), ts, at)
                s.add("tool", "\n".join(t for p in parts if p.get("type") == "tool_result" and (t := result_text(p)).strip()), ts, at, RESULT_CAP)
            else:
                said = [p.get("text") or "" if p.get("type") == "text" else f"⋮tool {p.get('name') or 'unknown'} {json.dumps(p.get('input'))[:INPUT_CAP]}" for p in parts if p.get("type") in ("text", "tool_use")]
                s.add("assistant", "\n".join(t for t in said if t) or (content if isinstance(content, str) else ""), ts, at)
        return [s] if s.turns or s.cwd else []


class StoreB(Adapter):
    """Rollout files: the first session_meta counts; events repeat what the responses say; developers' messages and
    encrypted reasoning are passed over."""

    agent, pattern = "codex", "sessions/**/*.jsonl"

    def read(self, path: str, start: int = 0) -> list[Session]:
        s, known = Session(os.path.basename(path).removesuffix(".jsonl"), path), False
        for at, r in json_lines(path):
            body = r.get("payload") or {}
            if r.get("type") == "session_meta" and not known:
                known, s.id, s.cwd = True, body.get("id") or s.id, body.get("cwd")
            if at < start or r.get("type") != "response_item":
                continue
            ts, kind = iso_ms(r.get("timestamp")), body.get("type")
            if kind == "message" and body.get("role") in ("user", "assistant"):
                s.add(body["role"], parts_text(body.get("content"), ("input_text", "output_text", "text")), ts, at)
            elif kind == "function_call":
                s.add("assistant", f"⋮tool {body.get('name')} {str(body.get('arguments') or '')[:INPUT_CAP]}", ts, at)
            elif kind == "function_call_output":
                out = body.get("output")
                s.add("tool", out if isinstance(out, str) else json.dumps(out), ts, at, RESULT_CAP)
        return [s] if s.turns or s.cwd else []


class StoreC(Adapter):
    """JSONL without times: the file's own time stands for all; a user's words stand in <user_query>."""

    agent, pattern = "cursor", "projects/**/agent-transcripts/**/*.jsonl"

    def read(self, path: str, start: int = 0) -> list[Session]:
        m = re.search(r"([^/]+)/subagents/[^/]+$", path)
        s = Session(os.path.basename(path).removesuffix(".jsonl"), path, parent=m[1] if m else None, ts_source="mtime")
        ts = int(os.path.getmtime(path) * 1000)
        for at, r in json_lines(path, start):
            role, text = r.get("role"), parts_text((r.get("message") or {}).get("content"))
            inner = re.search(r"<user_query>\s*(.*?)\s*</user_query>", text, re.S)
            if role in ("user", "assistant"):
                s.add(role, inner[1] if inner and role == "user" else text, ts, at)
        return [s] if s.turns else []


class StoreD(Adapter):
    """One history file; lines belong to the conversation they name, or to a common one."""

    agent, pattern = "gemini", "**/history.jsonl"

    def read(self, path: str, start: int = 0) -> list[Session]:
        held: dict[str, Session] = {}
        for at, r in json_lines(path, start):
            key = r.get("conversationId") or "history"
            s = held.setdefault(key, Session(key, path, cwd=r.get("workspace"), ts_source="unixms"))
            s.add("user", str(r.get("display") or r.get("text") or ""), to_ms(r.get("timestamp")), at)
        return [s for s in held.values() if s.turns]


class StoreE(Adapter):
    """SQLite with session, message and part; a message's parts make one turn."""

    agent, pattern = "opencode", "**/opencode*.db"

    def read(self, path: str, start: int = 0) -> list[Session]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            changed = {r[0] for r in db.execute("SELECT session_id FROM message GROUP BY session_id HAVING MAX(time_updated) > ?", (start,))} if start else None
            out = []
            for sid, folder, parent in db.execute("SELECT id, directory, parent_id FROM session ORDER BY id").fetchall():
                if changed is not None and sid not in changed:
                    continue
                s = Session(sid, path, cwd=folder, parent=parent, ts_source="unixms")
                for mid, when, data in db.execute("SELECT id, time_created, data FROM message WHERE session_id = ? ORDER BY time_created, id", (sid,)).fetchall():
                    parts = [json.loads(p) for (p,) in db.execute("SELECT data FROM part WHERE message_id = ? ORDER BY id", (mid,))]
                    said = [p.get("text") or "" if p.get("type") == "text" else f"⋮tool {p.get('tool')} {json.dumps((p.get('state') or {}).get('input'))[:INPUT_CAP]}" for p in parts if p.get("type") in ("text", "tool")]
                    s.add(json.loads(data).get("role") or "assistant", "\n".join(t for t in said if t), to_ms(when))
                out.append(s)
        return [s for s in out if s.turns]


class StoreF(StoreE):
    """The same tables as E's in another place."""

    agent, pattern = "zcode", "**/zcode*.db"


def linearize(nodes: list[tuple]) -> list[tuple]:
    """Nodes (node_id, parent, created_at, row_id, ...) in order: parents before children, siblings by time, then row; a node
    whose parent isn't there is a root; what hangs in a cycle comes last."""
    nodes = sorted(nodes, key=lambda n: (n[2], n[3]))
    known, below = {n[0] for n in nodes}, {}
    for n in nodes:
        below.setdefault(n[1] if n[1] in known else None, []).append(n)
    out, seen, stack = [], set(), below.get(None, [])[::-1]
    while stack:
        n = stack.pop()
        if n[3] not in seen:
            seen.add(n[3])
            out.append(n)
            stack += [c for c in below.get(n[0], [])[::-1] if c[3] not in seen]
    return out + [n for n in nodes if n[3] not in seen]


class StoreG(Adapter):
    """SQLite with a forest of messages for each session."""

    agent, pattern = "devin", "**/devin*.db"

    def read(self, path: str, start: int = 0) -> list[Session]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            rows = db.execute("SELECT session_id, node_id, parent_node_id, created_at, row_id, chat_message FROM message_nodes ORDER BY row_id").fetchall()
        changed = {r[0] for r in rows if r[4] > start}
        held: dict[str, list] = {}
        for sid, *node in rows:
            if sid in changed:
                held.setdefault(sid, []).append(tuple(node))
        out = []
        for sid, nodes in held.items():
            s = Session(str(sid), path, ts_source="unixms")
            for _, _, when, _, message in linearize(nodes):
                m = json.loads(message)
                s.add(m.get("role") or "assistant", parts_text(m.get("content")), to_ms(when))
            out.append(s)
        return [s for s in out if s.turns]


ADAPTERS = {a.agent: a for a in (StoreA(), StoreB(), StoreC(), StoreD(), StoreE(), StoreF(), StoreG())}


def classify(known: tuple[int, int, str | None] | None, size: int, mtime: int, path: str | None = None) -> tuple[str, int]:
    """(new, appended, rewritten or unchanged; the byte to go on from) of a unit last seen with (size, mtime, tail hash)."""
    if known is None:
        return "new", 0
    old, when, tail = known
    if (size, mtime) == (old, when):
        return "unchanged", old
    if size > old and (tail is None or path is None or tail_hash(path, old) == tail):
        return "appended", old
    return "rewritten", 0


def read_store(spark: SparkSession, agent: str, root: str, starts: dict[str, int] | None = None) -> DataFrame:
    """The turns of all of an agent's units under a folder that all executors see, each unit read by one task."""
    adapter, starts = ADAPTERS[agent], starts or {}
    units = [(p, starts.get(p, 0)) for p in adapter.units(root)]
    if not units:
        return spark.createDataFrame([], TURNS)

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in TURNS.split(", ")]
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["start"], strict=True):
                for s in adapter.read(path, int(start)):
                    rows = [(agent, s.id, s.path, s.cwd, s.parent is not None, s.parent, s.ts_source, i, *t) for i, t in enumerate(s.turns)]
                    yield pd.DataFrame(rows, columns=names).astype({"ts": "Int64", "byte_start": "Int64"})

    listed = spark.createDataFrame(units, "path string, start long")
    return listed.repartition(min(len(units), 200), "path").mapInPandas(run, TURNS)


def sessions(turns: DataFrame) -> DataFrame:
    """session_id, agent, cwd, parent, title, first and last time, turn_count of what read_store gives."""
    human = (F.col("role") == "user") & (fn.intent(F.col("text"), F.col("agent")) == "human")
    first = F.coalesce(F.min(F.when(human, F.struct("seq", "text")))["text"], F.min(F.struct("seq", "text"))["text"])
    return turns.groupBy("agent", "session_id").agg(
        F.max("cwd").alias("cwd"), F.max("parent").alias("parent"), F.bool_or("is_subagent").alias("is_subagent"), fn.title_of(first).alias("title"),
        F.min("ts").alias("ts_first"), F.max("ts").alias("ts_last"), F.count("*").alias("turn_count"),
    )
