import json
import sqlite3
import subprocess

import pytest

from larkspur.sources import chat, files, git
from larkspur.streaming import ingest


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (root / "a.rs").write_text("one\ntwo\nthree\n")
    (root / "b.bin").write_bytes(b"x\0y")
    run("add", ".")
    run("commit", "-qm", "good calc totals")
    (root / "a.rs").write_text("one\n2\nthree\nfour\n")
    (root / "c.rs").write_text("c\n")
    run("add", ".")
    run("commit", "-qm", "rework calc")
    (root / "a.rs").write_text("one\n2\nfour\n")
    (root / "new.txt").write_text("n")
    return str(root)


def test_git(spark, repo):
    git.register(spark)
    read = lambda kind, **o: [tuple(r) for r in spark.read.format("git").options(repo=repo, kind=kind, **o).load().collect()]
    assert len(read("head")[0][0]) == 40
    assert [p for p, _ in read("files")] == ["a.rs", "b.bin", "c.rs"]
    assert [(p, bytes(c)) for p, _, c in read("blobs", batch="1")] == [("a.rs", b"one\n2\nthree\nfour\n"), ("c.rs", b"c\n")]
    assert read("diff") == [("M", "a.rs"), ("A", "c.rs")]
    assert sorted(read("status")) == [(" M", "a.rs"), ("??", "new.txt")]
    assert [(i, s) for _, i, _, _, s, _ in read("log", path="a.rs")] == [(0, "rework calc"), (1, "good calc totals")]
    assert read("hunks") == [("a.rs", "M", 2, 2)]
    with pytest.raises(ValueError):
        git.check_ref("--output=x")


def test_diff_hunks():
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@\n+a\n@@ -9 +0,0 @@\n-b\ndiff --git a/n b/n\nnew file mode 1\n--- /dev/null\n+++ b/n\n@@ -0,0 +1 @@\n+q\ndiff --git a/d b/d\ndeleted file mode 1\n--- a/d\n+++ /dev/null\n@@ -1,3 +0,0 @@\n"
    assert git.parse_diff(text) == [("x", "M", 3, 6), ("x", "M", 1, 1), ("n", "A", 1, 1), ("d", "D", 1, 1)]


def test_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rs").write_text("fn a() {}\n")
    (tmp_path / "note.txt").write_text("n")
    (tmp_path / "blob.bin").write_bytes(b"a\0b")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/x.rs").write_text("x")
    (tmp_path / ".hidden").write_text("h")
    got = lambda **o: sorted(r.path for r in files.read_tree(spark, str(tmp_path), **o).collect())
    assert got() == ["note.txt", "out/x.rs", "src/a.rs"]
    assert got(ignore=["out/", "*.txt"]) == ["src/a.rs"] and got(supported=True, ignore=["/out/"]) == ["src/a.rs"] and got(most_bytes=1) == ["note.txt", "out/x.rs"]
    (tmp_path / "link").symlink_to(tmp_path / "note.txt")
    assert files.open_regular(str(tmp_path / "note.txt")) == b"n"
    with pytest.raises(ValueError):
        files.open_regular(str(tmp_path / "link"))
    with pytest.raises(ValueError):
        files.open_regular(str(tmp_path / "src/a.rs"), 3)


def lines(path, rows, tail=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + tail)


def rows_of(spark, agent, root):
    return [(r.session_id, r.seq, r.role, r.text) for r in chat.read_store(spark, agent, str(root)).orderBy("session_id", "seq").collect()]


def test_chat_a_b(spark, tmp_path):
    said = [
        {"type": "user", "cwd": "/w", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": "hello"}},
        {"type": "assistant", "message": {"content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "name": "ls", "input": {"p": 1}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "content": [{"type": "text", "text": "out"}]}]}}, {"type": "summary"},
    ]
    lines(tmp_path / "projects/p/s1.jsonl", said, '{"type": "user", "message": {"content": "cut off"')
    lines(tmp_path / "projects/p/s1/subagents/agent-x.jsonl", said[:1])
    assert rows_of(spark, "claude", tmp_path) == [("s1", 0, "user", "hello"), ("s1", 1, "assistant", 'hi\n⋮tool ls {"p": 1}'), ("s1", 2, "tool", "out"), ("s1/agent-x", 0, "user", "hello")]
    lines(tmp_path / "sessions/2024/r.jsonl", [
        {"type": "session_meta", "payload": {"id": "id1", "cwd": "/w"}}, {"type": "session_meta", "payload": {"id": "id2"}}, {"type": "event_msg", "payload": {"type": "user_message", "message": "dup"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]}}, {"type": "response_item", "payload": {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": "x"}]}},
        {"type": "response_item", "payload": {"type": "reasoning", "encrypted_content": "x"}}, {"type": "response_item", "payload": {"type": "function_call", "name": "sh", "arguments": "{}"}}, {"type": "response_item", "payload": {"type": "function_call_output", "output": "done"}},
    ])
    assert rows_of(spark, "codex", tmp_path) == [("id1", 0, "user", "q"), ("id1", 1, "assistant", "⋮tool sh {}"), ("id1", 2, "tool", "done")]
    s = {r.session_id: r for r in chat.sessions(chat.read_store(spark, "claude", str(tmp_path))).collect()}
    assert s["s1"].title == "hello" and s["s1/agent-x"].is_subagent and s["s1/agent-x"].parent == "s1"


def test_chat_c_d(spark, tmp_path):
    lines(tmp_path / "projects/x/agent-transcripts/t.jsonl", [{"role": "user", "message": {"content": [{"type": "text", "text": "a <user_query>\nwhat\n</user_query> b"}]}}, {"role": "assistant", "message": {"content": "yes"}}])
    assert rows_of(spark, "cursor", tmp_path) == [("t", 0, "user", "what"), ("t", 1, "assistant", "yes")]
    lines(tmp_path / "h/history.jsonl", [{"display": "x", "conversationId": "c", "timestamp": 5}, {"display": "y"}, {"display": "z", "conversationId": "c"}])
    assert rows_of(spark, "gemini", tmp_path) == [("c", 0, "user", "x"), ("c", 1, "user", "z"), ("history", 0, "user", "y")]


def test_chat_e_f_g(spark, tmp_path):
    for name, agent in (("opencode.db", "opencode"), ("zcode.db", "zcode")):
        with sqlite3.connect(tmp_path / name) as db:
            db.executescript("CREATE TABLE session (id, directory, parent_id); CREATE TABLE message (id, session_id, time_created, time_updated, data); CREATE TABLE part (id, message_id, data);")
            db.execute("INSERT INTO session VALUES ('s', '/w', NULL)")
            db.execute("INSERT INTO message VALUES ('m', 's', 1, 2, ?)", (json.dumps({"role": "user"}),))
            db.executemany("INSERT INTO part VALUES (?, 'm', ?)", [("p2", json.dumps({"type": "text", "text": "b"})), ("p1", json.dumps({"type": "text", "text": "a"}))])
        assert rows_of(spark, agent, tmp_path) == [("s", 0, "user", "a\nb")]
    with sqlite3.connect(tmp_path / "devin.db") as db:
        db.execute("CREATE TABLE message_nodes (row_id, session_id, node_id, parent_node_id, created_at, chat_message)")
        nodes = [(1, "s", 10, None, 5, "root"), (2, "s", 11, 10, 9, "late"), (3, "s", 12, 10, 6, "early"), (4, "s", 13, 12, 7, "child"), (5, "s", 14, 99, 8, "orphan")]
        db.executemany("INSERT INTO message_nodes VALUES (?, ?, ?, ?, ?, ?)", [(*n[:5], json.dumps({"role": "user", "content": n[5]})) for n in nodes])
    assert [t for *_, t in rows_of(spark, "devin", tmp_path)] == ["root", "early", "child", "late", "orphan"]
    assert [n[0] for n in chat.linearize([(1, 2, 0, 0), (2, 1, 0, 1)])] == [1, 2]


def test_ingest_passes(spark, tmp_path):
    path = tmp_path / "in/projects/p/s.jsonl"
    say = lambda t: {"type": "user", "cwd": "/w", "message": {"content": t}}
    lines(path, [say("one")])
    job = ingest.Ingest(spark, "claude", str(tmp_path / "in"), str(tmp_path / "out"))
    texts = lambda: sorted(r.text for r in job.turns().collect())
    assert job.run() == 1 and job.run() == 0 and texts() == ["one"]
    with path.open("a") as f:
        f.write(json.dumps(say("two")) + "\n" + '{"type": "user", "mess')
    assert job.run() == 1 and texts() == ["one", "two"]
    with path.open("a") as f:
        f.write('age": {"content": "three"}}\n')
    assert job.run() == 1 and texts() == ["one", "three", "two"]
    lines(path, [say("anew")])
    assert job.run() == 1 and texts() == ["anew"]


def test_growing_lines(spark, tmp_path):
    ingest.register(spark)
    (tmp_path / "d").mkdir()
    f = tmp_path / "d/x.jsonl"
    f.write_text("a\nb\npart")
    source = spark.readStream.format("growing_lines").option("path", str(tmp_path / "d")).load()

    def run():
        q = source.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        q.awaitTermination(60)
        return sorted(r.text for r in spark.read.parquet(str(tmp_path / "o")).collect())

    assert run() == ["a", "b"]
    with f.open("a") as out:
        out.write("ial\nc\n")
    assert run() == ["a", "b", "c", "partial"]
