"""Git repositories as tables: a Python data source named `git`, with one kind of rows for each option `kind`.

    spark.read.format("git").option("repo", root).option("kind", "files").load()

Kinds: head (oid); files (path, oid); blobs (path, oid, content) at option `at`; status (status, path);
diff (status, path) from `from` to `to`; log (path, idx, oid, unix_date, subject, blob) of option `path`; hunks
(path, status, a, b) of the working tree against `from`. Blobs are read in partitions of `batch` files, by one process each.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "head": "oid STRING",
    "files": "path STRING, oid STRING",
    "blobs": "path STRING, oid STRING, content BINARY",
    "status": "status STRING, path STRING",
    "diff": "status STRING, path STRING",
    "log": "path STRING, idx INT, oid STRING, unix_date BIGINT, subject STRING, blob STRING",
    "hunks": "path STRING, status STRING, a INT, b INT",
}
MOST_BYTES, SNIFF = 4 << 20, 8192


def check_ref(ref: str) -> str:
    """The ref; ValueError for what git could take for an option, or nothing."""
    if not ref or ref.startswith("-") or any(c.isspace() for c in ref):
        raise ValueError(f"no ref: {ref!r}")
    return ref


def run(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


def ls_tree(repo: str, at: str) -> list[tuple[str, str, int]]:
    """(path, oid, size) of the blobs of a commit."""
    out = []
    for row in run(repo, "ls-tree", "-r", "-l", "-z", check_ref(at)).decode("utf-8", "surrogateescape").split("\0"):
        if m := re.match(r"100\d{3} blob (\w+)\s+(\d+)\t(.*)", row, re.S):
            out.append((m[3], m[1], int(m[2])))
    return out


def status(repo: str) -> list[tuple[str, str]]:
    """(XY, path) of what isn't committed, untracked files as ??; a rename stands under its new path."""
    parts, out = run(repo, "status", "--porcelain", "-z", "-uall").decode("utf-8", "surrogateescape").split("\0"), []
    while parts:
        row = parts.pop(0)
        if len(row) > 3:
            out.append((row[:2], row[3:]))
            if row[0] in "RC" and parts:
                parts.pop(0)
    return out


def diff(repo: str, a: str, b: str) -> list[tuple[str, str]]:
    parts = run(repo, "diff", "--name-status", "--no-renames", "-z", check_ref(a), check_ref(b)).decode("utf-8", "surrogateescape").split("\0")
    return [(s[:1], p) for s, p in zip(parts[0::2], parts[1::2], strict=False) if s]


def parse_diff(text: str) -> list[tuple[str, str, int, int]]:
    """(path, status, a, b) of a unified diff: the new side's lines of each hunk; one without any is the line before it."""
    out, path, kind, old = [], None, "M", ""
    for row in text.split("\n"):
        if row.startswith("diff --git "):
            path, kind = None, "M"
        elif row.startswith("new file"):
            kind = "A"
        elif row.startswith("deleted file"):
            kind = "D"
        elif row.startswith("--- "):
            old = row[4:].split("\t")[0]
        elif row.startswith("+++ "):
            new = row[4:].split("\t")[0]
            path = (old if new == "/dev/null" else new).removeprefix("a/" if new == "/dev/null" else "b/")
        elif path and (m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", row)):
            start, n = int(m[1]), int(m[2] or 1)
            out.append((path, kind, max(1, start), max(1, start + n - 1) if n else max(1, start)))
    return out


def log(repo: str, path: str, depth: int = 50) -> list[tuple]:
    """The versions of a file, newest first, with the blob that each left."""
    out = []
    for i, row in enumerate(run(repo, "log", "--follow", "-n", str(depth), "--format=%H%x1f%ct%x1f%s", "--", path).decode(errors="replace").splitlines()):
        oid, when, subject = row.split("\x1f", 2)
        try:
            blob = run(repo, "rev-parse", f"{oid}:{path}").decode().strip()
        except subprocess.CalledProcessError:
            blob = None
        out.append((path, i, oid, int(when), subject, blob))
    return out


class _Blobs(InputPartition):
    def __init__(self, rows: list[tuple[str, str]]):
        self.rows = rows


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.kind, self.options = options["repo"], options.get("kind", "files"), dict(options)

    def partitions(self) -> list[InputPartition]:
        if self.kind != "blobs":
            return [InputPartition(None)]
        rows = [(p, oid) for p, oid, size in ls_tree(self.repo, self.options.get("at", "HEAD")) if 0 < size <= MOST_BYTES]
        n = int(self.options.get("batch", 1000))
        return [_Blobs(rows[i : i + n]) for i in range(0, len(rows), n)] or [_Blobs([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        get = self.options.get
        if self.kind == "blobs":
            yield from self._blobs(partition.rows)
        elif self.kind == "head":
            yield (run(self.repo, "rev-parse", "HEAD").decode().strip(),)
        elif self.kind == "files":
            yield from ((p, oid) for p, oid, _ in ls_tree(self.repo, get("at", "HEAD")))
        elif self.kind == "status":
            yield from status(self.repo)
        elif self.kind == "diff":
            yield from diff(self.repo, get("from", "HEAD~1"), get("to", "HEAD"))
        elif self.kind == "log":
            yield from log(self.repo, get("path"), int(get("depth", 50)))
        elif self.kind == "hunks":
            yield from parse_diff(run(self.repo, "diff", "-U0", "--no-color", check_ref(get("from", "HEAD"))).decode(errors="replace"))

    def _blobs(self, rows: list[tuple[str, str]]) -> Iterator[tuple]:
        with subprocess.Popen(["git", "-C", self.repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for path, oid in rows:
                git.stdin.write(f"{oid}\n".encode())
                git.stdin.flush()
                head = git.stdout.readline().split()
                if len(head) != 3:
                    continue
                content = git.stdout.read(int(head[2]))
                git.stdout.read(1)
                if b"\0" not in content[:SNIFF]:
                    yield path, oid, content
            git.stdin.close()


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "files")]

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)
