"""Trees of files as tables."""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as fn

MOST_BYTES, SNIFF = 4 << 20, 8192


def read_tree(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES, ignore: list[str] = (), supported: bool = False) -> DataFrame:
    """path (below root), content (text), length: regular files that are small enough and not binary; hidden ones are left out.

    ignore: globs of paths, as in an ignore file; supported: only files in languages that can be read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    path = F.regexp_replace(F.col("path"), r"^\w+:/*", "/")
    rel = F.substring_index(path, base.split(":")[-1].replace("//", "/").rstrip("/") + "/", -1)
    rows = raw.filter((F.col("length") <= most_bytes) & (F.col("length") > 0)).select(rel.alias("path"), "length", "content")
    rows = rows.filter(~F.regexp_like("path", F.lit(r"(^|/)\."))).filter(F.coalesce(F.position(F.lit(b"\0"), F.substring("content", 1, SNIFF)), F.lit(0)) == 0)
    for pattern in ignore:
        rows = rows.filter(~F.regexp_like("path", F.lit(_glob(pattern))))
    if supported:
        rows = rows.filter(fn.lang_of(F.col("path")).isNotNull())
    return rows.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("content"), "length").filter("content IS NOT NULL")


def _glob(pattern: str) -> str:
    """An ignore pattern as a regular expression on paths: without a slash it holds at any depth, with a final one for folders."""
    import re

    folder, body = pattern.endswith("/"), pattern.strip("/")
    out = re.sub(r"\\\*\\\*/?|\\\*|\\\?", lambda m: {"\\*": "[^/]*", "\\?": "[^/]"}.get(m[0], ".*"), re.escape(body))
    return f"{'^' if '/' in body else '(^|/)'}{out}{'/' if folder else '(/|$)'}"


def open_regular(path: str, most_bytes: int = MOST_BYTES) -> bytes:
    """The bytes of a regular file; ValueError for links, other kinds, files that are too large or change while read."""
    before = os.lstat(path)
    if not stat.S_ISREG(before.st_mode) or before.st_size > most_bytes:
        raise ValueError(f"{path} is no regular file of at most {most_bytes} bytes")
    with open(path, "rb") as f:
        now = os.fstat(f.fileno())
        if (now.st_dev, now.st_ino) != (before.st_dev, before.st_ino):
            raise ValueError(f"{path} was exchanged")
        data = f.read(most_bytes + 1)
    if len(data) > most_bytes:
        raise ValueError(f"{path} has grown")
    return data
