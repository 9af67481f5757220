"""Incremental ingest: a streaming data source for JSON lines that grow, and passes over chat stores that go on where they stopped.

    spark.readStream.format("growing_lines").option("path", folder).load()
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from larkspur.sources import chat


class _Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class GrowingReader(DataSourceStreamReader):
    """Offsets are the bytes of each file up to its last complete line; a file that has shrunk is read anew."""

    def __init__(self, options: dict):
        self.pattern = os.path.join(options["path"], options.get("glob", "**/*.jsonl"))

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": {p: self._complete(p) for p in sorted(glob.glob(self.pattern, recursive=True))}}

    @staticmethod
    def _complete(path: str) -> int:
        with open(path, "rb") as f:
            end = f.seek(0, os.SEEK_END)
            while end > 0:
                start = max(0, end - 65536)
                f.seek(start)
                if (at := f.read(end - start).rfind(b"\n")) >= 0:
                    return start + at + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, upto in end["files"].items():
            done = start["files"].get(path, 0)
            if upto != done:
                out.append(_Piece(path, done if upto > done else 0, upto))
        return out

    def read(self, partition: _Piece) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                yield partition.path, at, line.rstrip(b"\r\n").decode(errors="replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "path STRING, start BIGINT, text STRING"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLines)


class Ingest:
    """Passes over a store: unchanged units are skipped, appended ones go on, others are replaced whole.

    A pass writes its turns under passes/<n>, then the state that holds for it; a pass that was cut off is written again
    under the same number, so that it counts once."""

    def __init__(self, spark: SparkSession, agent: str, root: str, out: str):
        self.spark, self.agent, self.root, self.out = spark, agent, root, out
        os.makedirs(out, exist_ok=True)

    def _state(self) -> dict:
        path = os.path.join(self.out, "state.json")
        if not os.path.exists(path):
            return {"pass": 0, "units": {}}
        with open(path) as f:
            return json.load(f)

    def run(self) -> int:
        """Reads what has changed; returns the number of units read."""
        state, todo = self._state(), {}
        for path in chat.ADAPTERS[self.agent].units(self.root):
            now = os.stat(path)
            known = state["units"].get(path)
            change, start = chat.classify(None if known is None else (known["size"], known["mtime"], known["tail"]), now.st_size, int(now.st_mtime * 1000), path)
            if change != "unchanged":
                todo[path] = (start, change, now)
        if not todo:
            return 0
        n = state["pass"] + 1
        turns = self._read(todo)
        how = F.create_map(*[F.lit(x) for p, (_, c, _) in todo.items() for x in (p, c)])
        turns.withColumn("change", F.try_element_at(how, F.col("source_path"))).write.mode("overwrite").parquet(os.path.join(self.out, f"pass={n}"))
        for path, (_, _, now) in todo.items():
            end = GrowingReader._complete(path) if path.endswith(".jsonl") else now.st_size
            state["units"][path] = {"size": end, "mtime": int(now.st_mtime * 1000) if end == now.st_size else 0, "tail": chat.tail_hash(path, end)}
        state["pass"] = n
        temp = os.path.join(self.out, "state.json.tmp")
        with open(temp, "w") as f:
            json.dump(state, f)
        os.replace(temp, os.path.join(self.out, "state.json"))
        return len(todo)

    def _read(self, todo: dict) -> DataFrame:
        turns = chat.read_store(self.spark, self.agent, self.root, {p: start for p, (start, _, _) in todo.items()})
        wanted = self.spark.createDataFrame([(p,) for p in todo], "source_path string")
        return turns.join(F.broadcast(wanted), "source_path", "left_semi")

    def turns(self) -> DataFrame:
        """The turns that stand: of each unit those since its last replacement, up to the last pass that was finished."""
        rows = self.spark.read.parquet(self.out).filter(F.col("pass") <= self._state()["pass"])
        anew = rows.filter("change <> 'appended'").groupBy("source_path").agg(F.max("pass").alias("since"))
        return rows.join(anew, "source_path").filter("pass >= since").drop("since")
