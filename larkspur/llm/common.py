"""Helpers that the operators of this subpackage share: tables, materialisation, UTF-8 columns."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Maps A-Z to a-z and leaves every other byte, so it is safe on UTF-8.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: The same, and all ASCII other than a-z and 0-9 becomes a space: bytes.split() then yields the alphanumeric words.
FOLD_ALNUM = bytes((b if b >= 0x80 or chr(b).isalnum() else 0x20) for b in range(256)).translate(FOLD)
#: Regular expressions of the two kinds of words, after A-Z are lower-cased.
SPACED = r"[^\x20\x09-\x0D]+"
SPACES, SPACE_RUN = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"
ALNUM_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset, one in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session has ended: the folder's owner clears it
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and a lost executor costs nothing before it.

    The table is removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: A key that has at least this share of all rows is hot; there are at most so many of them, so they can be broadcast.
HOT = 1 << 16


def join_hot(rows: DataFrame, labels: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with labels on key (inner or left); labels has one row a key, and count: its rows of all total ones.

    The labels of hot keys, at most HOT of them, are broadcast, and only the other keys' rows are shuffled."""
    hot = F.col(count) * HOT >= total
    met = rows.join(F.broadcast(labels.filter(hot).drop(count).withColumn("_hot", F.lit(True))), key, "left")
    few = met.filter("_hot").drop("_hot")
    return few.unionByName(met.filter("_hot IS NULL").select(*rows.columns).join(labels.filter(~hot).drop(count), key, how))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string column without copying; offsets has one more entry than rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n, (_, off, data) = len(col), col.buffers()
    if n == 0 or off is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64), np.zeros(n, bool)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, offsets, col.is_valid().to_numpy(zero_copy_only=False)


def release() -> None:
    """Gives freed memory back to the system: a Python worker is kept for later tasks, and what one has freed counts until then."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], col: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows of about `most` bytes of col; a longer row stands alone.

    Behind the last one, memory that was freed meanwhile is released."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off, _ = utf8(batch.column(col))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(off, off[start] + most, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    release()
