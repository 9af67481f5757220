"""Cutting the lineage of iterations, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder in the warehouse, which all of a cluster's machines reach as well."""
    path = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session has ended: the folder's owner clears it
        pass


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet, so what reads it several times computes it once and reads its own columns.

    It is removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur-kept/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)
