"""Which version of a file to go back to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flag_suspects(versions: DataFrame, keywords: list[str]) -> DataFrame:
    """versions with suspect: a keyword stands in the subject, whatever its case."""
    low = F.lower("subject")
    hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(k.lower())) for k in keywords], F.lit(False))
    return versions.withColumn("suspect", hit)


def recommend(versions: DataFrame) -> DataFrame:
    """path, oid, reason for versions(path, idx, oid, blob, suspect), idx 0 being the newest, and its blob the head's.

    The version just older than the oldest suspect one; without one, the newest whose content differs from the head's."""
    oldest = versions.groupBy("path").agg(F.max(F.when(F.col("suspect"), F.col("idx"))).alias("at"), F.min_by("blob", "idx").alias("head"))
    rows = versions.join(oldest, "path")
    before = F.when(F.col("idx") == F.col("at") + 1, F.col("oid"))
    differs = F.when(F.col("blob").isNotNull() & ~F.col("blob").eqNullSafe(F.col("head")), F.struct("idx", "oid"))
    culprit = F.when(F.col("idx") == F.col("at"), F.left("oid", F.lit(7)))
    sums = rows.groupBy("path").agg(F.max(before).alias("before"), F.min(differs)["oid"].alias("other"), F.max(culprit).alias("culprit"))
    reason = F.when(F.col("before").isNotNull(), F.concat(F.lit("last version before suspect commit "), F.col("culprit"))).when(F.col("other").isNotNull(), "newest version whose content differs from HEAD")
    return sums.select("path", F.coalesce("before", "other").alias("oid"), reason.alias("reason"))


def plan(versions: DataFrame, keywords: list[str], dirty: DataFrame | None = None) -> DataFrame:
    """path, oid, reason, dirty: recommendations, and whether the file has changes that aren't committed."""
    out = recommend(flag_suspects(versions, keywords))
    if dirty is None:
        return out.withColumn("dirty", F.lit(False))
    marked = dirty.select("path", F.lit(True).alias("d")).distinct()
    return out.join(marked, "path", "left").select("path", "oid", "reason", F.coalesce("d", F.lit(False)).alias("dirty"))
