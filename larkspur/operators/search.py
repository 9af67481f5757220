"""Code search: an inverted gram index, candidates by a boolean plan, line-by-line verification, pages, layers."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as fn
from larkspur.operators.lineage import shared_dir
from larkspur.plans import grams
from larkspur.plans import regex as rx
from larkspur.plans.grams import Extractor

SNIFF, MOST_BYTES, LIMIT, MOST_LIMIT, SHARD, VERSION = 8192, 4 << 20, 100, 10_000, grams.SHARD, 2


# Index --------------------------------------------------------------------------------------------------------------------


def indexable(files: DataFrame, content: str = "content") -> DataFrame:
    """Files that are small enough and not binary (no NUL near the start)."""
    c = F.col(content)
    return files.filter(c.isNotNull() & (F.octet_length(c) <= MOST_BYTES) & ~F.contains(F.left(c, F.lit(SNIFF)), F.lit("\0")))


def postings(files: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """gram, path: one row for each distinct gram of each file.

    Files are dealt out first: cutting takes far longer than moving the texts, of which a scan may have many in one task."""
    extractor = extractor or Extractor()
    return extractor.of_files(indexable(files).select("path", "content").repartition("path")).select("path", F.explode("grams").alias("gram"))


def _cut(dealt: DataFrame, extractor: Extractor) -> DataFrame:
    return extractor.lists_of_files(dealt)


def posting_lists(files: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """gram, paths, n: sorted lists, for small corpora or rare grams; an index at scale keeps `postings`, sorted by gram."""
    return postings(files, extractor).groupBy("gram").agg(F.sort_array(F.collect_set("path")).alias("paths"), F.count("*").alias("n"))


def write_index(files: DataFrame, path: str, extractor: Extractor | None = None, partitions: int | None = None) -> None:
    """An index as Parquet, and its metadata. Files are dealt out in shards of about SHARD bytes of text, and each one's
    lists of paths are made in order of grams where its texts are cut: the texts are shuffled once, and postings, of which there
    are far more, neither shuffled nor sorted as rows. A shard's paths are few enough for Parquet's dictionary; a lookup reads
    the pages of its grams in every shard."""
    extractor, rows = extractor or Extractor(), indexable(files).select("path", "content")
    size = rows.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
    shards = partitions or max(1, -(-size // SHARD))
    own = _cut(rows.repartition(shards, "path"), extractor)
    pages = {"parquet.page.row.count.limit": 256, "parquet.bloom.filter.enabled#gram": True, "parquet.bloom.filter.max.bytes": 1 << 15}
    own.write.mode("overwrite").options(**pages).parquet(f"{path}/postings")
    meta = files.agg(F.count("*").alias("files")).select("files", F.lit(extractor.id).alias("extractor"), F.lit(VERSION).alias("version"))
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def open_index(spark: SparkSession, path: str, extractor: Extractor | None = None) -> DataFrame:
    """The postings of a written index; ValueError if another extractor or version wrote it."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["extractor"] != (extractor or Extractor()).id or meta["version"] != VERSION:
        raise ValueError(f"the index is of {meta['extractor']}, version {meta['version']}")
    lists = spark.read.schema("gram STRING, paths ARRAY<STRING>").parquet(f"{path}/postings")
    return lists.select("gram", F.explode("paths").alias("path"))


def stored_index(files: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """The postings of files(path, content) read from Parquet, written to the shared folder at first use and found again by
    what the table's files are: their names, sizes and times."""
    spark, extractor = files.sparkSession, extractor or Extractor()
    fs_path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    parts = sorted(files.inputFiles())
    status = [(p, s.getLen(), s.getModificationTime()) for p in parts for s in [fs_path(p).getFileSystem(conf).getFileStatus(fs_path(p))]]
    mark = hashlib.sha256(repr((status, files.columns)).encode()).hexdigest()[:24]
    home = f"{shared_dir(spark)}/larkspur-index/{extractor.id}-{VERSION}-{mark}"
    fs = fs_path(home).getFileSystem(conf)
    if not fs.exists(fs_path(f"{home}/meta/_SUCCESS")):
        aside = f"{home}-{uuid.uuid4().hex}"
        write_index(files, aside, extractor)
        if not fs.rename(fs_path(aside), fs_path(home)):  # another session was first
            fs.delete(fs_path(aside), True)
    return open_index(spark, home, extractor)


def candidates(index: DataFrame, plan: rx.Plan, universe: DataFrame) -> DataFrame:
    """path: files of universe whose grams fulfil the plan. Only the plan's grams are read from the index."""
    wanted = rx.grams_of(plan)
    if not wanted:
        return universe.select("path").distinct()
    read = index.filter(F.col("gram").isin(wanted))
    if isinstance(plan, rx.Gram):
        return read.select("path").distinct()
    have = read.groupBy("path").agg(F.collect_set("gram").alias("grams"))  # at most the plan's grams for a file
    return have.filter(rx.to_column(plan, F.col("grams"))).select("path")


# Verification -------------------------------------------------------------------------------------------------------------


def match_lines(files: DataFrame, pattern: str) -> DataFrame:
    """path, line (from 1), text: lines that match; nothing behind a NUL is searched."""
    body = fn.before_nul(F.col("content"))
    hit = files.filter(F.regexp_like(body, F.lit(f"(?m){pattern}")) | F.contains(body, F.lit("\r")))
    rows = hit.select("path", F.posexplode(fn.lines(body)).alias("at", "text"))
    return rows.filter(F.regexp_like("text", F.lit(pattern))).select("path", (F.col("at") + 1).alias("line"), "text")


def within(files: DataFrame, prefixes: list[str]) -> DataFrame:
    """Files at or below any of the path prefixes."""
    if not prefixes:
        return files
    any_ = F.lit(False)
    for p in prefixes:
        any_ = any_ | fn.under(F.col("path"), p)
    return files.filter(any_)


@dataclass
class Page:
    rows: DataFrame
    truncated: bool
    offset: int


def page(rows: DataFrame, order: list, offset: int, limit: int) -> Page:
    """A page in a total order, and whether anything follows it."""
    spark, held = rows.sparkSession, rows.orderBy(*order).offset(offset).limit(limit + 1).collect()  # a page: few rows
    return Page(spark.createDataFrame(held[:limit], rows.schema).orderBy(*order), len(held) > limit, offset)


def search(files: DataFrame, pattern: str, index: DataFrame | None = None, prefixes: list[str] = (), extractor: Extractor | None = None) -> DataFrame:
    """path, line, text of all matches. With an index, only candidates of the pattern's plan are read and verified.

    Files above MOST_BYTES or with a NUL near their start are not searched."""
    files = within(indexable(files), list(prefixes))
    if index is not None:
        plan = rx.plan_pattern(pattern, extractor)
        if not isinstance(plan, rx.All):
            files = files.join(candidates(index, plan, files), "path", "left_semi")
    return match_lines(files, pattern)


# Layers -------------------------------------------------------------------------------------------------------------------


def reconcile(status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed paths, tombstones) of a diff (status, path): D removes, A changes, all else does both."""
    changed = status.filter("status <> 'D'").select("path").distinct()
    return changed, status.filter("status <> 'A'").select("path").distinct()


def live(base: DataFrame, delta: DataFrame, tombstones: DataFrame, overlay: DataFrame) -> DataFrame:
    """path, layer: the base without what was removed or changed, then the delta, then unsaved files, the last one winning."""
    gone = tombstones.select("path").unionByName(overlay.select("path"))
    low = base.select("path").join(gone.unionByName(delta.select("path")), "path", "left_anti").withColumn("layer", F.lit("base"))
    mid = delta.select("path").join(overlay.select("path"), "path", "left_anti").withColumn("layer", F.lit("delta"))
    return low.unionByName(mid).unionByName(overlay.select("path").withColumn("layer", F.lit("overlay"))).distinct()


def layered_candidates(base: DataFrame, delta: DataFrame, tombstones: DataFrame, overlay: DataFrame) -> DataFrame:
    """path: candidates of the base that still stand, of the delta, and of the overlay."""
    return base.select("path").join(tombstones.select("path"), "path", "left_anti").unionByName(delta.select("path")).unionByName(overlay.select("path")).distinct()


def freshness(layers: DataFrame) -> DataFrame:
    """layer, n_files."""
    return layers.groupBy("layer").agg(F.count("*").alias("n_files"))


def signature(files: DataFrame, buckets: int = 256) -> DataFrame:
    """signature: a hash of all (path, content hash), by way of ordered hashes of buckets, so no list holds all files."""
    one = F.sha2(F.concat_ws("\0", "path", F.sha2(F.col("content"), 256)), 256)
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets))
    # Sums of independent parts of the hashes stand for the bucket's set of rows, whatever their order.
    rows = files.select(bucket.alias("b"), one.alias("h"))
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = rows.groupBy("b").agg(F.concat_ws("-", F.count("*").cast("string"), *[part(k) for k in range(5)]).alias("s"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "s"))), lambda x: x["s"]), "\n")
    return sums.agg(F.sha2(listed, 256).alias("signature"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("gram").agg(F.count("*").alias("df"))


def matches_line(pattern: str) -> Column:
    return F.regexp_like(F.col("text"), F.lit(pattern))
