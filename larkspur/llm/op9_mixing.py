"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame operations only.

1. Each document gets its size in words. Each source's target is its share of all words by weight, at most `cap` times
   its own size; what is cut off is shared again by weight among the sources below their caps (water filling).
2. A source takes floor(target / size) whole passes; the rest of its quota comes from its blocks (documents dealt by a
   keyed hash, about `block_docs` each) in a permuted order. One block in a source straddles the quota; its documents are
   taken in hashed order until the quota is met to the word.
3. Every drawn (source, pass, block) is a ticket. A binary tree splits the tickets among output shards: at each node a
   random half of fixed size goes left, so the per-source counts of the halves are multivariate hypergeometric and add up
   exactly. The counts at the leaves are the quotas; each source's permuted blocks are then dealt into them, disjoint, and
   rows are ordered by another hash within a shard.

Only sources and blocks meet in windows, never the documents of a source: one source may hold any part of the rows.

Defined cases: a null text has size 0; null sources form one source, last; an empty table gives no rows; sources of size
0 have target 0; rows that repeat a doc_id are dealt as rows of their own, whatever their texts; other columns take no part in
`mix` but tell such rows apart, and are kept by `draw` (columns named like its own get the ending _in). A null doc_id hashes
like any other value. The table of sources, a narrow row each, is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, materialize, table

SEED, CAP, BLOCK_DOCS, SHARDS = 20240, 3, 4096, 64


def word_count(col):
    """Number of maximal runs without white space (0x20, 0x09-0x0D); null counts as 0."""
    inner = F.btrim(col, F.lit(SPACES))
    return F.when(inner.isNull() | (inner == ""), F.lit(0)).otherwise(F.size(F.split(inner, SPACE_RUN))).cast("long")


def _mark(docs: DataFrame):
    """A hash of all of a row's columns (but maps, which have none): rows with one mark are alike."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        _mark(docs).alias("mark"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("skey"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
    )


def targets(docs: DataFrame, cap: int = CAP, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """skey, source, source_size, n_docs, weight, target, quota, passes, rest, n_blocks: one row per source."""
    src = docs.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = src.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    limit = F.col("source_size") * F.lit(float(cap))
    by_fill = Window.orderBy(limit / F.col("weight"), "skey")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        # What a unit of weight gets if all sources before this one stop at their caps and none from here on does.
        .withColumn("level", (F.col("total") - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("open", F.col("level") * F.col("weight") < limit)
    )
    # From the first open source on, its level holds for all.
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = filled.withColumn("level", level).withColumn("target", F.when(F.col("level").isNull(), limit).otherwise(F.least(limit, F.col("level") * F.col("weight"))))
    return (
        out.withColumn("quota", F.round("target").cast("long"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
        .withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
        .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(block_docs))).cast("long"))
        .select("skey", "source", "source_size", "n_docs", "weight", "target", "quota", "passes", "rest", "n_blocks")
    )


def _blocked(docs: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    keyed = docs.join(sources.drop("source", "n_docs", "weight", "quota"), "skey")
    return keyed.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "skey", "mark")).withColumn("block", F.pmod(F.col("h"), F.col("n_blocks")))


def _drawn_blocks(blocked: DataFrame, seed: int) -> DataFrame:
    """skey, block, turn (place in the permuted order), part (what the rest of the quota leaves for this block), whole."""
    blocks = blocked.groupBy("skey", "block", "rest", "passes").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(seed + 1), "skey", "block"), "block")
    return (
        blocks.withColumn("turn", F.row_number().over(order))
        .withColumn("part", F.greatest(F.lit(0), F.col("rest") - (F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))))
        .withColumn("whole", F.col("part") >= F.col("words"))
    )


def _taken(blocked: DataFrame, drawn: DataFrame) -> DataFrame:
    """blocked with extra: words that the last, partial pass takes of the document."""
    marked = blocked.join(drawn.select("skey", "block", "part", "whole", "turn"), ["skey", "block"])
    whole = marked.filter(F.col("whole") | (F.col("part") == 0)).withColumn("extra", F.when(F.col("whole"), F.col("size")).otherwise(F.lit(0)))
    within = Window.partitionBy("skey", "block").orderBy("h", "doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, 0)
    cut = marked.filter(~F.col("whole") & (F.col("part") > 0)).withColumn("run", F.sum("size").over(within) - F.col("size"))
    cut = cut.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("run")))).drop("run")
    return whole.unionByName(cut)


def plan(docs: DataFrame, cap: int = CAP, block_docs: int = BLOCK_DOCS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents with target and extra words, drawn blocks)."""
    rows = materialize(sized(docs), "mix-sizes")
    sources = materialize(targets(rows, cap, block_docs).coalesce(1), "mix-sources")
    blocked = _blocked(rows, sources, seed)
    drawn = materialize(_drawn_blocks(blocked, seed), "mix-blocks")
    return _taken(blocked, drawn), drawn


def tickets(drawn: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """skey, block, pass, shard: every draw of a block, dealt to the shards by the splitting tree."""
    draws = drawn.select("skey", "block", "turn", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("pass"), "passes", "part")
    draws = draws.filter((F.col("pass") < F.col("passes")) | (F.col("part") > 0)).select("skey", "block", "turn", "pass")
    tree, width, level = draws.withColumn("shard", F.lit(0)), shards, 0
    while width > 1:
        order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2 + level), "skey", "block", "pass"), "skey", "block", "pass")
        n = F.count("*").over(Window.partitionBy("shard"))
        left = F.row_number().over(order) * 2 <= n + F.pmod(F.xxhash64(F.lit(seed + level), "shard"), F.lit(2)) * (n % 2)
        tree = tree.withColumn("left", left).withColumn("shard", F.col("shard") * 2 + F.when(F.col("left"), 0).otherwise(1)).drop("left")
        width, level = (width + 1) // 2, level + 1
    # Quotas per shard and source are the counts at the leaves; each source's permuted draws fill them in turn.
    quota = tree.withColumn("k", F.row_number().over(Window.partitionBy("skey").orderBy("shard", "pass", "turn"))).select("skey", "k", "shard")
    deal = draws.withColumn("k", F.row_number().over(Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(seed + 99), "skey", "block", "pass"), "block", "pass")))
    return deal.join(quota, ["skey", "k"]).select("skey", "block", "pass", "shard")


def dealt(docs: DataFrame, cap: int = CAP, block_docs: int = BLOCK_DOCS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The documents with draws (pass, taken_words, shard): an entry for each ticket of the document's block in a shard.

    A document of no words goes along with its block's whole passes; the partial pass has only documents it takes words of."""
    rows, drawn = plan(docs, cap, block_docs, seed)
    out = materialize(tickets(drawn, shards, seed), "mix-tickets").filter(F.col("shard").isNotNull())
    of_block = out.groupBy("skey", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("tickets"))
    words = lambda t: F.when(t["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("extra")).cast("long")
    draws = F.transform("tickets", lambda t: F.struct(t["pass"].alias("pass"), words(t).alias("taken_words"), t["shard"].alias("shard")))
    draws = F.filter(draws, lambda d: (d["pass"] < F.col("passes")) | (d["taken_words"] > 0))
    none = F.array().cast("array<struct<pass:int,taken_words:bigint,shard:int>>")
    return rows.join(of_block, ["skey", "block"], "left").withColumn("draws", F.coalesce(draws, none)).drop("tickets")


def mix(docs: DataFrame, cap: int = CAP, block_docs: int = BLOCK_DOCS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target (of the source), taken (words, repeats counted), copies (draws of the document).

    taken and copies are counted from the draws that were dealt to the shards."""
    rows = dealt(docs, cap, block_docs, shards, seed)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["taken_words"])
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("draws").alias("copies"))


def _renamed(docs: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """docs without columns of these names, whatever their case: such ones end in _in, as often as it takes."""
    taken = {c.lower() for c in docs.columns} | set(own)
    names = {}
    for c in docs.columns:
        if c.lower() in own:
            new = c
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
            names[c] = new
    return docs.withColumnsRenamed(names)


def draw(docs: DataFrame, cap: int = CAP, block_docs: int = BLOCK_DOCS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: a row of docs for each draw, with pass, taken_words, shard and place. A shard lies in one partition,
    its rows in the order of place.

    Documents of no words are not drawn. Rows that are alike in all columns are drawn from as often as they are there."""
    rows = dealt(docs, cap, block_docs, shards, seed)
    key = ["doc_id", "skey", "mark"]
    each = rows.select(*key, F.inline("draws")).filter(F.col("taken_words") > 0)
    place = F.xxhash64(F.lit(seed + 7), "doc_id", "mark", "pass")
    chosen = each.select(F.col("doc_id").alias("mix_id"), F.col("skey").alias("mix_key"), F.col("mark").alias("mix_mark"), "pass", "taken_words", "shard", place.alias("place"))
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    marked = _renamed(docs.withColumn("_own_mark", _mark(docs)), ("pass", "taken_words", "shard", "place", "mix_id", "mix_key", "mix_mark"))
    same = lambda other: marked["doc_id"].eqNullSafe(other["mix_id"]) & (skey == other["mix_key"]) & (marked["_own_mark"] == other["mix_mark"])
    again = rows.groupBy(*key).count().filter("count > 1").select(F.col("doc_id").alias("mix_id"), F.col("skey").alias("mix_key"), F.col("mark").alias("mix_mark"))
    again = materialize(again, "mix-alike")
    if not again.isEmpty():  # of rows that are alike one stays, and gets the draws of all
        marked = marked.join(again, same(again), "left_anti").unionByName(marked.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "_own_mark"]))
    joined = marked.join(chosen, same(chosen)).drop("mix_id", "mix_key", "mix_mark", "_own_mark")
    return joined.repartition(shards, "shard").sortWithinPartitions("shard", "place")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
