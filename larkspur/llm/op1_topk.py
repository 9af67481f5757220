"""Exact top-k search by inner product: tiled matrix products, selection per tile, tree merging.

Vectors are quantised to integers, component by component, so scores are exact. Candidates are dealt to shards and queries
to groups by a hash of the id, at most about `shard_rows` and `group_rows` each; every (group, shard) cell is one matrix
product, cut into tiles of `TILE` queries by `TILE` candidates. A tile keeps each query's best k; the lists of a cell's
shards merge `FAN` at a time, so a merge never sees more than FAN lists of k. A stated query set meets all rows in blocks:
rows move once for each group or shard of the other side, and the cells are bounded whatever the data.

Products are taken in float64 where all partial sums stay below 2^53, else in int64, else in Python integers (a score
beyond a long is clipped to it).

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id;
vectors are compared with those of equal length only; a row with the query's id is the query's own; repeated rows count
once; of equal scores the smaller vec_id comes first; if fewer candidates than k exist, all are returned; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

K, SCALE, EVERY = 5, 256, 50
SHARD_ROWS, GROUP_ROWS, TILE, FAN = 8192, 8192, 1024, 16
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, q (array of longs) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))
    some = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return vectors.filter(some & F.coalesce(finite, F.lit(False))).select("vec_id", q.alias("q"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exactly, as int64."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    top = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if 0 <= top < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < _LONG and min(int(a.min()), int(b.min())) > -_LONG:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -_LONG, _LONG).astype(np.int64)


def best(scores: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores that aren't own, ties to the smaller id, in order."""
    if not scores.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    held = np.where(own, -_LONG - 1, scores)
    n = held.shape[1]
    least = np.partition(held, n - k, axis=1)[:, n - k] if n > k else np.full(len(held), -_LONG - 1)
    row, col = np.nonzero((held >= least[:, None]) & ~own)
    order = np.lexsort((ids[col], -held[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


def _few_of_each(ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest ids of each distinct vector: no more of equal ones can be among the best."""
    order = np.lexsort((ids, *rows.T[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(1)
    head = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
    return np.sort(order[rank < k])


def _by_length(ids: list, rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    size = np.array([len(r) for r in rows], np.int64)
    ids = np.asarray(ids, np.int64)
    return {int(n): (ids[size == n], np.stack([rows[i] for i in np.flatnonzero(size == n)]).astype(np.int64)) for n in np.unique(size)}


def _cell(k: int):
    def run(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = [np.empty((0, 4), np.int64)]
        if len(queries) and len(shard):
            at = int(shard["s"].iloc[0])
            asked, offered = _by_length(queries["vec_id"], list(queries["q"])), _by_length(shard["vec_id"], list(shard["q"]))
            for n, (qid, q) in asked.items():
                if n not in offered:
                    continue
                cid, c = offered[n]
                keep = _few_of_each(cid, c, k + 1)
                cid, c = cid[keep], c[keep]
                for i in range(0, len(q), TILE):
                    lists = []
                    for j in range(0, len(c), TILE):
                        scores = products(q[i : i + TILE], c[j : j + TILE])
                        row, col = best(scores, qid[i : i + TILE, None] == cid[None, j : j + TILE], cid[j : j + TILE], k)
                        lists.append(np.stack([qid[i + row], np.full(len(row), at), scores[row, col], cid[j + col]], 1))
                    one = np.concatenate(lists)
                    one = one[np.lexsort((one[:, 3], -one[:, 2], one[:, 0]))]
                    rank = np.arange(len(one)) - np.searchsorted(one[:, 0], one[:, 0])
                    out.append(one[rank < k])
        return pd.DataFrame(np.concatenate(out), columns=["query_id", "s", "score", "vec_id"])

    return run


def search(queries: DataFrame, vectors: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score; queries and vectors are (vec_id, q) as `quantised` gives them."""
    n_queries, n_vectors = queries.count(), vectors.count()
    groups, shards = max(1, -(-n_queries // group_rows)), max(1, -(-n_vectors // shard_rows))
    g, s = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(groups)).cast("int"), F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(shards)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.distinct().select("vec_id", "q", g.alias("g"), every(shards).alias("s"))
    offered = vectors.distinct().select("vec_id", "q", s.alias("s"), every(groups).alias("g"))
    cells = asked.groupBy("g", "s").cogroup(offered.groupBy("g", "s")).applyInPandas(_cell(k), "query_id long, s long, score long, vec_id long")
    # -score: smaller is better in both fields; collect_set drops what repeated rows have given twice.
    lists = cells.groupBy("query_id", "s").agg(F.collect_set(F.struct((-F.col("score")).alias("cost"), "vec_id")).alias("top"))
    lists = lists.withColumn("top", F.slice(F.sort_array("top"), 1, k))
    while shards > 1:
        shards = -(-shards // FAN)
        merged = lists.withColumn("s", F.floor(F.col("s") / FAN)).groupBy("query_id", "s").agg(F.collect_list("top").alias("top"))
        lists = merged.withColumn("top", F.slice(F.sort_array(F.array_distinct(F.flatten("top"))), 1, k))
    ranked = lists.select("query_id", F.posexplode("top").alias("rank", "one"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.cost")).alias("score"))


def every_nth(vec_id: Column, n: int = EVERY) -> Column:
    return F.pmod(vec_id, F.lit(n)) == 0


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialize(quantised(table(spark, sf_dir, "embeddings")), "topk-vectors")
    return search(vectors.filter(every_nth(F.col("vec_id"))), vectors)


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= {K}"""
