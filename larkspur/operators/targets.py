"""Which files a task is about: five ranked channels fused by reciprocal rank, tiers, and context packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as fn

RRF_K, BONUS, P0_CAP, COUNT_CAP, MATCH_LINES = 60.0, 0.05, 5, 50, 500
#: Weight and bit of each channel; the first three are lexical.
CHANNELS = {"filename": (3.0, 1), "symbol": (2.5, 2), "content": (1.5, 4), "graph": (1.0, 8), "cluster": (0.5, 16)}
LEXICAL, NAMED = 7, 3


def _ranked(rows: DataFrame, order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def filename_rank(files: DataFrame, keywords: list[str]) -> DataFrame:
    """path, score, rank: keywords among the words of a path, those of its last component twice."""
    parts = F.split("path", "/")
    wanted = F.array(*[F.lit(k) for k in keywords])
    hits = lambda part: F.size(F.filter(fn.ident_words(part), lambda w: F.array_contains(wanted, w)))
    score = F.aggregate(F.transform(parts, hits), F.lit(0), lambda a, x: a + x) + hits(F.element_at(parts, -1))
    return _ranked(files.select("path", score.alias("score")).filter("score > 0"), [F.desc("score"), "path"])


def symbol_rank(symbols: DataFrame, keywords: list[str], exact: list[str]) -> DataFrame:
    """path, n_keywords, n_symbols, exact, names (first five), rank: files that define symbols with the keywords or names."""
    wanted = F.array(*[F.lit(k) for k in keywords]).cast("array<string>")
    own = F.array_intersect(fn.ident_words(F.col("name")), wanted)
    hit = symbols.select("path", "name", own.alias("own"), F.col("name").isin(exact).alias("exact")).filter((F.size("own") > 0) | F.col("exact"))
    sums = hit.groupBy("path").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("own")))).alias("n_keywords"), F.countDistinct("name").alias("n_symbols"),
        F.bool_or("exact").alias("exact"), F.slice(F.sort_array(F.collect_set("name")), 1, 5).alias("names"),
    )
    return _ranked(sums, [F.desc(F.col("exact").cast("int")), F.desc("n_keywords"), F.desc("n_symbols"), "path"])


def content_rank(lines: DataFrame, keywords: list[str], most: int = MATCH_LINES, cap: int = COUNT_CAP) -> DataFrame:
    """path, n_keywords, total, rank: matching lines(path, line, text), for each keyword the first `most` in order."""
    low = F.lower("text")
    tagged = lines.select("path", "line", F.explode(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in keywords]))).alias("kw"))
    first = tagged.withColumn("r", F.row_number().over(Window.partitionBy("kw").orderBy("path", "line"))).filter(F.col("r") <= most)
    per = first.groupBy("path", "kw").agg(F.least(F.count("*"), F.lit(cap)).alias("n"))
    sums = per.groupBy("path").agg(F.count("*").alias("n_keywords"), F.sum("n").alias("total"))
    return _ranked(sums, [F.desc("n_keywords"), F.desc("total"), "path"])


def fuse(channels: dict[str, DataFrame], k: float = RRF_K, bonus: float = BONUS) -> DataFrame:
    """path, score, families (bits), exact: channels of (path, rank[, exact]) by reciprocal rank, and a bonus for exact names."""
    parts = []
    for name, rows in channels.items():
        weight, bit = CHANNELS[name]
        exact = F.col("exact") if "exact" in rows.columns else F.lit(False)
        parts.append(rows.select("path", (F.lit(weight) / (k + F.col("rank") + 1)).alias("part"), F.lit(bit).alias("bit"), exact.alias("exact")))
    sums = reduce(DataFrame.unionByName, parts).groupBy("path").agg(F.sum("part").alias("score"), F.bit_or("bit").alias("families"), F.bool_or("exact").alias("exact"))
    return sums.withColumn("score", F.col("score") + F.when(F.col("exact"), bonus).otherwise(0.0))


def tiers(fused: DataFrame, limit: int = 20) -> DataFrame:
    """path, tier, score: the best files; P0 the first few of strong evidence, P1 other lexical ones, P2 a quarter of neighbours.

    Caps depend on a row's place in its own class only, so they are ranks; what is over the cap of P0 is P1, of P2 nothing."""
    limit = max(1, min(limit, 100))
    order = [F.desc("score"), "path"]
    lexical = F.col("families").bitwiseAND(LEXICAL) != 0
    strong = lexical & (F.col("exact") | ((F.bit_count("families") >= 2) & (F.col("families").bitwiseAND(NAMED) != 0)))
    kind = F.when(strong, 0).when(lexical, 1).otherwise(2)
    # Nothing beyond the first `limit` of a class can be among the first `limit` of all.
    held = fused.withColumn("kind", kind).withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).filter(F.col("n") <= limit)
    tier = F.when((F.col("kind") == 0) & (F.col("n") <= min(P0_CAP, limit)), "P0").when(F.col("kind") < 2, "P1").when(F.col("n") <= -(-limit // 4), "P2")
    rows = held.withColumn("tier", tier).filter("tier IS NOT NULL").orderBy(*order).limit(limit)
    return rows.select("path", "tier", F.round("score", 6).alias("score")).orderBy("tier", F.desc("score"), "path")


def lexical_seeds(channels: dict[str, DataFrame], files: int = 8) -> DataFrame:
    """path, pos: the best files by the lexical channels alone, from which neighbours are looked up."""
    own = {k: v for k, v in channels.items() if CHANNELS[k][1] & LEXICAL}
    top = fuse(own, bonus=0.0).orderBy(F.desc("score"), "path").limit(files)
    return _ranked(top, [F.desc("score"), "path"]).select("path", F.col("rank").alias("pos"))


def targets(files: DataFrame, lines: DataFrame, symbols: DataFrame, task: str, limit: int = 20, graph: DataFrame | None = None, cluster: DataFrame | None = None) -> DataFrame:
    """path, tier, score for a task. graph and cluster are (path, rank) of neighbours of the seeds, if there is a graph."""
    exact, words = fn.tokenize_task(task)
    channels = {"symbol": symbol_rank(symbols, words, exact)}
    if words:
        channels |= {"filename": filename_rank(files, words), "content": content_rank(lines, words)}
    channels |= {k: v for k, v in (("graph", graph), ("cluster", cluster)) if v is not None}
    return tiers(fuse(channels), limit)


# Context ------------------------------------------------------------------------------------------------------------------

LAYERS = ["L0", "L1", "L2"]


def render(layer: str) -> Column:
    """An item (path, start_line, end_line, kind, name, sig, snippet): its place and name; with its signature; with its source."""
    head = F.concat(F.format_string("%s:%d-%d %s %s", "path", "start_line", "end_line", "kind", "name"))
    sig = F.trim(F.coalesce("sig", F.lit("")))
    if layer != "L0":
        head = F.concat(head, F.when(sig != "", F.concat(F.lit(" — "), sig)).otherwise(F.lit("")))
    head = F.concat(head, F.lit("\n"))
    if layer == "L2":
        body = F.transform(fn.lines(F.coalesce("snippet", F.lit(""))), lambda x: F.concat(F.lit("    "), x, F.lit("\n")))
        head = F.concat(head, F.when(F.coalesce("snippet", F.lit("")) != "", F.array_join(body, "")).otherwise(F.lit("")))
    return head


def fit_context(items: DataFrame, budget: int, layer: str = "L2") -> tuple[str, str, int]:
    """(text, layer, items left out): items by pos, at the richest layer up to `layer` that fits the budget of tokens; if none
    does, as many as fit at the poorest, and a line that says how many don't.

    Sizes are added up in the cluster; only text within the budget comes to the driver."""
    sizes = items.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.octet_length(render(x))), F.lit(0)).alias(x) for x in LAYERS]).first()
    for x in reversed(LAYERS[: LAYERS.index(layer) + 1]):
        if -(-sizes[x] // 4) <= budget:
            rows = items.select("pos", render(x).alias("t")).orderBy("pos").collect()
            return "".join(r["t"] for r in rows), x, 0
    run = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marker = lambda n: f"… {n} more items elided (budget)\n"
    near = items.orderBy("pos").limit(budget * 4)  # an item has a byte at least
    held = near.select("pos", render("L0").alias("t")).withColumn("bytes", F.sum(F.octet_length("t")).over(run)).filter(F.col("bytes") <= 4 * budget)
    kept, size = [], 0
    for r in held.orderBy("pos").collect():
        left = sizes["n"] - len(kept) - 1
        if -(-r["bytes"] // 4) + (-(-len(marker(left).encode()) // 4) if left else 0) > budget:
            break
        kept.append(r["t"])
        size = r["bytes"]
    left = sizes["n"] - len(kept)
    return "".join(kept) + (marker(left) if left else ""), "L0", left
