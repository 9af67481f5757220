"""Licence scan: an exact set-similarity join of text blocks with licence templates; DataFrame operations only.

A block is a line of a text, or of a longer line each window of 64 words, 32 apart; and so is each such window of the whole
text's words, whatever lines they stand on, so that a notice wrapped over lines is found. A template matches a block if the
block holds at least `threshold` of its distinct words; in a block that runs over line ends, as many must also stand in the
template's order, since words of unrelated lines (German "mit" near another licence) make no notice. Words are ordered by their number of documents, rarest first, over
the whole corpus. Then

* prefix filter: a matching block holds one of the first |T| - need + 1 words of template T;
* length filter: it has at least `need` distinct words, and at least `need` words of all templates together;
* positional filter: if the first word they share stands at place i of T and at place j of the block's template words,
  they share at most 1 + min(|T| - i, |B| - j) words, counting places from 1.

What passes is verified by intersecting the two sets. A document reaches the join only if it has `need` words of some
template, which is exact; the others are scanned once and cut off.

Base labels come from phrases that stand word for word; the templates add labels to them.

Defined cases: a null or empty text has no words, no labels, score 0; rows that repeat get equal results; documents of any
length are scanned whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_SEP, fold, materialize, table

THRESHOLD, BLOCK, STEP = 0.8, 64, 32
# Phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Short notices by which licences are usually declared.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


def words_of(col):
    """Lower-cased words of letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(fold(F.coalesce(col.cast("string"), F.lit(""))), ALNUM_SEP), "")


def _strings(values):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _need(size: int, threshold: float) -> int:
    return -(-round(size * threshold * 1_000_000) // 1_000_000)


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row for each row of docs."""
    sets = [(i, label, sorted(set(text.split()))) for i, (label, text) in enumerate(templates)]
    vocabulary = sorted({w for _, _, s in sets for w in s})
    last = sorted({p.split()[-1] for p, _ in phrases})
    text = F.col("text").cast("string")
    seen = docs.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text"), words_of(text).alias("words"))
    seen = seen.withColumn("found", F.array_intersect("words", _strings(vocabulary)))
    enough = F.lit(False)
    for _, _, s in sets:
        enough = enough | (F.size(F.array_intersect("found", _strings(s))) >= _need(len(s), threshold))
    phrased = F.arrays_overlap("words", _strings(last)) if last else F.lit(False)
    kept = seen.select("doc_id", "h", F.size("words").cast("long").alias("n_words"), "found", F.when(phrased, F.col("words")).alias("words"), F.when(enough, F.col("text")).alias("text"))
    kept = materialize(kept, "licence-scan")

    base = _base(kept, phrases)
    order = _by_frequency(kept, vocabulary)
    found = _join(kept, templates, sets, order, threshold)
    out = base.join(found, (base["doc_id"].eqNullSafe(found["of"])) & (base["h"] == found["of_h"]), "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("own", none)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _stands(parts: list[str]):
    def at(i):
        fits = F.get("words", i) == parts[0]
        for d, part in enumerate(parts[1:], 1):
            fits = fits & F.coalesce(F.get("words", i + d) == part, F.lit(False))
        return fits

    return at


def _base(kept: DataFrame, phrases) -> DataFrame:
    """Adds n_base, first_word, last_word and base from the phrases' places."""
    none = F.array().cast("array<int>")
    columns, places = [], []
    for k, (phrase, _) in enumerate(phrases):
        parts = phrase.split()
        at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), _stands(parts))
        columns.append(F.when(F.array_contains("words", parts[0]) & F.array_contains("words", parts[-1]), at).otherwise(none).alias(f"p{k}"))
        places.append(F.coalesce(F.col(f"p{k}"), none))
    out = kept.select("doc_id", "h", "n_words", *columns) if columns else kept.select("doc_id", "h", "n_words")
    every = F.concat(*places) if places else none
    labels = [F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(places, phrases, strict=True)]
    base = F.array_distinct(F.array_compact(F.array(*labels))) if labels else F.array().cast("array<string>")
    return out.select(
        "doc_id", "h", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), base.alias("base"),
    )


def _by_frequency(kept: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words, rarest in the corpus first: a row for each of them at most comes to the driver."""
    counts = {r["word"]: r["count"] for r in kept.select(F.explode("found").alias("word")).groupBy("word").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _in_order(words: str, notice: str):
    """Length of the longest common subsequence; row[j] is that of the words so far and the notice's first j."""

    def step(row, w):
        met = lambda i: F.when((i > 0) & (F.get(notice, i - 1) == w), F.get(row, i - 1) + 1).otherwise(F.get(row, i))
        return F.transform(row, lambda _, j: F.array_max(F.transform(F.sequence(F.lit(0), j), met)))

    return F.element_at(F.aggregate(words, F.array_repeat(F.lit(0), F.size(notice) + 1), step), -1)


def _join(kept: DataFrame, templates, sets, order: list[str], threshold: float) -> DataFrame:
    """of, of_h, own (labels), best (containment) of rows in which a template matches."""
    spark, place = kept.sparkSession, {w: i for i, w in enumerate(order)}
    prefix, whole = [], []
    for i, label, s in sets:
        ranked, need = sorted(s, key=place.get), _need(len(s), threshold)
        whole.append((i, label, ranked, len(ranked), need, templates[i][1].split()))
        prefix += [(w, i, at) for at, w in enumerate(ranked[: len(ranked) - need + 1], 1)]
    index = spark.createDataFrame(prefix, "word string, template int, at int")
    full = spark.createDataFrame(whole, "template int, label string, ranked array<string>, size int, need int, notice array<string>")
    least = min((need for *_, need, _ in whole), default=1)
    texts = kept.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("of"), F.col("h").alias("of_h"), "text")
    lines = texts.select("of", "of_h", F.explode(F.split("text", "\n")).alias("line"), F.lit(False).alias("over"))
    lines = lines.unionByName(texts.filter(F.contains("text", F.lit("\n"))).select("of", "of_h", F.col("text").alias("line"), F.lit(True).alias("over")))
    words = lines.select("of", "of_h", "over", words_of(F.col("line")).alias("line"))
    long = F.size("line") > BLOCK
    starts = F.when(long, F.sequence(F.lit(1), F.greatest(F.size("line") - (BLOCK - STEP), F.lit(1)), F.lit(STEP))).otherwise(F.array(F.lit(1)))
    blocks = words.filter(F.size("line") >= least).withColumn("start", F.explode(starts))
    blocks = blocks.select("of", "of_h", "over", F.slice("line", F.col("start"), F.lit(BLOCK)).alias("window"))
    known = F.filter("window", lambda w: F.array_contains(_strings(order), w))
    blocks = blocks.select("of", "of_h", F.when(F.col("over"), known).alias("run"), F.array_intersect(_strings(order), "window").alias("block")).filter(F.size("block") >= least)
    pairs = blocks.select("*", F.posexplode("block").alias("j", "word")).join(F.broadcast(index), "word").withColumn("j", F.col("j") + 1)
    # The first shared word decides: later ones of the same pair add nothing.
    pairs = pairs.join(F.broadcast(full), "template").filter((F.size("block") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("at"), F.size("block") - F.col("j")) >= F.col("need")))
    shared = F.size(F.array_intersect("ranked", "block"))
    met = pairs.withColumn("shared", shared).filter(F.col("shared") >= F.col("need"))
    met = met.filter(F.col("run").isNull() | (_in_order("run", "notice") >= F.col("need")))
    return met.groupBy("of", "of_h").agg(F.collect_set("label").alias("own"), F.max(F.col("shared") / F.col("size")).alias("best"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    sets = ", ".join(f"('{label}', {quote(sorted(set(t.split())))}, {_need(len(set(t.split())), THRESHOLD)})" for label, t in TEMPLATES)
    places = " || ".join(
        "list_filter(range(len(words)), lambda i: " + " AND ".join(f"words[i + {d + 1}] = '{w}'" for d, w in enumerate(p.split())) + ")" for p, _ in PHRASES
    )
    base = ", ".join(f"CASE WHEN contains(' ' || array_to_string(words, ' ') || ' ', ' {p} ') THEN '{label}' END" for p, label in PHRASES)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, text, regexp_extract_all({lower.format("text")}, '{word}') AS words FROM documents),
t AS (SELECT * FROM (VALUES {sets}) v(label, tokens, need)),
lines AS (SELECT doc_id, regexp_extract_all({lower.format("line")}, '{word}') AS line
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
blocks AS (SELECT doc_id, list_distinct(line[s:s + {BLOCK - 1}]) AS block
           FROM (SELECT doc_id, line, unnest(CASE WHEN len(line) > {BLOCK} THEN range(1, len(line) - {BLOCK - STEP} + 1, {STEP}) ELSE [1] END) AS s FROM lines)),
hit AS (SELECT doc_id, label, len(list_intersect(block, tokens)) / len(tokens) AS c, len(list_intersect(block, tokens)) >= need AS ok FROM blocks, t),
own AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS best FROM hit WHERE ok GROUP BY doc_id),
b AS (SELECT doc_id, len(words) AS n_words, {places} AS places, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM d)
SELECT b.doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base || coalesce(own.labels, []))), ',') AS labels,
       greatest(CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(best, 0.0::DOUBLE)) AS score
FROM b LEFT JOIN own USING (doc_id)"""


ORACLE = _sql()
