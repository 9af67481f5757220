"""Benchmark decontamination by suffix arrays of the training texts.

Words are runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased. The words of a shard (some MB of documents)
are numbered, 0 standing after each document, and its suffix array has all its suffixes in order, each up to its document's
end: places are sorted by their first words, then by prefix doubling until none tie but equal suffixes. The array knows
nothing of the benchmark. Every test suffix is searched in it, all at once: a binary search for each further word narrows
the range of places that share what has been read so far, down to a window's occurrences. From those whose words before
differ, the longest verbatim matches are read off.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.

Documents are read once. The benchmark is sent to the executors in blocks of rows of bounded size (`block_bytes` of text; a
longer item stands alone); a shard's array is searched for one block after the other, and a worker holds one at a time.

Defined cases: a null or empty text has no words and no hits; a null item or one without words matches nothing; rows that
repeat are reported for each row; an empty benchmark leaves
all documents clean; items that share an item_id count once; extra columns are ignored, and kept by `remove`; a document
longer than a shard is a shard, with about 40 bytes a word.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD_ALNUM, slices, table, utf8

WINDOW, BLOCK_BYTES, SHARD_BYTES, PIECE_BYTES = 10, 8 << 20, 4 << 20, 1 << 20


def words(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD_ALNUM).split()


# Suffix arrays ------------------------------------------------------------------------------------------------------------


class Shard:
    """The words of some texts as numbers, and their suffix array."""

    def __init__(self, raws: list[bytes]):
        self.names: dict[bytes, int] = defaultdict(count(1).__next__)
        number, parts, ends = self.names.__getitem__, [], []
        for raw in raws:
            folded, at, n = raw.translate(FOLD_ALNUM), 0, 0
            while at < len(folded):  # a long text's words are never all held
                end = folded.find(b" ", at + PIECE_BYTES)
                own = folded[at : end if end >= 0 else len(folded)].split()
                parts.append(np.fromiter(map(number, own), np.int32, len(own)))
                at, n = (end if end >= 0 else len(folded)), n + len(own)
            parts.append(np.zeros(1, np.int32))
            ends.append(n + 1)
        self.names.default_factory = None
        self.numbers = np.concatenate([np.empty(0, np.int32), *parts])
        size = np.array(ends, np.int64)
        self.begin, self.counts = np.cumsum(size) - size, size - 1
        self.array = suffix_array(self.numbers)
        #: Where the suffixes that begin with each number lie in the array.
        self.edge = np.concatenate([[0], np.cumsum(np.bincount(self.numbers[self.array], minlength=len(self.names) + 1))])


def suffix_array(numbers: np.ndarray) -> np.ndarray:
    """The places of all numbers but 0 in the order of what follows up to the next 0; equal suffixes by place.

    A place's rank is where its group, of places with equal first `h` numbers, begins in the array. Groups that still tie
    are sorted by the ranks of the places `h` further on, and `h` doubles."""
    places = np.flatnonzero(numbers).astype(np.int32)
    if not len(places):
        return places
    stops = np.flatnonzero(numbers == 0)
    run = (stops[np.searchsorted(stops, np.arange(len(numbers)))] - np.arange(len(numbers))).astype(np.int32)
    bits = int(numbers.max()).bit_length()
    h = max(1, min(4, 63 // bits))
    key = np.zeros(len(places), np.uint64)
    for k in range(h):
        key <<= np.uint64(bits)
        some = np.flatnonzero(run[places] > k)
        key[some] |= numbers[places[some] + k].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    array, key = places[order], key[order]
    rank = np.zeros(len(numbers), np.int32)  # from 1; 0 is that of an end
    new = np.append(True, key[1:] != key[:-1])
    head = np.flatnonzero(new)
    rank[array] = np.repeat(head, np.diff(head, append=len(array))) + 1
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in the array
    while True:
        tied = tied[run[array[tied]] >= h]  # others are equal up to the end of their documents: equal suffixes, and settled
        if not len(tied):
            return array
        own = array[tied]
        key = rank[own].astype(np.uint64) << np.uint64(32) | rank[own + h].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        array[tied] = own
        group, new = key >> np.uint64(32), np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        within = np.arange(len(own)) - np.repeat(first, np.diff(first, append=len(own)))
        head = np.flatnonzero(new)
        rank[own] = np.repeat(group[head].astype(np.int32) + within[head].astype(np.int32), np.diff(head, append=len(own)))
        tied, h = tied[~(new & np.append(new[1:], True))], 2 * h


# Test suffixes ------------------------------------------------------------------------------------------------------------


@dataclass
class Suffixes:
    """Test suffixes of a block of the benchmark."""

    vocabulary: list[bytes]
    words: np.ndarray  # places in the vocabulary, all items one after the other
    start: np.ndarray  # where each suffix that starts a window begins among them
    length: np.ndarray  # words of its window
    item: np.ndarray  # place of its item in ids
    begin: np.ndarray  # where each item begins, and the last one ends
    ids: list  # item_id


def test_suffixes(items: list[tuple], window: int) -> Suffixes:
    names: dict[bytes, int] = defaultdict(count().__next__)
    parts, ids = [], []
    for item_id, text in items:
        if found := words((text or "").encode()):
            parts.append(np.fromiter(map(names.__getitem__, found), np.int32, len(found)))
            ids.append(item_id)
    size = np.array([len(p) for p in parts], np.int64)
    begin, length = np.concatenate([[0], np.cumsum(size)]), np.minimum(size, window)
    windows = size - length + 1
    item = np.repeat(np.arange(len(ids)), windows)
    start = begin[item] + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
    return Suffixes(list(names), np.concatenate([np.empty(0, np.int32), *parts]), start, length[item], item, begin, ids)


def _bound(shard: Shard, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
    """The first place of each range low..high of the array whose suffix has at least `word` at `depth`; high if none."""
    low, high = low.copy(), high.copy()
    while len(on := np.flatnonzero(low < high)):
        middle = (low[on] + high[on]) >> 1
        less = shard.numbers[shard.array[middle] + depth] < word[on]
        low[on[less]] = middle[less] + 1
        high[on[~less]] = middle[~less]
    return low


def search(shard: Shard, suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(test words by the shard's numbers or -1, first and end of the range of each test suffix's window in the array)."""
    get = shard.names.get
    known = np.fromiter((get(w, -1) for w in suffixes.vocabulary), np.int32, len(suffixes.vocabulary))
    test = known[suffixes.words]
    word = test[suffixes.start]
    low, high = np.where(word > 0, shard.edge[word], 0), np.where(word > 0, shard.edge[word + 1], 0)
    for depth in range(1, int(suffixes.length.max()) if len(suffixes.length) else 0):
        on = np.flatnonzero((low < high) & (suffixes.length > depth))
        word = test[suffixes.start[on] + depth]
        low[on] = _bound(shard, low[on], high[on], depth, word)
        high[on] = np.where(word > 0, _bound(shard, low[on], high[on], depth, word + 1), low[on])
    return test, low, high


def longest(shard: Shard, suffixes: Suffixes) -> np.ndarray:
    """Rows (doc, start, words, item, start in the item): the longest matches with a window of a test suffix or more."""
    test, low, high = search(shard, suffixes)
    number = high - low
    which = np.repeat(np.arange(len(number)), number)
    place = shard.array[np.repeat(low, number) + np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)].astype(np.int64)
    at, item = suffixes.start[which], suffixes.item[which]
    # With equal words before, the match is part of a longer one; before a document stands a 0, of another or the last one.
    new = (at == suffixes.begin[item]) | (shard.numbers[place - 1] != test[at - 1])
    which, place, at, item = which[new], place[new], at[new], item[new]
    size, width, on = suffixes.length[which], 8, np.arange(len(which))
    stop = suffixes.begin[item + 1]
    while len(on):  # read on, more words at a time the longer the matches
        room, further = max(1, (1 << 20) // width), []
        for some in (on[i : i + room] for i in range(0, len(on), room)):
            step = size[some][:, None] + np.arange(width)
            there, here = at[some][:, None] + step, place[some][:, None] + step
            same = there < stop[some][:, None]
            same &= shard.numbers[np.minimum(here, len(shard.numbers) - 1)] == test[np.minimum(there, len(test) - 1)]
            more = np.logical_and.accumulate(same, axis=1).sum(1)
            size[some] += more
            further.append(some[more == width])
        on, width = np.concatenate(further), min(2 * width, 1 << 16)
    doc = np.searchsorted(shard.begin, place, "right") - 1
    found = np.stack([doc, place - shard.begin[doc], size, item, at - suffixes.begin[item]], 1) if len(which) else np.empty((0, 5), np.int64)
    return found[np.lexsort(found.T[::-1])]


_MATCH = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())]))


def _shards(batches: Iterator[pa.RecordBatch], blocks: list) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[list[dict]]]]:
    """(batch that makes up a shard, words and matches of each of its rows)."""
    for batch in slices(batches, "text", SHARD_BYTES):
        raw, off, valid = utf8(batch.column("text"))
        whole = raw[off[0] : off[-1]].tobytes()
        shard = Shard([whole[a:b] if v else b"" for a, b, v in zip(off[:-1] - off[0], off[1:] - off[0], valid, strict=True)])
        rows: list[list] = [[] for _ in range(batch.num_rows)]
        for block in blocks:
            suffixes = block.value
            for d, start, n, item, item_start in longest(shard, suffixes).tolist():
                rows[d].append({"start": start, "n_words": n, "item_id": str(suffixes.ids[item]), "item_start": item_start})
            if len(blocks) > 1:
                block.__dict__.pop("_value", None)  # read again from the executor's file: one block is held at a time
        yield batch, shard.counts, rows


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's rows in blocks of about block_bytes of text, one at a time at the driver."""
    held, size = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _shared(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """The blocks' suffixes, sorted out once and broadcast, each of a bounded size; the driver keeps none."""
    out = []
    for items in blocks(benchmark, block_bytes):
        out.append(benchmark.sparkSession.sparkContext.broadcast(test_suffixes(items, window)))
        out[-1].__dict__.pop("_value", None)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, matches: longest verbatim matches (start, n_words, item_id, item_start), for each row of docs."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = _shared(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, counts, rows in _shards(batches, shared):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(rows, _MATCH)], ["doc_id", "n_words", "matches"])

    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(run, f"doc_id {kind}, n_words long, matches array<struct<start: long, n_words: long, item_id: string, item_start: long>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from what `matches` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, items, names = [], [], []
            for spans in batch.column("matches").to_pylist():
                end = hit = 0
                for s in sorted(spans or [], key=lambda s: s["start"]):
                    stop = s["start"] + s["n_words"]
                    hit += max(0, stop - max(end, s["start"]))
                    end = max(end, stop)
                own = sorted({s["item_id"] for s in spans or []})
                hits.append(hit)
                items.append(len(own))
                names.append(hashlib.sha256(",".join(own).encode()).hexdigest())
            columns = [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(items, pa.int64()), pa.array(names, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = dict(found.dtypes)["doc_id"]
    return found.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs."""
    shared = _shared(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, rows in _shards(batches, shared):
            yield batch.filter(pa.array([not m for m in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + least(len(w), {WINDOW}) - 1] AS win
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, i, item_id FROM dw JOIN win USING (win)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
