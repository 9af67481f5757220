"""N-gram Jaccard join with signature trees, and the components of its links.

A document's set holds the hashes of its distinct shingles of k words (with fewer words, of the whole sequence). Two
documents link when 100 * intersection >= percent * union. Every link between different sets is decided by the signature
trees of `sigtree`; the steps before only bring together what could link, and none of them loses a link:

1. Documents with equal sets form a class. A shingle that no other document has can't be shared, and a set of n shingles
   needs ceil(percent * n / 100) shared ones: a document with more single shingles than that leaves over is done. Shingles
   are counted as 32 bits in ranges of the hash, a shingle that a chunk of documents has twice going out once for the chunk,
   so a passage that a third of all documents share costs a number for each chunk. (Bits that clash only keep more.)
2. Among the smallest documents of the classes that remain, shingles are counted again, and each set is put under those of
   its rarest n - ceil(percent * n / 100) + 1 shingles that another set has (prefix filter: similar sets share one).
   Sets under one shingle are linked with the least of them, a star and not all pairs; the stars' components are groups.
3. A group's sets are joined by dual traversal of their signature tree, groups together in tasks of bounded size; a group
   beyond `most_tokens` is cut into blocks by size of set, and each pair of blocks that sizes allow joins two trees.
   Every pair is decided. A task gives each set's number of links, weighted by the documents of the sets it links with, and a
   star for each component of its links, so a group of near copies costs comparisons but not a row for each pair.
4. Links become components with the smallest doc_id as their name; a document links with all others of its own set, too.

What one key may hold a third of (a class of copies, a common shingle, the least node of a component) is joined by broadcast of
its one label, so no task gets all rows of it; at most 65,536 keys are that frequent.

Defined cases: a null text or one without words has an empty set, links with nothing, and is a component of its own; rows
that repeat a doc_id take part each and are one document to `keep_one`; a null doc_id takes part and names a component only
if it has no other; an empty table gives no rows; texts of any length are read whole; extra columns are ignored, and kept
by `keep_one`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sigtree
from .common import FOLD, join_hot, materialize, release, slices, table, utf8
from .graph import components

SHINGLE, PERCENT, NEAR_SHINGLE, NEAR_PERCENT = 3, 90, 5, 80
CHUNK, PIECE = 4 << 20, 1 << 18
RANGE_CHARS, SETS_A_CHUNK, TASK_TOKENS, MOST_TOKENS = 16 << 20, 4096, 1 << 21, 1 << 22

_FOLD = np.frombuffer(FOLD, np.uint8)
_SEP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_RANDOM = np.random.RandomState(20240).randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(4) + np.uint64(1)
_BASE = np.uint64(0x2545F4914F6CDD1D)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), modulo 2^64; kept for the largest n so far."""
    if len(_powers.get(int(base), ())) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _powers[int(base)] = np.multiply.accumulate(steps)
    return _powers[int(base)][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes of all texts, first byte of every word, the byte behind it)."""
    data = _FOLD[raw[off[0] : off[-1]]]
    begin, n = off - off[0], len(data)
    sep = _SEP[data]
    new = np.zeros(n + 1, bool)
    new[begin] = True
    start = ~sep
    start[1:] &= sep[:-1] | new[1:n]
    stop = ~sep
    stop[:-1] &= sep[1:] | new[1:n]
    return data, np.flatnonzero(start), np.flatnonzero(stop) + 1


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of every word: a polynomial of its bytes."""
    out, done = np.empty(len(first), np.uint64), 0
    while done < len(first):  # some MB at a time; a word is never cut
        a = first[done]
        upto = max(done + 1, int(np.searchsorted(last, a + PIECE, "right")))
        b = last[upto - 1]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_RANDOM[data[a:b]] * _power(_BASE, b - a), out=sums[1:])
        out[done:upto] = (sums[last[done:upto] - a] - sums[first[done:upto] - a]) * _power(_BACK, b - a)[first[done:upto] - a]
        done = upto
    return mix(out)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the number of all)."""
    data, first, last = word_spans(raw, off)
    return span_hashes(data, first, last), np.searchsorted(first, off - off[0])


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every text, one after the other; offsets)."""
    words, at = word_hashes(raw, off)
    acc = words.copy()
    for j in range(1, k):
        acc = acc[: len(acc) - 1] * _BASE + words[j:] if len(acc) > 1 else acc[:0]
    acc = mix(acc)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            one = np.sort(acc[a : b - k + 1])
            if len(one) > 1:
                one = one[np.concatenate([[True], one[1:] != one[:-1]])]
            sets.append(one)
        elif b > a:  # the whole sequence; its length keeps it apart from shingles
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = np.uint64((int(whole) * int(_BASE) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            sets.append(mix(np.array([whole])))
        else:
            sets.append(words[:0])
    return np.concatenate(sets) if sets else words[:0], np.cumsum([0, *map(len, sets)])


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return run[offsets[1:]] - run[offsets[:-1]]


def set_ids(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set that doesn't depend on order."""
    return mix(_sums(mix(tokens ^ _BASE), offsets) + np.diff(offsets).astype(np.uint64)).view(np.int64)


def needed(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of this size must share with any similar one."""
    return -(-sizes * percent // 100)


def _cut(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(range of each token, its 32 bits there)."""
    ranges = (tokens >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)
    return ranges, (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _repeated(sorted_values: np.ndarray) -> np.ndarray:
    same = sorted_values[1:] == sorted_values[:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]])


def _binary(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


# 1. Documents whose shingles are nearly all shared ------------------------------------------------------------------------


def _small(values: np.ndarray) -> bytes:
    """Numbers as 16 bits if they fit, else 32."""
    return values.astype(np.uint32 if len(values) and values.max() > 0xFFFF else np.uint16).tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32).astype(np.int64)


def _spread(k: int, bits: int):
    """Chunks of documents to (src, r, n, docs, counts, once, more, meta), a row for each range r of the hash that has any:
    the n documents with single shingles (within the chunk) there, and how many, these shingles, those that the chunk has
    more than once, and, in its first row, the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", CHUNK):
            raw, off, _ = utf8(batch.column("text"))
            tokens, offsets = shingle_sets(raw, off, k)
            size = batch.num_rows
            order = np.argsort(tokens, kind="stable")
            again = np.zeros(len(tokens), bool)
            again[order] = _repeated(tokens[order]) if len(tokens) else False
            ranges, low = _cut(tokens[~again], bits)
            pair = ranges * size + np.repeat(np.arange(size), np.diff(offsets))[~again]
            by_range = np.argsort(pair, kind="stable")
            pair, low = pair[by_range], low[by_range]
            head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
            counts, of, doc = np.diff(head, append=len(pair)), pair[head] // size, pair[head] % size
            more_range, more_low = _cut(np.unique(tokens[again]), bits)
            filled = np.unique(np.concatenate([[0], of, more_range]))
            cuts = [[np.searchsorted(x, filled, side) for side in ("left", "right")] for x in (of, ranges[by_range], more_range)]
            meta = pickle.dumps((batch.column("doc_id").to_pylist(), np.diff(offsets), set_ids(tokens, offsets)))
            rows = []
            for r, a, b, c, d, e, f in zip(filled.tolist(), *(x.tolist() for cut in cuts for x in cut), strict=True):
                rows.append((src, r, b - a, _small(doc[a:b]), _small(counts[a:b]), low[c:d].tobytes(), more_low[e:f].tobytes(), meta if r == 0 else None))
            yield _binary(rows, ["src", "r", "n", "docs", "counts", "once", "more", "meta"], [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5])
            src += 1

    return run


def _alone(group: pa.Table) -> pa.Table:
    """For each chunk and document, how many of its shingles in this range are in no other document."""
    release()
    once = [np.frombuffer(x.as_py(), np.uint32) for x in group["once"]]
    more = [np.frombuffer(x.as_py(), np.uint32) for x in group["more"]]
    n = group["n"].to_pylist()
    every = np.concatenate([*once, *more])
    order = np.argsort(every, kind="stable")
    alone = np.ones(len(every), bool)
    if len(every):
        alone[order] = ~_repeated(every[order])
    out, place = [], 0
    for own, data, docs in zip(once, group["counts"], n, strict=True):
        ends = np.concatenate([[0], np.cumsum(_large(data.as_py(), docs))])
        out.append(_small(_sums(alone[place : place + len(own)].astype(np.int64), ends)))
        place += len(own)
    return pa.table([group["src"], group["n"], group["docs"], pa.array(out, pa.binary()), group["meta"]], names=["src", "n", "docs", "alone", "meta"])


def _documents(group: pa.Table) -> pa.Table:
    """doc_id, n, set_id, alone of a chunk."""
    ids, size, sets = pickle.loads(next(x.as_py() for x in group["meta"] if x.is_valid))
    alone = np.zeros(len(ids), np.int64)
    for n, docs, part in zip(group["n"].to_pylist(), group["docs"], group["alone"], strict=True):
        alone[_large(docs.as_py(), n)] += _large(part.as_py(), n)  # a document stands once in a range
    return pa.table([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(sets, pa.int64()), pa.array(alone)], names=["doc_id", "n", "set_id", "alone"])


def describe(docs: DataFrame, k: int, range_chars: int = RANGE_CHARS) -> DataFrame:
    """doc_id, n (size of the set), set_id, alone (shingles that no other document has) for each row of docs."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(0, int(chars // range_chars)).bit_length()
    spread = docs.mapInArrow(_spread(k, bits), "src long, r long, n long, docs binary, counts binary, once binary, more binary, meta binary")
    alone = spread.groupBy("r").applyInArrow(_alone, "src long, n long, docs binary, alone binary, meta binary")
    return materialize(alone.groupBy("src").applyInArrow(_documents, "doc_id long, n long, set_id long, alone long"), "jaccard-documents")


# 2. Groups ----------------------------------------------------------------------------------------------------------------


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK):
            raw, off, _ = utf8(batch.column("text"))
            tokens, offsets = shingle_sets(raw, off, k)
            blobs = [tokens[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(set_ids(tokens, offsets), pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(blobs, pa.binary())], ["set_id", "n", "tokens"])

    return run


def _read(group: pa.Table) -> tuple[list[int], list[np.ndarray]]:
    release()
    return group["set_id"].to_pylist(), [np.frombuffer(x.as_py(), np.uint64) for x in group["tokens"]]


def _ask(bits: int):
    """A chunk's distinct shingles with their numbers of sets, by range."""

    def run(group: pa.Table) -> pa.Table:
        _, sets = _read(group)
        tokens, count = np.unique(np.concatenate(sets), return_counts=True)
        ranges, low = _cut(tokens, bits)
        filled, begin = np.unique(ranges, return_index=True)
        src, ends = group["src"][0].as_py(), [*begin[1:].tolist(), len(tokens)]
        rows = [(src, r, low[a:b].tobytes(), count[a:b].astype(np.uint32).tobytes()) for r, a, b in zip(filled.tolist(), begin.tolist(), ends, strict=True)]
        return pa.table(_binary(rows, ["src", "r", "low", "count"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]).columns, names=["src", "r", "low", "count"])

    return run


def _answer(group: pa.Table) -> pa.Table:
    """To each chunk, the numbers of sets of its shingles in this range."""
    low = [np.frombuffer(x.as_py(), np.uint32) for x in group["low"]]
    count = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group["count"]])
    _, inverse = np.unique(np.concatenate(low), return_inverse=True)
    total = np.bincount(inverse, weights=count)[inverse].astype(np.uint32)
    ends = np.cumsum([0, *map(len, low)])
    return pa.table([group["src"], group["r"], pa.array([total[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["src", "r", "total"])


def _keys(bits: int, percent: int):
    """(key, set_id) for the rarest shingles of each set that another set has."""

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        key, of = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if group.num_rows:
            ids, sets = _read(group)
            tokens = np.unique(np.concatenate(sets))
            parts = dict(zip(answers["r"].to_pylist(), answers["total"], strict=True))
            total = np.concatenate([np.frombuffer(parts[r].as_py(), np.uint32) for r in sorted(parts)])
            for set_id, own in zip(ids, sets, strict=True):
                df = total[np.searchsorted(tokens, own)]
                prefix = np.lexsort((own, df))[: len(own) - int(needed(np.array(len(own)), percent)) + 1]
                prefix = prefix[df[prefix] > 1]
                key.append(own[prefix].view(np.int64))
                of.append(np.full(len(prefix), set_id))
        return pa.table([pa.array(np.concatenate(key), pa.int64()), pa.array(np.concatenate(of), pa.int64())], names=["key", "set_id"])

    return run


def groups(sets: DataFrame, percent: int) -> DataFrame:
    """node, root: for sets(set_id, n, tokens) that could link with another, a group that holds all its links."""
    n_sets, n_tokens = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = int(n_tokens // TASK_TOKENS).bit_length()
    chunks = max(1, -(-n_sets // SETS_A_CHUNK), -(-n_tokens // TASK_TOKENS))
    dealt = sets.withColumn("src", F.pmod(F.xxhash64("set_id"), F.lit(chunks)).cast("long"))
    asked = dealt.groupBy("src").applyInArrow(_ask(bits), "src long, r long, low binary, count binary")
    answers = asked.groupBy("r").applyInArrow(_answer, "src long, r long, total binary")
    keys = materialize(dealt.groupBy("src").cogroup(answers.groupBy("src")).applyInArrow(_keys(bits, percent), "key long, set_id long"), "jaccard-keys")
    least = keys.groupBy("key").agg(F.min("set_id").alias("v"), F.max("set_id").alias("w"), F.count("*").alias("held")).filter("v < w").select("key", "v", "held")
    stars = join_hot(keys, least, "key", "held", keys.count()).filter("set_id <> v").select(F.col("set_id").alias("u"), "v").distinct()
    return components(stars)


# 3. Signature trees -------------------------------------------------------------------------------------------------------


def _found(ids: list[int], weight: np.ndarray, a: np.ndarray, b: np.ndarray | None, sets: list[np.ndarray], percent: int) -> list[tuple]:
    """Rows (u, v, links) of the sets at places a, and b if given: a star for each component (u, v), and each set's links (u)."""
    right = a if b is None else b
    forest, count = sigtree.Forest(len(ids)), np.zeros(len(ids), np.int64)
    order = np.argsort(ids)
    rank = np.argsort(order)
    for x, y in sigtree.every_link([sets[i] for i in a], None if b is None else [sets[i] for i in b], percent):
        x, y = int(a[x]), right[y]
        count[x] += weight[y].sum()
        count[y] += weight[x]
        root = forest.find(int(rank[x]))
        apart = forest.up[rank[y]] != root
        if any([forest.join(int(rank[x]), z) for z in rank[y[apart]].tolist()]):
            forest.flat()
    label = forest.flat()
    stars = [(ids[order[i]], ids[order[r]], None) for i, r in enumerate(label.tolist()) if i != r]
    return stars + [(ids[i], None, n) for i, n in enumerate(count.tolist()) if n]


def _link_rows(out: list[tuple]) -> pa.Table:
    return pa.table([pa.array([row[i] for row in out], pa.int64()) for i in range(3)], names=["u", "v", "links"])


def _link_groups(percent: int):
    def run(group: pa.Table) -> pa.Table:
        ids, sets = _read(group)
        root, weight = np.array(group["root"].to_pylist()), np.array(group["copies"].to_pylist(), np.int64)
        order = np.argsort(root, kind="stable")
        ends = np.flatnonzero(np.concatenate([[True], root[order][1:] != root[order][:-1], [True]]))
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            own = order[a:b]
            out += _found([ids[i] for i in own], weight[own], np.arange(len(own)), None, [sets[i] for i in own], percent)
        return _link_rows(out)

    return run


def _link_blocks(percent: int):
    def run(group: pa.Table) -> pa.Table:
        ids, sets = _read(group)
        side, weight = np.array(group["side"].to_pylist()), np.array(group["copies"].to_pylist(), np.int64)
        b = np.flatnonzero(side == 1) if group["i"][0] != group["j"][0] else None
        return _link_rows(_found(ids, weight, np.flatnonzero(side == 0), b, sets, percent))

    return run


def _counted(found: DataFrame) -> DataFrame:
    return found.filter("links IS NOT NULL").groupBy(F.col("u").alias("of")).agg(F.sum("links").alias("links"))


def link(sets: DataFrame, grouped: DataFrame, percent: int, copies: DataFrame, most_tokens: int = MOST_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(node, root: components of the links among sets; of, links: the documents of other sets that a set links with).

    grouped is as `groups` gives it; copies has of, copies: the documents of a set. Sets without links are left out."""
    roots = grouped.select(F.col("root").alias("node"), "root").distinct()
    member = grouped.unionByName(roots)
    held = sets.dropDuplicates(["set_id"]).join(member, F.col("set_id") == F.col("node")).select("set_id", "n", "tokens", "root")
    held = materialize(held.join(copies, F.col("set_id") == F.col("of")).drop("of"), "jaccard-groups")
    sizes = held.groupBy("root").agg(F.sum("n").alias("total"))
    large = materialize(sizes.filter(F.col("total") > most_tokens).select(F.col("root").alias("big")), "jaccard-large")
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // TASK_TOKENS))
    bucket = F.pmod(F.xxhash64("root"), F.lit(tasks)).cast("int")
    some = not large.isEmpty()
    small = held.join(large, F.col("root") == F.col("big"), "left_anti") if some else held
    stars = small.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_link_groups(percent), "u long, v long, links long")
    if not some:
        found = materialize(stars, "jaccard-links")
        return found.filter("v IS NOT NULL").select(F.col("u").alias("node"), F.col("v").alias("root")), _counted(found)
    # A set's place among its group's tokens in order of size, from sums over sizes; sets of one size are spread by a hash.
    run = Window.partitionBy("root").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    cut = held.join(F.broadcast(large), F.col("root") == F.col("big"), "left_semi").select("set_id", "n", "root")
    place = cut.groupBy("root", "n").agg(F.sum("n").alias("own")).withColumn("before", F.coalesce(F.sum("own").over(run), F.lit(0)))
    share = F.pmod(F.xxhash64(F.lit(3), "set_id"), F.lit(1 << 20)) / (1 << 20)
    cut = cut.join(place, ["root", "n"]).withColumn("block", F.floor((F.col("before") + F.col("own") * share) / (most_tokens // 2)).cast("int"))
    cut = materialize(cut.select("set_id", "n", "root", "block"), "jaccard-blocks")
    blocks = cut.groupBy("root", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    first, second = (blocks.select("root", F.col("block").alias(b), F.col("least").alias(f"least_{b}"), F.col("most").alias(f"most_{b}")) for b in "ij")
    near = (F.col("i") <= F.col("j")) & (F.col("most_i") * 100 >= F.col("least_j") * percent)
    pairs = materialize(first.join(second, "root").filter(near).select(F.col("root").alias("of"), "i", "j"), "jaccard-pairs")
    of, block = F.col("root") == F.col("of"), F.col("block")
    left = cut.join(pairs, of & (block == F.col("i"))).withColumn("side", F.lit(0))
    right = cut.join(pairs, of & (block == F.col("j")) & (F.col("i") < F.col("j"))).withColumn("side", F.lit(1))
    met = left.unionByName(right).select("set_id", "root", "i", "j", "side").join(held.select("set_id", "tokens", "copies"), "set_id")
    across = met.groupBy("root", "i", "j").applyInArrow(_link_blocks(percent), "u long, v long, links long")
    found = materialize(stars.unionByName(across), "jaccard-links")
    return components(found.filter("v IS NOT NULL").select("u", "v")), _counted(found)


# 4. Documents -------------------------------------------------------------------------------------------------------------


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, most_tokens: int = MOST_TOKENS, range_chars: int = RANGE_CHARS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), n_links (other rows that this one links with) for
    each row of docs(doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = describe(texts, k, range_chars)
    classes = rows.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min("alone").alias("alone"), F.count("*").alias("copies"))
    classes = materialize(classes, "jaccard-classes")
    open_ = classes.filter(F.col("n") - F.col("alone") >= F.ceil(F.col("n") * percent / 100)).select("rep", "set_id")
    kind = "set_id long, n long, tokens binary"
    sets = texts.join(open_.hint("merge"), texts["doc_id"] == open_["rep"], "left_semi").mapInArrow(_sets(k), kind)
    # Classes without any doc_id have no representative to ask for: their rows are found by their sets.
    nameless = texts.filter("doc_id IS NULL").mapInArrow(_sets(k), kind).join(open_.filter("rep IS NULL").select("set_id"), "set_id", "left_semi")
    sets = materialize(sets.unionByName(nameless.dropDuplicates(["set_id"])), "jaccard-sets")
    copies = classes.select(F.col("set_id").alias("of"), "copies")
    linked, counted = link(sets, groups(sets, percent), percent, copies, most_tokens)
    # Components and links are settled among classes; then each row meets its class's label.
    named = classes.join(linked, F.col("set_id") == F.col("node"), "left").join(counted, F.col("set_id") == F.col("of"), "left")
    named = named.select("set_id", "rep", "copies", F.coalesce("root", "set_id").alias("name"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")).filter("n_links > 0")
    named = materialize(named, "jaccard-named")
    least = named.groupBy("name").agg(F.min("rep").alias("component_id"), F.count("*").alias("held"))
    labels = join_hot(named, least, "name", "held", named.count()).select("set_id", "component_id", "n_links", "copies")
    labels = materialize(labels, "jaccard-labels")
    some, label = rows.filter("n > 0"), F.coalesce("component_id", "doc_id").alias("component_id")
    met = join_hot(some, labels, "set_id", "copies", some.count(), "left").select("doc_id", F.col("n").alias("n_shingles"), label, F.coalesce("n_links", F.lit(0)).alias("n_links"))
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return met.unionByName(empty)


def keep_one(docs: DataFrame, k: int = NEAR_SHINGLE, percent: int = NEAR_PERCENT) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component."""
    rows = join(docs, k, percent)
    gone = rows.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def _sql(k: int = SHINGLE, percent: int = PERCENT) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS s
      FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [1] ELSE range(1, len(w) - {k} + 2) END) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS far FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.far = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a) k USING (doc_id) JOIN (SELECT doc_id, min(far) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id"""


ORACLE = _sql()
