"""N-grams of texts: trigrams, and sparse n-grams by the weights of their windows.

Grams are of characters: a gram never cuts one, so a literal's grams are those of any text that holds it. Whole columns are
cut with arrays over the bytes of an Arrow batch; the functions on single strings cover literals, at the driver.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of texts that are cut at once; that an inverted list is made of; paths in one row of it, and in a batch of rows.
PIECE, SHARD, LIST, BATCH = 1 << 18, 4 << 20, 1 << 12, 1 << 17


def cover_trigrams(literal: str) -> list[str]:
    """The trigrams that a text with this literal must have; none if it is too short to narrow anything."""
    return list(dict.fromkeys(literal[i : i + 3] for i in range(len(literal) - 2)))


def crc_weight(pair: str) -> int:
    """The weight of a window of two characters."""
    return zlib.crc32(pair.encode())


class FrequencyWeights:
    """Weights by how rare a window is in a sample: rare windows make good ends of grams."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts

    def __call__(self, pair: str) -> int:
        return (1 << 32) // (1 + self.counts.get(pair, 0))


def sparse_spans(text: str, least: int = 3, most: int = 8, weigh=crc_weight) -> Iterator[tuple[int, int]]:
    """(start, end) of the sparse n-grams: spans whose first and last windows both outweigh every window between them.

    Windows are visited once; those that a later one outweighs can start no further gram and leave."""
    open_: list[tuple[int, int]] = []  # windows that may still start a gram, by falling weight
    for right in range(len(text) - 1):
        weight, through = weigh(text[right : right + 2]), True
        while open_ and through:
            left, own = open_[-1]
            if right + 2 - left > most:
                open_.clear()  # all others lie further left
                break
            if right + 2 - left >= least:
                yield left, right + 2
            through = own < weight
            if own <= weight:
                open_.pop()
        open_.append((right, weight))


def sparse_grams(text: str, least: int = 3, most: int = 8, weigh=crc_weight) -> list[str]:
    return list(dict.fromkeys(text[a:b] for a, b in sparse_spans(text, least, most, weigh)))


def cover_sparse(literal: str, least: int = 3, most: int = 8, weigh=crc_weight) -> list[str]:
    """The longest sparse n-grams of a literal: those that lie within another one are left out."""
    kept: list[tuple[int, int]] = []
    for a, b in sorted(set(sparse_spans(literal, least, most, weigh)), key=lambda s: (s[0] - s[1], s[0])):
        if not any(x <= a and b <= y for x, y in kept):
            kept.append((a, b))
    return list(dict.fromkeys(literal[a:b] for a, b in kept))


# Columns ------------------------------------------------------------------------------------------------------------------


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _characters(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of every character and the end, its bytes as one number, first character of every text and the end)."""
    begin = np.flatnonzero((raw & 0xC0) != 0x80)
    size = np.diff(begin, append=len(raw))
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    code = padded[begin].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        code[more] |= padded[begin[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.append(begin, len(raw)), code, np.searchsorted(begin, off)


def pair_weights(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """CRC-32 of every two neighbouring characters' bytes."""
    first, size = begin[:-2], begin[2:] - begin[:-2]
    crc = np.full(len(first), 0xFFFFFFFF, np.uint32)
    for k in range(int(size.max()) if len(size) else 0):
        on = slice(None) if k < 2 else np.flatnonzero(size > k)
        crc[on] = _CRC[(crc[on] ^ raw[first[on] + k]) & 0xFF] ^ crc[on] >> np.uint32(8)
    return crc ^ np.uint32(0xFFFFFFFF)


def _spans(raw: np.ndarray, begin: np.ndarray, least: int, most: int, sparse: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(length, first characters) of the grams of each length, as if all texts were one."""
    n = len(begin) - 1
    if not sparse:
        yield 3, np.arange(max(0, n - 2))
        return
    weight = pair_weights(raw, begin)
    between = None  # the heaviest window strictly between the two ends
    for length in range(3, most + 1):
        if n < length:
            return
        left, right = weight[: n - length + 1], weight[length - 2 : n - 1]
        if length > 3:
            own = weight[1 : n - length + 2] if between is None else np.maximum(between[: n - length + 1], weight[length - 3 : n - 2])
            between = own
        if length >= least:
            yield length, np.arange(len(left)) if between is None else np.flatnonzero(between < np.minimum(left, right))


def _hashes(code: np.ndarray, start: np.ndarray, length: int, seed: int) -> np.ndarray:
    out = np.full(len(start), length * seed & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(length):
        out = (out ^ code[start + k]) * np.uint64(seed | 1)
        out ^= out >> np.uint64(31)
    return out


def distinct_grams(texts: pa.Array, least: int = 3, most: int = 8, sparse: bool = False) -> pa.Array:
    """The distinct grams of every text of a string column (null: none), in order of their hashes."""
    raw, off = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw, off = raw[off[0] : off[-1]], off - off[0]
    begin, code, at = _characters(raw, off)
    code = code.astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    parts = []
    for length, start in _spans(raw, begin, least, most, sparse):
        start = start[start + length <= at[owner[start] + 1]]  # within its text
        parts.append((start, np.full(len(start), length)))
    start, length = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*parts) if parts else ([], [])))
    one, two = (np.empty(len(start), np.uint64) for _ in range(2))
    for size in np.unique(length):
        own = np.flatnonzero(length == size)
        one[own], two[own] = (_hashes(code, start[own], int(size), seed) for seed in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
    # In order of text and as much of the first hash as there is room for; equal neighbours are one gram only if both whole
    # hashes are equal, too, and if any aren't, the order is made by all of them.
    text, room = owner[start], np.uint64(len(texts).bit_length())
    key = text.astype(np.uint64) << (np.uint64(64) - room) | one >> room
    order = np.argsort(key)
    apart = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    if (apart & (key[order][1:] == key[order][:-1])).any():
        order = np.lexsort((two, one, text))
    text, one, two = text[order], one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (text[1:] != text[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    order, text = order[new], text[new]
    first, end = begin[start[order]], begin[start[order] + length[order]]
    ends = np.cumsum(end - first)
    data = raw[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - (end - first)), end - first)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    values = pa.StringArray.from_buffers(len(order), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), values)


def _pieces(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(off, int(off[start]) + most, "right")) - 1)
        yield texts.slice(start, min(end, len(texts)) - start)
        start = end


def grams_udf(least: int = 3, most: int = 8, sparse: bool = False):
    """A column function over Arrow batches: the distinct grams of each text."""

    @F.arrow_udf("array<string>")
    def grams(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.string())
        done = [distinct_grams(piece, least, most, sparse) for piece in _pieces(texts, PIECE)]
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.string()))

    return grams


def grams_of_files(least: int = 3, most: int = 8, sparse: bool = False):
    """For mapInArrow over (path, content): the path and distinct grams of each text, a batch for each piece of texts.

    Only one piece's grams are held, however long a batch's texts are; memory that was freed goes back behind each batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts, at = batch.column(0), batch.column(1).cast(pa.string()), 0
            for piece in _pieces(texts, PIECE):
                yield pa.RecordBatch.from_arrays([paths.slice(at, len(piece)), distinct_grams(piece, least, most, sparse)], ["path", "grams"])
                at += len(piece)
            del batch, paths, texts
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
                trim(0)

    return cut


def _runs(key: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return np.flatnonzero(new)


def _inverted_trigrams(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray] | None:
    """As inverted(), by one sort of numbers of three characters and a text; None if they don't fit in 64 bits."""
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    begin, code, at = _characters(raw, off - off[0])
    high = np.flatnonzero(code > 127)
    other, place = np.unique(code[high].byteswap(), return_inverse=True)  # the first byte leads: in order of UTF-8
    ascii_ = np.flatnonzero(np.bincount(code[code < 128], minlength=128))
    per, room = max(1, (len(ascii_) + len(other)).bit_length()), len(texts).bit_length()
    if 3 * per + room > 64:
        return None
    number = np.zeros(128, np.uint64)
    number[ascii_] = np.arange(len(ascii_))
    ids = number[code & np.uint32(127)]
    ids[high] = place.astype(np.uint64) + np.uint64(len(ascii_))
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(at))
    per, room = np.uint64(per), np.uint64(room)
    key = ((ids[:-2] << per | ids[1:-1]) << per | ids[2:]) << room | owner[2:]
    key = key[owner[:-2] == owner[2:]]  # within a text
    key.sort()
    key = key[_runs(key)]
    three, row = key >> room, (key & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64)
    first = _runs(three)
    three, mask = three[first], (np.uint64(1) << per) - np.uint64(1)
    spelt = np.stack([three >> per + per, three >> per & mask, three & mask], 1).astype(np.int64)
    letters = np.concatenate([ascii_.astype(np.uint32), other.byteswap()]).astype("<u4").view(np.uint8).reshape(-1, 4)
    size = np.concatenate([np.ones(len(ascii_), np.int64), (letters[len(ascii_) :] != 0).sum(1)])[spelt]
    data = letters[spelt][np.arange(4) < size[:, :, None]]
    offsets = np.concatenate([[0], np.cumsum(size.sum(1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())), first, row


def inverted(texts: pa.Array, least: int = 3, most: int = 8, sparse: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the grams of all texts in order of UTF-8, where each one's rows begin, rows): a gram's rows are the texts that hold it."""
    if not sparse and (out := _inverted_trigrams(texts)):
        return out
    cut = [distinct_grams(piece, least, most, sparse) for piece in _pieces(texts, PIECE)]
    lists = pa.concat_arrays(cut) if cut else pa.array([], pa.list_(pa.string()))
    owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    coded = lists.values.dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary.cast(pa.binary())))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rank = rank[np.asarray(coded.indices)]
    by = np.lexsort((owner, rank))
    return coded.dictionary.take(pa.array(order)), _runs(rank[by]), owner[by]


def lists_of_files(least: int = 3, most: int = 8, sparse: bool = False):
    """For mapInArrow over (path, content): gram, paths, in order of grams for every SHARD bytes or so of texts.

    Spark then sees a row for LIST paths of a gram in place of one for each of them."""

    def invert(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, texts = (pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
        values, first, row = inverted(texts, least, most, sparse)
        begin = np.union1d(first, np.arange(0, len(row), LIST))
        gram = np.searchsorted(first, begin, "right") - 1
        begin = np.append(begin, len(row))
        for a in range(0, len(row), BATCH):  # a multiple of LIST, so a row begins there
            i, j = np.searchsorted(begin, [a, min(a + BATCH, len(row))])
            lists = pa.ListArray.from_arrays(pa.array(begin[i : j + 1] - a, pa.int32()), paths.take(pa.array(row[a : begin[j]])))
            yield pa.RecordBatch.from_arrays([values.take(pa.array(gram[i:j])), lists], ["gram", "paths"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            texts, at = batch.column(1).cast(pa.string()), 0
            for piece in _pieces(texts, PIECE):
                held.append(pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(piece)), piece], ["path", "content"]))
                at, size = at + len(piece), size + held[-1].column(1).nbytes
                if size >= 2 * SHARD:  # shards are of SHARD bytes, some more, some less
                    yield from invert(held)
                    held, size = [], 0
        if held:
            yield from invert(held)
        held.clear()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)

    return cut


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text."""
    return grams_udf()(text)


class Extractor:
    """What cuts texts into grams, and which grams a literal demands: `trigram` or `sparse`."""

    def __init__(self, kind: str = "trigram", least: int = 3, most: int = 8):
        if kind not in ("trigram", "sparse"):
            raise ValueError(f"no extractor {kind}")
        self.kind, self.least, self.most = kind, least, most

    @property
    def id(self) -> str:
        return self.kind if self.kind == "trigram" else f"sparse-{self.least}-{self.most}"

    def grams(self, text: Column) -> Column:
        return trigrams(text) if self.kind == "trigram" else grams_udf(self.least, self.most, True)(text)

    def of_files(self, files):
        """path, grams of files(path, content)."""
        path = dict(files.dtypes)["path"]
        sparse = self.kind == "sparse"
        return files.select("path", "content").mapInArrow(grams_of_files(self.least, self.most, sparse), f"path {path}, grams array<string>")

    def lists_of_files(self, files):
        """gram, paths of files(path, content): a partition's files by gram; a gram may have several rows."""
        path = dict(files.dtypes)["path"]
        cut = lists_of_files(self.least, self.most, self.kind == "sparse")
        return files.select("path", "content").mapInArrow(cut, f"gram string, paths array<{path}>")

    def cover(self, literal: str) -> list[str]:
        return cover_trigrams(literal) if self.kind == "trigram" else cover_sparse(literal, self.least, self.most)
