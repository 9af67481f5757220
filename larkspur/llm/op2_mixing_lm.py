"""Language-model scores by online logistic context mixing, beside a unigram base score.

The model codes the bytes of a text (A-Z folded to a-z, white space as it stands) and then an end symbol. A symbol is a
path of binary decisions in a Huffman tree that the two bytes before it pick (the one before, where the two are rare),
built from the corpus's counts, so a byte costs under three decisions. Four predictors look at each decision. Three have it
by a hashed context on top of the tree's: the last two bytes, the last four, and the word so far; their tables hold counts of
zeros and ones from all training documents. The fourth is a match model: after some words (a content hash picks every
`EVERY`th or so) it expects the bytes that most often followed the same three words in other training documents; that
table is kept exactly, range by range of the hash, and grows with the corpus, as the word counts do.

In scoring the tables are frozen; the mixer is online: predictions are stretched to the logistic domain and summed with
weights from a set that the decision's depth and a sureness gate pick, the weights follow the coding error after every
decision, and an adaptive map of (gate, predicted probability) refines the result. A text is coded from its first byte to
its end, one decision after the other: contexts, weights and map belong to the text and live for the whole of it, and each
decision is coded with all changes of those before. What goes side by side are texts, in chunks of about the same length; a
text of more than `LANE` bytes goes on from piece to piece. The score is the log10 probability of the text; `bits` its code
length.

Base score: tokens are words without white space and one end per document; with c the token's count in the training texts,
N all training tokens and V the distinct ones, it is the sum of log10((c + 1) / (N + V + 1)). Words are counted by 64-bit
hashes: documents are dealt to chunks by hash, a chunk asks for the totals of its distinct words, range by range of the
hash, and gets them back, so neither a vocabulary nor a frequent word is ever gathered in one place. The match model's
bytes go the same way; a training document asks for what other documents have.

What is broadcast has a proven bound: `slots()` bytes of tables and the paths of at most 2,305 trees.

Defined cases: a null or empty text has one token, its end; rows that repeat are learned from and scored each; without
training documents every count is 0 and all decisions start even; an empty table gives no rows; other columns are ignored;
a null doc_id is not held out.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, slices, table, utf8
from .op6_jaccard import span_hashes, word_spans

FOLDS, HELD_OUT = 7, 2
#: A lane is a whole text; of a longer one than LANE bytes, that many are in memory at a time.
LANE, BATCH, TRAIN_BATCH, CHUNK_CHARS, RANGE_CHARS = 1 << 23, 1 << 25, 1 << 18, 8 << 20, 32 << 20
#: Texts that go side by side at most, each with its weights and map (1,120 bytes), which stay in a processor's cache, too.
MOST_LANES = 1 << 10
#: Decisions that are laid out for the coder at a time, so that they stay in a processor's cache, and the least of them a lane.
WINDOW, LEAST_STEPS = 1 << 16, 32
#: The least size of long texts (of 11,585 bytes and more).
LONG = 27
#: Symbols that are counted at a time, after equal ones are put together.
COUNT_BATCH = 1 << 21
BITS, LINE, TABLE_BLOCK, PRIOR, SCALE = (20, 22, 22), 32, 1 << 16, 0.1, 16
PAIR_BLOCKS = (1 << BITS[0]) // TABLE_BLOCK
END, SYMBOLS = 256, 257
#: Pairs of bytes with at least this share of all bytes have a tree of their own; bytes, with so many of them behind.
PAIR_SHARE, BYTE_LEAST = 1 / 2048, 64
#: The match model: one in EVERY triples of words is kept, with the FOLLOW bytes behind it.
EVERY, FOLLOW = 32, 48
DEPTHS, SURE, BUCKETS, RATE, MAP_RATE, MAP_SHARE = 8, (0.05, 2.6, 4.0), 24, 0.08, 0.04, 0.4
#: First weights of the predictors (the fourth is the match, or a bias without one) by the gate: how sure the word's
#: prediction is, and last, whether there is a match.
WEIGHTS = ((0.35, 0.7, 0.0, 0.0), (0.3, 0.48, 0.45, 0.0), (0.2, 0.45, 0.5, 0.0), (0.1, 0.5, 0.5, 0.0), (0.1, 0.2, 0.3, 0.9))
LEVELS, MATCHED = len(WEIGHTS), len(WEIGHTS) - 1
BIAS = 5
#: Buckets of the adaptive map a unit of the logistic domain: sums are kept in buckets, and so are the weights.
CELLS = BUCKETS / 16

_FOLD = np.frombuffer(FOLD, np.uint8)
_SPREAD = np.uint32(0x9E3779B1)
_BASE32 = 0x2C1B3C6D
_BACK32 = pow(_BASE32, -1, 1 << 32)


def slots() -> int:
    return sum(1 << b for b in BITS)


def _paths(counts: list[float]) -> list[list[tuple[int, int]]]:
    """(node, bit) from the root to each symbol of a Huffman tree."""
    heap = [(c, s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    inner: list[tuple[int, int]] = []
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        inner.append((x, y))
        heapq.heappush(heap, (a + b, SYMBOLS + len(inner), SYMBOLS + len(inner) - 1))
    paths: list[list[tuple[int, int]]] = [[] for _ in range(SYMBOLS)]
    stack: list[tuple[int, list]] = [(SYMBOLS + len(inner) - 1, [])]
    while stack:
        node, path = stack.pop()
        if node < SYMBOLS:
            paths[node] = path
            continue
        for bit, child in enumerate(inner[node - SYMBOLS]):
            stack.append((child, [*path, (len(inner) - 1 - (node - SYMBOLS), bit)]))  # the root is 0
    return paths


class Code:
    """Huffman paths of the 257 symbols after each pair of bytes (0 at the start): path `tree[pair] + symbol`.

    Counts are those of pair * 257 + symbol (keys, in order). Counts after a context are mixed with a few of all bytes'
    counts, and rare symbols count as one in 2^13, so that no path is long."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        pair, symbol = keys // SYMBOLS, keys % SYMBOLS
        every = np.bincount(symbol, weights=counts, minlength=SYMBOLS) + 1
        rows, tree = [self._tree(every)], np.zeros(65536, np.int32)
        by_byte = np.bincount((pair & 255) * SYMBOLS + symbol, weights=counts, minlength=256 * SYMBOLS).reshape(256, SYMBOLS)
        for byte in np.flatnonzero(by_byte.sum(1) >= BYTE_LEAST):
            tree[byte::256] = len(rows)
            rows.append(self._tree(by_byte[byte] + every / every.sum()))
        by_pair = np.bincount(pair, weights=counts, minlength=65536)
        for p in np.flatnonzero(by_pair >= max(BYTE_LEAST, PAIR_SHARE * by_pair.sum())):
            own = slice(*np.searchsorted(pair, [p, p + 1]))
            tree[p] = len(rows)
            rows.append(self._tree(np.bincount(symbol[own], weights=counts[own], minlength=SYMBOLS) + every / every.sum()))
        flat = [p for row in rows for p in row]
        size = np.array([len(p) for p in flat], np.int32)
        self.tree = tree * np.int32(SYMBOLS)
        self.length, self.start = size, (np.cumsum(size) - size).astype(np.int32)
        self.node = np.array([n for p in flat for n, _ in p], np.uint8)
        self.bit = np.array([b for p in flat for _, b in p], np.uint8)
        depth = np.array([min(d, DEPTHS - 1) for p in flat for d in range(len(p))], np.uint16)
        # The slot on a line (nodes are numbered from the root, so that likely ones share none), the depth above it, the bit on top.
        self.info = self.node.astype(np.uint16) % LINE | depth << np.uint16(8) | self.bit.astype(np.uint16) << np.uint16(15)

    @staticmethod
    def _tree(counts: np.ndarray) -> list[list[tuple[int, int]]]:
        return _paths(np.maximum(counts, counts.sum() / (1 << 13)).tolist())


class Tail:
    """What contexts need of each lane's symbols before: the last four, and the polynomial of the word so far with its next power.

    The first lane may go on from the last one of another."""

    def __init__(self, lanes: int = 1, before: Tail | None = None):
        self.last = [np.zeros(lanes, np.uint32) for _ in range(4)]
        self.word, self.power = np.zeros(lanes, np.uint32), np.ones(lanes, np.uint32)
        if before is not None:
            self.put(0, before.rows(-1))

    def rows(self, lane) -> Tail:
        out = Tail(0)
        out.last, out.word, out.power = [x[lane] for x in self.last], self.word[lane], self.power[lane]
        return out

    def put(self, lane, other: Tail) -> None:
        for mine, new in zip((*self.last, self.word, self.power), (*other.last, other.word, other.power), strict=True):
            mine[lane] = new


def _shifted(x: np.ndarray, begin: np.ndarray, before=0) -> np.ndarray:
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[begin] = before
    return out


def _before(symbols: np.ndarray, begin: np.ndarray, tail: Tail, n: int = 4) -> list[np.ndarray]:
    """The symbols one to n places before each; lanes go on from tail, which is moved to their ends."""
    out, end = [symbols], np.append(begin[1:], len(symbols)) - 1
    for k in range(n):
        out.append(_shifted(out[-1], begin, tail.last[k]))
    tail.last[:n] = [x[end].astype(np.uint32) for x in out[:n]]
    return out[1:]


_power: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the polynomial's base and of its inverse, modulo 2^32; kept for the largest n so far."""
    if not _power or len(_power[0]) < n + 1:
        _power.clear()
        for base in (_BASE32, _BACK32):
            steps = np.full(n + 1, base, np.uint32)
            steps[0] = 1
            _power.append(np.multiply.accumulate(steps, dtype=np.uint32))
    return _power


def contexts(symbols: np.ndarray, begin: np.ndarray, tail: Tail | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """(the two bytes before each symbol, 32 spread bits for each predictor's context); lanes begin at `begin`.

    Lanes go on from tail, which is moved to their ends; none is empty."""
    tail = tail or Tail(len(begin))
    one, two, three, four = _before(symbols.astype(np.uint32), begin, tail)
    pair = one | two << np.uint32(8)
    quad = pair | three << np.uint32(16)
    quad |= four << np.uint32(24)
    # The word so far: a polynomial of its bytes, from running sums.
    n = len(symbols)
    power, back = _powers(n)
    sums = np.zeros(n + 1, np.uint32)
    np.cumsum((symbols + np.uint32(1)) * power[:n], out=sums[1:], dtype=np.uint32)
    fresh = np.empty(n + 1, bool)
    fresh[1:] = (symbols == 32) | (symbols - np.uint16(9) < 5)
    end = np.append(begin[1:], n)
    ended = fresh[end]
    fresh[begin] = fresh[n] = True
    starts = np.flatnonzero(fresh)
    size, starts = np.diff(starts), starts[:-1]
    first = np.searchsorted(starts, begin)
    last = np.append(first[1:], len(starts)) - 1
    scale, so_far, next_power = back[starts], np.zeros(len(starts), np.uint32), power[size]
    scale[first] *= tail.power
    so_far[first] = tail.word
    next_power[first] *= tail.power
    of = _owners(starts, n)
    word = sums[:n] - np.take(sums[starts], of)
    word *= np.take(scale, of)
    word += np.take(so_far, of)
    tail.word = np.where(ended, np.uint32(0), (sums[end] - sums[starts[last]]) * scale[last] + so_far[last])
    tail.power = np.where(ended, np.uint32(1), next_power[last])
    word ^= word >> np.uint32(16)
    word *= np.uint32(0xC2B2AE35)
    word += one * np.uint32(0x5BD1E995)
    return pair, [_line(k, c) for k, c in enumerate((pair, quad, word))]


def _line(k: int, context: np.ndarray) -> np.ndarray:
    """A slot of table k for each context: nodes go to the slots around it, so that a symbol's decisions share a line."""
    spread = context * _SPREAD
    spread ^= spread >> np.uint32(15)
    spread *= np.uint32(0x846CA68B)
    spread >>= np.uint32(32 - BITS[k])
    return spread


def lanes(raw: np.ndarray, off: np.ndarray, batch: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(symbols, begins of lanes, text of each lane, place of the first byte in the texts) for some lanes at a time.

    A lane is a text with its end, or `LANE` symbols of a longer one; such a text goes on as the first lane of the next batch."""
    data, begin, n = raw[off[0] : off[-1]], off - off[0], len(off) - 1
    stop = begin[1:] + np.arange(1, n + 1)  # texts with their ends, one after the other
    start = np.concatenate([[0], stop[:-1]]) if n else stop
    count = -(-(stop - start) // LANE)
    owner = np.repeat(np.arange(n), count)
    first = start[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * LANE
    ends = np.append(first[1:], stop[-1] if n else 0)
    on = np.append(np.flatnonzero(owner[1:] == owner[:-1]) + 1, len(owner))
    done = 0
    while done < len(owner):
        upto = max(done + 1, int(np.searchsorted(ends, first[done] + batch, "right")))
        upto = min(upto, done + MOST_LANES, int(on[np.searchsorted(on, done, "right")]))
        a, b = int(first[done]), int(ends[upto - 1])
        own = slice(owner[done], owner[upto - 1] + 1)
        symbols = np.empty(b - a, np.uint16)
        last = stop[own][stop[own] <= b] - 1 - a
        byte = np.ones(b - a, bool)
        byte[last] = False
        place = a - int(owner[done])
        symbols[byte] = _FOLD[data[place : place + b - a - len(last)]]
        symbols[last] = END
        yield symbols, first[done:upto] - a, owner[done:upto], place
        done = upto


def tailed(raw: np.ndarray, off: np.ndarray, batch: int) -> Iterator[tuple[np.ndarray, np.ndarray, Tail]]:
    """(symbols, begins, tail) of `lanes`, where a text that goes on does so from its tail."""
    tail, last = None, -1
    for symbols, begin, owner, _ in lanes(raw, off, batch):
        tail = Tail(len(begin), tail if owner[0] == last else None)
        yield symbols, begin, tail
        last = owner[-1]


class _Shared:
    """A broadcast value with a name by which a worker keeps what it makes of it."""

    def __init__(self, broadcast):
        self.id, self._broadcast = broadcast._jbroadcast.id(), broadcast

    @property
    def value(self):
        return self._broadcast.value

    def __getstate__(self):
        return {"id": self.id, "_broadcast": self._broadcast}


def _owners(first: np.ndarray, n: int) -> np.ndarray:
    """Which part each of n places is in; parts begin at first, the first one at 0, and none is empty.

    Taking values by it costs a fraction of repeating them, where parts are short."""
    out = np.zeros(n, np.int64)
    out[first[1:]] = 1
    return np.cumsum(out, out=out)


def decisions(code: Code, path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(decisions of each symbol, where each symbol's begin and the last ones end, symbol of each, place in the code of each)."""
    length = np.take(code.length, path)
    ends = np.zeros(len(path) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    each = _owners(ends[:-1], int(ends[-1]))
    at = np.take(np.take(code.start, path) - ends[:-1], each)
    at += np.arange(len(at))
    return length, ends, each, at


# Training ---------------------------------------------------------------------------------------------------------------


def _sparse(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(keys.astype(np.int32).tobytes() + counts.astype(np.int64).tobytes(), 1)


def _summed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, summed counts) of some `_sparse` ones."""
    keys, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for part in map(zlib.decompress, parts):
        n = len(part) // 12
        keys.append(np.frombuffer(part, np.int32, n))
        counts.append(np.frombuffer(part, np.int64, n, 4 * n))
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, inverse, np.concatenate(counts))
    return found, total


def _histogram(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(65536 * SYMBOLS, np.uint32)
        for batch in slices(batches, "text", 4 * TRAIN_BATCH):
            raw, off, _ = utf8(batch.column("text"))
            for symbols, begin, tail in tailed(raw, off, TRAIN_BATCH):
                one, two = _before(symbols.astype(np.int32), begin, tail, 2)
                key = (one | two << 8) * SYMBOLS + symbols
                key.sort()
                last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
                counts[key[last]] += np.diff(last, prepend=-1).astype(np.uint32)
        keys = np.flatnonzero(counts)
        g = TaskContext.get().partitionId() % groups
        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([_sparse(keys, counts[keys])], pa.binary())], ["g", "data"])

    return run


def _add_histograms(group: pa.Table) -> pa.Table:
    total = _sparse(*_summed([x.as_py() for x in group["data"]]))
    return pa.table([group["g"].slice(0, 1), pa.array([total], pa.binary())], names=["g", "data"])


def _add_symbols(code: Code, path: np.ndarray, context: np.ndarray, times: np.ndarray, counts: np.ndarray) -> None:
    """Adds the decisions of symbols (path) after contexts, so many times each, to a table's zeros and ones."""
    _, _, each, at = decisions(code, path)
    info = np.take(code.info, at)
    slot = np.take(context << np.uint32(1), each)
    slot ^= (info & np.uint16(LINE - 1)) << np.uint16(1) | info >> np.uint16(15)
    np.add.at(counts, slot, np.take(times.astype(counts.dtype), each))


def _add_held(code: Code, held: list[list[np.ndarray]], counts: list[np.ndarray]) -> None:
    """Adds held (context, path) keys of each table, those that are equal at once, and empties the lists."""
    for keys, own in zip(held, counts, strict=True):
        key = np.concatenate([np.empty(0, np.uint64), *keys])
        keys.clear()
        key.sort()
        last = np.flatnonzero(np.append(key[1:] != key[:-1], True)) if len(key) else np.empty(0, np.int64)
        key = key[last]
        _add_symbols(code, (key & np.uint64(0xFFFFFFFF)).astype(np.int64), (key >> np.uint64(32)).astype(np.uint32), np.diff(last, prepend=-1), own)


def _pair_blocks(code: Code, keys: np.ndarray, counts: np.ndarray) -> list[tuple[int, bytes]]:
    """The blocks of the table of two bytes, from the counts of pair * 257 + symbol that the trees are made of."""
    total = np.zeros(2 << BITS[0], np.int64)
    for a in range(0, len(keys), COUNT_BATCH // 4):
        pair, symbol = np.divmod(keys[a : a + COUNT_BATCH // 4], SYMBOLS)
        _add_symbols(code, code.tree[pair] + symbol, _line(0, pair.astype(np.uint32)), counts[a : a + COUNT_BATCH // 4], total)
    parts = total.reshape(-1, 2 * TABLE_BLOCK)
    return [(block, zlib.compress(_stretched(part).tobytes(), 1)) for block, part in enumerate(parts) if part.any()]


def _count(shared: _Shared, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        counts, held = [np.zeros(2 << b, np.uint32) for b in BITS[1:]], [[] for _ in BITS[1:]]
        for batch in slices(batches, "text", 4 * TRAIN_BATCH):
            raw, off, _ = utf8(batch.column("text"))
            for symbols, begin, tail in tailed(raw, off, TRAIN_BATCH):
                pair, kept = contexts(symbols, begin, tail)
                path = (np.take(own.tree, pair) + symbols).astype(np.uint64)
                for context, keys in zip(kept[1:], held, strict=True):
                    keys.append(context.astype(np.uint64) << np.uint64(32) | path)
                if sum(map(len, held[0])) >= COUNT_BATCH:
                    _add_held(own, held, counts)
        _add_held(own, held, counts)
        block, g = PAIR_BLOCKS, TaskContext.get().partitionId() % groups
        for one in counts:
            for a in range(0, len(one), 2 * TABLE_BLOCK):
                part = one[a : a + 2 * TABLE_BLOCK]
                if part.any():
                    wide = part.dtype if part.max() > 0xFFFF else np.uint16
                    data = zlib.compress(part.astype(wide).tobytes(), 1)
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([g], pa.int32()), pa.array([data], pa.binary())], ["block", "g", "data"])
                block += 1

    return run


def _block_sum(group: pa.Table) -> np.ndarray:
    total = np.zeros(2 * TABLE_BLOCK, np.int64)
    for data in group["data"]:
        raw = zlib.decompress(data.as_py())
        total += np.frombuffer(raw, {2: np.uint16, 4: np.uint32, 8: np.int64}[len(raw) // len(total)])
    return total


def _add(group: pa.Table) -> pa.Table:
    data = zlib.compress(_block_sum(group).tobytes(), 1)
    return pa.table([group["block"].slice(0, 1), pa.array([data], pa.binary())], names=["block", "data"])


def _stretched(total: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.log((total[1::2] + PRIOR) / (total[0::2] + PRIOR)) * SCALE), -127, 127).astype(np.int8)


def _finish(group: pa.Table) -> pa.Table:
    """A block's stretched probabilities of a one, in steps of 1 / SCALE."""
    stretched = _stretched(_block_sum(group))
    return pa.table([group["block"].slice(0, 1), pa.array([zlib.compress(stretched.tobytes(), 1)], pa.binary())], names=["block", "data"])


def train(texts: DataFrame, partitions: int = 1) -> tuple[Code, list[tuple[int, bytes]]]:
    """(the code, blocks of the predictors' tables) of texts(text); both have a bounded size.

    What partitions have counted is added in two steps, about the square root of their number at a time, so that no task and
    not the driver ever holds a part of each."""
    groups = max(1, round(partitions**0.5))
    parts = texts.mapInArrow(_histogram(groups), "g int, data binary").groupBy("g").applyInArrow(_add_histograms, "g int, data binary")
    after_pairs = _summed([bytes(row["data"]) for row in parts.toLocalIterator()])
    code = Code(*after_pairs)
    shared = _Shared(texts.sparkSession.sparkContext.broadcast(code))
    blocks = texts.mapInArrow(_count(shared, groups), "block int, g int, data binary")
    if groups > 1:
        blocks = blocks.groupBy("block", "g").applyInArrow(_add, "block int, data binary")
    longer = blocks.groupBy("block").applyInArrow(_finish, "block int, data binary").collect()
    return code, [*_pair_blocks(code, *after_pairs), *((r["block"], bytes(r["data"])) for r in longer)]


def tables(blocks: list[tuple[int, bytes]]) -> list[np.ndarray]:
    out = [np.zeros(1 << b, np.int8) for b in BITS]
    place = [(k, a) for k, b in enumerate(BITS) for a in range(0, 1 << b, TABLE_BLOCK)]
    for block, data in blocks:
        k, a = place[block]
        out[k][a : a + TABLE_BLOCK] = np.frombuffer(zlib.decompress(data), np.int8)
    return out


# Scoring ----------------------------------------------------------------------------------------------------------------


def first_state(texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of four weights, each as one 16-byte number; adaptive map) of some texts."""
    weights = np.tile(np.repeat(np.array(WEIGHTS, np.float32) * np.float32(CELLS / SCALE), DEPTHS, axis=0), (texts, 1)).view(np.complex128).ravel()
    centre = (np.arange(BUCKETS, dtype=np.float32) + 0.5) * (16 / BUCKETS) - 8
    return weights, np.tile(1 / (1 + np.exp(-centre)), texts * LEVELS).astype(np.float32)


def code_lengths(symbols: np.ndarray, begin: np.ndarray, owner: np.ndarray, code: Code, predictors: list[np.ndarray], expected=None, state=None):
    """(bits of each lane, state of the last text); state: of the first text, where it goes on. Lanes are of different texts.

    expected: the byte that the match model expects at each byte (ends have no place) or -1, and how many it has had right so
    far."""
    n = len(symbols)
    weights, refined = first_state(int(owner[-1] - owner[0]) + 1)
    before, done = None, np.zeros(len(begin), np.int64)
    if state is not None:
        weights[: LEVELS * DEPTHS], refined[: LEVELS * BUCKETS], before, done[0] = state
    tail = Tail(len(begin), before)
    # Decisions up to each symbol; of the whole batch, no more than these and the symbols is kept.
    ends = np.zeros(n + 1, np.int32)
    for a in range(0, n, TRAIN_BATCH):
        b = min(n, a + TRAIN_BATCH)
        own = begin[slice(*np.searchsorted(begin, [a, b]))] - a
        if a and len(own) and own[0] == 0:
            before = None
        own = own if len(own) and own[0] == 0 else np.append(0, own)
        before = Tail(len(own), before)
        one, two = _before(symbols[a:b].astype(np.int32), own, before, 2)
        np.cumsum(np.take(code.length, np.take(code.tree, one | two << 8) + symbols[a:b]), out=ends[a + 1 : b + 1])
        ends[a + 1 : b + 1] += ends[a]
    # Lanes in step, some decisions of each at a time; the long ones go on when the others are at their ends.
    text = (owner - owner[0]).astype(np.int64)
    bits, lane, place, stop = np.zeros(len(begin)), np.arange(len(begin)), begin.astype(np.int64), np.append(begin[1:], n)
    while len(lane):
        most = max(LEAST_STEPS, WINDOW // len(lane))
        upto = _upto(ends, place, stop, most)
        size = upto - place
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum()))
        at += np.repeat(place - first, size)
        some, own = np.take(symbols, at), tail.rows(lane)
        pair, kept = contexts(some, first, own)
        tail.put(lane, own)
        known = None
        if expected is not None:
            at -= np.repeat(text[lane], size)
            known = np.take(expected[0], at), expected[1], at
        bits[lane] += _window(code, predictors, np.take(code.tree, pair), some, kept, known, size, done[lane], text[lane], weights, refined)
        done[lane] += ends[upto] - ends[place]
        more = upto < stop
        lane, place, stop = lane[more], upto[more], stop[more]
    return bits, (weights[-LEVELS * DEPTHS :], refined[-LEVELS * BUCKETS :], tail, int(done[-1]))


def _upto(ends: np.ndarray, place: np.ndarray, stop: np.ndarray, most: int) -> np.ndarray:
    """Where each lane's next symbols of at most so many decisions end; one symbol at least. Each has a decision at least,
    so it is looked for near the place."""
    goal, upto, step = np.take(ends, place) + np.int32(most), place + 1, 1 << most.bit_length() - 1
    while step:
        further = np.minimum(upto + step, stop)
        upto = np.where(np.take(ends, further) <= goal, further, upto)
        step >>= 1
    return upto


#: How fast the weights follow, by the decisions of the text so far; the last one stands for all later ones.
#: Half of it, as errors are doubled.
_RATES = (CELLS * RATE / 2 / SCALE**2 * np.maximum(0.15, 1 / (1 + np.arange(2048) / 256))).astype(np.float32)


#: What clip() of an array calls, behind checks that cost more than it does.
_clip = np._core.umath.clip


def _window(code: Code, predictors, tree, symbols, kept, known, size, done, text, weights, refined) -> np.ndarray:
    """Bits of some symbols of lanes (size: of each lane) that go in step; weights and map are changed in place."""
    length, ends, each, at = decisions(code, tree + symbols)
    info = np.take(code.info, at)
    near = info & np.uint16(LINE - 1)
    inputs = np.empty((len(at), 4), np.int8)
    for k, (context, table) in enumerate(zip(kept, predictors, strict=True)):
        slot = np.take(context, each)
        slot ^= near
        inputs[:, k] = own = np.take(table, slot)
    inputs[:, 3] = BIAS
    gate = np.take(_GATE, own.view(np.uint8))
    info >>= np.uint16(8)
    gate |= info.astype(np.uint8)
    if known is not None:
        _expect(inputs, gate, code, at, tree, length, ends, *known)
    # Lanes by falling number of decisions: those that have one in a step are the first ones. Decisions go by step, then lane.
    stop = np.cumsum(size)
    begin = ends[stop - size]
    events = ends[stop] - begin
    order = np.argsort(-events, kind="stable")
    active = len(events) - np.searchsorted(events[order][::-1], np.arange(int(events[order[0]])), "right")
    first = np.concatenate([[0], np.cumsum(active)])
    lane = np.arange(len(at))
    lane -= np.repeat(first[:-1], active)
    step = np.repeat(np.arange(len(active)), active)
    some = np.take(begin[order], lane)
    some += step
    x, gates = np.take(inputs.view(np.uint32).ravel(), some), np.take(gate, some)
    young = done.min() < len(_RATES)
    if young:
        step += np.take(done[order], lane)
        rates = np.take(_RATES, step, mode="clip")
    row = np.take(text[order] * (LEVELS * DEPTHS), lane)
    row += gates & _LOW
    cell = row >> _DEPTH_BITS
    cell *= BUCKETS
    x = x.view(np.int8).astype(np.float32)
    y = (gates >> _SEVEN).astype(np.float32)
    pull = y * np.float32(MAP_RATE)
    y += y
    y -= np.float32(1)
    # In the loop stands only what the next step needs; all numbers but the inputs are 32-bit. Chances are
    # kept as twice their distance from a half, which is tanh of half the sum, and so are the bits (y). A step has few
    # lanes, so that calls cost more than their work: numbers are arrays without axes, which need not be made into arrays.
    mixed, mapped = np.empty(len(at), np.float32), np.empty(len(at), np.float32)
    ones, single, whole = np.ones(4, np.float32), np.dtype(np.float32), np.dtype(np.int64)
    keep, low, high, middle, back, rate = (np.array(v, np.float32) for v in (1 - MAP_RATE, -7.99 * CELLS, 7.99 * CELLS, BUCKETS / 2, 0.5 / CELLS, _RATES[-1]))
    cuts = first.tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        r, inside, own = row[a:b], x[4 * a : 4 * b], mapped[a:b]
        w = weights.take(r)
        parts = w.view(single)
        t = (parts * inside).reshape(-1, 4).dot(ones)
        _clip(t, low, high, t)
        q = (t + middle).astype(whole)
        q += cell[a:b]
        t *= back
        p = np.tanh(t, mixed[a:b])
        refined.take(q, out=own, mode="clip")
        own = own * keep
        own += pull[a:b]
        refined[q] = own
        error = y[a:b] - p
        error *= rates[a:b] if young else rate
        inside *= error.repeat(4)
        parts += inside
        weights[r] = w
    mapped -= np.float32(0.5)
    mapped *= np.float32(MAP_SHARE)
    mixed *= np.float32((1 - MAP_SHARE) / 2)
    mixed += mapped
    mixed *= y
    mixed += np.float32(0.5)  # the chance of the bit
    cost = mixed
    np.maximum(cost, np.float32(1e-6), out=cost)
    np.log2(cost, out=cost)
    out = np.empty(len(order))
    out[order] = np.bincount(lane, weights=cost, minlength=len(order))
    return -out


def _expect(inputs, gate, code: Code, at, tree, length, ends, hoped, right, byte) -> None:
    """Puts the match model's word in: the decision that leads to the expected symbol, where the path so far is its path."""
    symbol = np.flatnonzero(hoped >= 0)
    if not len(symbol):
        return
    want = np.take(tree, symbol) + np.take(hoped, symbol)
    both = np.minimum(np.take(length, symbol), np.take(code.length, want))  # decisions that the two paths may share
    first, n = np.cumsum(both) - both, int(both.sum())
    each, depth = _owners(first, n), np.arange(n)
    some = np.take(np.take(ends, symbol) - first, each) + depth
    there = np.take(np.take(code.start, want) - first, each) + depth
    ok = np.flatnonzero(np.take(code.node, there) == np.take(code.node, np.take(at, some)))
    some, there, each = np.take(some, ok), np.take(there, ok), np.take(each, ok)
    push = SCALE + np.minimum(np.take(right, np.take(byte, symbol)), 16).astype(np.int64) * (SCALE // 4)
    inputs[some, 3] = (np.take(code.bit, there).astype(np.int64) * 2 - 1) * np.take(push, each)
    gate[some] = MATCHED * DEPTHS | (np.take(code.info, np.take(at, some)) >> np.uint16(8)).astype(np.uint8)


#: The gate's first row of weights by a prediction's byte. Its lowest bits are the depth, its highest the bit.
_GATE = (sum((np.abs(np.arange(256).astype(np.int8).astype(int)) > least * SCALE) for least in SURE) * DEPTHS).astype(np.uint8)
_SEVEN, _LOW, _DEPTH_BITS = np.uint8(7), np.uint8(127), DEPTHS.bit_length() - 1


def text_bits(raw: np.ndarray, off: np.ndarray, code: Code, predictors: list[np.ndarray], expected=None) -> np.ndarray:
    """Code length of each text with its end, in bits; expected is by byte of the texts, with one place more.

    First bytes have nothing expected, so that ends, which read the place behind their text, don't either."""
    out, state, last = np.zeros(len(off) - 1), None, -1
    for symbols, begin, owner, place in lanes(raw, off):
        known = None if expected is None else (expected[0][place:], expected[1][place:])
        bits, state = code_lengths(symbols, begin, owner, code, predictors, known, state if owner[0] == last else None)
        out += np.bincount(owner, weights=bits, minlength=len(out))
        last = owner[-1]
    return out


# Matches ----------------------------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, words: np.ndarray, stop: np.ndarray, at: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of three words, byte behind them, text) of every anchor; at: first word of each text."""
    if len(words) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    key = (words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + words[2:]
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    some = np.flatnonzero(key % np.uint64(EVERY) == 0)
    text = np.searchsorted(at, some + 2, "right") - 1
    some, text = some[some >= at[text]], text[some >= at[text]]
    return key[some], stop[some + 2], text


def behind(data: np.ndarray, place: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The FOLLOW bytes from each place, 0 from the end of its text on."""
    step = place[:, None] + np.arange(FOLLOW)
    out = np.concatenate([data, np.zeros(FOLLOW, np.uint8)])[step]
    out[step >= end[:, None]] = 0
    return out


def expectations(data: np.ndarray, place: np.ndarray, end: np.ndarray, hoped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(expected byte or -1, number right before) of every byte: what an anchor expects holds until the first one is wrong."""
    out, right = np.full(len(data) + 1, -1, np.int16), np.zeros(len(data) + 1, np.int16)
    if len(place):
        good = hoped == behind(data, place, end)
        run = np.cumprod(np.concatenate([np.ones((len(place), 1), bool), good[:, :-1]], axis=1), axis=1, dtype=np.int8)
        step = place[:, None] + np.arange(FOLLOW)
        alive = (run > 0) & (step < end[:, None]) & (hoped > 0)
        out[step[alive]] = hoped[alive]
        right[step[alive]] = np.broadcast_to(np.arange(FOLLOW, dtype=np.int16), step.shape)[alive]
    return out, right


# Words ------------------------------------------------------------------------------------------------------------------


class Chunk:
    """Words and anchors of some texts; the same whatever order the texts come in."""

    def __init__(self, group: pa.Table):
        self.raw, self.off, _ = utf8(group["text"].combine_chunks() if group.num_rows else pa.array([], pa.string()))
        begin = self.off - self.off[0]
        self.data, first, last = word_spans(self.raw, self.off)
        self.words, self.at = span_hashes(self.data, first, last), np.searchsorted(first, begin)
        self.learned = ~np.array(group["held_out"].to_pylist(), bool)
        self.anchor, self.place, self.text = anchors(self.data, self.words, last, self.at, begin)
        self.end = begin[1:][self.text]
        self.distinct = np.unique(self.anchor)
        # What training texts have behind an anchor: (anchor, bytes) in order, with the number of texts.
        own = self.learned[self.text]
        self.follow = behind(self.data, self.place, self.end)
        key = _entry(self.anchor[own], self.follow[own])
        self.entry, inverse = np.unique(key, return_inverse=True)
        pair = np.unique(inverse * np.int64(len(self.off)) + self.text[own])
        self.texts = np.bincount(pair // len(self.off), minlength=len(self.entry)).astype(np.uint32)


_WIDE = 8 + FOLLOW


def _entry(anchor: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Anchor (big end first) and bytes as one fixed-length value."""
    out = np.empty((len(anchor), _WIDE), np.uint8)
    out[:, :8] = anchor.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8:] = follow
    return out.view(f"S{_WIDE}").ravel()


def _anchor_of(entry: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(entry.view(np.uint8).reshape(-1, _WIDE)[:, :8]).view(">u8").ravel().astype(np.uint64)


def _ends(values: np.ndarray, bits: int, ranges: np.ndarray) -> np.ndarray:
    """(first, end) of the values of each range, values in order."""
    top = values >> np.uint64(64 - bits) if bits else np.zeros(len(values), np.uint64)
    return np.stack([np.searchsorted(top, ranges, "left"), np.searchsorted(top, ranges, "right")], 1)


def _ranges(bits: int, *values: np.ndarray) -> np.ndarray:
    """Range 0 and those in which some value lies."""
    top = [v >> np.uint64(64 - bits) if bits else np.zeros(len(v), np.uint64) for v in values]
    return np.unique(np.concatenate([np.zeros(1, np.uint64), *top]))


_ASKED = [("src", pa.int64()), ("r", pa.int64()), ("word", pa.binary()), ("n", pa.binary()), ("anchor", pa.binary()), ("entry", pa.binary()), ("texts", pa.binary()), ("docs", pa.int64())]
_ASKED_DDL = "src long, r long, word binary, n binary, anchor binary, entry binary, texts binary, docs long"


def _ask(bits: int):
    """A chunk's distinct words by range of the hash, with their counts in its training texts; its anchors, and what its
    training texts have behind them; with range 0, its ends."""

    def run(group: pa.Table) -> pa.Table:
        c = Chunk(group)
        taught = np.sort(c.words[np.repeat(c.learned, np.diff(c.at))])
        distinct = np.unique(c.words)
        n = (np.searchsorted(taught, distinct, "right") - np.searchsorted(taught, distinct, "left")).astype(np.uint32)
        ranges, by_entry = _ranges(bits, distinct, c.distinct), _anchor_of(c.entry)
        cuts = zip(ranges.tolist(), _ends(distinct, bits, ranges), _ends(c.distinct, bits, ranges), _ends(by_entry, bits, ranges), strict=True)
        src, docs = group["src"][0].as_py(), int(c.learned.sum())
        rows = [
            (src, r, distinct[slice(*w)].tobytes(), n[slice(*w)].tobytes(), c.distinct[slice(*a)].tobytes(), c.entry[slice(*e)].tobytes(), c.texts[slice(*e)].tobytes(), docs if r == 0 else 0)
            for r, w, a, e in cuts
        ]
        return pa.table([pa.array([x[i] for x in rows], t) for i, (_, t) in enumerate(_ASKED)], names=[name for name, _ in _ASKED])

    return run


def _joined(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a column of binaries, where each row's begin and end)."""
    parts = [np.frombuffer(x.as_py(), kind) for x in column]
    return np.concatenate([np.empty(0, kind), *parts]), np.cumsum([0, *map(len, parts)])


def _answer(group: pa.Table) -> pa.Table:
    """To each chunk the totals of its words, and of its anchors which bytes stand behind most often, and in how many texts:
    by place among the chunk's own entries, or the bytes."""
    words, cut = _joined(group["word"], np.uint64)
    n, _ = _joined(group["n"], np.uint32)
    found, inverse = np.unique(words, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, inverse, n.astype(np.int64))
    wide = np.int64 if len(sums) and sums.max() > 0xFFFFFFFF else np.uint32
    total = sums[inverse].astype(wide)
    totals = [total[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]

    entries, e_cut = _joined(group["entry"], f"S{_WIDE}")
    texts, _ = _joined(group["texts"], np.uint32)
    known, inverse = np.unique(entries, return_inverse=True)
    count = np.zeros(len(known), np.int64)
    np.add.at(count, inverse, texts.astype(np.int64))
    of = _anchor_of(known)
    order = np.lexsort((np.arange(len(known)), -count, of))
    best = order[np.append(True, of[order][1:] != of[order][:-1])] if len(order) else order
    named = of[best]
    asked, a_cut = _joined(group["anchor"], np.uint64)
    most, own, blobs = [], [], []
    for i in range(group.num_rows):
        mine = asked[a_cut[i] : a_cut[i + 1]]
        at = np.minimum(np.searchsorted(named, mine), max(len(named) - 1, 0))
        hit = named[at] == mine if len(named) else np.zeros(len(mine), bool)
        entry = np.where(hit, best[at], -1) if len(named) else np.full(len(mine), -1)
        held = inverse[e_cut[i] : e_cut[i + 1]]  # in order, as the chunk's entries are
        place = np.searchsorted(held, entry)
        mine_too = hit & (place < len(held)) & (held[np.minimum(place, max(len(held) - 1, 0))] == entry) if len(held) else np.zeros(len(mine), bool)
        most.append(np.where(hit, np.minimum(count[entry], 0xFFFFFFFF), 0).astype(np.uint32).tobytes() if len(known) else bytes(4 * len(mine)))
        own.append(np.where(mine_too, place, -1).astype(np.int32).tobytes())
        blobs.append(known[entry[hit & ~mine_too]].tobytes())
    binary = lambda rows: pa.array(rows, pa.binary())
    columns = [group["src"], group["r"], binary(totals), pa.array(np.full(group.num_rows, wide == np.int64)), binary(most), binary(own), binary(blobs)]
    return pa.table(columns, names=["src", "r", "total", "wide", "most", "own", "blob"])


_ANSWER_DDL = "src long, r long, total binary, wide boolean, most binary, own binary, blob binary"


def _totals(group: pa.Table) -> pa.Table:
    """A range's distinct and counted words, and the ends."""
    words, _ = _joined(group["word"], np.uint64)
    n, _ = _joined(group["n"], np.uint32)
    row = [0, len(np.unique(words[n > 0])), int(n.sum(dtype=np.int64)), sum(group["docs"].to_pylist())]
    return pa.table([pa.array([x], t) for x, t in zip(row, [pa.int32(), *[pa.int64()] * 3], strict=True)], names=["k", "distinct", "counted", "docs"])


def _hopes(c: Chunk, answers: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """What is expected at each byte of the chunk, from the answers to its anchors."""
    ranges = np.array(answers["r"].to_pylist(), np.uint64)
    by_range, by_entry = _ends(c.distinct, bits, ranges), _ends(_anchor_of(c.entry), bits, ranges)
    most = np.zeros(len(c.distinct), np.int64)
    best = np.zeros(len(c.distinct), f"S{_WIDE}")
    for i, ((a, b), (e, _)) in enumerate(zip(by_range, by_entry, strict=True)):
        if b > a:
            most[a:b] = np.frombuffer(answers["most"][i].as_py(), np.uint32)
            own = np.frombuffer(answers["own"][i].as_py(), np.int32)
            part = best[a:b]
            part[own >= 0] = c.entry[e + own[own >= 0]]
            part[(own < 0) & (most[a:b] > 0)] = np.frombuffer(answers["blob"][i].as_py(), f"S{_WIDE}")
    which = np.searchsorted(c.distinct, c.anchor)
    hoped = best[which].view(np.uint8).reshape(-1, _WIDE)[:, 8:]
    # A training text is one of those that have what it has itself.
    others = most[which] - (c.learned[c.text] & (hoped == c.follow).all(1)) if len(which) else most[which]
    some = others > 0
    return expectations(c.data, c.place[some], c.end[some], hoped[some])


def _word_sums(c: Chunk, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, known words, sum of log10(count + 1) of the words) of each text."""
    distinct, inverse = np.unique(c.words, return_inverse=True)
    parts = [np.frombuffer(x.as_py(), np.int64 if w else np.uint32).astype(np.int64) for x, w in zip(answers["total"], answers["wide"].to_pylist(), strict=True)]
    found = np.concatenate([np.empty(0, np.int64), *parts])[inverse]
    tokens = np.diff(c.at) + 1
    owner = np.repeat(np.arange(len(tokens)), tokens - 1)
    known = np.bincount(owner, weights=found > 0, minlength=len(tokens)).astype(np.int64)
    return tokens, known, np.bincount(owner, weights=np.log10(found + 1), minlength=len(tokens))


_SCORES = ["doc_id", "held_out", "n_tokens", "known", "logs", "bits", "n_bytes", "k"]


def _score(shared, bits: int):
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(pc.binary_length(group["text"])))  # texts that go side by side end together
        c = Chunk(group)
        answers = answers.sort_by("r").combine_chunks()
        tokens, known, logs = _word_sums(c, answers)
        hopes, raw, off = _hopes(c, answers, bits), c.raw, c.off
        del c, answers  # the coder has its own arrays
        code, predictors = _model(shared)
        length = text_bits(raw, off, code, predictors, hopes)
        out = [tokens, known, logs, length, np.diff(off), np.zeros(len(tokens), np.int32)]
        return pa.table([group["doc_id"], group["held_out"], *map(pa.array, out)], names=_SCORES)

    return run


_models: dict[int, tuple[Code, list[np.ndarray]]] = {}


def _model(shared) -> tuple[Code, list[np.ndarray]]:
    if shared.id not in _models:
        _models.clear()
        code, blocks = shared.value
        _models[shared.id] = code, tables(blocks)
    return _models[shared.id]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _size(text: Column) -> Column:
    """0 to 62; texts of one size differ in length by less than the square root of two."""
    return F.floor(2 * F.log2(F.octet_length(text) + 1)).cast("int")


def _dealing(sizes: list[tuple[int, int, int]], chunk_chars: int) -> tuple[list[int], list[int]]:
    """(first chunk, number of chunks) by size of text, from (size, texts, characters): texts of a chunk are about as long
    as each other, so that many go in step to their ends. Sizes that have too little for a chunk share one; chunks of long
    texts, which take more steps, have twice as much."""
    base, chunks, done = [0] * 64, [1] * 64, 0
    own, n, chars = [], 0, 0
    for i, (size, texts, length) in enumerate(sorted(sizes, reverse=True)):
        own, n, chars = [*own, size], n + texts, chars + length
        most = chunk_chars * (1 + (size >= LONG))
        if chars >= most or i == len(sizes) - 1:
            count = max(1, -(-chars // most), -(-n // 100_000))
            for x in own:
                base[x], chunks[x] = done, count
            own, n, chars, done = [], 0, 0, done + count
    return base, chunks


def score(docs: DataFrame, chunk_chars: int = CHUNK_CHARS, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Scores of docs(doc_id, text, held_out), learning from rows that are not held out."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "held_out")
    size = _size(F.col("text"))
    placed = rows.withColumn("part", F.spark_partition_id()).groupBy(size.alias("size"))
    sizes = [tuple(x) for x in placed.agg(F.count("*"), F.sum(F.length("text")), F.max("part")).collect()]  # at most 63
    learned = train(rows.filter(~F.col("held_out")).select("text"), max([0, *(x[3] for x in sizes)]) + 1)
    shared = _Shared(rows.sparkSession.sparkContext.broadcast(learned))
    base, chunks = _dealing([x[:3] for x in sizes], chunk_chars)
    bits = int(sum(x[2] for x in sizes) // range_chars).bit_length()
    # The partition is part of the hash, so that many rows that are alike in id and text aren't one chunk.
    of = lambda values: F.get(F.array(*map(F.lit, values)), size)
    dealt = rows.withColumn("src", (of(base) + F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), of(chunks))).cast("long"))
    asked = dealt.groupBy("src").applyInArrow(_ask(bits), _ASKED_DDL)
    answers = asked.groupBy("r").applyInArrow(_answer, _ANSWER_DDL)
    totals = asked.groupBy("r").applyInArrow(_totals, "k int, distinct long, counted long, docs long").groupBy("k")
    totals = totals.agg(*[F.sum(c).alias(c) for c in ("distinct", "counted", "docs")])  # one row
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, n_tokens long, known long, logs double, bits double, n_bytes long, k int"
    scored = dealt.groupBy("src").cogroup(answers.groupBy("src")).applyInArrow(_score(shared, bits), schema).join(F.broadcast(totals), "k")
    ends = (F.col("docs") > 0).cast("long")
    all_tokens = F.col("counted") + F.col("docs")
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + ends).alias("n_known"), all_tokens.alias("train_tokens"),
        (F.col("logs") + F.log10(F.col("docs") + 1) - F.col("n_tokens") * F.log10(all_tokens + F.col("distinct") + ends + 1)).alias("base_score"),
        (-F.col("bits") * float(np.log10(2))).alias("score"), "bits", "n_bytes",
    )


def op2_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")))
