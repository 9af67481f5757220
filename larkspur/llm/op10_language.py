"""Language identification by prediction by partial matching over bytes.

For each language a context tree of order 3 counts which byte follows which one to three bytes. A byte costs -log2 of its
probability in the longest context that has seen it; where a context has not, its escape probability is paid and the next
shorter one asked, down to a uniform choice of 256. A context with t bytes seen, d of them distinct, gives a byte seen c
times c/(t+d) and the escape d/(t+d). Statistics are frozen after training, so the cost of a byte depends on the last four
bytes alone, and a text's code length in every language is a sum of table entries.

The language of the smallest code length wins, ties to the smaller name; score is its share of 2^-length over languages.

Training rows: of the rows with text and language that the caller lets through and whose whole texts have at most
`train_chars` characters, about `per_language` for each language, chosen by a hash of doc_id and text. In a language that
has longer texts only, their first `train_chars` characters stand in. This bounds the model of a language; it is the only
sample: all languages are learned, in tables of `GROUP_LANGUAGES` each, and every document is scored whole in all.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text if nothing could be learned;
A-Z count as a-z; rows that repeat get equal results; extra columns are ignored; lang, source and doc_id of a row never
enter its prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, slices, table, utf8

PER_LANGUAGE, TRAIN_CHARS, GROUP_LANGUAGES, FOLDS, CHUNK = 1500, 20_000, 64, 5, 2 << 20
#: Bytes of text whose costs in every language are held at once.
PIECE = 1 << 18
UND = "und"
MOST_BITS, LEAST_BYTES = 7.0, 200
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.frombuffer(FOLD, np.uint8)


class Index:
    """Maps 32-bit codes to rows by open addressing; unknown codes give -1."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(codes)) * 4))))
        self.keys = np.zeros(1 << self.bits, np.uint32)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        self.probes = 0
        left, rows = codes.astype(np.uint32), np.arange(len(codes), dtype=np.int32)
        while len(left):
            at = self._at(left, self.probes)
            free = self.rows[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            self.keys[slot], self.rows[slot] = left[free][first], rows[free][first]
            placed = np.zeros(len(left), bool)
            placed[np.flatnonzero(free)[first]] = True
            left, rows = left[~placed], rows[~placed]
            self.probes += 1

    def _at(self, codes: np.ndarray, probe: int) -> np.ndarray:
        return (((codes * np.uint32(2654435761)) >> np.uint32(32 - self.bits)) + np.uint32(probe)) & np.uint32((1 << self.bits) - 1)

    def find(self, codes: np.ndarray) -> np.ndarray:
        at = self._at(codes, 0)
        out = np.where(self.keys[at] == codes, self.rows[at], -1)
        miss = np.flatnonzero((out < 0) & (self.rows[at] >= 0))
        for probe in range(1, self.probes):
            if not len(miss):
                break
            at = self._at(codes[miss], probe)
            hit = (self.keys[at] == codes[miss]) & (self.rows[at] >= 0)
            out[miss[hit]] = self.rows[at[hit]]
            miss = miss[~hit & (self.rows[at] >= 0)]
        return out


def grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each byte with the three before it in its text, 0 before the start; first place of each text)."""
    low = _FOLD[raw[off[0] : off[-1]]].astype(np.uint32)
    begin = off[:-1] - off[0]
    size = np.diff(off)
    out, shifted = low.copy(), low
    for k in (1, 2, 3):
        shifted = np.concatenate([np.zeros(1, np.uint32), shifted[:-1]])[: len(low)]
        shifted[begin[size > 0]] = 0  # a text starts anew; the zeros of earlier rounds have moved on with the bytes
        out |= shifted << np.uint32(8 * k)
    return out, begin


@dataclass
class Model:
    languages: list[str]
    four: Index
    three: Index
    cost4: np.ndarray  # (4-grams, languages): bits of the last byte
    cost3: np.ndarray  # (3-grams, languages): bits of the last byte at order 2
    escape3: np.ndarray  # (3-grams, languages): bits to leave the context of these three bytes
    cost2: np.ndarray  # (65536, languages): bits at order 1
    escape2: np.ndarray  # (65536, languages): bits to leave the context of these two bytes

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        """Bits of each byte in each language."""
        row = self.four.find(codes)
        out = self.cost4[row] if len(self.cost4) else np.zeros((len(codes), len(self.languages)), np.float32)
        new = np.flatnonzero(row < 0)
        if len(new):
            code = codes[new]
            context = self.three.find(code >> np.uint32(8))
            bits = np.where((context >= 0)[:, None], self.escape3[context], 0)
            tail = self.three.find(code & np.uint32(0xFFFFFF))
            two = code & np.uint32(0xFFFF)
            short = self.escape2[(code >> np.uint32(8)) & np.uint32(0xFFFF)] + self.cost2[two]
            out[new] = bits + np.where((tail >= 0)[:, None], self.cost3[tail], short)
        return out


@dataclass
class Models:
    """Languages in groups with a table each, as the rows of one table would be the grams of all."""

    groups: list[Model]

    @property
    def languages(self) -> list[str]:
        return [x for group in self.groups for x in group.languages]

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([group.lengths(codes) for group in self.groups], axis=1)


def _split(code: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    return code >> np.uint32(8), code & np.uint32((1 << (8 * order)) - 1)


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """counts: for each language the 4-grams seen, sorted, and how often."""
    names = sorted(counts)
    n = len(names)
    every4 = np.unique(np.concatenate([counts[x][0] for x in names])).astype(np.uint32)
    every3 = np.unique(np.concatenate([every4 & np.uint32(0xFFFFFF), every4 >> np.uint32(8)])).astype(np.uint32)
    cost4, cost3 = np.empty((len(every4), n), np.float32), np.empty((len(every3), n), np.float32)
    escape3, cost2, escape2 = np.zeros((len(every3), n), np.float32), np.empty((65536, n), np.float32), np.zeros((65536, n), np.float32)

    def table(code: np.ndarray, count: np.ndarray, order: int):
        """Sorted codes of order+1 bytes with counts, and their contexts with totals and distinct bytes."""
        code, inverse = np.unique(code & np.uint32((1 << (8 * (order + 1))) - 1 if order < 3 else 0xFFFFFFFF), return_inverse=True)
        count = np.bincount(inverse, weights=count)
        context, inverse, distinct = np.unique(code >> np.uint32(8), return_inverse=True, return_counts=True)
        return code, count, context, np.bincount(inverse, weights=count), distinct

    def bits(code: np.ndarray, seen, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs of codes at this order where shorter has them one order below; known contexts and their escapes."""
        known, count, context, total, distinct = seen
        leave = -np.log2(distinct / (total + distinct))
        c = np.minimum(np.searchsorted(context, code >> np.uint32(8)), len(context) - 1)
        there = context[c] == code >> np.uint32(8)
        k = np.minimum(np.searchsorted(known, code), len(known) - 1)
        hit = known[k] == code
        return np.where(hit, -np.log2(count[k] / (total[c] + distinct[c])), np.where(there, leave[c], 0) + shorter), context, leave

    for j, name in enumerate(names):
        code, count = counts[name]
        seen = [table(code, count, order) for order in range(4)]
        zero = np.zeros(256)
        known, number, _, total, distinct = seen[0]
        unseen = 8 - np.log2(distinct[0] / (total[0] + distinct[0]))
        zero[:] = unseen
        zero[known] = -np.log2(number / (total[0] + distinct[0]))
        one, _, _ = bits(np.arange(65536, dtype=np.uint32), seen[1], zero[np.arange(65536) & 255])
        two, context, leave = bits(every3, seen[2], one[every3 & np.uint32(0xFFFF)])
        escape2[context, j] = leave
        at = np.searchsorted(every3, every4 & np.uint32(0xFFFFFF))
        three, context, leave = bits(every4, seen[3], two[at])
        escape3[np.searchsorted(every3, context), j] = leave
        cost4[:, j], cost3[:, j], cost2[:, j] = three, two, one
    return Model(names, Index(every4), Index(every3), cost4, cost3, escape3, cost2, escape2)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", CHUNK):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            own = batch.filter(pa.array(langs == lang))
            raw, off, _ = utf8(own.column("text"))
            code, count = np.unique(grams(raw, off)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([code.tobytes()], pa.binary()), pa.array([count.astype(np.int64).tobytes()], pa.binary())], ["lang", "code", "n"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, train_chars: int = TRAIN_CHARS, group_languages: int = GROUP_LANGUAGES) -> Model | Models | None:
    """Fits on docs(doc_id, text, lang); the sample's counts, bounded by the parameters, are summed at the driver."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    short = F.length("text") <= train_chars
    counts = rows.groupBy("lang").agg(F.count("*").alias("every"), F.count(F.when(short, 1)).alias("short"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    n = F.when(F.col("short") > 0, F.col("short")).otherwise(F.col("every"))
    # A hash's lowest part of the rows, as large as per_language is of all.
    chosen = rows.join(F.broadcast(counts), "lang").filter((short | (F.col("short") == 0)) & (place < F.lit(float(per_language << 30)) / n))
    chosen = chosen.select("lang", F.substring("text", 1, train_chars).alias("text"))
    sums: dict[str, dict[str, list]] = {}
    for row in chosen.mapInArrow(_count, "lang string, code binary, n binary").toLocalIterator():
        held = sums.setdefault(row["lang"], {"code": [], "n": []})
        held["code"].append(np.frombuffer(row["code"], np.uint32))
        held["n"].append(np.frombuffer(row["n"], np.int64))
        if len(held["code"]) >= 16:
            _merge(held)
    learned = {lang: held for lang, held in sums.items() if held["code"]}
    if not learned:
        return None
    for held in learned.values():
        _merge(held)
    names = sorted(learned)
    fitted = [fit({x: (learned[x]["code"][0], learned[x]["n"][0]) for x in names[a : a + group_languages]}) for a in range(0, len(names), group_languages)]
    return fitted[0] if len(fitted) == 1 else Models(fitted)


def _merge(held: dict[str, list]) -> None:
    code, inverse = np.unique(np.concatenate(held["code"]), return_inverse=True)
    held["code"], held["n"] = [code], [np.bincount(inverse, weights=np.concatenate(held["n"])).astype(np.int64)]


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text", PIECE):
            col = batch.column("text")
            raw, off, valid = utf8(col)
            n = batch.num_rows
            best, score, per_byte = np.full(n, UND, object), np.zeros(n), np.zeros(n)
            letters = np.array([bool(v) and _LETTER.search(t) is not None for v, t in zip(valid, col.to_pylist(), strict=True)])
            if model is not None and letters.any():
                codes, begin = grams(raw, off)
                size = np.diff(off)
                total = np.zeros((n, len(model.languages)))
                # Pieces keep the table of costs small even where one text is very long.
                piece = max(1, PIECE * GROUP_LANGUAGES // max(GROUP_LANGUAGES, len(model.languages)))
                for a in range(0, len(codes), piece):
                    bits = model.lengths(codes[a : a + piece])
                    first = int(np.searchsorted(begin, a, "right")) - 1
                    some = np.arange(first, int(np.searchsorted(begin, a + len(bits), "left")))
                    some = some[(size[some] > 0) & (begin[some] + size[some] > a)]
                    total[some] += np.add.reduceat(bits, np.maximum(begin[some] - a, 0), axis=0, dtype=np.float64)
                win = total.argmin(1)
                least = total[np.arange(n), win]
                share = 1 / np.exp2(-np.minimum(total - least[:, None], 1000)).sum(1)
                best = np.where(letters, np.array(model.languages, object)[win], UND)
                score = np.where(letters, share, 0)
                per_byte = np.where(letters, least / np.maximum(size, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(per_byte, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score", "bits_per_byte"])

    return run


def identify(docs: DataFrame, model: Model | Models | None, keep: list[Column] | None = None) -> DataFrame:
    """The columns `keep` (doc_id by default), lang_pred, score, bits_per_byte of every row of docs."""
    rows = docs.select(*(keep or [F.col("doc_id")]), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(_predict(shared), f"{schema}, lang_pred string, score double, bits_per_byte double")


def keep_language(docs: DataFrame, model: Model | Models | None, most_bits: float = MOST_BITS, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The rows of docs in some language: not `und`, and no text of least_bytes or more that costs over most_bits a byte."""
    predict = _predict(docs.sparkSession.sparkContext.broadcast(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            found = next(predict(iter([batch.select(["text"])])))
            bits = found.column("bits_per_byte").to_numpy(zero_copy_only=False)
            size = np.diff(utf8(batch.column("text"))[1])
            known = np.array([x != UND for x in found.column("lang_pred").to_pylist()], bool)
            yield batch.filter(pa.array(known & ((size < least_bytes) | (bits <= most_bits))))

    return docs.mapInArrow(run, docs.schema)


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    model = train(docs.filter(fold_of(F.col("doc_id")) != 0))
    return identify(docs, model, [F.col("doc_id"), held_out.alias("held_out")]).drop("bits_per_byte")
