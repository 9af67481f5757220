r"""Chat formatting with a prefix tree: turns that conversations share from the start are written once.

Template: a turn is `[INST] role [/INST]text</s>`. Inside roles and texts a backslash goes before each of \, <s>, </s>, [INST]
and [/INST]; the reader takes a control string for one only without it, so any text comes back unchanged.

Conversations are cut into pieces at the turn that reaches `piece_chars` or `piece_turns`; nearly all are one piece. A
conversation's cuts depend on its turns up to there alone, so conversations that share their start share pieces, too. Pieces
are sorted by the hashes of what stands before them and of their first turns, and packed in that order. A pack is a tree of
turns: each distinct turn after equal turns is a node, written once, depth first, a node's first child right behind it. With
each node go its place in the pack's text, the position id of its first token (tokens are code points; positions count from
the conversation's start, not the pack's), the intervals of the pack that its tokens attend to (its ancestors; it also
attends to its own tokens up to each), and the interval under the loss mask (an assistant's text). Nodes of a later piece
also attend to the whole piece before, which the conversation names by number and the pack by the hash of all before it. A
pack is closed at `pack_chars` of distinct text or `pack_convs` pieces, so a first turn that a third of all conversations
share is repeated once for each pack, and neither such a group nor a long conversation is ever held whole.

Reading back follows the attention intervals from each piece's last node, checks the position ids, and that a later piece
stands behind the ones before it, and parses what it finds; the query reports from that. A conversation's pieces are read
one after the other, as its digests ask for.

Defined cases: turns are ordered by turn, role and text, nulls first; repeated rows are turns of their own; a null role or
text is empty; rows with a null conv_id form one conversation; an empty table gives no conversations; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

PACK_CHARS, PACK_CONVS, PIECE_CHARS, PIECE_TURNS, SORT_DEPTH = 1 << 18, 1 << 12, 1 << 17, 1 << 12, 16
OPEN, CLOSE, END, LEARN = "[INST] ", " [/INST]", "</s>", "assistant"
_CONTROL = re.compile(r"\\|</?s>|\[/?INST\]")
_READ = re.compile(r"\\(?:\\|</?s>|\[/?INST\])|</?s>|\[/?INST\]")
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, LEARN, "</s>[INST] ok [/INST]")]


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of its text)."""
    head = OPEN + escape(role) + CLOSE
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; ValueError if it isn't one."""
    part, held, place = [], {}, 0
    for m in _READ.finditer(formatted):
        part.append(formatted[place : m.start()])
        place = m.end()
        if m[0][0] == "\\":
            part.append(m[0][1:])
        elif m[0] == "[INST]" and not held and not "".join(part):
            held, part = {"open": True}, []
        elif m[0] == "[/INST]" and "open" in held and "role" not in held:
            held, part = held | {"role": "".join(part)[1:-1]}, []
        elif m[0] == "</s>" and "role" in held:
            yield held["role"], "".join(part)
            held, part = {}, []
        else:
            raise ValueError(f"{m[0]} out of place at {m.start()}")
    if held or part and "".join(part) or formatted[place:]:
        raise ValueError("the last turn isn't closed")


# Packs ------------------------------------------------------------------------------------------------------------------


class Tree:
    """Turns by their parent; children in order of arrival. What stands before a piece is its root, numbered from -1 down."""

    def __init__(self) -> None:
        self.turns: list[tuple[int, str, str]] = []
        self.places: dict[tuple[int, str, str], int] = {}
        self.children: dict[int, list[int]] = {}
        self.roots: dict[bytes, tuple[int, int]] = {}
        self.convs: list[tuple] = []
        self.chars = 0

    def add(self, conv_id, turns: list[tuple[str, str]], piece: int = 0, whole: bool = True, before: bytes = b"", position: int = 0) -> None:
        node, _ = self.roots.setdefault(before, (-1 - len(self.roots), position))
        for role, text in turns:
            key = (node, role, text)
            if (at := self.places.get(key)) is None:
                at = self.places[key] = len(self.turns)
                self.turns.append(key)
                self.children.setdefault(node, []).append(at)
                self.chars += len(role) + len(text)
            node = at
        self.convs.append((conv_id, piece, whole, before, node))

    def pack(self) -> dict:
        """text, nodes and pieces of conversations of the tree, depth first."""
        parts, nodes, number, place = [], [], {}, 0
        stack = [(at, position, []) for root, position in reversed(self.roots.values()) for at in reversed(self.children.get(root, []))]
        while stack:
            at, position, attends = stack.pop()
            _, role, text = self.turns[at]
            formatted, start, end = format_turn(role, text)
            learn = role == LEARN
            number[at] = len(nodes)
            nodes.append({"start": place, "end": place + len(formatted), "position": position, "attends": attends, "loss_start": place + start if learn else None, "loss_end": place + end if learn else None})
            if attends and attends[-1]["end"] == place:
                path = [*attends[:-1], {"start": attends[-1]["start"], "end": place + len(formatted)}]
            else:
                path = [*attends, {"start": place, "end": place + len(formatted)}]
            parts.append(formatted)
            place += len(formatted)
            stack += [(child, position + len(formatted), path) for child in reversed(self.children.get(at, []))]
        convs = [{"conv_id": c, "piece": p, "whole": w, "before": b, "last": number[n]} for c, p, w, b, n in self.convs]
        return {"text": "".join(parts), "nodes": nodes, "convs": convs, "chained": not all(c["whole"] for c in convs)}


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_NODE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("attends", pa.list_(_SPAN)), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_CONV = pa.struct([("conv_id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), ("before", pa.binary()), ("last", pa.int64())])
_PACK = pa.schema([("text", pa.string()), ("nodes", pa.list_(_NODE)), ("convs", pa.list_(_CONV)), ("chained", pa.bool_())])
_SPAN_DDL = "struct<start: long, end: long>"
PACK_DDL = (
    f"text string, nodes array<struct<start: long, end: long, position: long, attends: array<{_SPAN_DDL}>, loss_start: long, loss_end: long>>, "
    "convs array<struct<conv_id: long, piece: long, whole: boolean, before: binary, last: long>>, chained boolean"
)
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_PIECE = [("conv_id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), ("before", pa.binary()), ("position", pa.int64()), ("turns", pa.list_(_TURN)), ("path", pa.binary())]
_PIECE_DDL = "conv_id long, piece long, whole boolean, before binary, position long, turns array<struct<role: string, text: string>>, path binary"


class Chain:
    """The hash of a conversation's turns so far."""

    def __init__(self) -> None:
        self.state, self.empty = hashlib.blake2b(digest_size=16), True

    def add(self, role: str, text: str) -> bytes:
        self.state.update(f"{len(role)} {len(text)} {role}{text}".encode())
        self.empty = False
        return self.state.digest()

    def digest(self) -> bytes:
        return b"" if self.empty else self.state.digest()


def _cut(piece_chars: int, piece_turns: int):
    """Pieces of conversations from their turns in order; path: what is before, the first prefixes of turns, then all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, turns, chain, piece, position, before, path, chars, size = object(), [], [], Chain(), 0, 0, b"", b"", 0, 0

        def close(whole: bool) -> None:
            out.append((now, piece, whole, before, position, turns, path + chain.digest()))

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, (_, t) in enumerate(_PIECE)], [n for n, _ in _PIECE])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for r in batch.slice(i, 256).to_pylist():
                    if r["conv_id"] != now:
                        if turns:
                            close(piece == 0)
                        now, turns, chain, piece, position, before, path, chars, size = r["conv_id"], [], Chain(), 0, 0, b"", b"", 0, 0
                    elif chars >= piece_chars or len(turns) >= piece_turns:
                        close(False)
                        turns, piece, position, before, chars, size = [], piece + 1, position + size, chain.digest(), 0, 0
                        path = before
                    role, text = r["role"], r["text"]
                    upto = chain.add(role, text)
                    if len(turns) < SORT_DEPTH:
                        path += upto[:8]
                    turns.append({"role": role, "text": text})
                    chars += len(role) + len(text)
                    size += len(format_turn(role, text)[0])
                if out:
                    yield batch_of()
                    out.clear()
        if turns:
            close(piece == 0)
            yield batch_of()

    return run


def _pack(pack_chars: int, pack_convs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree()
        for batch in batches:
            for i in range(batch.num_rows):
                p = batch.slice(i, 1).to_pylist()[0]
                tree.add(p["conv_id"], [(t["role"], t["text"]) for t in p["turns"]], p["piece"], p["whole"], p["before"], p["position"])
                if tree.chars >= pack_chars or len(tree.convs) >= pack_convs:
                    yield pa.RecordBatch.from_pylist([tree.pack()], _PACK)
                    tree = Tree()
        if tree.convs:
            yield pa.RecordBatch.from_pylist([tree.pack()], _PACK)

    return run


def _rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls as empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def pack(rows: DataFrame, pack_chars: int = PACK_CHARS, pack_convs: int = PACK_CONVS, piece_chars: int = PIECE_CHARS, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """Packs (text, nodes, convs, chained) of conversations; a conversation's rows pass through one task, in order."""
    turns = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    pieces = materialize(turns.mapInArrow(_cut(piece_chars, piece_turns), _PIECE_DDL), "chat-pieces")
    ordered = pieces.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.mapInArrow(_pack(pack_chars, pack_convs), PACK_DDL)


# Reading back -----------------------------------------------------------------------------------------------------------


class Digest:
    """What the query reports of a conversation, fed turn by turn."""

    def __init__(self) -> None:
        self.n, self.loss, self.chars = 0, 0, 0
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str) -> None:
        self.n += 1
        self.turns.update(f"{role}\n{text}\n".encode())

    def learn(self, text: str) -> None:
        self.loss += len(text)
        self.learned.update(text.encode())

    def read(self, formatted: str, loss: list[tuple[int, int]], chain: Chain | None = None) -> None:
        self.chars += len(formatted)
        for role, text in parse(formatted):
            self.add(role, text)
            if chain is not None:
                chain.add(role, text)
        for a, b in loss:
            self.learn(unescape(formatted[a:b]))

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def unescape(text: str) -> str:
    return _READ.sub(lambda m: m[0][1:] if m[0][0] == "\\" else m[0], text)


def _formatted(pack: dict, last: int) -> tuple[str, int, list[tuple[int, int]]]:
    """(formatted turns of the piece that ends with a node, position id of its first token, intervals of the loss in it)."""
    text, nodes = pack["text"], pack["nodes"]
    by_start = pack.setdefault("by_start", {n["start"]: n for n in nodes})
    node = nodes[last]
    spans = [(s["start"], s["end"]) for s in node["attends"]] + [(node["start"], node["end"])]
    first = by_start[spans[0][0]]["position"]
    if first + sum(b - a for a, b in spans[:-1]) != node["position"]:
        raise ValueError("position ids don't fit the attention intervals")
    loss, place = [], 0
    for a, b in spans:  # an interval is a chain of nodes, each right behind its parent
        while a < b:
            part = by_start[a]
            if part["loss_start"] is not None:
                loss.append((place + part["loss_start"] - a, place + part["loss_end"] - a))
            place, a = place + part["end"] - a, part["end"]
    return "".join(text[a:b] for a, b in spans), first, loss


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def _read_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of conversations of one piece."""
    for batch in batches:
        for i in range(batch.num_rows):
            pack, known, rows = batch.slice(i, 1).to_pylist()[0], {}, []
            for conv in pack["convs"]:
                if not conv["whole"]:
                    continue
                if (last := conv["last"]) not in known:
                    formatted, first, loss = _formatted(pack, last)
                    if first or conv["before"]:
                        raise ValueError("a conversation doesn't begin at its start")
                    out = Digest()
                    out.read(formatted, loss)
                    known[last] = out.row()
                rows.append((conv["conv_id"], *known[last]))
            if rows:
                yield _batch(rows)


_PART = [("conv_id", pa.int64()), ("piece", pa.int64()), ("before", pa.binary()), ("position", pa.int64()), ("text", pa.string()), ("loss", pa.list_(_SPAN))]
_PART_DDL = f"conv_id long, piece long, before binary, position long, text string, loss array<{_SPAN_DDL}>"


def _read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of conversations of several, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            pack = batch.slice(i, 1).to_pylist()[0]
            for conv in pack["convs"]:
                if not conv["whole"]:
                    formatted, first, loss = _formatted(pack, conv["last"])
                    row = (conv["conv_id"], conv["piece"], conv["before"], first, formatted, [{"start": a, "end": b} for a, b in loss])
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(row, _PART, strict=True)], [n for n, _ in _PART])


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of conversations from their pieces in order; only what is read passes through."""
    now, out, chain, piece = None, None, Chain(), 0
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if out is None or r["conv_id"] != now:
                if out is not None:
                    yield _batch([(now, *out.row())])
                now, out, chain, piece = r["conv_id"], Digest(), Chain(), 0
            if r["piece"] != piece or r["position"] != out.chars or r["before"] != chain.digest():
                raise ValueError("a piece is missing or doesn't follow the one before")
            out.read(r["text"], [(s["start"], s["end"]) for s in r["loss"]], chain)
            piece += 1
    if out is not None:
        yield _batch([(now, *out.row())])


def format_all(conversations: DataFrame, **settings) -> DataFrame:
    """Packs of all conversations, written to the shared folder; settings as in `pack`."""
    return materialize(pack(_rows(conversations), **settings), "chat-packs")


def read_all(packs: DataFrame) -> DataFrame:
    """What the query reports, read back from packs."""
    parts = packs.filter("chained").mapInArrow(_read_parts, _PART_DDL).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return packs.mapInArrow(_read_packs, _DDL).unionByName(parts.mapInArrow(_join_parts, _DDL))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _rows(table(spark, sf_dir, "conversations"))
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return read_all(format_all(given.unionByName(probe)))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '(\\|</?s>|\[/?INST\])', '\\\1', 'g')) + length(regexp_replace(text, '(\\|</?s>|\[/?INST\])', '\\\1', 'g'))
             + length('[INST]  [/INST]</s>') AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
