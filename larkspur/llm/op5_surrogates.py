"""Personal data: detection, and keyed, type-consistent surrogates.

Detected: e-mail addresses, phone numbers, IPv4 addresses, payment cards (Luhn-valid), IBANs (mod 97), social security
numbers (3-2-4), secrets (assigned to a key word, or long hex and well-known key shapes) and personal names (after a title,
or a known first name before a capitalised word).

A surrogate is a keyed permutation of the entity's own format: x -> Q(P(x) + s mod N), P a Feistel network over the numbers
below N (cycle-walked), Q its inverse, 0 < s < N. It has no fixed point, equal entities get equal surrogates in every
document (coreference), and different entities of one format get different ones. Formats are kept: character classes,
letter case, script, separators, e-mail hosts' top level, card and IBAN check digits, country codes, public or private
address ranges. Known first names are exchanged within their list, one list for each gender and script; other names keep
script, case, vowels and their last letter, which carries gender in many languages, and are walked past the lists.

Collision check: every surrogate is inverted before it is used, and must give back its entity; the permutation is thus
verified to be one-to-one where it was applied, without comparing entities across documents. What fails the check gets
characters drawn by a keyed hash. `distinct_surrogates` then compares all pairs (entity, surrogate) of a corpus in one
aggregate, and draws again what collides.

Spans found by two detectors go to the one that starts first, then to the longer. Words of a name that was found are replaced
wherever they stand in that text, so a later mention by one name keeps its reference. Defined cases: a null text stays null
with no entities, a text without entities stays as it is; rows that repeat are treated alike; texts of any length are read
whole; extra columns are kept by `anonymize`, which names its own so that they don't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

KEY = b"larkspur surrogate key"
ROUNDS, CHUNK = 8, 4 << 20

# Common first names, by gender and script.
FIRST_NAMES = [
    ["Mary", "Anna", "Sarah", "Laura", "Julia", "Emma", "Maria", "Sophie", "Claire", "Ingrid", "Helen", "Alice", "Susan", "Linda", "Karen", "Lucia"],
    ["John", "James", "Peter", "Thomas", "Michael", "David", "Robert", "Paul", "Pierre", "Hans", "Carlos", "George", "William", "Martin", "Frank", "Louis"],
    ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Наталья", "Татьяна", "Светлана"],
    ["Иван", "Пётр", "Алексей", "Сергей", "Дмитрий", "Николай", "Андрей", "Михаил"],
]
# Titles before a name.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Señor", "Señora", "Sr", "Sra", "Don", "Doña", "Господин", "Госпожа"]
# Alphabets within which letters are exchanged, vowels and consonants apart.
ALPHABETS = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "áéíóúàèìòùâêîôûäëïöü", "çñ",
]

_NAMES = "|".join(sorted((n for names in FIRST_NAMES for n in names), key=len, reverse=True))
_CAPITAL = r"[^\W\d_a-zà-öø-ÿа-яё][^\W\d_]+"
PATTERNS = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}"),
    ("secret", r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?P<secret_value>[^\s\"'<>]{8,})"),
    ("key", r"\b(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,})\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("ip", r"(?<![\w.-])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w-]|\.\d)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?)(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"),
    ("titled", rf"\b(?:{'|'.join(TITLES)})\b\.? (?P<titled_value>{_CAPITAL}(?: {_CAPITAL})?)"),
    ("named", rf"\b(?:{_NAMES}) {_CAPITAL}"),
]
#: Cheap signs, each a regular expression for RE2, without which none of the detectors named can match.
SIGNS = [
    (r"[0-9]", ("email", "secret", "key", "iban", "card", "ip", "ssn", "phone")),
    (r"@|(?i:token|secret|passw|pwd|api|access|private)", ("email", "secret")),
    (rf"(?:{'|'.join(TITLES)})\.? ", ("titled",)),
    (rf"(?:{_NAMES}) ", ("named",)),
]


# Keyed permutations -----------------------------------------------------------------------------------------------------


def _mac(key: bytes, *parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), key=key[:64], digest_size=32).digest(), "big")


def _feistel(x: int, n: int, key: bytes, back: bool) -> int:
    """A keyed permutation of 0..n-1: an alternating network over a x b >= n, walked until it falls below n."""
    a = 1 << ((n - 1).bit_length() + 1) // 2
    b = -(-n // a)
    while True:
        left, right = divmod(x, a)  # left < b, right < a
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2:
                right = (right + sign * _mac(key, n, r, left)) % a
            else:
                left = (left + sign * _mac(key, n, r, right)) % b
        x = left * a + right
        if x < n:
            return x


def permute(x: int, n: int, key: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..n-1 without fixed points (n > 1)."""
    if n < 2:
        return x
    step = _mac(key, n, "step") % (n - 1) + 1
    return _feistel((_feistel(x, n, key, False) + (-step if back else step)) % n, n, key, True)


@lru_cache(1 << 14)
def _class(ch: str) -> str:
    """The alphabet of a character; what has none stays as it is."""
    low = ch.lower()
    if len(low) != 1:
        return ch
    for letters in ALPHABETS:
        if low in letters:
            return letters
    code = ord(low)
    for first, last in ((0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x5D0, 0x5EA), (0x621, 0x64A), (0x905, 0x939)):
        if first <= code <= last:
            return f"{chr(first)}-{chr(last)}"
    return ch


def _mapped(text: str, classes: list[str], key: bytes, back: bool) -> str:
    """Permutes the characters' places in their classes as one number; classes of one character keep it."""
    value = n = 0
    n, digits = 1, []
    for ch, cls in zip(text, classes, strict=True):
        low = ch.lower()
        if len(cls) == 3 and cls[1] == "-":
            base, radix = ord(cls[0]), ord(cls[2]) - ord(cls[0]) + 1
            digits.append((ord(low) - base, radix))
        elif len(cls) > 1:
            digits.append((cls.index(low), len(cls)))
        else:
            digits.append((0, 1))
    for d, radix in digits:
        value, n = value * radix + d, n * radix
    # The shape is part of the key: formats are permuted apart.
    value = permute(value, n, key + hashlib.blake2b("|".join(classes).encode(), digest_size=8).digest(), back)
    out = []
    for (_, radix), cls, ch in reversed(list(zip(digits, classes, text, strict=True))):
        value, d = divmod(value, radix)
        new = ch if radix == 1 else chr(ord(cls[0]) + d) if len(cls) == 3 and cls[1] == "-" else cls[d]
        out.append(new.upper() if ch.isupper() and len(new.upper()) == 1 else new)
    return "".join(reversed(out))


def _by_class(text: str, key: bytes, back: bool, keep=()) -> str:
    return _mapped(text, [ch if i in keep else _class(ch) for i, ch in enumerate(text)], key, back)


def _digits(text: str, key: bytes, back: bool, fixed: int = 0) -> str:
    """Permutes the digits after the first `fixed`, leaving all else in place; spelling does not enter."""
    own = [ch for ch in text if ch.isdigit()]
    new = iter(own[:fixed] + list(_mapped("".join(own[fixed:]), ["0123456789"] * (len(own) - fixed), key, back)))
    return "".join(next(new) if ch.isdigit() else ch for ch in text)


def luhn(digits: str) -> int:
    """The sum that is divisible by 10 for a valid card."""
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))


def iban_check(text: str) -> int:
    own = text.replace(" ", "").upper()
    return int("".join(str(int(ch, 36)) for ch in own[4:] + own[:4])) % 97


# Types ------------------------------------------------------------------------------------------------------------------


def _email(text: str, key: bytes, back: bool) -> str:
    at = text.rindex("@")
    host = text[at + 1 :].split(".")
    name = next((i for i in range(len(host) - 2, -1, -1) if host[i].lower() not in ("example", "co", "com", "org", "ac", "gov")), -1)
    at_host = at + 1 + sum(len(h) + 1 for h in host[:name]) if name >= 0 else -1
    moving = set(range(at)) | (set(range(at_host, at_host + len(host[name]))) if name >= 0 else set())
    low = _by_class(text.lower(), key, back, {i for i in range(len(text)) if i not in moving})
    return "".join(n.upper() if o.isupper() else n for n, o in zip(low, text, strict=True))


def _ip_class(x: int) -> int:
    a, b = x >> 24, x >> 16 & 255
    if a == 10:
        return 1
    if a == 172 and 16 <= b < 32:
        return 2
    if a == 192 and b == 168:
        return 3
    return 4 if a in (0, 127) else 5 if a >= 224 else 0


#: The private and other ranges: number of addresses before one is permuted in its class.
_RANGES = {1: (10 << 24, 1 << 24), 2: ((172 << 24) + (16 << 16), 1 << 20), 3: ((192 << 24) + (168 << 16), 1 << 16)}


def _ip(text: str, key: bytes, back: bool) -> str:
    x = 0
    for part in text.split("."):
        x = x * 256 + int(part)
    kind = _ip_class(x)
    base, n = _RANGES.get(kind, (0, 1 << 32))
    out = permute(x - base, n, key + bytes([kind]), back) + base
    while _ip_class(out) != kind:
        out = permute(out - base, n, key + bytes([kind]), back) + base
    return ".".join(str(out >> s & 255) for s in (24, 16, 8, 0))


def _card(text: str, key: bytes, back: bool) -> str:
    own = "".join(ch for ch in text if ch.isdigit())
    body = own[0] + _mapped(own[1:-1], ["0123456789"] * (len(own) - 2), key, back)
    new = iter(body + str(-luhn(body + "0") % 10))
    return "".join(next(new) if ch.isdigit() else ch for ch in text)


def _iban(text: str, key: bytes, back: bool) -> str:
    own = text.replace(" ", "")
    body = _mapped(own[4:], ["0123456789" if ch.isdigit() else "abcdefghijklmnopqrstuvwxyz" for ch in own[4:]], key, back)
    check = 98 - iban_check(own[:2] + "00" + body)
    new = iter(own[:2] + f"{check:02d}" + body)
    return "".join(ch if ch == " " else next(new) for ch in text)


def _phone(text: str, key: bytes, back: bool) -> str:
    code = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    return _digits(text, key, back, len(code[0]) - 1 if code else 0)


def _secret(text: str, key: bytes, back: bool) -> str:
    if re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", text):
        new = _mapped(text.lower(), ["0123456789abcdef"] * len(text), key, back)
        return new.upper() if any(ch.isupper() for ch in text) else new
    keep = re.match(r"AKIA|gh[opsu]_|sk-", text)
    cls = [ch if keep and i < keep.end() else "0123456789" if ch.isdigit() else "abcdefghijklmnopqrstuvwxyz" if ch.isascii() and ch.isalpha() else _class(ch) for i, ch in enumerate(text)]
    return _mapped(text, cls, key, back)


_LISTED = {name.lower(): (i, j) for i, names in enumerate(FIRST_NAMES) for j, name in enumerate(names)}


def _word(word: str, key: bytes, back: bool) -> str:
    if (listed := _LISTED.get(word.lower())) is not None:
        names = FIRST_NAMES[listed[0]]
        new = names[permute(listed[1], len(names), key + bytes([listed[0]]), back)]
        return new.upper() if word.isupper() else new
    out = word
    while True:  # the last letter stays; a name that falls on a list is walked on
        out = _by_class(out, key, back, {len(word) - 1})
        if out.lower() not in _LISTED:
            return out


def _name(text: str, key: bytes, back: bool) -> str:
    return " ".join(_word(w, key, back) for w in text.split(" "))


_MAKERS = {"email": _email, "secret": _secret, "key": _secret, "iban": _iban, "card": _card, "ip": _ip, "ssn": _digits, "phone": _phone, "titled": _name, "named": _name}
#: Types that share one key, so that an entity has one surrogate by whichever detector it is found.
_KEYS = {"key": "secret", "titled": "name", "named": "name"}


def _drawn(entity: str, key: bytes) -> str:
    """For what fails the check (letters whose upper and lower case don't pair): characters drawn by a keyed hash."""
    rest, out = _mac(key, "drawn", entity), []
    for i, ch in enumerate(entity):
        cls = "abcdefghijklmnopqrstuvwxyz" if ch.isalpha() else "0123456789" if ch.isdigit() else ch
        rest, d = divmod(rest if rest else _mac(key, i, entity), len(cls))
        out.append(cls[d])
    return "".join(out)


@lru_cache(1 << 16)
def surrogate(kind: str, entity: str, key: bytes = KEY, attempt: int = 0) -> str:
    """attempt: another permutation of the same format, for what a collision has made to be drawn again."""
    own = hashlib.blake2b(_KEYS.get(kind, kind).encode() + b"!" * attempt, key=key[:64], digest_size=24).digest()
    new = _MAKERS[kind](entity, own, False)
    return new if _MAKERS[kind](new, own, True) == entity else _drawn(entity, own)


# Detection --------------------------------------------------------------------------------------------------------------

_COMPILED = [(kind, re.compile(pattern)) for kind, pattern in PATTERNS]


def _valid(kind: str, text: str) -> bool:
    if kind == "card":
        digits = "".join(ch for ch in text if ch.isdigit())
        return luhn(digits) % 10 == 0 and len(set(digits)) > 1
    if kind == "iban":
        return 15 <= len(text.replace(" ", "")) <= 34 and iban_check(text) == 1
    if kind == "secret":
        return any(ch.isdigit() for ch in text)
    return True


def detect(text: str, kinds: set[str] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a text, in order, without overlaps."""
    found = []
    for kind, pattern in _COMPILED:
        if kinds is None or kind in kinds:
            group = f"{kind}_value" if f"{kind}_value" in pattern.groupindex else 0
            for m in pattern.finditer(text):
                if _valid(kind, m[group]):
                    found.append((m.start(group), -m.end(group), kind))
    out, end = [], 0
    for start, stop, kind in sorted(found):
        if start >= end:
            out.append((start, -stop, kind))
            end = -stop
    return _mentions(text, out)


_CAPITALS = re.compile(rf"\b{_CAPITAL}\b")


def _mentions(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """spans, and where else in the text a word of three letters or more of a name that was found stands by itself."""
    names = {w for a, b, kind in spans if _KEYS.get(kind) == "name" for w in text[a:b].split(" ") if len(w) > 2}
    if not names:
        return spans
    out, at = [], 0
    for start, stop, kind in [*spans, (len(text), len(text), "")]:
        out += [(m.start(), m.end(), "named") for m in _CAPITALS.finditer(text, at, start) if m[0] in names]
        at = stop
        if kind:
            out.append((start, stop, kind))
    return out


def _digest(entity: str, key: bytes) -> str:
    return hashlib.blake2b(entity.lower().encode(), key=key[:64], digest_size=16).hexdigest()


def replace(text: str, spans: list[tuple[int, int, str]], key: bytes = KEY, attempts: dict | None = None) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (type, entity, surrogate) of each span; attempts: (type, digest) of what is drawn again."""
    parts, pairs, end = [], [], 0
    for start, stop, kind in spans:
        own = (attempts or {}).get((_KEYS.get(kind, kind), _digest(text[start:stop], key)), 0) if attempts else 0
        new = surrogate(kind, text[start:stop], key, own)
        parts += [text[end:start], new]
        pairs.append((_KEYS.get(kind, kind), text[start:stop], new))
        end = stop
    return "".join([*parts, text[end:]]), pairs


_ENTITIES = "array<struct<kind: string, digest: string, surrogate: string>>"


def _run(key: bytes, name: str, entities_name: str, attempts: dict | None):
    pairs_type = pa.list_(pa.struct([("kind", pa.string()), ("digest", pa.string()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, name, CHUNK):
            col = batch.column(name)
            kinds: dict[int, set[str]] = {}
            for sign, some in SIGNS:
                for i in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(col, sign), False)).to_pylist():
                    kinds.setdefault(i, set()).update(some)
            texts, entities = {}, [[] for _ in range(batch.num_rows)]
            for i, some in kinds.items():
                text = col[i].as_py()
                if spans := detect(text, some):
                    texts[i], pairs = replace(text, spans, key, attempts)
                    entities[i] = [{"kind": k, "digest": _digest(e, key), "surrogate": s} for k, e, s in pairs]
            if texts:
                mask = [i in texts for i in range(batch.num_rows)]
                col = pc.replace_with_mask(col, pa.array(mask), pa.array([texts[i] for i in sorted(texts)], col.type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], col, pa.array(entities, pairs_type)], [*batch.schema.names, entities_name])

    return run


def entities_name(docs: DataFrame) -> str:
    """_entities, with as many more of the first character as it takes where docs has such a column."""
    name = "_entities"
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


def anonymize(docs: DataFrame, key: bytes = KEY, attempts: dict | None = None) -> DataFrame:
    """docs with its text replaced, and the column `entities_name(docs)`: type, keyed digest and surrogate of each, in order."""
    others, name = [c for c in docs.columns if c != "text"], entities_name(docs)
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    out = rows.mapInArrow(_run(key, "text", name, attempts), f"{schema}, {name} {_ENTITIES}")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], name)


def collisions(anonymized: DataFrame) -> DataFrame:
    """kind, surrogate, digest of entities whose surrogate is that of another one with a smaller digest; empty if surrogates
    are distinct."""
    each = anonymized.select(F.explode("_entities").alias("e")).select("e.kind", "e.digest", F.lower("e.surrogate").alias("surrogate"))
    least = each.groupBy("kind", "surrogate").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a != b").select("kind", "surrogate", "a")
    return each.join(least, ["kind", "surrogate"]).filter("digest != a").select("kind", "surrogate", "digest").distinct()


MOST_AGAIN = 100_000


def distinct_surrogates(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """`anonymize`, after all entities' surrogates have been compared in one aggregate: what collides is drawn again by
    another permutation, until nothing does. Only colliding entities come to the driver, an error if beyond MOST_AGAIN.

    Texts are read once for the comparison and once to be written; nothing but digests and surrogates is kept in between."""
    attempts: dict = {}
    while True:
        found = materialize(collisions(anonymize(docs.select("text"), key, attempts)), "surrogate-collisions").limit(MOST_AGAIN + 1).collect()
        if not found:
            return anonymize(docs, key, attempts)
        if len(found) > MOST_AGAIN:
            raise RuntimeError("too many surrogates collide")
        for r in found:
            attempts[r["kind"], r["digest"]] = attempts.get((r["kind"], r["digest"]), 0) + 1


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_entities, kinds (sorted, comma-joined), text (with surrogates) of every document."""
    out = distinct_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("_entities", lambda e: e["kind"]))), ",")
    return out.select("doc_id", F.size("_entities").cast("long").alias("n_entities"), kinds.alias("kinds"), "text")
