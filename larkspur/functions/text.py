"""Scalar text functions as Column expressions; the driver-side ones on plain strings read queries, never data."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a task or a question may hold without meaning.
TASK_STOP_WORDS = [
    "the", "and", "for", "with", "that", "this", "its", "it", "a", "an", "to", "in", "of", "on", "at", "by", "is", "are", "be", "was",
    "were", "or", "as", "so", "we", "our", "my", "your", "into", "from", "when", "then", "than", "them", "they", "there", "all", "any", "can", "will",
    "should", "must", "not", "but", "how", "what", "why", "fix", "add", "implement", "support", "make", "create", "update", "remove", "change",
    "refactor", "improve", "ensure", "allow", "use", "need", "want", "please", "new", "also", "file", "files", "code", "feature", "bug", "task", "issue",
]
SHORT_STOP_WORDS = ["am", "an", "as", "at", "be", "by", "do", "go", "he", "if", "in", "is", "it", "me", "my", "no", "of", "on", "or", "so", "to", "up", "us", "we"]
# How texts begin, or what they hold, that programs have put into a user's turn.
ORCHESTRATOR_PREFIXES = [
    "<system-reminder>", "<task-notification>", "<command-name>", "<command-message>", "<local-command", "<bash-input>", "[SYSTEM NOTIFICATION",
    "Caveat: The messages below", "[Request interrupted",
]
ORCHESTRATOR_MARKERS = ["CMUX agent handoff", "cmux-agent-send --queue"]
# Further ones that the programs of two stores put in.
STORE_PREFIXES = {
    "codex": ["<user_instructions>", "<environment_context>", "<turn_aborted>", "<skills_instructions>", "<permissions_context>", "<recommended_plugins>", "<codex_internal_context", "# AGENTS.md instructions"],
    "cursor": ["<hooks_context", "<additional_data"],
}
DIAGNOSTIC = r"^(.+)\((\d+),(\d+)\): error (TS\d+): (.*)$"


def lines(text: Column) -> Column:
    """The lines of a text; a final line feed ends the last line and opens none; trailing CR is cut."""
    parts = F.split(text, "\n")
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(cut, lambda x: F.regexp_replace(x, "\r+$", ""))


def before_nul(text: Column) -> Column:
    """What stands before the first NUL: binary content is searched no further."""
    return F.substring_index(text, "\0", 1)


def ident_words(name: Column) -> Column:
    """The words of an identifier: split at _ - . : # and at changes of case, lower-cased."""
    spaced = F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})|(?<=.)(?=\p{Lu}\p{Ll})", " ")
    return F.filter(F.split(F.lower(spaced), r"[\s_\-.:#]+"), lambda w: w != "")


def humanize(name: Column) -> Column:
    return F.concat(F.initcap(F.array_join(ident_words(name), " ")), F.lit(" flow"))


def cap(text: Column, n: int) -> Column:
    """(text, truncated): the first n characters, and whether there were more."""
    return F.struct(F.left(text, F.lit(n)).alias("text"), (F.length(text) > n).alias("truncated"))


def title_of(text: Column, n: int = 120) -> Column:
    """A title: the trimmed text on one line, n characters at most."""
    return F.left(F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), r"[\r\n]+", " "), F.lit(n))


def snippet(text: Column, pattern: str, around: int = 120) -> Column:
    """`around` characters on either side of the first match on one line, with ellipses where text is left out."""
    at = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(at - around, F.lit(1))
    size = F.length(F.regexp_extract(text, pattern, 0))
    stop = F.least(at + size + around, F.length(text) + 1)
    body = F.regexp_replace(text.substr(start, stop - start), r"[\r\n]", " ")
    found = F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), body, F.when(stop <= F.length(text), F.lit("…")).otherwise(F.lit("")))
    return F.when(at > 0, found)


def chunk_windows(text: Column, width: int = 1500, overlap: int = 200) -> Column:
    """(start, end) of overlapping windows of characters that cover a text; an empty text has none."""
    n, step = F.length(text), width - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(step))
    windows = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + width, n).alias("end")))
    return F.when(n > 0, windows).otherwise(F.array().cast("array<struct<start: int, end: int>>"))


def embed_header(agent: Column, cwd: Column, role: Column, chunk: Column) -> Column:
    return F.format_string("[%s] [%s] %s: %s", agent, F.element_at(F.split(cwd, "/"), -1), role, chunk)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def intent(text: Column, agent: Column | None = None) -> Column:
    """human, or orchestrator if a program wrote it; with the store's agent, by its own list, too."""
    trimmed, by_program = F.ltrim(F.regexp_replace(text, r"^\s+", "")), F.lit(False)
    for p in ORCHESTRATOR_PREFIXES:
        by_program = by_program | F.startswith(trimmed, F.lit(p))
    for m in ORCHESTRATOR_MARKERS:
        by_program = by_program | F.contains(trimmed, F.lit(m))
    for name, prefixes in STORE_PREFIXES.items() if agent is not None else ():
        for p in prefixes:
            by_program = by_program | ((agent == name) & F.startswith(trimmed, F.lit(p)))
    return F.when(by_program, F.lit("orchestrator")).otherwise(F.lit("human"))


# Error messages -----------------------------------------------------------------------------------------------------------


def _normal_word(word: Column) -> Column:
    url = F.concat(F.lit("<url>"), F.regexp_extract(word, r"""([.,)'"]*)$""", 1))
    # A run of hexadecimal digits counts only where no letter or digit follows it.
    run = r"(?<![0-9A-Fa-f])%s(?![\p{L}\p{N}])"
    spans = F.regexp_replace(word, run % "[0-9A-Fa-f]{8,}", "<hex>")
    spans = F.regexp_replace(spans, run % "[0-9]{5,7}", "<num>")
    stamp = F.regexp_like(word, F.lit(r"^[0-9]{4}-[0-9]{2}-.*:")) & (F.length(word) >= 16)
    return F.when(F.regexp_like(word, F.lit("^https?://")), url).when(stamp, F.lit("<ts>")).otherwise(spans)


def normalize_message(message: Column) -> Column:
    """The message with white space collapsed and its volatile parts replaced: <url>, <ts>, <hex>, <num>."""
    return F.array_join(F.transform(F.filter(F.split(message, r"\s+"), lambda w: w != ""), _normal_word), " ")


def is_app_file(path: Column) -> Column:
    return (path != "") & ~F.contains(path, F.lit("node_modules")) & ~F.startswith(path, F.lit("node:")) & ~F.startswith(path, F.lit("bun:"))


def best_location(frame: Column) -> Column:
    """(file, line): the source-mapped place of a stack frame, else the raw one; a missing line is 0."""
    mapped = F.struct(frame["mapped_file"].alias("file"), F.coalesce(frame["mapped_line"], F.lit(0)).alias("line"))
    raw = F.struct(frame["file"].alias("file"), F.coalesce(frame["line"], F.lit(0)).alias("line"))
    return F.when(frame["mapped_file"].isNotNull(), mapped).when(frame["file"].isNotNull(), raw)


def top_app_frames(frames: Column, n: int = 3) -> Column:
    """file:line of the first n frames of the application itself."""
    places = F.filter(F.transform(frames, best_location), lambda p: p.isNotNull() & is_app_file(p["file"]))
    return F.transform(F.slice(places, 1, n), lambda p: F.concat_ws(":", p["file"], p["line"].cast("string")))


def dedup_hash(surface: Column, kind: Column, message: Column, frames: Column | None = None) -> Column:
    """SHA-256 that stands for an error: surface, kind, normalized message, the first application frames."""
    parts = F.concat_ws("\n", surface, F.coalesce(kind, F.lit("")), normalize_message(message))
    if frames is not None:
        own = F.coalesce(top_app_frames(frames), F.array().cast("array<string>"))
        parts = F.concat(parts, F.when(F.size(own) > 0, F.concat(F.lit("\n"), F.array_join(own, "\n"))).otherwise(F.lit("")))
    return F.sha2(parts, 256)


def evaluating_chain(message: Column) -> Column:
    """['a', 'b', 'c'] of "(evaluating 'a.b.c')", ['c'] of "(reading 'c')", else null."""
    chain = F.regexp_extract(message, r"\(evaluating '([^']+)'\)", 1)
    read = F.regexp_extract(message, r"\(reading '([^']+)'\)", 1)
    return F.when(chain != "", F.split(chain, r"\.")).when(read != "", F.array(read))


def project_key(root: Column) -> Column:
    return F.concat(F.element_at(F.split(root, "/"), -1), F.lit("-"), F.left(F.sha2(root, 256), F.lit(12)))


def redact(values: Column, max_keys: int = 20, max_chars: int = 256) -> Column:
    """A map of strings with secret keys masked, long values cut and few keys kept, by name."""
    keys = F.slice(F.array_sort(F.map_keys(values)), 1, max_keys)
    secret = lambda k: F.regexp_like(k, F.lit("(?i)pass|secret|token|auth|cookie|api_?key"))
    pair = lambda k: F.struct(k, F.when(secret(k), F.lit("[redacted]")).otherwise(F.left(values[k], F.lit(max_chars))))
    return F.map_from_entries(F.transform(keys, pair))


# Time ---------------------------------------------------------------------------------------------------------------------

_SINK_UNITS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
_RECALL_UNITS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def duration_ms(text: str, recall: bool = False) -> int | None:
    """Milliseconds of 30s, 5m, 2h, 1d (recall: m h d w); a bare number is seconds, for recall nothing. None if it is neither."""
    m = re.fullmatch(r"(\d+)([a-z]?)", text.strip())
    if not m or recall and not m[2]:
        return None
    units = _RECALL_UNITS if recall else _SINK_UNITS
    return int(m[1]) * units[m[2] or "s"] if (m[2] or "s") in units else None


def time_ms(text: str, now_ms: int) -> int | None:
    """A moment: that long before now, or an ISO date or time in UTC."""
    from datetime import UTC, datetime

    if (back := duration_ms(text, recall=True)) is not None:
        return now_ms - back
    try:
        when = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return int((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp() * 1000)


def iso_ms(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def to_ms(stamp: Column) -> Column:
    """Milliseconds of a Unix time that may be in seconds."""
    return F.when(stamp <= 1_000_000_000_000, stamp * 1000).otherwise(stamp)


def format_ms(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm")


def age(ms: Column) -> Column:
    """How long ago, in the largest whole unit."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000)
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


# Paths --------------------------------------------------------------------------------------------------------------------


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def under(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix or lies below it; src/foo doesn't hold src/foobar."""
    prefix = prefix.rstrip("/")
    return F.lit(True) if not prefix else (path == prefix) | F.startswith(path, F.lit(prefix + "/"))


def normalize_path(path: Column) -> Column:
    """A path without empty, . and .. parts; a .. above the top is dropped."""
    step = lambda done, part: (
        F.when((part == "") | (part == "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


# Languages by extension.
LANGUAGES = {"ts": "ts", "tsx": "tsx", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "rs": "rust", "go": "go", "java": "java", "py": "python"}


def lang_of(path: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(pairs, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


# Queries ------------------------------------------------------------------------------------------------------------------


def tokenize_task(task: str, most: int = 12) -> tuple[list[str], list[str]]:
    """(quoted names, keywords) of a task: names stand in back ticks or quotes; keywords have three letters or more.

    ValueError if there is neither."""
    exact = list(dict.fromkeys(a or b or c for a, b, c in re.findall(r"`([^`\s]+)`|\"([^\"\s]+)\"|'([^'\s]+)'", task)))
    words = [w.lower() for w in re.findall(r"[A-Za-z0-9_]+", task)]
    keywords = [w for w in dict.fromkeys(words) if len(w) >= 3 and w not in TASK_STOP_WORDS][:most]
    if not exact and not keywords:
        raise ValueError("the task names nothing to look for")
    return exact, keywords


def query_words(query: str) -> list[str]:
    """The words of a question that are worth a search, in order, once each whatever their case."""
    out: dict[str, str] = {}
    for token in re.split(r"[^\w.\-]+", query):
        word = token.strip(".-")
        if len(word) >= 2 and not (len(word) == 2 and word.lower() in SHORT_STOP_WORDS):
            out.setdefault(word.lower(), word)
    return list(out.values())


def word_pattern(word: str) -> str:
    """A pattern for the whole word as given, in lower and upper case, and capitalised."""
    low = word.lower()
    forms = sorted({re.escape(w) for w in (word, low, word.upper(), low[:1].upper() + low[1:])})
    return rf"(?U)\b(?:{'|'.join(forms)})\b"


def whole_word(pattern: str) -> str:
    return rf"(?U)\b(?:{pattern})\b"


def word_weight(count: Column, most: int = 50_000) -> Column:
    """What a word's match is worth: the rarer, the more; a word of unknown count is taken for a middling one."""
    return F.greatest(F.lit(0.1), F.ln(F.lit(float(most)) / (1 + F.coalesce(count, F.lit(most // 10)))))
