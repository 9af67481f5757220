"""From source text to symbols, calls and imports, one file at a time.

Python is read by its own parser. The other languages are read by a scanner that blanks out comments and strings, finds
definitions and calls by pattern, and ends a definition at its closing brace. A file that can't be read gives no rows."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as fn

SIG = 200
_WORDS = {"if", "for", "while", "switch", "match", "return", "catch", "function", "fn", "func", "new", "await", "typeof", "super", "sizeof", "loop", "else", "do", "try", "in", "as", "let", "const", "var"}
_DEFS = {
    "js": [
        ("function", r"\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*\("),
        ("class", r"\bclass\s+(?P<name>[\w$]+)"),
        ("interface", r"\binterface\s+(?P<name>[\w$]+)"),
        ("enum", r"\benum\s+(?P<name>[\w$]+)"),
        ("function", r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::[^=;{]+)?=>"),
        ("method", r"^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*\*?(?P<name>[\w$]+)\s*\([^;{}]*\)\s*(?::[^;{}]+)?\{"),
    ],
    "rust": [
        ("function", r"\bfn\s+(?P<name>\w+)"),
        ("struct", r"\bstruct\s+(?P<name>\w+)"),
        ("enum", r"\benum\s+(?P<name>\w+)"),
        ("trait", r"\btrait\s+(?P<name>\w+)"),
        ("module", r"\bmod\s+(?P<name>\w+)\s*\{"),
        ("impl", r"\bimpl\b(?:\s*<[^{]*?>)?\s+(?:[\w:<>, ]+?\s+for\s+)?(?P<name>\w+)[^;{]*(?=\{)"),
    ],
    "go": [
        ("method", r"\bfunc\s*\(\s*\w*\s*\*?(?P<of>\w+)[^)]*\)\s*(?P<name>\w+)"),
        ("function", r"\bfunc\s+(?P<name>\w+)"),
        ("struct", r"\btype\s+(?P<name>\w+)\s+struct\b"),
        ("interface", r"\btype\s+(?P<name>\w+)\s+interface\b"),
    ],
    "java": [
        ("class", r"\b(?:class|record)\s+(?P<name>\w+)"),
        ("interface", r"\binterface\s+(?P<name>\w+)"),
        ("enum", r"\benum\s+(?P<name>\w+)"),
        ("method", r"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*(?:<[^>]+>\s*)?[\w<>\[\],.? ]+?\s(?P<name>\w+)\s*\([^;{}]*\)\s*(?:throws[^{;]+)?\{"),
    ],
}
_OWNERS = {"class", "interface", "struct", "enum", "trait", "impl"}
_CALL = re.compile(r"(?:(?P<receiver>[\w$]+)\s*(?:\.|::)\s*)?(?P<name>[A-Za-z_$][\w$]*)\s*(?:::<[^()]*>)?\(")


def blank(source: str, lang: str) -> str:
    """The source with comments and the inside of strings as spaces, line for line."""
    hash_ = lang == "python"
    token = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|" + (r"'(?:\\.|[^'\\\n])*'" if lang != "rust" else r"'(?:\\.|[^'\\\n])'") + (r"|`(?:\\.|[^`\\])*`" if lang == "js" else "|`[^`]*`" if lang == "go" else "") + (r"|#[^\n]*" if hash_ else r"|//[^\n]*|/\*.*?\*/"), re.S)
    return token.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _close(code: str, at: int) -> int:
    """Where the brace that opens next is closed; the end of the line if a ; comes first."""
    opened = code.find("{", at)
    stop = code.find(";", at)
    if opened < 0 or 0 <= stop < opened:
        return stop if stop >= 0 else len(code)
    depth = 0
    for m in re.finditer(r"[{}]", code[opened:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return opened + m.start()
    return len(code)


def _imports(source: str, lang: str) -> list[tuple[str, list[str]]]:
    out: list[tuple[str, list[str]]] = []
    if lang == "js":  # bindings are known for these languages alone; an alias stands under its original name
        for names, spec in re.findall(r"\b(?:import|export)\s+([^'\";]*?)\s*from\s*['\"]([^'\"]+)['\"]", source):
            inner = re.search(r"\{([^}]*)\}", names)
            own = [re.split(r"\s+as\s+", n.strip().removeprefix("type "))[0] for n in (inner[1].split(",") if inner else []) if n.strip()]
            lead = re.match(r"(?:type\s+)?([\w$]+)", names)
            out.append((spec, own + ([lead[1]] if lead and lead[1] != "type" else [])))
        out += [(s, []) for s in re.findall(r"\b(?:import|require)\s*\(?\s*['\"]([^'\"]+)['\"]", source)]
    elif lang == "rust":
        out = [(s.strip(), []) for s in re.findall(r"\buse\s+([^;]+);", source)] + [(f"self::{s}", []) for s in re.findall(r"\bmod\s+(\w+)\s*;", source)]
    elif lang == "go":
        blocks = re.findall(r"\bimport\s*\(([^)]*)\)", source)
        out = [(s, []) for b in blocks for s in re.findall(r"\"([^\"]+)\"", b)] + [(s, []) for s in re.findall(r"\bimport\s+(?:\w+\s+)?\"([^\"]+)\"", source)]
    elif lang == "java":
        out = [(s, []) for s in re.findall(r"\bimport\s+(?:static\s+)?([\w.*]+)\s*;", source)]
    return out


def _test_spans(code: str) -> list[tuple[int, int]]:
    """Rust: what stands under #[test] or #[cfg(test)]."""
    return [(m.start(), _close(code, m.end())) for m in re.finditer(r"#\[(?:\w+::)?test\b[^\]]*\]|#\[cfg\(test\)\]", code)]


def scan(path: str, source: str, lang: str) -> dict[str, list]:
    """symbols (name, qualified, kind, start, end, sig), calls (name, receiver, line), imports (spec, bindings)."""
    code = blank(source, lang)
    line = lambda at: code.count("\n", 0, at) + 1
    tests = _test_spans(code) if lang == "rust" else []
    found, owners = [], []
    for kind, pattern in _DEFS[lang]:
        for m in re.finditer(pattern, code, re.M):
            name = m["name"]
            if name in _WORDS and not (name == "new" and lang == "rust") or any(a <= m.start() < b for a, b in tests):
                continue
            end = _close(code, m.end() - 1 if m[0].endswith("{") else m.end())
            if kind in _OWNERS:
                owners.append((m.start(), end, name))
            if kind != "impl":
                found.append((m.start(), end, name, kind, m.groupdict().get("of")))
    symbols, taken = [], set()
    for start, end, name, kind, of in sorted(found, key=lambda s: (s[0], s[1])):
        at = start + len(code[start:]) - len(code[start:].lstrip())
        inside = [o for o in owners if o[0] < start and end <= o[1]]
        owner = of or (max(inside)[2] if inside else None)
        if kind == "method" and not owner or (line(at), name) in taken:
            continue
        taken.add((line(at), name))
        if kind == "function" and owner and lang == "rust":
            kind = "method"
        qualified = name if not owner else f"{owner}{'::' if lang == 'rust' else '.'}{name}"
        sig = source[at:].split("\n", 1)[0].split("{")[0].strip()[:SIG]
        symbols.append((name, qualified, kind, line(at), line(min(end, len(code) - 1) if code else 0), sig))
    defs = {(s[3], s[0]) for s in symbols}
    calls = [(m["name"], m["receiver"], line(m.start("name"))) for m in _CALL.finditer(code) if (m["name"] not in _WORDS or m["name"] == "new" and lang == "rust") and (line(m.start("name")), m["name"]) not in defs and not any(a <= m.start() < b for a, b in tests)]
    return {"symbols": symbols, "calls": calls, "imports": _imports(source, lang)}


def parse_python(path: str, source: str) -> dict[str, list]:
    tree = ast.parse(source)
    rows = source.split("\n")
    symbols, calls, imports = [], [], []

    def visit(node: ast.AST, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                qualified = f"{owner}.{child.name}" if owner else child.name
                symbols.append((child.name, qualified, kind, child.lineno, child.end_lineno, rows[child.lineno - 1].strip().rstrip(":")[:SIG]))
                inner = child.name if kind == "class" else owner
            elif isinstance(child, ast.Call):
                f = child.func
                if isinstance(f, ast.Name):
                    calls.append((f.id, None, child.lineno))
                elif isinstance(f, ast.Attribute):
                    calls.append((f.attr, f.value.id if isinstance(f.value, ast.Name) else "?", child.lineno))
            elif isinstance(child, ast.Import):
                imports.extend((a.name, []) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.append(("." * child.level + (child.module or ""), []))
            visit(child, inner)

    visit(tree, None)
    return {"symbols": symbols, "calls": calls, "imports": imports}


def extract_file(path: str, source: str, lang: str) -> dict[str, list]:
    try:
        return parse_python(path, source) if lang == "python" else scan(path, source, "js" if lang in ("ts", "tsx") else lang)
    except (SyntaxError, ValueError, RecursionError):
        return {"symbols": [], "calls": [], "imports": []}


_ROW = "path STRING, what STRING, name STRING, qualified STRING, kind STRING, start INT, end INT, detail STRING, bindings ARRAY<STRING>"


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "what", "name", "qualified", "kind", "start", "end", "detail", "bindings"]
    for pdf in batches:
        out = []
        for path, source, lang in zip(pdf["path"], pdf["content"], pdf["lang"], strict=True):
            got = extract_file(path, source, lang)
            out += [(path, "symbol", n, q, k, a, b, s, None) for n, q, k, a, b, s in got["symbols"]]
            out += [(path, "call", n, None, None, at, at, r, None) for n, r, at in got["calls"]]
            out += [(path, "import", s, None, None, 0, 0, None, b) for s, b in got["imports"]]
        yield pd.DataFrame(out, columns=columns)


def extract(files: DataFrame) -> dict[str, DataFrame]:
    """symbols, calls and imports of files(path, content) in the languages known; a call has its smallest enclosing symbol."""
    from larkspur.operators.graph import smallest_enclosing

    known = files.withColumn("lang", fn.lang_of(F.col("path"))).filter("lang IS NOT NULL AND content IS NOT NULL")
    rows = known.select("path", "content", "lang").mapInPandas(_run, _ROW)
    symbols = rows.filter("what = 'symbol'").select(F.concat_ws("#", "path", "qualified", "kind").alias("uid"), F.col("path").alias("file"), "name", "qualified", "kind", F.col("start").alias("start_line"), F.col("end").alias("end_line"), F.col("detail").alias("sig"))
    calls = rows.filter("what = 'call'").select(F.concat_ws(":", "path", "start", "name", F.coalesce("detail", F.lit(""))).alias("call_id"), F.col("path").alias("file"), "name", F.col("detail").alias("receiver"), F.col("start").alias("site_line")).distinct()
    at = smallest_enclosing(calls.select(F.col("call_id").alias("point_id"), F.col("file").alias("file_id"), F.col("site_line").alias("line")), symbols.select(F.col("file").alias("file_id"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("uid").alias("id")))
    calls = calls.join(at, F.col("call_id") == F.col("point_id"), "left").select("call_id", "file", "name", "receiver", "site_line", F.col("id").alias("caller"))
    imports = rows.filter("what = 'import'").select(F.col("path").alias("file"), F.col("name").alias("spec"), "bindings")
    return {"symbols": symbols, "calls": calls, "imports": imports}


def build_graph(files: DataFrame) -> dict[str, DataFrame]:
    """symbols, edges (src, dst, kind, tier, site_line) and open calls of a tree of files."""
    from larkspur.operators import graph

    got = extract(files)
    targets = graph.resolve_imports(got["imports"], files)
    bound = got["imports"].join(targets, ["file", "spec"]).select("file", "target", F.explode_outer("bindings").alias("binding"))
    resolved = graph.resolve_calls(got["calls"], got["symbols"], bound)
    edges = got["calls"].join(resolved, "call_id").select(F.col("caller").alias("src"), "dst", F.lit("calls").alias("kind"), "tier", "site_line")
    return got | {"edges": edges, "open_calls": graph.unresolved(got["calls"], resolved), "file_imports": targets}
