"""Source files to code entities. Files are parsed where they are read, in Arrow batches; a file that can't be parsed gives one row that tells why.

Python is parsed by its own grammar; Java and JavaScript by a lexer that blanks comments and strings, and patterns over what is left. All captures of a
file are put into the order of their first byte, and calls are then given to an entity: to the innermost definition that encloses them, or, with ``parity``, to the last
entity emitted before them if that is a function, class or endpoint.
"""

from __future__ import annotations

import ast
import io
import os
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import LANGUAGES, STDLIB

OWNERS = ("function", "class", "api_endpoint")
SCHEMA = (
    "project string, file string, name string, type string, labels array<string>, content string, start_line int, end_line int, decorators array<string>, base_classes array<string>, "
    "import_type string, calls array<string>, ord long, error string"
)


def detect_language(path: str) -> str:
    extension = os.path.splitext(path)[1].lower()
    if extension not in LANGUAGES:
        raise ValueError(f"no language for {path}")
    return LANGUAGES[extension]


def import_kind(statement: str) -> str:
    words = statement.strip().split()
    if statement.strip().startswith("from ."):
        return "internal"
    root = words[1].split(".")[0].rstrip(",").lower() if len(words) > 1 else ""
    return "stdlib" if root in STDLIB else "external"


class _Capture:
    """Something found in a file: at its place, an entity or a call."""

    def __init__(self, at: int, kind: str, name: str, span: tuple[int, int] = (0, 0), **more):
        self.at, self.kind, self.name, self.span, self.more, self.calls = at, kind, name, span, more, []


def _python(source: str) -> list[_Capture]:
    tree = ast.parse(source)
    lines = source.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))

    def place(line: int, column: int) -> int:
        text = lines[line - 1] if line <= len(lines) else ""
        return starts[line - 1] + len(text.encode()[:column].decode("utf-8", "ignore"))

    def span(node) -> tuple[int, int]:
        return place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)

    found = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            a, b = span(node)
            names = [re.split(r"\(", ast.unparse(d), maxsplit=1)[0].strip() for d in node.decorator_list]
            bases = [ast.unparse(x) for x in node.bases if isinstance(x, (ast.Name, ast.Attribute))] if isinstance(node, ast.ClassDef) else []
            found.append(_Capture(source.find(node.name, a), "class" if isinstance(node, ast.ClassDef) else "function", node.name, (a, b), decorators=names, base_classes=bases))
            if node.decorator_list:
                first = source.rfind("@", 0, span(node.decorator_list[0])[0])
                found.append(_Capture(first, "api_endpoint", "API_Route", (first, b)))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            a, b = span(node)
            found.append(_Capture(a, "import", source[a:b], (a, b), import_type=import_kind(source[a:b])))
        elif isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr
            found.append(_Capture(span(node.func)[1] - len(name), "call", name))
    for token in tokenize.generate_tokens(io.StringIO(source).readline):
        if token.type == tokenize.COMMENT:
            a = starts[token.start[0] - 1] + token.start[1]
            found.append(_Capture(a, "comment", "Comment", (a, a + len(token.string))))
    return found


_LEX = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_NO_CALL = frozenset("if for while switch catch return function new synchronized super this else do try throw typeof await assert class".split())


def _blanked(source: str) -> tuple[str, list[tuple[int, int]]]:
    """The source with comments and strings blanked, and the comments' spans."""
    comments = []

    def blank(m: re.Match) -> str:
        if m[0].startswith(("//", "/*")):
            comments.append(m.span())
        return re.sub(r"[^\n]", " ", m[0])

    return _LEX.sub(blank, source), comments


def _closing(code: str, at: int, pair: str) -> int:
    """The end of the block that opens at ``at``."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(code, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.end()
    return len(code)


def _definitions(code: str, pattern: str, kind: str, found: list[_Capture], taken: set[int]) -> None:
    for m in re.finditer(pattern, code, re.M):
        if m["name"] in _NO_CALL or m.start("name") in taken:
            continue
        opens = code.find("{", m.end() - 1)
        taken.add(m.start("name"))
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        found.append(_Capture(m.start("name"), kind, m["name"], (start, _closing(code, opens, "{}") if opens >= 0 else m.end())))


def _java(source: str) -> list[_Capture]:
    code, comments = _blanked(source)
    found = [_Capture(a, "comment", "Comment", (a, b)) for a, b in comments]
    taken: set[int] = set()
    _definitions(code, r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*class\s+(?P<name>\w+)[^{;]*\{", "class", found, taken)
    _definitions(code, r"(?:(?:public|private|protected|static|final|abstract|synchronized|native)\s+)*[\w<>\[\],.?]+[ \t]+(?P<name>\w+)\s*\([^(){};]*\)\s*(?:throws\s+[\w.,\s]+)?\{", "function", found, taken)
    for m in re.finditer(r"^[ \t]*(import\s+[^;]+;)", code, re.M):
        found.append(_Capture(m.start(1), "import", source[m.start(1) : m.end(1)], m.span(1)))
    modifiers = r"(?:public|private|protected|static|final|abstract|synchronized)\b"
    for m in re.finditer(rf"(?:@\w+(?:\s*\([^()]*\))?\s*|{modifiers}\s*)*@(?:Get|Post|Request|Put|Delete)Mapping\s*\([^()]*\)\s*(?:@\w+(?:\s*\([^()]*\))?\s*|{modifiers}\s*)*", code):
        end = m.start() + len(m[0].rstrip())
        found.append(_Capture(m.start(), "api_endpoint", "API_Route", (m.start(), end)))
    _calls(code, r"(?<!@)\b(\w+)\s*\(", found, taken)
    return found


def _javascript(source: str) -> list[_Capture]:
    code, comments = _blanked(source)
    found = [_Capture(a, "comment", "Comment", (a, b)) for a, b in comments]
    taken: set[int] = set()
    _definitions(code, r"\b(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*\([^)]*\)\s*\{", "function", found, taken)
    _definitions(code, r"^[ \t]*(?:(?:static|async|get|set)\s+)*\*?(?P<name>[\w$]+)\s*\([^(){};]*\)\s*\{", "function", found, taken)
    for m in re.finditer(r"^[ \t]*(import\s[^;\n]*;?)", code, re.M):
        found.append(_Capture(m.start(1), "import", source[m.start(1) : m.end(1)], m.span(1)))
    for m in re.finditer(r"[\w$][\w$.]*\.(\w*(?:get|post|put|delete|patch|use)\w*)\s*\(", code):
        found.append(_Capture(m.start(), "api_endpoint", "API_Route", (m.start(), _closing(code, m.end() - 1, "()"))))
    _calls(code, r"(?<![.\w$])([\w$]+)\s*\(", found, taken)
    return found


def _calls(code: str, pattern: str, found: list[_Capture], taken: set[int]) -> None:
    for m in re.finditer(pattern, code):
        if m[1] not in _NO_CALL and m.start(1) not in taken and not m[1][0].isdigit():
            found.append(_Capture(m.start(1), "call", m[1]))


_PARSERS = {"python": _python, "java": _java, "javascript": _javascript}


def parse(path: str, source: str, parity: bool = False) -> list[dict]:
    """The entities of one file, in order; SyntaxError and ValueError mean that it can't be parsed."""
    found = sorted(_PARSERS[detect_language(path)](source), key=lambda c: c.at)
    entities, last = [], None
    for c in found:
        if c.kind == "call":
            if parity:
                owner = last
            else:
                around = [e for e in found if e.kind in OWNERS and e.span[0] <= c.at < e.span[1]]
                owner = max(around, key=lambda e: (e.span[0], e.kind != "api_endpoint"), default=None)
            if owner is not None and owner.kind in OWNERS:
                owner.calls.append(c.name)
        else:
            entities.append(c)
            last = c
    line = lambda at: source.count("\n", 0, at) + 1
    rows = [
        {
            "name": e.name, "type": e.kind, "labels": ["CodeEntity", e.kind], "content": source[e.span[0] : e.span[1]], "start_line": line(e.span[0]), "end_line": line(max(e.span[0], e.span[1] - 1)),
            "decorators": e.more.get("decorators", []), "base_classes": e.more.get("base_classes", []), "import_type": e.more.get("import_type"), "calls": e.calls, "ord": i,
        }
        for i, e in enumerate(entities)
    ]
    if source.strip() and not any(e.kind in OWNERS for e in entities):
        rows.append({"name": os.path.basename(path), "type": "script", "labels": ["CodeEntity", "script"], "content": source, "start_line": 1, "end_line": len(source.split("\n")), "decorators": [], "base_classes": [], "import_type": None, "calls": [], "ord": len(rows)})
    return rows


def parse_files(files: DataFrame, parity: bool = False) -> DataFrame:
    """Rows of SCHEMA of all files (project, path, content binary); an unparsable file has one row of type ``parse_error`` with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for project, path, content in zip(b["project"], b["path"], b["content"], strict=True):
                try:
                    parsed = parse(path, bytes(content).decode("utf-8"), parity)
                    rows += [{"project": project, "file": path, "error": None, **r} for r in parsed]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append({"project": project, "file": path, "name": os.path.basename(path), "type": "parse_error", "labels": [], "content": "", "start_line": 0, "end_line": 0, "decorators": [], "base_classes": [], "import_type": None, "calls": [], "ord": 0, "error": str(e)[:500]})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("project", "path", "content").mapInPandas(run, SCHEMA)


def entities(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNull()).drop("error")


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).select("project", "file", "error")
