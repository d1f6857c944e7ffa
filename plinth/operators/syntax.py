"""Facts from source files by Python table functions: chunks, calls and imports.

Python is parsed by the standard ``ast`` module.  JavaScript goes through a scanner of its own that
knows strings, comments, templates and brackets; it finds declarations by their heads and bodies by
matching braces.  A file with a syntax error has no chunks and no calls; imports of a broken Python
file are found line by line.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.ids import chunk_id, file_id

CHUNK_SCHEMA = "path string, ordinal int, chunk_type string, function_name string, class_name string, parent_class string, start_line int, end_line int, raw_code string, error string"
CALL_SCHEMA = "path string, ordinal int, owner_start int, owner_name string, callee string, is_self boolean, qualifier string, is_reference boolean"
IMPORT_SCHEMA = "path string, module string, level int"


# --- Python ------------------------------------------------------------------------------------


def _base_name(node: ast.expr) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    return ast.unparse(node) if isinstance(node, ast.Attribute) else None


def python_chunks(source: str) -> list[dict]:
    """Functions, classes and methods in document order; a nested function keeps the nearest class around it."""
    lines = source.split("\n")
    found: list[dict] = []

    def visit(node: ast.AST, cls: str | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                row = {"start_line": start, "end_line": child.end_lineno, "raw_code": "\n".join(lines[start - 1 : child.end_lineno])}
                if isinstance(child, ast.ClassDef):
                    bases = ", ".join(b for b in map(_base_name, child.bases) if b)
                    found.append(row | {"chunk_type": "class", "function_name": None, "class_name": child.name, "parent_class": bases or None})
                    visit(child, child.name, True)
                else:
                    kind = "method" if in_class else "async_function" if isinstance(child, ast.AsyncFunctionDef) else "function"
                    found.append(row | {"chunk_type": kind, "function_name": child.name, "class_name": cls, "parent_class": None})
                    visit(child, cls, False)
            else:
                visit(child, cls, in_class)

    visit(ast.parse(source), None, False)
    return found


def _site(func: ast.expr) -> dict | None:
    if isinstance(func, ast.Name):
        return {"callee": func.id, "is_self": False, "qualifier": None}
    if isinstance(func, ast.Attribute):
        owner = func.value.id if isinstance(func.value, ast.Name) else None
        return {"callee": func.attr, "is_self": owner in ("self", "cls"), "qualifier": None if owner in ("self", "cls") else owner}
    return None


def python_calls(source: str) -> list[dict]:
    """Every call inside a chunk, once for each chunk around it, in document order."""
    found: list[dict] = []
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            calls = sorted((c for c in ast.walk(node) if isinstance(c, ast.Call)), key=lambda c: (c.lineno, c.col_offset, -(c.end_lineno or 0), -(c.end_col_offset or 0)))
            found += [site | {"owner_start": start, "owner_name": node.name, "is_reference": False} for c in calls if (site := _site(c.func))]
    return found


def python_imports(source: str) -> list[tuple[str, int]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        plain = re.findall(r"(?m)^[ \t]*import[ \t]+([^\n#;]+)", source)
        named = [(part.split(" as ")[0].strip(), 0) for x in plain for part in x.split(",") if part.strip()]
        return named + [(m, len(d)) for d, m in re.findall(r"(?m)^[ \t]*from[ \t]+(\.*)([\w.]*)[ \t]+import\b", source)]
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found += [(a.name, 0) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            found.append((node.module or "", node.level))
    return found


# --- JavaScript --------------------------------------------------------------------------------

_KEYWORDS = frozenset("if for while switch catch function return typeof new await do else try with super import in of instanceof void delete throw yield case class extends const let var async static get set export default".split())


def js_blank(source: str) -> str | None:
    """The source with the insides of strings, comments and regular expressions blanked; None if brackets or quotes don't match."""
    out, i, n, stack = list(source), 0, len(source), []
    last = ""
    pairs = {")": "(", "]": "[", "}": "{"}

    def blank(a: int, b: int) -> None:
        for k in range(a, b):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        c = source[i]
        if source.startswith("//", i):
            j = source.find("\n", i)
            j = n if j < 0 else j
            blank(i, j)
            i = j
            continue
        if source.startswith("/*", i):
            j = source.find("*/", i + 2)
            if j < 0:
                return None
            blank(i, j + 2)
            i = j + 2
            continue
        if c in "'\"`" or (c == "/" and (last in "" or last in "(,=:[!&|?{};+-*%~^<>")):
            j, in_set = i + 1, False
            while j < n:
                d = source[j]
                if d == "\\":
                    j += 2
                    continue
                if c == "/" and d in "[]":
                    in_set = d == "["
                elif d == c and not in_set:
                    break
                elif d == "\n" and c != "`":
                    return None
                j += 1
            if j >= n:
                return None
            blank(i + 1, j)
            last, i = c, j + 1
            continue
        if c in "([{":
            stack.append(c)
        elif c in ")]}":
            if not stack or stack.pop() != pairs[c]:
                return None
        if not c.isspace():
            last = c
        i += 1
    return None if stack else "".join(out)


def _close(text: str, at: int) -> int:
    """The index of the bracket that closes the one at ``at``."""
    depth, opens = 0, text[at]
    closes = {"(": ")", "[": "]", "{": "}"}[opens]
    for i in range(at, len(text)):
        depth += (text[i] == opens) - (text[i] == closes)
        if not depth:
            return i
    return len(text) - 1


_JS_CLASS = re.compile(r"\bclass\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([\w$.]+))?\s*\{")
_JS_FUNCTION = re.compile(r"\b(async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(")
_JS_ARROW = re.compile(r"(?:\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)|\b(?:module\.)?exports\.([A-Za-z_$][\w$]*))\s*=\s*((?:[A-Za-z_$][\w$]*\s*\(\s*)*)(?:async\s+)?(?=\([^()]*(?:\([^()]*\)[^()]*)*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)")
_JS_METHOD = re.compile(r"(?:\b(?:static|async|get|set)\s+)*\*?\s*(#?[A-Za-z_$][\w$]*)\s*\(")


def _js_body_end(text: str, at: int) -> int:
    """The end of an arrow function's body that begins at ``at``."""
    while at < len(text) and text[at].isspace():
        at += 1
    if at < len(text) and text[at] == "{":
        return _close(text, at)
    depth = 0
    for i in range(at, len(text)):
        if text[i] in "([{":
            depth += 1
        elif text[i] in ")]}":
            if not depth:
                return i - 1
            depth -= 1
        elif not depth and text[i] in ";,\n" and text[at:i].strip():
            return i - 1
    return len(text) - 1


def js_chunks(source: str) -> list[dict]:
    """Classes, methods, function declarations and named arrow functions, in document order."""
    text = js_blank(source)
    if text is None:
        raise SyntaxError("brackets or quotes don't match")
    lines = source.split("\n")
    spans: list[tuple[int, int, dict]] = []
    classes = []
    for m in _JS_CLASS.finditer(text):
        end = _close(text, m.end() - 1)
        classes.append((m.end() - 1, end, m[1]))
        spans.append((m.start(), end, {"chunk_type": "class", "function_name": None, "class_name": m[1], "parent_class": m[2]}))
    around = lambda at: max((c for c in classes if c[0] < at < c[1]), default=None)
    for a, b, name in classes:
        at = a + 1
        while at < b:
            m = _JS_METHOD.match(text, at)
            if m and m[1] not in _KEYWORDS:
                after = _close(text, m.end() - 1) + 1
                brace = re.compile(r"\s*\{").match(text, after)
                if brace:
                    end = _close(text, brace.end() - 1)
                    spans.append((m.start() + len(m[0]) - len(m[0].lstrip()), end, {"chunk_type": "method", "function_name": m[1], "class_name": name, "parent_class": None}))
                    at = end + 1
                    continue
            at = _close(text, at) + 1 if text[at] in "([{" else at + 1
    for m in _JS_FUNCTION.finditer(text):
        brace = re.compile(r"\s*\{").match(text, _close(text, m.end() - 1) + 1)
        if brace:
            inside = around(m.start())
            spans.append((m.start(), _close(text, brace.end() - 1), {"chunk_type": "async_function" if m[1] else "function", "function_name": m[2], "class_name": inside[2] if inside else None, "parent_class": None}))
    for m in _JS_ARROW.finditer(text):
        head = text.find("=>", _close(text, m.end()) if text[m.end() : m.end() + 1] == "(" else m.end())
        inside = around(m.start())
        begin = m.end() - (len("async ") if text[: m.end()].rstrip().endswith("async") else 0)
        spans.append((begin if not m[3].strip() else m.start(), _js_body_end(text, head + 2), {"chunk_type": "arrow_function", "function_name": m[1] or m[2], "class_name": inside[2] if inside else None, "parent_class": None}))
    out = []
    for a, b, row in sorted(spans, key=lambda x: (x[0], -x[1])):
        first, last = source.count("\n", 0, a) + 1, source.count("\n", 0, b + 1) + 1
        out.append(row | {"start_line": first, "end_line": last, "raw_code": "\n".join(lines[first - 1 : last])})
    return out


_JS_CALL = re.compile(r"(?:\b([A-Za-z_$][\w$]*)\s*\.\s*|(?<=[)\]])\s*\.\s*)?(?<![\w$.])?\b([A-Za-z_$][\w$]*)\s*\(")
_JS_REFERENCE = re.compile(r"[(,]\s*([A-Za-z_$][\w$]*)\s*(?=[,)])")


def _js_sites(text: str) -> list[dict]:
    found = []
    for m in _JS_CALL.finditer(text):
        name, owner = m[2], m[1]
        before = text[: m.start()].rstrip()
        if name in _KEYWORDS or re.search(r"\b(?:function\s*\*?|class|new)$", before) and not owner:
            continue
        if owner and before.endswith("."):  # a longer chain: no qualifier
            owner = None
        found.append({"callee": name, "is_self": owner == "this", "qualifier": None if owner == "this" else owner, "is_reference": False})
    return found


def js_calls(source: str) -> list[dict]:
    """Calls inside each chunk, and at module scope (no owner) calls and bare names passed as arguments."""
    text = js_blank(source)
    if text is None:
        raise SyntaxError("brackets or quotes don't match")
    chunks = js_chunks(source)
    blanked = text.split("\n")
    found, covered = [], set()
    for c in chunks:
        body = "\n".join(blanked[c["start_line"] - 1 : c["end_line"]])
        covered.update(range(c["start_line"], c["end_line"] + 1))
        name = c["function_name"] or c["class_name"]
        own = re.compile(rf"(?:function\s*\*?\s*)?{re.escape(name)}\s*\(").search(body) if c["chunk_type"] not in ("class", "arrow_function") else None
        body = body[own.end() :] if own else body
        found += [s | {"owner_start": c["start_line"], "owner_name": name} for s in _js_sites(body)]
    outside = "\n".join("" if i + 1 in covered else x for i, x in enumerate(blanked))
    found += [s | {"owner_start": None, "owner_name": None} for s in _js_sites(outside)]
    found += [{"callee": m[1], "is_self": False, "qualifier": None, "is_reference": True, "owner_start": None, "owner_name": None} for m in _JS_REFERENCE.finditer(outside) if m[1] not in _KEYWORDS]
    return found


def js_imports(source: str) -> list[tuple[str, int]]:
    clean = re.sub(r"(?m)//.*$|/\*[\s\S]*?\*/", "", source)
    found = re.findall(r"""\bimport\s+(?:[\w*{}\s,$]+\s+from\s+)?["']([^"'\n]+)["']|\brequire\(\s*["']([^"'\n]+)["']\s*\)""", clean)
    return [(a or b, 0) for a, b in found]


# --- table functions ---------------------------------------------------------------------------

_CHUNKERS = {"python": python_chunks, "javascript": js_chunks}
_CALLERS = {"python": python_calls, "javascript": js_calls}
_IMPORTERS = {"python": python_imports, "javascript": js_imports}


def _apply(files: DataFrame, table: dict, schema: str, on_error: bool) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, language, text in zip(frame["path"], frame["language"], frame["text"], strict=True):
                try:
                    rows = table[language](text) if language in table else []
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows = [{"error": str(e)}] if on_error else []
                out += [{"path": path, "ordinal": i} | (row if isinstance(row, dict) else {"module": row[0], "level": row[1]}) for i, row in enumerate(rows)]
            frame = pd.DataFrame(out, columns=names)
            for name in ("ordinal", "start_line", "end_line", "owner_start", "level"):
                if name in frame:
                    frame[name] = frame[name].astype("Int32")
            yield frame.astype(object).where(frame.notna(), None)

    return files.select("path", "language", "text").mapInPandas(make, schema)


def chunks(files: DataFrame) -> DataFrame:
    """Chunks of (path, language, text) with deterministic ids; files that can't be parsed give one row with ``error``."""
    found = _apply(files, _CHUNKERS, CHUNK_SCHEMA, True)
    name = F.coalesce("function_name", "class_name")
    return found.withColumn("file_id", file_id(F.col("path"))).withColumn("chunk_id", F.when(F.col("error").isNull(), chunk_id(F.col("file_id"), name, F.col("start_line"))))


def calls(files: DataFrame) -> DataFrame:
    return _apply(files, _CALLERS, CALL_SCHEMA, False)


def imports(files: DataFrame) -> DataFrame:
    return _apply(files, _IMPORTERS, IMPORT_SCHEMA, False)
