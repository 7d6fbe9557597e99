"""Symbols of source texts by a walk over their blocks: classes and their members, functions, constants; function bodies are passed over."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Symbol(NamedTuple):
    name: str
    kind: str
    parent: str | None
    line: int
    end_line: int
    exported: bool
    signature: str


FAMILIES = {"py": "python", "pyi": "python", "js": "script", "mjs": "script", "cjs": "script", "jsx": "script", "ts": "script", "mts": "script", "cts": "script", "tsx": "script", "java": "java", "go": "go"}
_C_TEXT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"
_HIDDEN = {
    "python": re.compile(r"#[^\n]*|\"\"\"(?:[^\\]|\\[\s\S])*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\[\s\S])*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?"),
    "script": re.compile(_C_TEXT + r"|`(?:[^`\\]|\\[\s\S])*`?|(?:(?<=[=(,:;!&|?{}\[\n])|(?<=return)|(?<=typeof))[ \t]*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/"),
    "java": re.compile(r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|" + _C_TEXT), "go": re.compile(_C_TEXT + r"|`[^`]*`?"),
}
_NAME = r"[^\W\d][\w$]*"
_NOT_CALLED = r"(?!(?:if|for|while|switch|catch|return|else|do|new|function|await|typeof|throw|super|this|synchronized)\b)"
_SCRIPT_HEAD = r"(?P<lead>(?:(?:export|default|declare|abstract|async)[ \t]+)*)"
_MEMBER_HEAD = r"(?P<lead>(?:(?:public|private|protected|static|async|get|set|override|readonly|abstract|declare|accessor)[ \t]+)*)"
# What begins a symbol at the head of a line, at the top of a text and within a class.
_TOP = {
    "script": re.compile(
        rf"^[ \t]*{_SCRIPT_HEAD}(?:(?P<function>function)[ \t]*\*?[ \t]*(?P<n1>{_NAME})|(?P<class>class)[ \t]+(?P<n2>{_NAME})|(?P<interface>interface)[ \t]+(?P<n3>{_NAME})|(?P<enum>(?:const[ \t]+)?enum)[ \t]+(?P<n4>{_NAME})"
        rf"|(?P<type>type)[ \t]+(?P<n5>{_NAME})[^=\n]*=|(?P<value>const|let|var)[ \t]+(?P<n6>{_NAME})[ \t]*(?::[^=\n]+)?=)", re.M),
    "java": re.compile(rf"^[ \t]*(?P<lead>(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp)[ \t]+)*)(?:(?P<class>class|record)[ \t]+(?P<n1>{_NAME})|(?P<interface>@?interface)[ \t]+(?P<n2>{_NAME})|(?P<enum>enum)[ \t]+(?P<n3>{_NAME}))", re.M),
    "go": re.compile(rf"^(?:(?P<function>func)[ \t]+(?:\([^)\n]*?\*?(?P<owner>{_NAME})(?:\[[^\]]*\])?\)[ \t]*)?(?P<n1>{_NAME})|type[ \t]+(?P<n2>{_NAME})(?:\[[^\]]*\])?[ \t]+(?:(?P<class>struct)|(?P<interface>interface)|(?P<type>[^\s=]))|(?P<value>const|var)[ \t]+(?P<n3>{_NAME}))", re.M),
}
_WITHIN = {
    "script": re.compile(rf"^[ \t]*{_MEMBER_HEAD}(?P<method>[*#]?){_NOT_CALLED}(?P<n1>{_NAME})\??[ \t]*(?:<[^>\n]*>)?[ \t]*\(", re.M),
    "java": re.compile(
        rf"^[ \t]*(?P<lead>(?:(?:public|private|protected|static|final|abstract|default|synchronized|native|sealed|strictfp)[ \t]+)*)(?:(?P<class>class|record)[ \t]+(?P<n1>{_NAME})|(?P<interface>@?interface)[ \t]+(?P<n2>{_NAME})|(?P<enum>enum)[ \t]+(?P<n3>{_NAME})"
        rf"|(?P<method>(?:<[^>\n]*>[ \t]*)?(?:{_NOT_CALLED}{_NAME}[\w$.]*(?:<[^;{{}}()=\n]*>)?(?:\[\])*[ \t]+)?){_NOT_CALLED}(?P<n4>{_NAME})[ \t]*\(|(?P<value>{_NAME}[\w$.]*(?:<[^;{{}}()=\n]*>)?(?:\[\])*)[ \t]+(?P<n5>{_NAME})[ \t]*=)", re.M),
}
_PY = re.compile(rf"^(?P<pad>[ \t]*)(?:(?P<function>(?:async[ \t]+)?def)[ \t]+(?P<n1>{_NAME})|(?P<class>class)[ \t]+(?P<n2>{_NAME})|(?P<value>)(?P<n3>[^\W\d]\w*)[ \t]*(?::[^=\n]+)?=(?!=))", re.M)
_ARROW = re.compile(r"[ \t]*(?:async[ \t]*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)[ \t]*(?::[^=\n{]+)?=>")
_BLANK = re.compile(r"[^\n]")


class _Text:
    """A text with comments and strings blanked, its lines, and where its brackets close."""

    def __init__(self, text: str, family: str):
        self.text = text.replace("\r\n", "\n").replace("\r", "\n")
        self.bare = _HIDDEN[family].sub(lambda m: _BLANK.sub(" ", m[0]), self.text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.text))]
        self.closed: dict[int, int] = {}
        held: list[int] = []
        for m in re.finditer(r"[(){}\[\]]", self.bare):
            if m[0] in "({[":
                held.append(m.start())
            elif held:
                self.closed[held.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def block(self, at: int, stop: int) -> tuple[int, int] | None:
        """The braces after a head that begins at at, past brackets; None where a semicolon or the stop comes first."""
        while at < stop:
            c = self.bare[at]
            if c == "{":
                return at, self.closed.get(at, stop)
            if c in "([":
                at = self.closed.get(at, stop)
            elif c == ";":
                return None
            at += 1
        return None

    def statement(self, at: int, stop: int) -> int:
        """The last character of the statement that goes on at at: to a semicolon or a line break outside brackets."""
        while at < stop:
            c = self.bare[at]
            if c in "([{":
                at = self.closed.get(at, stop)
            elif c == ";" or c == "\n" and self.bare[:at].rstrip()[-1:] not in ("=", ",", "+", "|", "&"):
                return at if c == ";" else at - 1
            at += 1
        return max(stop - 1, 0)

    def said(self, at: int, to: int) -> str:
        return " ".join(self.text[at:to].split()).rstrip("{;: ")


def _braced(t: _Text, family: str, lo: int, hi: int, parent: str | None) -> Iterator[Symbol]:
    """Symbols of one level: of the text, or of a class's body. Other blocks, function bodies among them, are passed over."""
    heads, at = (_WITHIN.get(family) if parent else None) or _TOP[family], lo
    while at < hi:
        m = heads.search(t.bare, at, hi)
        brace = t.bare.find("{", at, hi)
        if brace >= 0 and (m is None or brace < m.start()):
            at = t.closed.get(brace, hi) + 1
            continue
        if m is None:
            return
        kind = next((k for k in ("function", "method", "class", "interface", "enum", "type", "value") if m.groupdict().get(k) is not None), "method")
        name = next(m[k] for k in m.re.groupindex if k[0] == "n" and k[1:].isdigit() and m[k])
        lead, begin, owner = m.groupdict().get("lead") or "", m.start() + len(m[0]) - len(m[0].lstrip()), m.groupdict().get("owner") or parent
        body = None
        if kind == "value":
            end = t.statement(m.end(), hi)
            head = end + 1
            kind = "function" if family == "script" and _ARROW.match(t.bare, m.end()) else "constant"
        elif kind == "type" and family == "script":
            end = t.statement(m.end(), hi)
            head = end + 1
        else:
            body = t.block(m.end() - 1 if t.bare[m.end() - 1] == "(" else m.end(), hi)
            if body is None and (kind == "class" or kind == "method" and family == "script" and not parent):
                at = m.end()
                continue
            end = body[1] if body else t.statement(m.end() - 1, hi)
            head = body[0] if body else end
        if kind == "function" and owner:
            kind = "method"
        exported = {"go": name[:1].isupper(), "java": not re.search(r"\b(?:private|protected)\b", lead), "script": "export" in lead if not parent else "private" not in lead and not m.group(0).lstrip().startswith("#")}[family]
        yield Symbol(name, kind, owner if kind != "class" or parent else None, t.line(begin), t.line(end), exported, t.said(begin, head))
        if body and kind in ("class", "interface", "enum") and family != "go":
            yield from _braced(t, family, body[0] + 1, body[1], name)
        at = end + 1


def _indented(t: _Text, first: int, last: int, parent: str | None) -> Iterator[Symbol]:
    """Symbols of the lines first to last that stand at the indentation of the first of them."""
    level = None
    k = first
    lines = t.bare.split("\n")
    while k <= last:
        row = lines[k - 1]
        if not row.strip():
            k += 1
            continue
        pad = len(row) - len(row.lstrip())
        level = pad if level is None else level
        m = _PY.match(row) if pad == level else None
        if m is None:
            k += 1
            continue
        begin = t.starts[k - 1] + pad
        name = m["n1"] or m["n2"] or m["n3"]
        if m["n3"] is not None:
            end = t.line(t.statement(t.starts[k - 1] + m.end(), len(t.bare)))
            yield Symbol(name, "constant", parent, k, end, not name.startswith("_"), t.said(begin, t.starts[end] if end < len(t.starts) else len(t.text)))
            k = end + 1
            continue
        at = t.starts[k - 1] + m.end()
        while at < len(t.bare) and t.bare[at] != ":":
            at = t.closed.get(at, len(t.bare)) + 1 if t.bare[at] in "([{" else at + 1
        end = body = t.line(at)
        for n in range(body + 1, last + 1):
            if lines[n - 1].strip():
                if len(lines[n - 1]) - len(lines[n - 1].lstrip()) <= pad and lines[n - 1].lstrip()[0] not in ")]}":
                    break
                end = n
        yield Symbol(name, "class" if m["class"] else "method" if parent else "function", parent, k, end, not name.startswith("_"), t.said(begin, at))
        if m["class"]:
            yield from _indented(t, body + 1, end, name)
        k = end + 1


def symbols_of(path: str | None, text: str | None) -> list[Symbol]:
    """The symbols of a text by its path's extension; none for unknown ones."""
    family = FAMILIES.get((path or "").rpartition(".")[2].lower())
    if not family or not text:
        return []
    t = _Text(text, family)
    return list(_indented(t, 1, len(t.starts), None) if family == "python" else _braced(t, family, 0, len(t.bare), None))


SCHEMA = "file_id bigint, name string, kind string, parent string, line int, end_line int, exported boolean, signature string"


def parsed(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(file_id, name, kind, parent, line, end_line, exported, signature): one pass over the whole texts of supported files, after one join by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
        for b in batches:
            rows = [(i, *s) for i, p, c in zip(*(x.to_pylist() for x in b.columns)) for s in symbols_of(p, c)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, types)], names=names)

    texts = contents.where("supported and content is not null").select(F.col("file_id").cast("bigint").alias("file_id"), "content")
    return files.select(F.col("id").cast("bigint").alias("file_id"), "path").join(texts, "file_id").select("file_id", "path", "content").mapInArrow(run, SCHEMA)
