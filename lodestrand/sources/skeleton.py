"""Source files as tables: declarations by pattern, bodies by braces or indentation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Declaration shapes by extension.
_SCRIPT = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|enum|type|const|let|var)\s*\*?\s+([A-Za-z_$][\w$]*)")
DECLARATIONS = {
    "py": re.compile(r"^\s*(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)"), "go": re.compile(r"^(func|type|var|const)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"),
    "java": re.compile(r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*(class|interface|enum|record)\s+([A-Za-z_]\w*)"),
    **dict.fromkeys(("ts", "mts", "tsx", "js", "mjs", "jsx"), _SCRIPT),
}
MOST_LINES = 500
_MASK = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\[\s\S])*`?")


def _extension(path: str | None) -> str:
    return (path or "").rpartition(".")[2].lower()


def declarations(path: str | None, text: str | None) -> list[tuple[int, str, str]]:
    """(line, kind, name) of the declarations of a text."""
    pattern = DECLARATIONS.get(_extension(path))
    if not pattern or not text:
        return []
    return [(n, m[1], m[2]) for n, line in enumerate(text.split("\n"), 1) if (m := pattern.match(line))]


def body(path: str | None, text: str, line: int, most: int | None = MOST_LINES) -> str:
    """The block that begins on the line: by indentation in Python, by braces outside strings and comments elsewhere; most lines at most, the whole block where most is None."""
    lines = text.split("\n")
    most = len(lines) if most is None else most
    if not 1 <= line <= len(lines):
        return ""
    if _extension(path) == "py":
        own = len(lines[line - 1]) - len(lines[line - 1].lstrip())
        end = line
        for k in range(line, min(len(lines), line - 1 + most)):
            if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) <= own:
                break
            end = k + 1
        return "\n".join(lines[line - 1 : end]).rstrip()
    rest = "\n".join(lines[line - 1 : line - 1 + most])
    masked = _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), rest)
    depth = 0
    for m in re.finditer(r"[{}]", masked):
        depth += 1 if m[0] == "{" else -1
        if depth <= 0:
            return rest[: m.end()]
    return rest


def _texts(files: DataFrame, contents: DataFrame) -> DataFrame:
    return files.select(F.col("id").alias("file_id"), "path").join(contents.select("file_id", "content", "supported"), "file_id")


def skeletons(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(file_id, line, kind, name): one pass over whole texts, no shuffle beyond the join by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *d) for i, p, t in zip(*(c.to_pylist() for c in b.columns)) for d in declarations(p, t)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["file_id", "line", "kind", "name"])

    return _texts(files, contents).where("supported").select("file_id", "path", "content").mapInArrow(run, "file_id bigint, line int, kind string, name string")


def bodies(symbols: DataFrame, contents: DataFrame) -> DataFrame:
    """(symbol_id, lines, hash) of function and method bodies, symbols gathered by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            out = []
            for text, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s in held:
                    if s["line"]:
                        found = body(s["file_path"], text, s["line"])
                        out.append((s["id"], found.count("\n") + 1, hashlib.sha256(found.encode("utf-8", "surrogatepass")).hexdigest()))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string()))], names=["symbol_id", "lines", "hash"])

    grouped = symbols.where("kind in ('function', 'method')").groupBy("file_id").agg(F.collect_set(F.struct("id", "file_path", "line")).alias("held"))
    return grouped.join(contents.select("file_id", "content").where("content is not null"), "file_id").select("content", "held").mapInArrow(run, "symbol_id bigint, lines int, hash string")
