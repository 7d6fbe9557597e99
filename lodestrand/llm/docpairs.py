"""Problem 5: functions paired with their documentation."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.lexing import Lexed
from lodestrand.session import table

EXTENSIONS = {"py": "py", "pyi": "py", "js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "ts": "js", "mts": "js", "cts": "js", "tsx": "js", "java": "java", "go": "go"}
_CONTROL = r"(?!(?:if|for|while|switch|catch|return|else|do|new|function|await|typeof|throw|super|constructor_)\b)"
HEADS = {
    "py": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)", re.M),
    "go": re.compile(r"^func[ \t]*(?:\([^)\n]*\)[ \t]*)?(\w+)", re.M),
    "java": re.compile(r"^[ \t]*(?:[\w<>\[\],.?&@]+[ \t]+)+" + _CONTROL + r"(\w+)[ \t]*\([^;{}=]*\)[ \t\n]*(?:throws[^{;]+)?\{", re.M),
    "js": re.compile(
        r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(\w+)"
        r"|^[ \t]*(?:(?:public|private|protected|static|async|get|set|override|readonly)[ \t]+)*[*#]?" + _CONTROL + r"([\w$]+)[ \t]*(?:<[^>\n]*>)?\([^;{}]*\)[ \t]*(?::[^{};=]+)?\{"
        r"|^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(\w+)[ \t]*=[ \t]*(?:async[ \t]*)?(?:\([^()]*\)|\w+)[ \t]*(?::[^=\n]+)?=>", re.M),
}


def language_of(path: str | None) -> str | None:
    return EXTENSIONS.get((path or "").rpartition(".")[2].lower())


class Source:
    """One file, lexed: its lines, comments by last line, strings, brackets."""

    def __init__(self, text: str, language: str):
        self.text = text = text.replace("\r\n", "\n").replace("\r", "\n")
        self.language = language
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        lexed = Lexed(text, language)
        self.comments, self.strings, self.brackets = lexed.comments, lexed.strings, lexed.brackets
        self.ends = {self.line_at(e - 1): (s, e) for s, e in self.comments if e > s}

    def line_at(self, offset: int) -> int:
        """The 1-based line of an offset."""
        return bisect_right(self.starts, offset)

    def line(self, number: int) -> str:
        if not 1 <= number <= len(self.starts):
            return ""
        end = self.starts[number] if number < len(self.starts) else len(self.text)
        return self.text[self.starts[number - 1] : end].rstrip("\n")

    def inside(self, spans: list[tuple[int, int]], offset: int) -> bool:
        at = bisect_right(spans, (offset, len(self.text) + 1)) - 1
        return at >= 0 and spans[at][0] <= offset < spans[at][1]

    def above(self, number: int) -> str:
        """The comment that ends on the line directly above, past decorators and annotations: one block comment or a run of line comments."""
        k = number - 1
        while k >= 1 and self.line(k).lstrip().startswith("@") and k not in self.ends:
            k -= 1
        parts: list[str] = []
        while k >= 1 and k in self.ends:
            s, e = self.ends[k]
            first = self.line_at(s)
            if self.text[self.starts[first - 1] : s].strip() or self.text[e : self.starts[k] if k < len(self.starts) else len(self.text)].strip():
                break
            block = self.text.startswith("/*", s)
            if block and parts:
                break
            parts.append(self.text[s:e])
            if block:
                break
            k = first - 1
        return "\n".join(reversed(parts))

    def docstring(self, number: int) -> str:
        """The string that is the first statement of the Python def that begins on the line, past its decorators."""
        while self.line(number).lstrip().startswith("@"):
            number += 1
        if not 1 <= number <= len(self.starts):
            return ""
        depth, at = 0, self.starts[number - 1]
        k = bisect_left(self.brackets, (at, ""))
        while True:
            stop = self.brackets[k][0] if k < len(self.brackets) else len(self.text)
            if depth == 0:
                colon = self.text.find(":", at, stop)
                while colon >= 0 and (self.inside(self.strings, colon) or self.inside(self.comments, colon)):
                    colon = self.text.find(":", colon + 1, stop)
                if colon >= 0:
                    break
            if k >= len(self.brackets):
                return ""
            depth += 1 if self.brackets[k][1] in "([{" else -1
            at, k = stop + 1, k + 1
        rest = colon + 1
        while True:
            while rest < len(self.text) and self.text[rest].isspace():
                rest += 1
            c = bisect_left(self.comments, (rest, 0))
            if c < len(self.comments) and self.comments[c][0] == rest:
                rest = self.comments[c][1]
                continue
            break
        s = bisect_left(self.strings, (rest, 0))
        if s < len(self.strings) and self.strings[s][0] == rest:
            found = self.text[rest : self.strings[s][1]]
            return re.sub(r"""^[rRbBuUfF]*("{3}|'{3}|"|')|("{3}|'{3}|"|')$""", "", found)
        return ""

    def end_line(self, number: int) -> int:
        """Where the function that begins on the line ends: by matched braces, in Python by indentation."""
        if self.language == "py":
            own = len(self.line(number)) - len(self.line(number).lstrip())
            last = number
            for k in range(number + 1, len(self.starts) + 1):
                text = self.line(k)
                if not text.strip() or text.lstrip()[0] == "#" or self.inside(self.strings, self.starts[k - 1]):
                    continue
                if len(text) - len(text.lstrip()) <= own and text.lstrip()[0] not in ")]}":
                    break
                last = k
            return last
        depth = parens = 0
        for at, c in self.brackets[bisect_left(self.brackets, (self.starts[number - 1], "")) :]:
            if c in "()":
                parens += 1 if c == "(" else -1
            elif parens <= 0:
                depth += 1 if c == "{" else -1
                if depth <= 0:
                    return self.line_at(at)
        return len(self.starts)

    def delimited(self, number: int, name: str) -> tuple[int, int]:
        """First and last line of the function whose head stands on the line or begins there, past decorators."""
        first = number
        while name and name not in self.line(first) and self.line(first).lstrip().startswith("@") and first < len(self.starts):
            first += 1
        return number, self.end_line(first)

    def functions(self) -> Iterator[tuple[str, int]]:
        """(name, line) of the functions and methods whose head stands in code."""
        for m in HEADS[self.language].finditer(self.text):
            group = next(k for k in range(1, m.re.groups + 1) if m.group(k)) if m.lastindex else 0
            at = m.start(group)
            if group and not self.inside(self.comments, at) and not self.inside(self.strings, at):
                yield m.group(group), self.line_at(at)

    def documentation(self, number: int) -> str:
        """What documents the function on the line: its docstring, else the comment directly above."""
        found = self.docstring(number) if self.language == "py" else ""
        return found if tells(found, "") else self.above(number) or found


# Marks and phrases that tell nothing.
_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!/)|///?/*!?|#+!?|\"\"\"|''')[ \t]?|\*+/\s*$|\"\"\"\s*$|'''\s*$")
_TOOL = re.compile(
    r"^\W{0,3}(?:eslint|prettier|tslint|jshint|jslint|istanbul|c8|v8|webpack|vite|biome|stylelint|deno-lint|ts-(?:ignore|nocheck|expect-error|check)|flow|nolint|noqa|pylint|mypy|pyright|type:\s*ignore|pragma|pragma:|fmt:|isort|yapf|ruff|flake8|nosec|noinspection|checkstyle|nosonar|spotless|suppress\w*|formatter:|language=|go:\w+|export_test|lint[:\-]|line \d|sourcemappingurl|coverage|codecov|\+build|\$\w+:)", re.I)
_PLACEHOLDER = re.compile(
    r"""^(?:(?:todo|fixme|xxx|tbd|tba|wip|hack|n/?a|nil|none|null|nothing|empty|ok|okay|same|see\s+(?:above|below|code|source|name|implementation)|as\s+above|same\s+as\s+(?:above|below|before)|ditto|
    (?:pretty\s+|quite\s+)?self[\s-]*explanatory|obvious|lorem\s+ipsum.*|(?:an?\s+|the\s+)?(?:helper|utility|internal|private|public|protected|static|main|getter|setter|constructor|destructor|function|method|class|stub|description|docs?|documentation|comment|comments|summary|placeholder|undocumented|deprecated|override|overrides|inherited|inheritdoc)(?:\s+(?:helper|function|method|only|use|api|stub|class|here))*|
    (?:\w+\s+)?auto-?\s?generated(?:\s+\w+)?\s+(?:stub|method|code|comment|doc)s?|(?:method|function)\s+stub|
    (?:no|missing|without)\s+(?:description|documentation|docs?|comments?)(?:\s+(?:yet|available|provided|given|here|needed|necessary))*|(?:description|documentation|docs?|comments?)\s+(?:is\s+|are\s+)?(?:missing|pending|needed|required|tbd|todo|goes\s+here|here|to\s+come|to\s+follow|follows?|later|coming\s+soon)|
    (?:please\s+)?(?:insert|add|write|put|enter|fill\s+in|provide)\s+(?:an?\s+|the\s+|some\s+|your\s+|missing\s+)?(?:description|documentation|docs?|comments?|docstring|summary|text)(?:\s+(?:here|later|please|below|above))*|change\s+me|fill\s+(?:me\s+)?in|coming\s+soon|work\s+in\s+progress|to\s+be\s+(?:done|written|documented|described|completed|defined))\s*)$""", re.I | re.X)
_TASK = re.compile(r"^\W*(?:todo|fixme|xxx|tbd|hack|wip)\b(?:\([^)\n]*\))?[^.!?\n]*(?:[.!?](?:\s|$)|$)", re.I | re.M)
_TAG = re.compile(r"^\s*(?:[@\\:]\w+|\{@\w+[^}]*\}|:(?:param|type|returns?|rtype|raises?)\b[^:]*:)")
_SECTION = re.compile(r"^\s*(?:args?|arguments|param(?:eter)?s?|returns?|yields?|raises|throws|attributes)\s*:?\s*$", re.I)
_CODE = re.compile(
    r"""^(?:[\w.$\[\]]+\s*(?:[-+*/%|&^]|<<|>>|\*\*|//|:)?=[^=].*|(?:return|yield|await|throw|raise|del|assert|import|from|break|continue|pass|goto|package)\b(?:\s*$|\s+[^\s]+(?:\s*[-+*/%.,(\[=<>].*|;)?$)
    |(?:if|for|while|elif|else\s+if|switch|catch|with)\s*\(.*|(?:if|elif|for|while|with|else|try|except|finally|def|class)\b.*[:{]$|(?:const|let|var|final|int|long|string|boolean|auto|func|function)\s+[\w$]+\s*(?:[=(:].*|;)$
    |[\w$.]+\([^()]*(?:\([^()]*\)[^()]*)*\)\s*[;{]?|.*[;{}]|[{}()\[\];,]+|</?\w+.*>)$""", re.X)
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+")
_FILLER = frozenset("a an the this that it its is are be of for to and or in on by with function method class procedure routine helper func fn def returns return does do just simply here new get set use used using performs perform executes execute implements implementation call calls name named called foo bar baz qux quux".split())


def strip_marks(text: str) -> list[str]:
    """The lines of a comment without comment marks."""
    lines = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        while (less := _MARKS.sub("", line, count=1)) != line:
            line = less
        lines.append(line.strip())
    return lines


def description(text: str) -> str:
    """What a comment says besides marks, tool instructions, disabled code, tags and parameter lists."""
    kept: list[str] = []
    listing = False
    for line in strip_marks(text):
        if not line:
            listing = False
            continue
        if _SECTION.match(line):
            listing = True
            continue
        if _TAG.match(line):
            said = re.match(r"\s*(?:@(?:returns?|description|summary|brief|desc|remarks|deprecated|throws)|:returns?:)\s+(?:\{[^}]*\}\s*)?(.*)", line)
            if said and len(said[1].split()) > 2:
                kept.append(said[1])
            listing = bool(re.match(r"\s*[@:]param", line))
            continue
        if listing and re.match(r"[\w*$]+(?:\s*\([^)]*\))?\s*(?::|-|–)", line):
            continue
        listing = False
        if _TOOL.match(line) or _CODE.match(line):
            continue
        kept.append(line)
    return _TASK.sub("", "\n".join(kept)).strip()


def _stem(word: str) -> str:
    for end in ("ing", "ies", "es", "ed", "s", "e", "y"):
        if len(word) > len(end) + 2 and word.endswith(end):
            return word[: -len(end)]
    return word


def tells(text: str | None, name: str) -> bool:
    """Whether a comment tells something of what the function does or how, beyond its name."""
    if not text:
        return False
    said = description(text)
    if not any(c.isalpha() for c in said):
        return False
    if _PLACEHOLDER.match(re.sub(r"[\[\](){}<>.!?:*~=#\s-]+$|^[\[\](){}<>.!?:*~=#\s-]+", "", said)):
        return False
    known = {_stem(w.lower()) for w in _SPLIT.findall(name)} | {name.lower()}
    fresh = [w for w in (x.lower() for x in re.findall(r"[^\W\d_]+", " ".join(_SPLIT.findall(said)))) if w not in _FILLER and _stem(w) not in known]
    return any(map(_is_word, set(fresh))) and (len(fresh) < 2 or len(set(fresh)) > 1)


_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_VOWELS = frozenset("aeiouyáàâãäåæéèêëíìîïóòôõöøœúùûüýÿаеёиоуыэюяіїєαεηιουω")


def _is_word(word: str) -> bool:
    """Whether letters can be a word that says something: two or more, not one letter repeated, no run along the keyboard, and vowels where the script writes them."""
    if len(word) == 1 and ord(word) < 0x2E80 or len(set(word)) == 1 and len(word) < 4:
        return False
    if len(word) > 3 and any(word in row or word in row[::-1] for row in _KEYS):
        return False
    return ord(word[0]) > 0x530 or bool(_VOWELS & set(word)) or word.isupper() or len(word) < 4


CHUNK = 5_000  # symbols of a file in one group, about; files with more are split by a hash of the symbol's id


def _by_file(symbols: DataFrame, contents: DataFrame) -> DataFrame:
    """(content, symbols): the function symbols of each file beside its text; files without text keep their symbols.

    A file's symbols are grouped, at most about CHUNK together, and symbols without a file stand alone, so no
    group grows with the table.
    """
    wanted = symbols.where(F.lower("kind").isin("function", "method") & F.col("id").isNotNull())
    spread = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("_many") / CHUNK)))
    crowded = wanted.where("file_id is not null").groupBy("file_id").agg(F.count("*").alias("_many")).where(F.col("_many") > CHUNK)
    wanted = wanted.join(crowded, "file_id", "left")
    part = F.when(F.col("file_id").isNull(), F.col("id").cast("bigint")).otherwise(F.coalesce(spread, F.lit(0)))
    held = wanted.select("file_id", part.alias("part"), F.struct(F.col("id").cast("bigint").alias("id"), "file_path", "name", "signature", F.col("line").cast("int").alias("line"), "comment").alias("s"))
    grouped = held.groupBy("file_id", "part").agg(F.collect_set("s").alias("symbols"))
    texts = contents.select("file_id", "content").where("file_id is not null")
    with_file = grouped.where("file_id is not null").join(texts, "file_id", "left").select("content", "symbols")
    return with_file.union(grouped.where("file_id is null").select(F.lit(None).cast("string").alias("content"), "symbols"))


PAIR = "symbol_id bigint, name string, signature string, documentation string, start_line int, end_line int"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for content, symbols in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sources: dict[str, Source] = {}
            for s in symbols:
                name, line, source = s["name"] or "", s["line"], None
                if content and line and (language := language_of(s["file_path"])):
                    source = sources.get(language) or sources.setdefault(language, Source(content, language))
                    if not 1 <= line <= len(source.starts):
                        source = None
                first, end = source.delimited(line, name) if source else (line, None)
                doc = s["comment"] if tells(s["comment"], name) else source.documentation(first) if source else None
                if doc is not None and tells(doc, name):
                    out.append((s["id"], s["name"], s["signature"], "\n".join(strip_marks(doc)).strip(), line, end))
        columns = list(zip(*out)) or [()] * 6
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["symbol_id", "name", "signature", "documentation", "start_line", "end_line"])


def documented_symbols(symbols: DataFrame, contents: DataFrame) -> DataFrame:
    """A row for each function or method symbol whose documentation tells something.

    The file's text is lexed whole; each symbol's function is delimited in it by matched braces, in Python by
    indentation. Documentation is the symbol's comment, else the docstring within or the comment directly
    above the function. Null kinds, ids and names, files without text, lines outside the text and
    unknown languages are met by what is left of the two sources; repeated rows count once. The text
    is shuffled once, to its file's symbols.
    """
    return _by_file(symbols, contents).mapInArrow(_pairs, PAIR)


def extracted_functions(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(file_id, name, start_line, end_line, signature, documentation): functions found in the text itself that are documented.

    files gives path by id. Texts are lexed whole; functions are found by their heads in code, delimited by
    matched braces or indentation, and paired with the documentation directly above or within.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for ident, path, content in zip(*(c.to_pylist() for c in b.columns)):
                if content and (language := language_of(path)):
                    source = Source(content, language)
                    for name, line in source.functions():
                        found = source.documentation(line)
                        if tells(found, name):
                            out.append((ident, name, line, source.end_line(line), source.line(line).strip(), "\n".join(strip_marks(found)).strip()))
            columns = list(zip(*out)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file_id", "name", "start_line", "end_line", "signature", "documentation"])

    texts = files.select(F.col("id").cast("bigint").alias("file_id"), "path").join(contents.select(F.col("file_id").cast("bigint").alias("file_id"), "content"), "file_id")
    return texts.select("file_id", "path", "content").mapInArrow(run, "file_id bigint, name string, start_line int, end_line int, signature string, documentation string")


def p5_found(spark, d):
    return documented_symbols(table(spark, d, "symbols"), table(spark, d, "file_contents")).select("symbol_id").distinct()


def p5_pairs(spark, d):
    return documented_symbols(table(spark, d, "symbols"), table(spark, d, "file_contents"))


def p5_extracted(spark, d):
    return extracted_functions(table(spark, d, "files"), table(spark, d, "file_contents"))


QUERIES = {"p5_found": p5_found, "p5_pairs": p5_pairs, "p5_extracted": p5_extracted}
SQL: dict[str, str] = {}
