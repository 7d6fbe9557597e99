"""Problem 7: source files that are no valid syntax of their language."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import grammars
from lodestrand.llm.glr import Grammar, Recogniser
from lodestrand.session import table

LANGUAGES = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "go": "go", "java": "java"}

_WORD = r"[^\W\d]\w*"
_C_NUMBER = r"(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*|0[bB][01](?:_?[01])*|0[oO]?[0-7](?:_?[0-7])*|(?:(?:\d(?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)"
_C_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|/\*"
_QUOTED = r'"(?:[^"\\\n]|\\[\s\S])*"|' + r"'(?:[^'\\\n]|\\[\s\S])*'"
_AFTER = r"(?:(?<=[=(,:;!&|?{\[+\-*%<>~^])|(?<=[=(,:;!&|?{\[+\-*%<>~^] )|(?<=return )|(?<=typeof )|(?<=case ))"
_BREAK = r"\n[ \t\f]*"

PATTERNS = {
    "python": "|".join((
        r"(?:[rRbBuUfF]|[bBfF][rR]|[rR][bBfF])?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|(?!\"\"\"|''')(?:" + _QUOTED + "))",
        r"#[^\n]*", _BREAK, r"\\\n[ \t]*", _WORD,
        r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]|[1-9](?:_?\d)*|0(?:_?0)*)(?!\w)",
        r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|[-+*/%&|^@=!<>]=|\S",
    )),
    "javascript": "|".join((
        r"\A#![^\n]*", _C_COMMENT, _BREAK, _QUOTED, r"`(?:[^`\\]|\\[\s\S])*`", _AFTER + r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*", r"#?(?:[^\W\d]|\$)[\w$]*",
        r"(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?n?)(?![\w$])",
        r"\.\.\.|\?\.(?!\d)|=>|\*\*=|<<=|&&=|\|\|=|\?\?=|===|!==|\*\*|<<|&&|\|\||\?\?|\+\+|--|[-+*/%&|^=!<>]=|\S",
    )),
    "go": "|".join((_C_COMMENT, _BREAK, r'"(?:[^"\\\n]|\\.)*"', r"'(?:\\[^\n]+?|[^'\\\n])'", r"`[^`]*`", _WORD, _C_NUMBER + r"i?(?!\w)", r"<<=|>>=|&\^=|\.\.\.|:=|<-|\+\+|--|&&|\|\||&\^|<<|>>|[-+*/%&|^=!<>]=|\S")),
    "java": "|".join((_C_COMMENT, _BREAK, r'"""(?:[^\\]|\\[\s\S])*?"""', r'(?!""")"(?:[^"\\\n]|\\.)*"', r"'(?:\\[^\n']+|\\'|[^'\\\n])'", r"non-sealed|" + r"(?:[^\W\d]|\$)[\w$]*", _C_NUMBER + r"[lLfFdD]?(?!\w)", r"\.\.\.|->|::|<<=|\+\+|--|&&|\|\||<<|[-+*/%&|^=!<>]=|\S")),
}
PATTERNS["typescript"] = PATTERNS["javascript"]
# Tokens that share a class of the grammar.
SHARED = {
    "python": {"BIN": "// % & ^ | << >>", "CMP": "< > == != <= >=", "UN": "~", "ASG": "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=", "CONST": "None True False"},
    "javascript": {"BIN": "== === != !== <= && || ?? ** << / % ^", "ASG": "+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??=", "GE": ">=", "UN": "~", "UNW": "typeof void delete", "INC": "++ --", "CONST": "null true false"},
    "go": {"BIN": "== != < <= > >= && || / % &^ << >>", "ASG": "+= -= *= /= %= &= |= ^= <<= >>= &^=", "INC": "++ --"},
    "java": {"BIN": "== != <= && || << / % ^", "ASG": "+= -= *= /= %= &= |= ^= <<=", "GE": ">=", "UN": "! ~", "INC": "++ --", "CONST": "true false null", "PRIM": "boolean byte short int long char float double", "MOD": "public private protected native transient volatile strictfp non-sealed"},
}
SHARED["typescript"] = SHARED["javascript"]
KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while",
}


# Where tokens hang on more than the characters beside them, texts are cut into tokens one by one.
_NESTED = {"python": re.compile(r"(?i)(?<!\w)(?:f|fr|rf)[\"']"), "javascript": re.compile(r"\$\{|\)[ \t\n]*/(?![/*])|(?:\n|\A|[ \t])[ \t]+/(?![/*])|\n/(?![/*])"), "go": None}
_NESTED["typescript"] = _NESTED["javascript"]
_NAMED = re.compile(r"\\N\{[\w -]+\}")
_F_STRING = re.compile(r"(?:[fF][rR]?|[rR][fF])(\"\"\"|'''|\"|')")
_REGEX = re.compile(r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_TEMPLATE_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)?")


def _script_tokens(pattern: re.Pattern, text: str) -> list[str]:
    """Tokens of a script: templates in parts around the code within, patterns after the bracket of a condition."""
    out: list[str] = []
    parts: list[int] = []  # open braces in each template part
    conditions: list[bool] = []
    last, condition, fresh, at = "", False, True, 0
    while (m := pattern.search(text, at)) is not None:
        t, at = m[0], m.end()
        if t[0] == "`" or t == "}" and parts and parts[-1] == 0:
            if t == "}":
                parts.pop()
            text_part = _TEMPLATE_TEXT.match(text, m.start() + 1)
            at = text_part.end()
            t = text[m.start() : at] if text_part[1] else "\\"
            if text_part[1] == "${":
                parts.append(0)
        elif t[0] == "/" and not t.startswith(("//", "/*")) and _begins(last, condition, fresh) and (found := _REGEX.match(text, m.start())):
            t, at = found[0], found.end()
        elif t == "{" and parts:
            parts[-1] += 1
        elif t == "}" and parts:
            parts[-1] -= 1
        elif t == "(":
            conditions.append(last in ("if", "while", "for", "with"))
        elif t == ")":
            condition = conditions.pop() if conditions else False
        out.append(t)
        if t[0] == "\n":
            fresh = True
        elif not t.startswith(("//", "/*")):
            last, fresh = t, False
    return out


# Words after which a slash begins a pattern.
_WORDS_BEFORE = frozenset("return typeof case in of delete void throw new do else instanceof yield await".split())


def _begins(last: str, condition: bool, fresh: bool) -> bool:
    """Whether a slash begins a pattern after the token last. fresh: a line break stands between."""
    if last == ")":
        return condition
    if last == "}":
        return fresh
    if not last or last in _WORDS_BEFORE:
        return True
    return not (last[-1].isalnum() or last[-1] in "_$]\"'`" or last in ("++", "--") or len(last) > 2 and last[0] == "/")


def _python_tokens(pattern: re.Pattern, text: str) -> list[str]:
    """Tokens of a Python text, f-strings in parts around the fields within: ':\\0' begins a field's format, '{\\0' and '}\\0' stand around a field in it."""
    out: list[str] = []
    fields: list[list] = []  # of each open field: the quote of its string, its open brackets, whether it stands in a format
    at = 0

    def literal(start: int, quote: str, begin: int) -> int:
        """Put the string's text from start to its next field or end, with what stands from begin on."""
        k, end, raw = start, len(text), "r" in text[begin : begin + 2].lower()
        while k < end:
            c = text[k]
            if c == "\\":
                named = not raw and _NAMED.match(text, k)
                k = named.end() if named else k + 1 if text[k + 1 : k + 2] in ("{", "}") else k + 2
            elif text.startswith(quote, k):
                out.append(text[begin : k + len(quote)])
                return k + len(quote)
            elif c == "\n" and len(quote) == 1:
                break
            elif text.startswith(("{{", "}}"), k):
                k += 2
            elif c == "{":
                out.append(text[begin : k + 1])
                fields.append([quote, 0, False])
                return k + 1
            elif c == "}":
                break
            else:
                k += 1
        out.append("\\")
        return min(k + 1, end)

    def format_(k: int) -> int:
        """Skip the text of a field's format to the next field in it or to its end."""
        quote = fields[-1][0]
        while k < len(text) and text[k] not in "{}" and not text.startswith(quote, k) and not (text[k] == "\n" and len(quote) == 1):
            k += 1
        if k < len(text) and text[k] == "{":
            out.append("{\0")
            fields.append([quote, 0, True])
            return k + 1
        if k >= len(text) or text[k] != "}":
            out.append("\\")
            return k + 1
        if fields.pop()[2]:
            out.append("}\0")
            return format_(k + 1)
        return literal(k + 1, quote, k)

    while (m := pattern.search(text, at)) is not None:
        t, at = m[0], m.end()
        opened = _F_STRING.match(text, m.start())
        if opened and not (out and out[-1][-1:].isalnum() and m.start() and text[m.start() - 1].isalnum()):
            at = literal(opened.end(), opened[1], m.start())
            continue
        if fields:
            quote, depth, inner = fields[-1]
            if depth == 0 and t[0] == "}":
                fields.pop()
                if inner:
                    out.append("}\0")
                at = format_(m.start() + 1) if inner else literal(m.start() + 1, quote, m.start())
                continue
            if depth == 0 and t[0] == ":":
                out.append(":\0")
                at = format_(m.start() + 1)
                continue
            if depth == 0 and out[-1] == "!" and t not in ("s", "r", "a"):
                out.append("\\")
            if t in ("(", "[", "{"):
                fields[-1][1] += 1
            elif t in (")", "]", "}"):
                fields[-1][1] -= 1
        out.append(t)
    return out


_FIELDS = {"python": _python_tokens, "javascript": _script_tokens, "typescript": _script_tokens}


class Checker:
    """Lexer and recogniser of one language."""

    def __init__(self, language: str):
        self.language = language
        text = {"python": grammars.PYTHON, "go": grammars.GO, "java": grammars.JAVA}.get(language) or grammars.script(language == "typescript")
        grammar = Grammar(text, "file")
        terminals = sorted({s for alternatives in grammar.rules.values() for a in alternatives for s in a if s not in grammar.rules})
        self.classes = {t: chr(0x100 + k) for k, t in enumerate(terminals)}
        name = self.classes.get
        self.recogniser = Recogniser(grammar, self.classes, inserted=name("ASI", ""), before=(name("'}'") + name("END")) if "ASI" in self.classes else "", restricted=name("INC", "") if "ASI" in self.classes else "")
        self.pattern = re.compile(PATTERNS[language])
        self.tokens = _Tokens(language, self.classes)
        self.end = self.classes["END"]
        if language == "go":
            self.ends = "".join(self.classes[t] for t in ("NAME", "NUM", "STR", "'break'", "'continue'", "'fallthrough'", "'return'", "INC", "')'", "']'", "'}'"))
        if language == "python":
            self.indent, self.dedent, self.newline = (self.classes[t] for t in ("IN", "DE", "NL"))
            self.nets: dict[str, int] = {}
            self.opening, self.closing = ("".join(self.classes[t] for t in x) for x in (("'('", "'['", "'{'", "FHEAD"), ("')'", "']'", "'}'", "FTAIL")))

    def error_line(self, text: str) -> int:
        """0 for valid text, else the line of the first token that no way of reading the text allows."""
        if self.recogniser.full():
            self.recogniser.clear()
        text = text.removeprefix("﻿")
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        nested = _NESTED.get(self.language)
        tokens = self.pattern.findall(text) if nested is None or not nested.search(text) else _FIELDS[self.language](self.pattern, text)
        pieces = "".join(map(self.tokens.__getitem__, tokens)).split("\n")
        bad = self._python(tokens, pieces, text) if self.language == "python" else self._braced(pieces)
        if bad < 0:
            return 0
        line = 1
        for t in tokens:
            if "\n" in t:
                if bad == 0 and self.tokens[t] == "\n":
                    break
                line += t.count("\n")
                bad -= self.tokens[t] == "\n"
        return line

    def _braced(self, pieces: list[str]) -> int:
        step, at = self.recogniser.line, 1
        known = self.recogniser.lines.get
        ends = self.ends + "" if self.language == "go" else ""
        semicolon = self.classes["';'"]
        for k, piece in enumerate(pieces):
            if piece:
                if ends and piece[-1] in ends:
                    piece += semicolon
                at = known((at, piece)) or step(at, piece)
                if not at:
                    return k
        return -1 if step(at, self.end) else len(pieces) - 1

    def _python(self, tokens: list[str], pieces: list[str], text: str) -> int:
        step, at, known = self.recogniser.line, 1, self.recogniser.lines.get
        first = re.match(r"[ \t\f]*", text)[0]
        breaks = [first, *(t[1:] for t in tokens if t[0] == "\n")]
        stack, depth, nets = [(0, 0)], 0, self.nets
        for k, piece in enumerate(pieces):
            if depth == 0:
                if not piece:
                    continue
                blank = breaks[k]
                width = (len(blank), len(blank)) if "\t" not in blank else (len(blank.expandtabs(8)), len(blank))  # with tabs of 8 and of 1: both must agree
                if width[0] > stack[-1][0]:
                    if width[1] <= stack[-1][1]:
                        return k
                    stack.append(width)
                    piece = self.indent + piece
                else:
                    n = len(stack)
                    while width[0] < stack[-1][0]:
                        stack.pop()
                    if width != stack[-1]:
                        return k
                    piece = self.dedent * (n - len(stack)) + piece
            if (net := nets.get(piece)) is None:
                net = nets[piece] = sum(c in self.opening for c in piece) - sum(c in self.closing for c in piece)
                if len(nets) > 500_000:
                    nets.clear()
            depth = max(0, depth + net)
            if depth == 0:
                piece += self.newline
            at = known((at, piece)) or step(at, piece)
            if not at:
                return k
        return -1 if step(at, self.dedent * (len(stack) - 1) + self.end) else len(pieces) - 1


class _Tokens(dict):
    """The class characters of a token: none for comments, a line break for breaks, a character no grammar has for anything else."""

    WRONG = "\x01"
    LIMIT = 400_000

    def __init__(self, language: str, classes: dict[str, str]):
        self.language, self.classes = language, classes
        self.shared = {t: classes[c] for c, ts in SHARED[language].items() for t in ts.split() if c in classes}
        self.reserved = set(KEYWORDS.get(language, "").split())
        self.comment: Callable[[str], bool] = (lambda t: t[0] == "#") if language == "python" else (lambda t: t.startswith(("//", "/*", "#!")))

    def __missing__(self, t: str) -> str:
        if len(self) > self.LIMIT:
            self.clear()
        out = self._of(t)
        if len(t) < 200:
            self[t] = out
        return out

    def _of(self, t: str) -> str:
        c = self.classes
        if t[0] == "\n":
            return "\n"
        if t.startswith("\\\n"):
            return ""
        if self.comment(t):
            return self.WRONG if t == "/*" else "\n" if "\n" in t else ""
        if self.language == "python" and (t[-1] == "\0" or len(t) > 1 and (t[0] == "}" or t[-1] == "{")):
            return c[{":": "FSPEC", "{": "FO", "}": "FC"}[t[0]] if t[-1] == "\0" else "FHEAD" if t[0] != "}" else "FMID" if t[-1] == "{" else "FTAIL"]
        if "THEAD" in c and len(t) > 1 and (t[0] == "}" or t[0] == "`" and t.endswith("${")):
            return c["THEAD" if t[0] == "`" else "TMID" if t.endswith("${") else "TTAIL"]
        if t in self.shared:
            return self.shared[t]
        if f"'{t}'" in c:
            return c[f"'{t}'"]
        if t[-1] in "\"'`" and len(t) > 1:
            return c["TEMPLATE"] if t[-1] == "`" and "TEMPLATE" in c else c["STR"] if self.language != "go" or t[0] != "'" else c["NUM"]
        if t[0].isdigit() or t[0] == "." and len(t) > 1 and t[1].isdigit():
            return c["NUM"] if len(t) > 1 or t[0].isascii() else self.WRONG
        if t[0] == "/" and len(t) > 2 and "REGEX" in c:
            return c["REGEX"]
        if t[0] == "#" and len(t) > 1 and "PRIV" in c:
            return c["PRIV"]
        if (t[0].isalpha() or t[0] in "_$") and t not in self.reserved and (t[0] != "$" or self.language in ("javascript", "typescript", "java")):
            return c["NAME"]
        return self.WRONG


_checkers: dict[str, Checker] = {}


def checker(language: str) -> Checker:
    """This process's checker of a language, made once."""
    if language not in _checkers:
        _checkers[language] = Checker(language)
    return _checkers[language]


def language_of(path: str | None) -> str | None:
    return LANGUAGES.get((path or "").rpartition(".")[2].lower())


def checked(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(file_id, project_id, language, valid, error_line): each supported file of a known extension, parsed whole.

    error_line is the line of the first token at which no reading of the text goes on (the last line
    where the text ends too soon), null for valid files. Rows that aren't supported, or have neither
    text nor a known extension, are left out; empty texts are valid. Files meet their texts in one
    equi-join; nothing is collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            languages = [language_of(p) for p in b.column(2).to_pylist()]
            lines = [checker(k).error_line(t) for k, t in zip(languages, b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(languages, pa.string()), pa.array([n == 0 for n in lines], pa.bool_()), pa.array([n or None for n in lines], pa.int32())],
                names=["file_id", "project_id", "language", "valid", "error_line"])

    known = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*LANGUAGES)
    paths = files.where(known).select(F.col("id").cast("bigint").alias("file_id"), F.col("project_id").cast("bigint").alias("project_id"), "path")
    texts = contents.where("supported and content is not null").select(F.col("file_id").cast("bigint").alias("file_id"), "content")
    both = paths.join(texts, "file_id").select("file_id", "project_id", "path", "content")
    return both.mapInArrow(run, "file_id bigint, project_id bigint, language string, valid boolean, error_line int")


def _all(spark, d):
    return checked(table(spark, d, "files"), table(spark, d, "file_contents"))


def p7_found(spark, d):
    return _all(spark, d).where("not valid").select("file_id").distinct()


def p7_errors(spark, d):
    return _all(spark, d).where("not valid").select("file_id", "language", "error_line")


def p7_rates(spark, d):
    """Files, invalid ones and their share per project and language."""
    rates = _all(spark, d).groupBy("project_id", "language").agg(F.count("*").alias("files"), F.sum((~F.col("valid")).cast("bigint")).alias("invalid"))
    return rates.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))


QUERIES = {"p7_found": p7_found, "p7_errors": p7_errors, "p7_rates": p7_rates}
SQL: dict[str, str] = {}
