"""A lexer as a state machine: comments, strings and brackets of a source text, templates nested to any depth."""

from __future__ import annotations

import re

CODE, LINE, BLOCK, TEXT, TEMPLATE = range(5)

# What may begin something in code, by language: longer openings first.
_OPENINGS = {
    "py": r"#|[rRbBuUfFtT]{0,2}(?:\"\"\"|'''|\"|')|[{}()\[\]]",
    "js": r"//|/\*|/|[\"'`]|[{}()\[\]]",
    "java": r"//|/\*|\"\"\"|[\"']|[{}()\[\]]",
    "go": r"//|/\*|[\"'`]|[{}()\[\]]",
}
_CODE = {k: re.compile(v) for k, v in _OPENINGS.items()}
_CLOSINGS = {  # how a string goes on: an escape, its end, or for short ones the end of the line
    '"': re.compile(r"\\.|\"|\n", re.S), "'": re.compile(r"\\.|'|\n", re.S), '"""': re.compile(r'\\.|"""', re.S), "'''": re.compile(r"\\.|'''", re.S),
    "`": re.compile(r"\\.|`|\$\{", re.S), "raw`": re.compile("`"), "/": re.compile(r"\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|/\w*|\n"),
}
_WORD_BEFORE = re.compile(r"[\w$]+\Z")
# Words after which a slash begins a pattern; words whose condition's bracket does.
_BEFORE_PATTERN = frozenset("return typeof case in of delete void throw new do else instanceof yield await".split())
_CONDITIONS = frozenset(("if", "while", "for", "with"))


class Lexed:
    """Spans of comments and strings, and (offset, bracket) in code. A template's code parts are lexed as code, its text as strings."""

    def __init__(self, text: str, language: str):
        self.comments: list[tuple[int, int]] = []
        self.strings: list[tuple[int, int]] = []
        self.brackets: list[tuple[int, str]] = []
        self.patterns = language == "js"
        opening = _CODE[language]
        state, at, begin, closing = CODE, 0, 0, None
        depths: list[int] = []  # open braces in each template part that the lexer is in
        conditions: list[bool] = []  # of each open parenthesis, whether a condition stands in it
        condition = False  # whether the last bracket closed a condition
        end = len(text)
        while at < end:
            if state == CODE:
                m = opening.search(text, at)
                if m is None:
                    break
                t, begin, at = m[0], m.start(), m.end()
                if t == "#" or t == "//":
                    state = LINE
                elif t == "/*":
                    state = BLOCK
                elif t == "/":
                    if self._pattern(text, begin, condition):
                        state, closing = TEXT, _CLOSINGS["/"]
                elif t in "{}()[]":
                    if t == "(":
                        conditions.append((w := _WORD_BEFORE.search(text[max(0, begin - 12) : begin].rstrip())) is not None and w[0] in _CONDITIONS)
                    elif t == ")":
                        condition = conditions.pop() if conditions else False
                    elif depths and t == "{":
                        depths[-1] += 1
                    elif depths and t == "}":
                        if depths[-1] == 0:  # back in the template's text
                            depths.pop()
                            state, closing = TEMPLATE, _CLOSINGS["`"]
                            continue
                        depths[-1] -= 1
                    self.brackets.append((begin, t))
                elif t == "`" and language == "js":
                    state, closing = TEMPLATE, _CLOSINGS["`"]
                else:
                    quote = "raw`" if t == "`" else t.lstrip("rRbBuUfFtT") or t
                    state, closing = TEXT, _CLOSINGS[quote]
            elif state == LINE:
                at = text.find("\n", at)
                at = end if at < 0 else at
                self.comments.append((begin, at))
                state = CODE
            elif state == BLOCK:
                at = text.find("*/", at)
                at = end if at < 0 else at + 2
                self.comments.append((begin, at))
                state = CODE
            else:
                m = closing.search(text, at)
                if m is None:
                    at = end
                    break
                at = m.end()
                if m[0][0] == "\\" or closing is _CLOSINGS["/"] and m[0][0] == "[":
                    continue
                if m[0] == "\n":  # a short string that its line leaves open
                    at = m.start()
                self.strings.append((begin, at))
                if m[0] == "${":
                    depths.append(0)
                state = CODE
        if state in (LINE, BLOCK):
            self.comments.append((begin, end))
        elif state != CODE:
            self.strings.append((begin, end))

    @staticmethod
    def _pattern(text: str, at: int, condition: bool) -> bool:
        """Whether a slash begins a pattern rather than divides."""
        near = text[max(0, at - 40) : at]
        before = near.rstrip()
        if not before:
            return True
        last = before[-1]
        if last == ")":
            return condition
        if last == "}":
            return "\n" in near[len(before) :]
        if last in "]\"'`":
            return False
        word = _WORD_BEFORE.search(before)
        return word is None or word[0] in _BEFORE_PATTERN
