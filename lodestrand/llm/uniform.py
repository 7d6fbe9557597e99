"""Visually identical text brought to one form (problem 10), as plain Python on whole texts.

Steps: compatibility forms, invisible characters and spaces; canonical composition; then, token
by token, the scripts in which each letter has a twin are intersected, mixed and whole-script
spellings are detected and respelled in the one consistent script.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

# Letters of several scripts with the same shape, Latin first: Greek, Cyrillic, Armenian, Georgian, Cherokee and Lisu, and Latin letters that look like another.
LOOKALIKES = (
    "aɑаα", "cᴄсϲ", "dԁᏧ", "eе", "gɡց", "hһհᏂ", "iіιᎥ", "jјϳ", "lӏ", "nո", "oᴏοоօჿ", "pрρ", "qԛզ", "sꜱѕ", "uᴜυս", "vᴠνѵ", "wᴡԝա", "xх", "yуү", "zᴢ",
    "AАΑᎪꓮ", "BВΒᏴꓐ", "CСϹᏟꓚ", "DᎠꓓ", "EЕΕᎬꓰ", "FϜꓝ", "GԌᏀꓖ", "HНΗᎻꓧ", "IІΙӀꓲ", "JЈͿᎫꓙ", "KКΚᏦꓗ", "LᏞꓡ", "MМΜϺᎷꓟ", "NΝꓠ", "OОΟՕꓳ", "PРΡᏢꓑ", "QԚ", "RᎡꓣ", "SЅՏᏚꓢ", "TТΤᎢꓔ", "UՍꓴ", "VѴᏙꓦ", "WԜᎳꓪ", "XХΧꓫ", "YΥҮꓬ", "ZΖᏃꓜ",
    "ΓГ", "ΠП", "ΦФ",
)
# Signs that look like ASCII ones.
SIGNS = {"∶": ":", "꞉": ":", "׃": ":", "։": ":", "․": ".", "‚": ",", "ǃ": "!", "ǀ": "|", "∣": "|", "⁄": "/", "∕": "/", "∖": "\\", "∗": "*", "∼": "~"}
TURKISH = re.compile("[ğşĞŞİ]")  # beside these a dotless i is a letter of its own
#: Compatibility mappings that keep the look of a character; superscripts, fractions, circled forms and the like don't.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")
DASHES = "‐‑﹣－"
KEEP = "\n\t\r"
CACHE = 200_000  # entries after which a cache starts anew; results don't depend on it


def script(letter: str) -> str:
    """LATIN, GREEK, CYRILLIC ...: the first word of a letter's name."""
    return unicodedata.name(letter, "NONE").split(" ", 1)[0]


SPELLINGS: dict[str, dict[str, str]] = {}  # letter -> script -> its twin there
for _group in LOOKALIKES:
    _by: dict[str, str] = {}
    for _c in _group:
        _by.setdefault(script(_c), _c)
    for _c in _group:
        SPELLINGS[_c] = _by
_TWINS = {c for c in SPELLINGS if c > "\x7f"}
FOREIGN = re.compile("[" + "".join(c for c in map(chr, range(0x80, 0x10000)) if unicodedata.normalize("NFD", c)[0] in _TWINS) + "]")  # accented ones, too
TOKEN = re.compile(r"[\w\u0300-\u036f]+")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
TRAILING = re.compile(r"[ \t]+(?=\n|\Z)")


class _Chars(dict):
    """What str.translate puts for each character."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        if c in KEEP or code < 127 and code >= 32:
            out = c
        elif c in DASHES:
            out = "-"
        elif c in SIGNS:
            out = SIGNS[c]
        elif kind in ("Zl", "Zp") or code == 0x85:
            out = "\n"
        elif kind == "Zs":
            out = " "
        elif kind in ("Cf", "Cc") or code == 0x34F or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x115F, 0x1160, 0x3164, 0xFFA0):
            out = ""
        else:
            mapping = unicodedata.decomposition(c)
            out = unicodedata.normalize("NFKC", c) if mapping.startswith(SAME_LOOK) else c
        self[code] = out
        return out


CHARS = _Chars()


class _Scripts(dict):
    """The scripts a character may be read in; none for marks, digits and the like."""

    def __missing__(self, c: str) -> frozenset[str]:
        if c in SPELLINGS:
            out = frozenset(SPELLINGS[c])
        else:
            out = frozenset([script(c)]) if c.isalpha() else frozenset()
        self[c] = out
        return out


SCRIPTS = _Scripts()
_resolved: dict[tuple[str, str], str] = {}


def resolve(token: str, main: str) -> str:
    """Spell token in the one script that all its letters share.

    With several such scripts (a whole-script look-alike) the text's main script decides, then
    Latin, then the alphabet. With none the letters bound to one script stay, and the others follow
    the script most of them have.
    """
    key = (token, main)
    if (known := _resolved.get(key)) is not None:
        return known
    letters = unicodedata.normalize("NFD", token)
    sets = [s for s in map(SCRIPTS.__getitem__, letters) if s]
    common = frozenset.intersection(*sets) if sets else frozenset()
    if common:
        to = next((s for s in (main, "LATIN") if s in common), None) or min(common)
    else:
        bound = Counter(next(iter(s)) for s in sets if len(s) == 1)
        to = min(bound, key=lambda s: (-bound[s], s != "LATIN", s)) if bound else main
    out = unicodedata.normalize("NFC", "".join(SPELLINGS[c].get(to, c) if c in SPELLINGS else c for c in letters))
    if len(_resolved) > CACHE:
        _resolved.clear()
    _resolved[key] = out
    return out


def main_script(text: str) -> str:
    """The script of most letters that have no twin elsewhere; Latin where they tie or are missing."""
    seen: Counter = Counter()
    for c, n in Counter(unicodedata.normalize("NFD", text)).items():
        if len(s := SCRIPTS[c]) == 1:
            seen[next(iter(s))] += n
    return min(seen, key=lambda s: (-seen[s], s != "LATIN", s)) if seen else "LATIN"


def uniform(text: str | None) -> str | None:
    """The one form of a text. Null stays null, empty stays empty; texts of any length are taken whole.

    Case, real accents, digits, words and visible punctuation stay.
    """
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFC", text.translate(CHARS))
        if "ı" in text and not TURKISH.search(text):
            text = text.replace("ı", "i")
        if FOREIGN.search(text):
            main = main_script(text)
            text = TOKEN.sub(lambda m: t if (t := m[0]).isascii() and main == "LATIN" else resolve(t, main), text)
    elif CONTROL.search(text):
        text = text.translate(CHARS)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return TRAILING.sub("", text) if " \n" in text or "\t\n" in text or text[-1:] in " \t" else text
