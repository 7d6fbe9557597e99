"""Deterministic text reducers: whole payloads in, at most about cap characters out.

Each reducer is a plain function (text, cap, query) -> text; texts within the cap stay as they are, so
reducing twice changes nothing more. reduced() applies one to a column in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.texts import CLOCK_PREFIX, TIME_PREFIX

# Limits of the reducers.
LEAST_ROWS, MOST_ROWS, ANCHORS, RESERVE, JSON_SHARE, QUERY_CHARS = 8, 50_000, 3, 200, 0.8, 4000
GREP_PER_FILE, STATUS_PER_GROUP, LISTED, TOP_EXTENSIONS = 8, 5, 20, 10

# Patterns of what tools print.
_STAMP = re.compile(TIME_PREFIX)
_CLOCK = re.compile(CLOCK_PREFIX)
_GREP = re.compile(r"([^\s:]+(?:\.[a-zA-Z0-9]+)?):(\d+):")
_NPM_NOISE = re.compile(r"^[⠀-⣿]|^Progress: resolved\s|^\s*\[[#=\-> ]+\]\s+\d+/\d+")
_NPM_KEEP = re.compile(r"^(?:npm |yarn |pnpm )?(?:warn|err|error|notice|info)\b|^packages:\s+[+-]\d+|^(?:added|removed|changed|audited)\s+\d+\s+package|^up to date(?:,|\.| in )|^done in |found \d+ vulnerabilit", re.I)
_PUSHED = re.compile(r"^To |^\s+[0-9a-f]+\.\.[0-9a-f]+\s+\S+\s+->\s+\S+|^Already up to date\.?$|^Updating [0-9a-f]+\.\.[0-9a-f]+|^Fast-forward|^\s+\d+ files? changed")
_FAILED = {"pytest": re.compile(r"^=+\s*(?:FAILURES?|ERRORS?)\s*=+$"), "vitest": re.compile(r"^\s*FAIL\s|^⎯+\s*Failed Tests\s*\d+")}
_FAILED["jest"] = _FAILED["vitest"]


def note(label: str, said: str) -> str:
    return f"[smart-reducer: {label} — {said}]"


def _fitting(parts: list[str], budget: int) -> int:
    """How many leading parts fit, one separator each."""
    used = 0
    for n, p in enumerate(parts):
        used += len(p) + 1
        if used > budget:
            return n
    return len(parts)


def git_log(text: str, cap: int, query: str | None = None) -> str:
    """The newest and the oldest commits, two fifths of the cap each."""
    commits = re.split(r"\n(?=commit [0-9a-f]{7,40})", text)
    if len(text) <= cap or len(commits) <= 4:
        return text
    share = int(cap * 0.4)
    head = _fitting(commits, share)
    tail = _fitting(commits[head:][::-1], share)
    gone = len(commits) - head - tail
    if gone <= 0:
        return text
    last = commits[len(commits) - tail :] if tail else []
    return "\n".join(commits[:head]) + "\n\n" + note("git_log", f"elided {gone} middle commit(s) of {len(commits)} total") + "\n\n" + "\n".join(last)


def git_diff(text: str, cap: int, query: str | None = None) -> str:
    """Header and first hunks of each file; files after 85 % of the cap go."""
    if len(text) <= cap:
        return text
    kept, size, cut_hunks, cut_files = [], 0, 0, 0
    for file in re.split(r"\n(?=diff --git )", text):
        if size > cap * 0.85:
            cut_files += 1
            continue
        hunks = re.split(r"\n(?=@@ )", file)
        if len(hunks) > 3:
            cut_hunks += len(hunks) - 3
            file = "\n".join(hunks[:3]) + "\n" + note("git_diff", f"{len(hunks) - 3} hunk(s) elided in this file") + "\n"
        kept.append(file)
        size += len(file) + 1
    if not cut_hunks and not cut_files:
        return text
    end = "\n\n" + note("git_diff", f"{cut_files} file(s) entirely elided due to budget") + "\n" if cut_files else ""
    return "\n".join(kept) + end


def grep(text: str, cap: int, query: str | None = None) -> str:
    """The first matches of each file; other lines stay."""
    if len(text) <= cap:
        return text
    seen: Counter = Counter()
    kept = []
    for line in text.split("\n"):
        m = _GREP.match(line)
        if m:
            seen[m[1]] += 1
        if not m or seen[m[1]] <= GREP_PER_FILE:
            kept.append(line)
    gone = sum(max(0, n - GREP_PER_FILE) for n in seen.values())
    return "\n".join(kept) + "\n" + note("grep", f"kept top {GREP_PER_FILE} match(es) per file; elided {gone} additional match(es)") + "\n" if gone else text


def head_tail(text: str, cap: int, query: str | None = None) -> str:
    """Two fifths of the cap from the start, half from the end."""
    if len(text) <= cap:
        return text
    a, b = int(cap * 0.4), int(cap * 0.5)
    middle = len(text) - a - b
    return text[:a] + "\n" + note("run_command head/tail", f"kept {a + b}/{len(text)} chars") + f" — {middle} chars elided from middle\n" + text[len(text) - b :]


def log_lines(body: str) -> str | None:
    """Runs of lines that are equal but for their time; None where nothing is saved."""
    lines = body.split("\n")
    if len(lines) < 20:
        return None
    out: list[str] = []
    for _, run in groupby(lines, key=lambda x: _CLOCK.sub("", _STAMP.sub("", x))):
        run = list(run)
        out.append(run[0])
        if len(run) > 1:
            out.append(f"[same as previous × {len(run) - 1} more time(s), last: {run[-1]}]")
    return "\n".join(out) if len(out) < len(lines) else None


def listing(body: str) -> str | None:
    """The first entries and the commonest extensions."""
    lines = [x for x in body.split("\n") if x.strip()]
    if len(lines) < 30:
        return None
    ext = [m[1] if (m := re.search(r"\.([a-zA-Z0-9]+)\s*$", x)) else None for x in lines]
    counts = Counter(e for e in ext if e)
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:TOP_EXTENSIONS]
    bare = ext.count(None)
    more = [f"  .{e}: {n}" for e, n in top] + ([f"  (no extension): {bare}"] if bare else [])
    return "\n".join([*lines[:LISTED], "", f"[smart-reducer: {len(lines)} total entries; top extensions:", *more, "]"])


def _capped(lines: list[str], rest: Callable[[int], str]) -> list[str]:
    return lines if len(lines) <= STATUS_PER_GROUP else [*lines[:STATUS_PER_GROUP], rest(len(lines) - STATUS_PER_GROUP)]


def status(body: str) -> str:
    """git status without its advice, a few files a section."""
    lines = body.split("\n")
    if re.match(r"On branch |HEAD detached ", lines[0]):
        kept = [x for x in lines if not re.match(r"\s+\(use ", x)]
        out: list[str] = []
        for is_file, run in groupby(kept, key=lambda x: x.startswith("\t")):
            out += _capped(list(run), lambda n: f"... {n} more file(s)") if is_file else run
        return "\n".join(out)
    groups: dict[str, list[str]] = {}
    for x in lines:
        if x.strip():
            groups.setdefault(x[:2], []).append(x)
    return "\n".join(y for p, g in groups.items() for y in _capped(g, lambda n, p=p: f"... {n} more line(s) with prefix '{p}'"))


def _envelope(text: str) -> dict | None:
    """The parts of a command's record: '$ command', 'exit code: n', stdout and stderr blocks."""
    m = re.match(r"\$ ([^\n]*)\nexit code: (-?\d+|killed)( \(timed out\))?(?:\n|$)", text)
    if not m:
        return None
    rest = "\n" + text[m.end() :]
    out, _, err = rest.partition("\n--- stderr ---\n")
    out = out.partition("\n--- stdout ---\n")[2]
    words = m[1].split()
    return {"command": m[1], "head": words[0] if words else "", "sub": next((w for w in words[1:] if not w.startswith("-")), ""), "code": m[2], "late": m[3] or "", "out": out, "err": err}


def _rebuilt(e: dict, out: str, err: str, label: str, said: str) -> str:
    blocks = [f"$ {e['command']}", f"exit code: {e['code']}{e['late']}"]
    for title, body in (("stdout", out), ("stderr", err)):
        if body.strip():
            blocks += [f"--- {title} ---", body]
    return "\n".join([*blocks, note(label, said)])


def _test_run(e: dict, kind: str) -> str | None:
    lines = "\n".join(x for x in (e["out"], e["err"]) if x).split("\n")
    if len(lines) < 20:
        return None
    if e["code"] == "0":
        return _rebuilt(e, "\n".join(lines[-10:]), "", f"{kind} success", "kept final summary only")
    at = next((n for n, x in enumerate(lines) if _FAILED[kind].search(x)), None)
    if at is None:
        return _rebuilt(e, "\n".join(lines[-15:]), "", f"{kind} failure", "no FAILURES anchor; kept last 15 lines")
    return _rebuilt(e, "\n".join(lines[at:]), "", f"{kind} failure", "kept FAILURES section onward")


def _npm(e: dict) -> str | None:
    keep = lambda s: "\n".join(x for x in s.split("\n") if x.strip() and not _NPM_NOISE.search(x) and _NPM_KEEP.search(x))
    out, err = keep(e["out"]), keep(e["err"])
    if len(out) + len(err) >= len(e["out"]) + len(e["err"]):
        return None
    return _rebuilt(e, out, err, f"{e['head']}_install", "kept warnings/errors/summary; trimmed progress noise")


def _by_command(e: dict) -> str | None:
    head, sub = e["head"], e["sub"]
    if head == "git" and sub == "status":
        new = status(e["out"])
        return None if new == e["out"] else _rebuilt(e, new, e["err"], "git_status", "dropped help lines, capped files per section")
    if head == "git" and sub in ("push", "pull", "fetch"):
        if e["code"] != "0":
            return None
        kept = [x for x in (e["err"] + "\n" + e["out"]).split("\n") if _PUSHED.search(x)]
        return _rebuilt(e, "", "\n".join(kept) or f"git {sub}: ok", f"git_{sub}", "success distilled to ref-update lines")
    if head in ("npm", "pnpm", "yarn") and sub in ("install", "i", "add", "ci"):
        return _npm(e)
    for kind in ("pytest", "vitest", "jest"):
        if head == kind or (kind != "pytest" and re.search(rf"\b{kind}\b", e["command"])):
            return _test_run(e, kind)
    if head in ("docker", "kubectl") and sub == "logs":
        new = log_lines(e["out"])
        return None if new is None else _rebuilt(e, new, e["err"], f"{head}_logs", "collapsed consecutive identical lines")
    if head in ("ls", "find", "dir"):
        new = listing(e["out"])
        return None if new is None else _rebuilt(e, new, e["err"], head, "first 20 entries + extension breakdown")
    return None


def run_command(text: str, cap: int, query: str | None = None) -> str:
    """By what the command is, else head and tail."""
    if len(text) <= cap:
        return text
    e = _envelope(text)
    shaped = _by_command(e) if e else None
    return head_tail(shaped, cap) if shaped is not None and len(shaped) < len(text) else head_tail(text, cap)


def _rows(text: str) -> tuple[list[str], bool] | None:
    """Rows of a JSON array (True) or of mostly JSON lines (False)."""
    body = text.strip()
    if body.startswith("["):
        try:
            values = json.loads(body)
        except ValueError:
            return None
        return ([json.dumps(v, separators=(",", ":"), ensure_ascii=False) for v in values], True) if LEAST_ROWS <= len(values) <= MOST_ROWS else None
    lines = [x for x in text.split("\n") if x.strip()]
    if not LEAST_ROWS <= len(lines) <= MOST_ROWS:
        return None

    def fine(line: str) -> bool:
        try:
            return line.lstrip()[0] in "{[" and json.loads(line) is not None
        except ValueError:
            return False

    return (lines, False) if sum(map(fine, lines)) >= JSON_SHARE * len(lines) else None


def json_crush(text: str, cap: int, query: str | None = None) -> str:
    """Distinct rows: both ends always, then by words shared with the query as long as room is left; unchanged where that saves nothing."""
    found = _rows(text) if len(text) > cap else None
    if not found:
        return text
    rows, is_array = found
    unique = list(dict.fromkeys(rows))
    tokens = lambda s: set(re.findall(r"[a-z0-9_]{2,}", s.lower()))
    asked = tokens((query or "")[:QUERY_CHARS])
    n = len(unique)
    chosen = {*range(min(ANCHORS, n)), *range(max(ANCHORS, n - ANCHORS), n)}
    room = max(0, cap - RESERVE) - sum(len(unique[k]) + 1 for k in chosen)
    for k in sorted(set(range(n)) - chosen, key=lambda k: (-len(asked & tokens(unique[k])) if asked else 0, k)):
        if len(unique[k]) + 1 <= room:
            chosen.add(k)
            room -= len(unique[k]) + 1
    doubles, gone = len(rows) - n, n - len(chosen)
    if not doubles and not gone:
        return text
    kept = [unique[k] for k in sorted(chosen)]
    body = "[" + ",\n".join(kept) + "]" if is_array else "\n".join(kept)
    said = f"kept {len(kept)}/{len(rows)} rows" + (f"; dropped {doubles} duplicate(s)" if doubles else "") + (f"; elided {gone} lower-relevance row(s) — re-run with narrower params if needed" if gone else "")
    out = f"{body}\n{note('json-crush', said)}\n"
    return out if len(out) < len(text) else text


REDUCERS: dict[str, Callable[..., str]] = {"git_log": git_log, "git_diff": git_diff, "grep_code": grep, "run_command": run_command}


def reduce_text(tool: str, text: str, cap: int, query: str | None = None) -> str:
    """By the tool's own reducer, else by content type."""
    return REDUCERS.get(tool, json_crush)(text, cap, query)


def reduced(df: DataFrame, ident: str, text: str, tool: str, cap: int, query: str | None = None) -> DataFrame:
    """(id, text): every payload reduced; null stays null. One Arrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if x is None else reduce_text(tool, x, cap, query) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[ident, "text"])

    kind = dict(df.dtypes)[ident]
    return df.select(ident, F.col(text).alias("text")).mapInArrow(run, f"{ident} {kind}, text string")
