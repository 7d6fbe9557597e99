"""Scalar text functions as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
# Output levels and their factor of the base cap.
LEVELS = {"economic": 1, "medium": 2, "high": 4, "extra": 6}
TIME_PREFIX = r"^\S*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?\s*"
CLOCK_PREFIX = r"^\d{2}:\d{2}:\d{2}(\.\d+)?\s*"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def line_count(text: Column) -> Column:
    """Pieces between line feeds; an empty text has one."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def history_hash(text: Column) -> Column:
    """md5 after CRLF became LF."""
    return F.md5(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def stable_id(*parts: Column) -> Column:
    """sha1 over parts joined by colons, null as empty."""
    return F.sha1(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def truncated(text: Column, max_tokens: int, suffix: str = "... [truncated]") -> Column:
    return F.when(F.length(text) > 4 * max_tokens, F.concat(F.substring(text, 1, 4 * max_tokens), F.lit(suffix))).otherwise(text)


def one_line(text: Column, cap: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > cap, F.concat(F.substring(flat, 1, cap - 1), F.lit("…"))).otherwise(flat)


def windows(text: Column, window: int, overlap: int = 0, most: int | None = None) -> Column:
    """Array of pieces of window characters, each window - overlap after the one before; overlap is kept within 0 ... window - 1."""
    step = window - max(0, min(overlap, window - 1))
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    out = F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(window)))
    out = F.when(F.length(text) <= window, F.array(text)).otherwise(out)
    return F.slice(out, 1, most) if most else out


def indexable(text: Column) -> Column:
    """0 < bytes <= 200 KiB, no NUL, 500 characters a line at most on average."""
    return (F.octet_length(text) > 0) & (F.octet_length(text) <= 200 * 1024) & (F.instr(text, "\0") == 0) & (F.length(text) / line_count(text) <= 500)


def scrubbed(text: Column) -> Column:
    """Secrets and home directories masked."""
    out = F.regexp_replace(text, r"(?i)\b(api[_-]?key|token|secret|password)\b(\s*[=:]\s*)\S+", "$1$2***")
    return F.regexp_replace(out, r"(/home/|/Users/)[^/\s]+", "$1***")


def without_time(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, TIME_PREFIX, ""), CLOCK_PREFIX, "")


def joined_capped(items: Column, cap: int = 20) -> Column:
    """Trimmed distinct items joined by commas, an ellipsis behind the cap-th."""
    clean = F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))
    text = F.array_join(F.slice(clean, 1, cap), ", ")
    return F.when(F.size(clean) > cap, F.concat(text, F.lit(", …"))).otherwise(text)


def output_cap(level: str, base: int, ceiling: int) -> int:
    if level == "ultra":
        return 4 * ceiling
    return ceiling if level == "max" else min(base * LEVELS.get(level, 1), ceiling)


def namespace_token(ns: Column) -> Column:
    return F.regexp_replace(ns, r"[^A-Za-z0-9_-]", "_")


def fnv_53(data: bytes) -> int:
    """FNV-1a over 64 bits, the low 53 kept."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h & ((1 << 53) - 1)


def fnv_53_all(data: list[bytes]) -> np.ndarray:
    """fnv_53 of many, a position at a time over all of them."""
    lengths = np.array([len(d) for d in data], np.int64)
    order = np.argsort(-lengths, kind="stable")
    padded = np.zeros((len(data), int(lengths.max(initial=0))), np.uint8)
    for row, k in enumerate(order.tolist()):
        padded[row, : lengths[k]] = np.frombuffer(data[k], np.uint8)
    h = np.full(len(data), 0xCBF29CE484222325, np.uint64)
    for at in range(padded.shape[1]):
        n = int(np.searchsorted(-lengths[order], -at, "left"))  # rows that are longer than at
        h[:n] = (h[:n] ^ padded[:n, at]) * np.uint64(0x100000001B3)
    out = np.empty(len(data), np.int64)
    out[order] = (h & np.uint64((1 << 53) - 1)).astype(np.int64)
    return out


def snapped(version: float, levels: list[float]) -> float:
    """The greatest level that isn't above version, else the lowest."""
    return max((x for x in levels if x <= version), default=min(levels))
