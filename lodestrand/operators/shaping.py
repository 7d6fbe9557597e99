"""What leaves the tool surface: allowed tools, the session's project, output within a cap, and what an empty result means."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.texts import output_cap
from lodestrand.operators.reducers import reduce_text

CAP, CEILING = 6_000, 1_000_000  # characters of a tool's output at the lowest level, and at the highest


def shaped(tools: dict[str, Callable[..., object]], allowed: Iterable[str], project: object = None, level: str = "economic", bases: dict[str, int] | None = None, uncapped: Iterable[str] = ()) -> dict[str, Callable[..., str]]:
    """The allowed tools, each giving text within its cap.

    A tool that takes a project and is called without one gets the session's. Output over the cap goes
    through the tool's reducer, then is cut, except JSON, which a cut would break, and the output of
    uncapped tools.
    """
    free = frozenset(uncapped)
    return {name: _wrapped(name, tools[name], project, None if name in free else output_cap(level, (bases or {}).get(name, CAP), CEILING)) for name in allowed if name in tools}


def _wrapped(name: str, tool: Callable[..., object], project: object, cap: int | None) -> Callable[..., str]:
    takes_project = "project" in inspect.signature(tool).parameters

    def run(**arguments: object) -> str:
        if project is not None and takes_project and arguments.get("project") in (None, ""):
            arguments["project"] = project
        text = str(tool(**arguments))
        if cap is None or len(text) <= cap:
            return text
        asked = next((a for a in (arguments.get("query"), arguments.get("pattern")) if isinstance(a, str)), None)
        text = reduce_text(name, text, cap, asked)
        if len(text) <= cap or re.match(r"\s*[\[{]", text):
            return text
        return f"{text[:cap]}\n[cut at {cap} characters]"

    return run


@dataclass
class Ran:
    """How a search went: the mode that ran and why, hits of the words, and of the vectors or what kept them from running."""

    mode: str
    reason: str = ""
    word_hits: int | None = None
    vector_hits: int = 0
    failed: str | None = None


def empty_result(ran: Ran, coverage: str | None = None) -> str:
    """What an empty result says about the index: which streams ran, and how far the project is covered."""
    how = f"{ran.mode} ({ran.reason})" if ran.reason else ran.mode
    parts = [f"mode {how}", *([f"{ran.word_hits} word hits"] if ran.word_hits is not None else []), f"vectors failed: {ran.failed}" if ran.failed else f"{ran.vector_hits} vector matches"]
    lines = ["No results.", "; ".join(parts)]
    if ran.failed:
        lines.append("The vector search did not run: what is missing here may still exist. Search for exact text.")
    return "\n".join([*lines, *([coverage] if coverage else [])])


def degraded_note(ran: Ran) -> str | None:
    """A line below results that came without vectors."""
    return f"[vector search failed ({ran.failed}): these are word hits only]" if ran.failed else None


def covered(files: DataFrame) -> DataFrame:
    """(project_id, files, embedded, stale): files in all, those with an embedding, and those changed since their last semantic pass."""
    count = lambda c: F.count(F.when(c, 1))
    stale = F.col("semantic_hash").isNotNull() & (F.col("semantic_hash") != F.col("content_hash"))
    return files.groupBy("project_id").agg(F.count("*").alias("files"), count(F.col("embedding_hash").isNotNull()).alias("embedded"), count(stale).alias("stale"))


def coverage_note(files: Column, embedded: Column, stale: Column) -> Column:
    """What a search in a project can't see, as text; null where it sees everything."""
    seen = F.when(F.coalesce(files, F.lit(0)) == 0, F.lit("no index yet")).when(embedded == 0, F.lit("words only, no embeddings yet")).when(embedded < files, F.concat(F.lit("embeddings cover "), embedded, F.lit(" of "), files, F.lit(" files")))
    behind = F.when(stale > 0, F.concat(stale, F.lit(" files changed since their last summary")))
    return F.nullif(F.concat_ws("; ", seen, behind), F.lit(""))
