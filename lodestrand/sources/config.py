"""Small configuration sources, read on the driver."""

from __future__ import annotations

import json
import re

_JSONC = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/|,(?=\s*[}\]])')


def strip_comments(text: str) -> str:
    """JSON with comments and trailing commas as plain JSON."""
    once = _JSONC.sub(lambda m: m[1] or ("," if m[0] == "," else ""), text)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", once)


def path_aliases(config: str) -> list[tuple[str, list[str]]]:
    """(prefix, targets) of the paths a compiler configuration maps, its base directory applied."""
    try:
        options = json.loads(strip_comments(config)).get("compilerOptions", {})
    except (ValueError, AttributeError):
        return []
    base = options.get("baseUrl", ".").strip("/").removeprefix("./")
    join = lambda t: "/".join(x for x in (base if base != "." else "", t.removeprefix("./").removesuffix("*").rstrip("/")) if x)
    out = [(k.removesuffix("*"), [join(t) for t in v]) for k, v in options.get("paths", {}).items()]
    return out + ([("", [join("")])] if "baseUrl" in options else [])


def alias_rows(configs: dict[int, str]) -> list[tuple[int, str, str]]:
    """(project_id, prefix, target) of the compiler configurations of projects, as graph.resolved_imports takes them."""
    return [(project, prefix, target) for project, text in configs.items() for prefix, targets in path_aliases(text) for target in targets]


def coerced(arguments: dict) -> dict:
    """'true', 'false' and numbers given as text in their own type."""
    def one(v):
        if v in ("true", "false"):
            return v == "true"
        return (float(v) if "." in v else int(v)) if isinstance(v, str) and re.fullmatch(r"-?\d+(\.\d+)?", v) else v

    return {k: one(v) for k, v in arguments.items()}


def analysis(text: str, layers: tuple[str, ...] = ("presentation", "business", "data", "infrastructure", "config", "test")) -> dict:
    """Summary, at most five concepts and a known layer from a model's answer; the first 200 characters where it holds no JSON."""
    m = re.search(r"\{[\s\S]*\}", text)
    try:
        found = json.loads(m[0]) if m else {}
    except ValueError:
        found = {}
    concepts = [str(c) for c in found.get("concepts", []) if str(c).strip()][:5] if isinstance(found.get("concepts", []), list) else []
    return {"summary": str(found.get("summary") or text.strip()[:200])[:200], "concepts": concepts, "layer": found.get("layer") if found.get("layer") in layers else "unknown"}
