"""The answers as text: map, context, search, impact, summary, stats (Q-*)."""

from __future__ import annotations

import json
import re
import time
from datetime import datetime

from pyspark.sql import functions as F

from ..errors import ParseError, WeftError
from ..functions.paths import relative
from ..functions.text import age, fixed4, plural
from ..operators.closure import impact, ranked
from ..operators.graph import counts
from ..operators.rank import top_files
from ..operators.render import context_text, render_json, render_map
from ..sources import cache
from ..sources.tree import read_text, resolved, rooted
from .index import Index, search

#: Fixed limits and defaults.
BUDGET, RESOURCE_BUDGET, PER_TOKEN = 2048, 8192, 3
MOST_QUERY, MOST_PATH, MOST_KIND, MOST_BUDGET = 500, 1000, 50, 32000
OUTSIDE = "Error: path is outside project root"


def inside(root: str, path: str) -> str | None:
    """The absolute path, if it is the root or below it (FLT-6)."""
    root = rooted(root)
    path = resolved(root, path)
    return path if path == root or path.startswith(root.rstrip("/") + "/") else None


def checked_budget(value: str | int) -> int:
    """The whole number that the text begins with; what follows it counts for nothing."""
    found = re.match(r"\s*[+-]?\d+", str(value))
    budget = int(found.group()) if found else 0
    if budget < 1:
        raise WeftError("Invalid budget value", "Provide a positive integer for --budget", "INVALID_INPUT")
    return budget


def map_text(index: Index, budget: int = BUDGET) -> str:
    return render_map(index.files, index.nodes, index.scores, index.root, budget, PER_TOKEN).first()["text"]


def file_text(index: Index, path: str) -> str:
    return context_text(path, index.nodes, index.edges, index.scores, index.root).first()["text"]


def _matches(index: Index, query: str, kind: str | None) -> list:
    found = search(index.nodes, query, kind)
    return found.select("kind", "name", relative(F.col("file_path"), index.root).alias("rel"), "start_line").collect()


def search_text(index: Index, query: str, kind: str | None = None) -> str:
    rows = _matches(index, query, kind)
    head = plural(len(rows), "match", "matches")
    return head if not rows else f"{head}\n\n" + "\n".join(f"{r['kind']} {r['name']} in {r['rel']}:L{r['start_line']}" for r in rows)


def _scored(index: Index, df) -> list[str]:
    rows = df.select(F.concat(relative(F.col("file_path"), index.root), F.lit(" [score: "), fixed4(F.col("score")), F.lit("]")).alias("line")).collect()
    return [r["line"] for r in rows]


def impact_lines(index: Index, path: str) -> list[str]:
    return _scored(index, ranked(impact(index.edges, path), index.scores))


def impact_text(index: Index, path: str) -> str:
    lines = impact_lines(index, path)
    return f"{plural(len(lines), 'file', 'files')} affected\n\n" + "\n".join(lines)


def packages(root: str) -> list[str] | None:
    """Names of the dependencies in package.json, then of those for development; None without a readable file (SRC-14)."""
    try:
        found = json.loads(read_text(f"{rooted(root).rstrip('/')}/package.json"))
        return [*(found.get("dependencies") or {}), *(found.get("devDependencies") or {})]
    except (ParseError, ValueError, AttributeError):
        return None


def summary_text(index: Index) -> str:
    n = counts(index.files, index.nodes, index.edges).first()
    best = _scored(index, top_files(index.files, index.scores))
    names = packages(index.root)
    stack = ["No package.json detected"] if names is None else names or ["(no dependencies found)"]
    return "\n".join(["## Project Stats", f"  Files: {n['files']}", f"  Definitions: {n['nodes']}", f"  Edges: {n['edges']}", "", "## Key Files", *[f"  {x}" for x in best], "", "## Tech Stack", *[f"  {x}" for x in stack]])


def cache_age(root: str, now: float | None = None) -> str:
    entry = cache.read(root)
    made = entry.get("created_at") if entry else None
    return age((now or time.time()) - datetime.fromisoformat(made.replace("Z", "+00:00")).timestamp()) if made else "No cache"


def stats_text(index: Index, name: str = "Weftmap") -> str:
    n = counts(index.files, index.nodes, index.edges).first()
    return "\n".join([f"{name} Stats", "", f"  Files:       {n['files']}", f"  Definitions: {n['definitions']}", f"  Edges:       {n['edges']}", f"  Cache:       {cache_age(index.root)}", ""])


def impact_report(index: Index, path: str) -> str:
    lines = impact_lines(index, path)
    rel = index.files.sparkSession.range(1).select(relative(F.lit(path), index.root)).first()[0]
    return "\n".join([f"Impact analysis: {rel}", plural(len(lines), "affected file", "affected files"), "", *[f"  {x}" for x in lines], ""])


def search_report(index: Index, query: str, kind: str | None = None) -> str:
    rows = _matches(index, query, kind)
    return "\n".join([f'Search results for "{query}"', plural(len(rows), "match", "matches"), "", *[f"  {r['kind']} {r['name']} in {r['rel']}:L{r['start_line']}" for r in rows], ""])


def json_text(index: Index) -> str:
    return render_json(index.files, index.nodes, index.edges, index.scores, index.root)
