"""Definitions and imports of a source file, as rows of the nodes table.

A language has a function (path, source) -> nodes; ``register`` adds one. Nodes
come in the order of a walk from the top; those of equal id count once, the
first; the result is sorted by first line, stably.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from ...schemas import LANGUAGES
from .python import python_nodes
from .script import script_nodes

HANDLERS: dict[str, Callable[[str, str], list[dict]]] = {
    "python": python_nodes,
    "javascript": lambda path, source: script_nodes(source, jsx=True),
    "tsx": lambda path, source: script_nodes(source, jsx=True),
    "typescript": lambda path, source: script_nodes(source, jsx=False),
}


def register(extension: str, language: str, handler: Callable[[str, str], list[dict]]) -> None:
    LANGUAGES[extension] = language
    HANDLERS[language] = handler


def language_of(path: str, languages: dict[str, str] = LANGUAGES) -> str | None:
    return languages.get(os.path.splitext(path)[1])


def registered() -> tuple[dict, dict]:
    """Handlers and languages as they are now, to go with a job to the executors."""
    return dict(HANDLERS), dict(LANGUAGES)


def extract(path: str, source: str, handlers: dict = HANDLERS, languages: dict[str, str] = LANGUAGES) -> list[dict]:
    """Nodes (id, name, kind, start_line, end_line, references, seq) of a file; none for other languages."""
    handler = handlers.get(language_of(path, languages) or "")
    out: dict[str, dict] = {}
    for n in handler(path, source) if handler else ():
        out.setdefault(f"{path}:{n['name']}:{n['start_line']}", n)
    nodes = sorted(out.items(), key=lambda x: x[1]["start_line"])
    return [{"id": key, **n, "seq": k} for k, (key, n) in enumerate(nodes)]
