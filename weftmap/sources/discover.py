"""Finding the source files below a root, as a list (SRC-1 to SRC-11).

For trees that are as small as a list on the driver should be; ``tree.scan`` gives the
same files as a table, listed by the executors.
"""

from __future__ import annotations

from ..errors import log
from .tree import IGNORE_FILES, Share, Walk


def discover(root: str, extra: list[str] | tuple[str, ...] = (), ignore_files: tuple[str, ...] = IGNORE_FILES) -> list[str]:
    """Absolute paths of the source files, in binary order. Rules: defaults, ``extra``, then each ignore file of the root."""
    walk = Walk(root, tuple(extra), ignore_files)
    found = sorted(f"{walk.root.rstrip('/')}/{relative}" for relative, _, _ in walk.below(Share("")))
    log("info", "files found", {"root": walk.root, "found": len(found)})
    return found
