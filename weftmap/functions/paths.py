"""Path columns: folders, normal form, relative paths (POSIX)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folder(path: Column) -> Column:
    """All before the last slash (``/`` for files of the root)."""
    out = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(out == "", F.lit("/")).otherwise(out)


#: What a path has that isn't in normal form: an empty part, ``.`` or ``..``, or a slash at its end.
_ODD = r"^[^/]|^\z|/\.{0,2}(/|\z)"


def normal(path: Column, keep_slash: bool = False) -> Column:
    """An absolute path without ``.``, ``..`` and double slashes; with ``keep_slash`` a final slash stays. One that is so already is only looked at."""
    parts = F.aggregate(
        F.split(path, "/", -1),
        F.array().cast("array<string>"),
        lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when((p == "") | (p == "."), a).otherwise(F.concat(a, F.array(p))),
    )
    out = F.concat(F.lit("/"), F.array_join(parts, "/"))
    whole = F.when(path.endswith("/") & (F.size(parts) > 0), F.concat(out, F.lit("/"))).otherwise(out) if keep_slash else out
    return F.when(~path.rlike(_ODD), path).otherwise(whole)


def up(path: Column, levels: Column) -> Column:
    """The folder ``levels`` above ``path``."""
    parts = F.split(path, "/", -1)
    out = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - levels, F.lit(1))), "/")
    return F.when(out == "", F.lit("/")).otherwise(out)


def relative(path: Column, root: str) -> Column:
    """``path`` as seen from ``root``: shared folders go, the rest of the root becomes ``..``."""
    root = "/" + root.strip("/")
    base = [p for p in root.split("/") if p]
    inside = "/" + "/".join(base) + "/" if base else "/"
    parts = F.filter(F.split(path, "/", -1), lambda p: p != "")
    given = F.array(*[F.lit(p) for p in base]).cast("array<string>")
    shared = F.coalesce(
        F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(base))), lambda i: F.when((i == len(base)) | ~F.get(parts, i).eqNullSafe(F.get(given, i)), i)), lambda i: i.isNotNull())),
        F.lit(0),
    )
    outside = F.array_join(F.concat(F.array_repeat(F.lit(".."), F.lit(len(base)) - shared), F.slice(parts, shared + 1, F.greatest(F.size(parts) - shared, F.lit(0)))), "/")
    return F.when(path == root, F.lit("")).when(path.startswith(inside), F.substr(path, F.lit(len(inside) + 1))).otherwise(outside)


def within(path: Column, root: str) -> Column:
    """``path``, absolute or as seen from ``root``, in normal form, if it is the root or below it; else null (FLT-6)."""
    root = "/" + root.strip("/")
    whole = normal(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root + "/"), path)))
    return F.when((whole == root) | whole.startswith(root.rstrip("/") + "/"), whole)
