"""The budgeted map and the JSON document (WIN-1, WIN-2, AGG-10, PRJ-1 to 5, SNK-2, SNK-3).

Lengths come first: a file's block length is summed from its lines, files are
ordered by score, and a running sum cuts at the budget. Only files that fit are
rendered, so the budget bounds what is put in one row. As every block has
a length above 0, the running sum is over the best ``most`` files alone: more
can't fit, and no global window runs over all files.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.paths import relative
from ..functions.text import fixed4, units
from .graph import definitions

#: A header without a path: " [score: 0.0000]" and line ends.
LEAST_BLOCK = 17


def definition_line(kind: Column, name: Column, line: Column) -> Column:
    return F.format_string("  %s %s (L%s)", kind, name, line.cast("string"))


def file_blocks(files: DataFrame, nodes: DataFrame, scores: DataFrame, root: str) -> DataFrame:
    """(file_path, score, header, length): the header line of each file and the length of its block in UTF-16 units."""
    lines = definitions(nodes).groupBy("file_path").agg(F.sum(units(definition_line(F.col("kind"), F.col("name"), F.col("start_line"))) + 1).alias("body"))
    scored = files.select("file_path").join(scores, "file_path", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    header = F.concat(relative(F.col("file_path"), root), F.lit(" [score: "), fixed4(F.col("score")), F.lit("]"))
    out = scored.join(lines, "file_path", "left").withColumn("header", header)
    return out.select("file_path", "score", "header", (units(F.col("header")) + 1 + F.coalesce("body", F.lit(0).cast("long"))).alias("length"))


def budget_cut(blocks: DataFrame, most: int) -> DataFrame:
    """The blocks that fit ``most`` units in order of score, with their place and the sum so far."""
    order = [F.desc("score"), F.collate("file_path", "UNICODE")]
    best = blocks.orderBy(*order).limit(most // LEAST_BLOCK + 2)
    w = Window.orderBy(*order)
    ranked = best.withColumn("place", F.row_number().over(w)).withColumn("total", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where(F.col("total") <= most)


def render_map(files: DataFrame, nodes: DataFrame, scores: DataFrame, root: str, budget: int = 2048, per_token: int = 3) -> DataFrame:
    """One row: text, of the files that fit the budget and the count of tokens."""
    fit = budget_cut(file_blocks(files, nodes, scores, root), budget * per_token)
    own = definitions(nodes).select("file_path", "start_line", "seq", definition_line(F.col("kind"), F.col("name"), F.col("start_line")).alias("line"))
    met = fit.join(own, "file_path", "left").groupBy("file_path", "place", "header", "total").agg(F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("start_line", "seq", "line")))).alias("lines"))
    block = F.array_join(F.concat(F.array("header"), F.transform("lines", lambda x: x["line"]), F.array(F.lit(""))), "\n")
    whole = met.select("place", "total", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "block"))).alias("blocks"), F.coalesce(F.max("total"), F.lit(0)).alias("total"))
    body = F.regexp_replace(F.array_join(F.transform("blocks", lambda x: x["block"]), ""), r"\s+$", "")
    footer = F.format_string("[~%s tokens]", F.ceil(F.col("total") / per_token).cast("string"))
    return whole.select(F.when(F.size("blocks") == 0, footer).otherwise(F.concat(body, F.lit("\n"), footer)).alias("text"))


def context_text(path: str, nodes: DataFrame, edges: DataFrame, scores: DataFrame, root: str) -> DataFrame:
    """One row: text, on a file's definitions, what it needs and what needs it. Unknown files have none of these."""
    spark = nodes.sparkSession

    def joined(df: DataFrame, line: Column, *order: Column | str, name: str) -> DataFrame:
        got = df.agg(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))).alias("l"))
        return got.select(F.when(F.size("l") == 0, F.lit("(none)")).otherwise(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias(name))

    own = joined(definitions(nodes).where(F.col("file_path") == path), definition_line(F.col("kind"), F.col("name"), F.col("start_line")), "start_line", "seq", name="defs")
    place = lambda c: F.collate(F.col(c), "UNICODE").alias("place")
    link = lambda c: F.concat(F.lit("  "), relative(F.col(c), root))
    needs = joined(edges.where(F.col("src") == path).select("dst").distinct(), link("dst"), place("dst"), name="needs")
    needed = joined(edges.where(F.col("dst") == path).select("src").distinct(), link("src"), place("src"), name="needed")
    score = scores.where(F.col("file_path") == path).agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    title = spark.range(1).select(relative(F.lit(path), root).alias("rel"))
    one = title.join(own).join(needs).join(needed).join(score)
    return one.select(F.concat(F.lit("# "), "rel", F.lit(" [score: "), fixed4(F.col("score")), F.lit("]\n\n## Definitions\n"), "defs", F.lit("\n\n## Dependencies\n"), "needs", F.lit("\n\n## Dependents\n"), "needed").alias("text"))


def json_rows(files: DataFrame, nodes: DataFrame, scores: DataFrame, root: str) -> DataFrame:
    """(filePath, score, definitions, file_path): a row for each file of the JSON document."""
    own = definitions(nodes).groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("start_line", "seq", "name", "kind", "end_line"))).alias("d"))
    scored = files.select("file_path").join(scores, "file_path", "left").join(own, "file_path", "left")
    entry = F.transform(F.coalesce("d", F.array().cast("array<struct<start_line:int,seq:int,name:string,kind:string,end_line:int>>")), lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), x["start_line"].alias("startLine"), x["end_line"].alias("endLine")))
    return scored.select(relative(F.col("file_path"), root).alias("filePath"), F.coalesce("score", F.lit(0.0)).alias("score"), entry.alias("definitions"), "file_path")


def _number(x: float) -> int | float:
    return int(x) if x == int(x) and abs(x) < 1e21 else x


def _dump(value) -> str:
    """JSON with two spaces, numbers as scripts print them."""

    def show(v, pad: str) -> str:
        if isinstance(v, dict | list):
            if not v:
                return "{}" if isinstance(v, dict) else "[]"
            inner = pad + "  "
            items = [f"{json.dumps(k, ensure_ascii=False)}: {show(x, inner)}" for k, x in v.items()] if isinstance(v, dict) else [show(x, inner) for x in v]
            a, b = "{}" if isinstance(v, dict) else "[]"
            return f"{a}\n{inner}" + f",\n{inner}".join(items) + f"\n{pad}{b}"
        if isinstance(v, float):
            v = _number(v)
            if isinstance(v, float) and 1e-6 <= abs(v) < 1e-4:
                return _plain(v)
            return repr(v).replace("e-0", "e-").replace("e+0", "e+")
        return json.dumps(v, ensure_ascii=False)

    return show(value, "")


def _plain(v: float) -> str:
    """A small number without an exponent."""
    digits, exp = repr(v).split("e-") if "e-" in repr(v) else (repr(v), "0")
    if exp == "0":
        return digits
    sign, digits = ("-", digits[1:]) if digits.startswith("-") else ("", digits)
    return f"{sign}0.{'0' * (int(exp) - 1)}{digits.replace('.', '')}"


def render_json(files: DataFrame, nodes: DataFrame, edges: DataFrame, scores: DataFrame, root: str) -> str:
    """The document: all files, best first. It is one text, so it is made on the driver; for large maps use ``json_rows``."""
    rows = json_rows(files, nodes, scores, root).orderBy(F.desc("score"), F.collate("file_path", "UNICODE")).drop("file_path")
    entries = [{"filePath": r["filePath"], "score": r["score"], "definitions": [d.asDict() for d in r["definitions"]]} for r in rows.toLocalIterator()]
    out = {"metadata": {"fileCount": len(entries), "edgeCount": edges.distinct().count(), "tokenCount": 0, "rootDir": root}, "files": entries}
    out["metadata"]["tokenCount"] = math.ceil(len(_dump(out).encode("utf-16-le")) / 2 / 3)
    return _dump(out)
