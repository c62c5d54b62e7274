"""More of the engine's operators over the driver's tables, with SQL: answers as ordered parts, both ways to
resolve imports, requests, manifests, ages and totals.

The code base is that of ``testdata``. The hub is part 1, which every part needs here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import within
from ..functions.text import ago, package_names
from ..operators import graph, parts, render, resolve
from ..operators.closure import impact, ranked
from ..sources.shared import materialize
from . import testdata as T
from .index import search

HUB = 1
RESOURCE_BUDGET = 8192

#: Files of a folder /repo/r<k> and the imports in them: (importing file, reference, what compat finds, what strict finds).
FILES = ("__init__.py", "in/__init__.py", "in/a.py", "in/b.py", "in/a.ts", "in/x.ts", "y.ts", "sub/index.ts", "p/__init__.py")
IMPORTS = (
    ("in/a.py", ".", None, "in/__init__.py"),
    ("in/a.py", "..", "__init__.py", "__init__.py"),
    ("in/a.py", "...", None, None),
    ("in/a.py", ".b", "in/b.py", "in/b.py"),
    ("in/a.py", "..p", None, "p/__init__.py"),
    ("in/a.py", "os", None, None),
    ("in/a.ts", "./x", "in/x.ts", "in/x.ts"),
    ("in/a.ts", "./x.js", None, "in/x.ts"),
    ("in/a.ts", "../y", "y.ts", "y.ts"),
    ("in/a.ts", "../y.ts", None, "y.ts"),
    ("in/a.ts", "../sub/", "sub/index.ts", "sub/index.ts"),
    ("in/a.ts", "../../r{k}/y", None, "y.ts"),
    ("in/a.ts", "lodash", None, None),
)
#: Requests for paths, and what is below the root of them.
REQUESTS = (
    ("pkg/p{k}.py", "pkg/p{k}.py"),
    ("./pkg//x/../p{k}.py", "pkg/p{k}.py"),
    ("../repo/pkg/p{k}.py", "pkg/p{k}.py"),
    ("pkg/../../etc/p{k}", None),
    ("/repo/p{k}/..", ""),
    ("/repository/p{k}.py", None),
    ("/repo/../repo/p{k}", "p{k}"),
    ("/../../p{k}", None),
)


def hub() -> str:
    return f"{T.ROOT}/pkg/p{HUB}.py"


def hub_edges(spark, sf_dir) -> DataFrame:
    every = T.files(spark, sf_dir).select(F.col("file_path").alias("src"), F.lit(hub()).alias("dst")).where("src != dst")
    return T.edges(spark, sf_dir).unionByName(every).distinct()


def context_hub(spark, sf_dir):
    """The context of a file that all others need, a part for each line."""
    return parts.context_parts(hub(), T.nodes(spark, sf_dir), hub_edges(spark, sf_dir), T.scores(spark, sf_dir), T.ROOT)


def search_document(spark, sf_dir):
    """The search's text, a part for each match."""
    return parts.search_parts(search(T.nodes(spark, sf_dir), "WIDGET"), T.ROOT)


def impact_document(spark, sf_dir):
    """The impact's text, a part for each dependent."""
    reached = impact(materialize(T.edges(spark, sf_dir), "edges"), T.seed())
    return parts.impact_parts(ranked(reached, T.scores(spark, sf_dir)), T.ROOT)


def resource_map(spark, sf_dir):
    """The map within the budget of the resource."""
    return render.render_map(T.files(spark, sf_dir), T.nodes(spark, sf_dir), T.scores(spark, sf_dir), T.ROOT, RESOURCE_BUDGET)


def _put(text: str, k):
    return F.replace(F.lit(text), F.lit("{k}"), k.cast("string"))


def resolution_rules(spark, sf_dir):
    """What every kind of reference leads to, by the established rules and by strict ones."""
    k = F.col("s_suppkey")
    keys = T.table(spark, sf_dir, "supplier").select(k)
    at = lambda name: F.concat(F.lit(f"{T.ROOT}/r"), k.cast("string"), F.lit(f"/{name}"))
    files = keys.select(F.explode(F.array(*[at(f) for f in FILES])).alias("file_path"))
    made = F.array(*[F.struct(at(f).alias("file_path"), _put(ref, k).alias("name"), F.lit(n).alias("seq")) for n, (f, ref, *_) in enumerate(IMPORTS)])
    nodes = keys.select(F.explode(made).alias("m")).select("m.*", F.lit("import").alias("kind"), F.concat_ws(":", "m.file_path", "m.seq").alias("id"))
    out = [resolve.resolve(nodes, files, how).select(F.lit(how).alias("resolution"), "id", "src", "dst") for how in ("compat", "strict")]
    return out[0].unionByName(out[1])


def requested_paths(spark, sf_dir):
    """Which requests stay below the root."""
    k = F.col("p_partkey")
    asked = T.table(spark, sf_dir, "part").select(F.explode(F.array(*[_put(r, k) for r, _ in REQUESTS])).alias("request"))
    return asked.select("request", within(F.col("request"), T.ROOT).alias("file_path"))


def manifest_packages(spark, sf_dir):
    """Names in manifests, some of them broken, empty, missing, or without one of the lists."""
    k = F.col("l_orderkey")
    name = F.concat(F.lit('"n'), F.col("l_partkey").cast("string"), F.lit('": "'), F.col("l_linenumber").cast("string"), F.lit('"'))
    lists = T.table(spark, sf_dir, "lineitem").select(k, "l_linenumber", "l_partkey", name.alias("name"), (F.col("l_linenumber") % 2).alias("dev"))
    lists = lists.groupBy("l_orderkey", "dev", "l_partkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "name")).alias("m"))
    by = lists.groupBy("l_orderkey").agg(*[F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("dev") == d, F.col("m")))), lambda x: x["name"]), ", ").alias(c) for d, c in ((1, "need"), (0, "dev"))])
    both = F.concat(F.lit('{"name": "x", "dependencies": {'), F.col("need"), F.lit('}, "devDependencies": {'), F.col("dev"), F.lit("}}"))
    text = F.when(k % 7 == 0, F.concat(F.lit('{"devDependencies": {'), F.col("dev"), F.lit("}}"))).when(k % 7 == 1, F.lit("{}")).when(k % 7 == 2, F.concat(F.lit("no {"), "need")).when(k % 7 != 3, both)
    return by.select("l_orderkey", F.array_join(package_names(text), ",").alias("packages"))


def relative_ages(spark, sf_dir):
    """How long after its time each click arrived, in words."""
    gap = F.unix_micros(F.col("arrived_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return T.table(spark, sf_dir, "clicks").select("click_id", ago(gap / 1e6).alias("age"))


def parse_totals(spark, sf_dir):
    """How many files and nodes the parse gave, by kind of node."""
    nodes = T.nodes_of(T.parsed_corpus(spark, sf_dir))
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_path").alias("files"))


def queries() -> dict:
    return {f.__name__: f for f in (context_hub, search_document, impact_document, resource_map, resolution_rules, requested_paths, manifest_packages, relative_ages, parse_totals)}


def _placed(rows: str, head: str) -> str:
    """SQL of (start, text): ``rows`` (place, t) behind ``head``, which may use the count n."""
    return f"""rows AS ({rows}), total AS (SELECT count(*) AS n FROM rows),
 every AS (SELECT 0::BIGINT AS place, {head} AS t FROM total UNION ALL SELECT place, CASE WHEN place > 1 THEN chr(10) ELSE '' END || t FROM rows)
 SELECT (sum(length(t)) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) - length(t))::BIGINT AS start, t AS text FROM every"""


def oracle_sql() -> dict[str, str]:
    cut = len(T.ROOT) + 2
    with_rank = f"WITH RECURSIVE {T._E}, {T._F}, {T._rank('1 / nn.c')}"
    path = f"'{hub()}'"
    put = lambda text: "'" + text.replace("{k}", "' || k || '") + "'"
    home = f"'{T.ROOT}/r' || k || '/"
    rules = " UNION ALL ".join(
        f"SELECT '{how}' AS resolution, {home}{f}:{n}' AS id, {home}{f}' AS src, {home}{to}' AS dst FROM s" for n, (f, _, *both) in enumerate(IMPORTS) for how, to in zip(("compat", "strict"), both, strict=True) if to
    )
    below = lambda to: f"'{T.ROOT}'" if to == "" else put(f"{T.ROOT}/{to}") if to else "NULL"
    requests = " UNION ALL ".join(f"SELECT {put(r)} AS request, {below(to)} AS file_path FROM p" for r, to in REQUESTS)
    unit = lambda size, name: f"floor(s / {size})::BIGINT || ' {name}' || CASE WHEN floor(s / {size}) = 1 THEN '' ELSE 's' END || ' ago'"
    names = "coalesce(string_agg('n' || l_partkey, ',' ORDER BY l, l_partkey) FILTER (WHERE dev = {}), '')"
    return {
        "context_hub": f"""{with_rank}, {T._N}, h AS (SELECT dst AS p, 'src' AS way FROM e WHERE src = {path} UNION SELECT src, 'dst' FROM e WHERE dst = {path} UNION SELECT file_path, 'dst' FROM f WHERE file_path != {path}),
 listed AS (SELECT 2 AS section, start_line AS a, seq AS b, '' AS p, {T._L} AS t FROM own WHERE file_path = {path}
  UNION ALL SELECT CASE way WHEN 'src' THEN 4 ELSE 6 END, 0, 0, p, '  ' || substr(p, {cut}) FROM h),
 said AS (SELECT * FROM listed UNION ALL SELECT v.s, 0, 0, '', '(none)' FROM (VALUES (2), (4), (6)) v(s) WHERE v.s NOT IN (SELECT section FROM listed)
  UNION ALL SELECT v.s, 0, 0, '', chr(10) || v.t FROM (VALUES (1, '## Definitions'), (3, '## Dependencies'), (5, '## Dependents')) v(s, t)
  UNION ALL SELECT 0, 0, 0, '', '# ' || substr({path}, {cut}) || ' [score: ' || {T._exact(f'(SELECT score FROM score WHERE file_path = {path})')} || ']'),
 o AS (SELECT row_number() OVER (ORDER BY section, a, b, p) AS place, t FROM said), every AS (SELECT place, CASE WHEN place > 1 THEN chr(10) ELSE '' END || t AS t FROM o)
 SELECT (sum(length(t)) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) - length(t))::BIGINT AS start, t AS text FROM every""",
        "search_document": f"WITH {T._E}, {T._N}, {_placed(f'''SELECT row_number() OVER (ORDER BY file_path, start_line, seq) AS place, kind || ' ' || name || ' in ' || substr(file_path, {cut}) || ':L' || start_line AS t FROM n WHERE contains(lower(name), 'widget')''', '''n || CASE n WHEN 1 THEN ' match' ELSE ' matches' END || CASE n WHEN 0 THEN '' ELSE chr(10) || chr(10) END''')}",
        "impact_document": f"""{with_rank}, z AS (SELECT '{T.seed()}' AS p, 0 AS depth, CAST([] AS VARCHAR[]) AS key UNION ALL SELECT e.src, z.depth + 1, min(list_append(z.key, e.src)) FROM z JOIN e ON e.dst = z.p GROUP BY e.src, z.depth),
 m AS (SELECT p, min(depth) AS depth, arg_min(key, depth) AS key FROM z GROUP BY p),
 {_placed(f"""SELECT row_number() OVER (ORDER BY score DESC, depth, key) AS place, substr(p, {cut}) || ' [score: ' || {T._exact('score')} || ']' AS t FROM m JOIN score ON score.file_path = m.p""", "n || CASE n WHEN 1 THEN ' file affected' ELSE ' files affected' END || CASE n WHEN 0 THEN '' ELSE chr(10) || chr(10) END")}""",
        "resource_map": T.oracle_sql()["map_text"].replace(f"total <= {2048 * 3}", f"total <= {RESOURCE_BUDGET * 3}"),
        "resolution_rules": f"WITH s AS (SELECT s_suppkey AS k FROM supplier) {rules}",
        "requested_paths": f"WITH p AS (SELECT p_partkey AS k FROM part) {requests}",
        "manifest_packages": f"""WITH l AS (SELECT l_orderkey, l_linenumber % 2 AS dev, l_partkey, min(l_linenumber) AS l FROM lineitem GROUP BY ALL),
 a AS (SELECT l_orderkey, {names.format(1)} AS need, {names.format(0)} AS dev FROM l GROUP BY l_orderkey)
 SELECT l_orderkey, CASE WHEN l_orderkey % 7 = 0 THEN dev WHEN l_orderkey % 7 = 1 THEN '' WHEN l_orderkey % 7 > 3 THEN need || CASE WHEN need != '' AND dev != '' THEN ',' ELSE '' END || dev END AS packages FROM a""",
        "relative_ages": f"WITH g AS (SELECT click_id, trunc((epoch_us(arrived_at) - epoch_us(ts)) / 1e6)::BIGINT AS s FROM clicks) SELECT click_id, CASE WHEN s < 60 THEN s || ' seconds ago' WHEN s < 3600 THEN {unit(60, 'minute')} WHEN s < 86400 THEN {unit(3600, 'hour')} WHEN s IS NOT NULL THEN {unit(86400, 'day')} END AS age FROM g",
        "parse_totals": f"WITH {T._E} SELECT 'constant' AS kind, count(*) AS n, count(*) AS files FROM part UNION ALL SELECT 'function', count(*), count(*) FROM part UNION ALL SELECT 'import', count(*), count(DISTINCT src) FROM e",
    }
