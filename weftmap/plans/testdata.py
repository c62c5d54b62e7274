"""The engine's operators over the driver's tables, with SQL that gives the same rows.

The tables hold no code, so a code base is made of them: each part is a file
``/repo/pkg/p<key>.py``; in an order, each part needs the part before it in order
of key (so the graph has as many edges as order lines at most and no cycle). Its
definitions are a function named after the part and a constant after its brand.
Each supplier is a script and a Python file with a definition of every kind, below
as many lines of comment as the rest of its key by 4.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.extract.sql import register_function
from ..functions.paths import relative
from ..functions.text import fixed4, printed12, screaming, units
from ..operators import graph, rank, render, trigrams
from ..operators.closure import depths, impact, ranked
from ..operators.document import json_parts
from ..sources.files import nodes_of, parse_sources
from ..sources import cache
from ..sources.shared import materialize, shared_dir
from ..sources.tree import remove_files, scan, write_tree
from .index import build_index, from_parsed, search

ROOT = "/repo"
SEED = 40
FOCUS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path(key: Column) -> Column:
    return F.concat(F.lit(f"{ROOT}/pkg/p"), key.cast("string"), F.lit(".py"))


def key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): part a needs part b. An order is dealt out once, and lies where its lines are told apart and put in order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey")
    return lines.select(F.col("l_partkey").alias("a"), F.lag("l_partkey").over(w).alias("b")).where("b is not null").distinct()


def files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(path(F.col("p_partkey")).alias("file_path"))


def edges(spark, sf_dir) -> DataFrame:
    """Edges between known files, as paths."""
    known = table(spark, sf_dir, "part").select("p_partkey")
    e = key_edges(spark, sf_dir)
    e = e.join(known, e.a == known.p_partkey, "left_semi").join(known, e.b == known.p_partkey, "left_semi")
    return e.select(path(F.col("a")).alias("src"), path(F.col("b")).alias("dst"))


def nodes(spark, sf_dir) -> DataFrame:
    """Two definitions for each part, and an import for each edge."""
    part = table(spark, sf_dir, "part").select(path(F.col("p_partkey")).alias("file_path"), "p_name", "p_brand", "p_type", "p_size")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    constant = F.upper(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"))
    made = F.array(
        F.struct(constant.alias("name"), F.lit("constant").alias("kind"), F.lit(1).alias("start_line"), F.lit(0).alias("seq")),
        F.struct(name.alias("name"), F.when(F.col("p_size") % 3 == 0, "class").otherwise("function").alias("kind"), (F.col("p_size").cast("int") + 1).alias("start_line"), F.lit(1).alias("seq")),
    )
    own = part.select("file_path", F.explode(made).alias("m")).select("file_path", "m.*")
    links = edges(spark, sf_dir).select(F.col("src").alias("file_path"), F.concat(F.lit("."), F.regexp_extract("dst", r"/([^/]+)\.py$", 1)).alias("name"), F.lit("import").alias("kind"), F.lit(2).alias("start_line"), F.lit(2).alias("seq"))
    both = own.unionByName(links)
    return both.select(F.concat_ws(":", "file_path", "name", F.col("start_line").cast("string")).alias("id"), "name", "kind", "file_path", "start_line", F.col("start_line").alias("end_line"), F.array().cast("array<string>").alias("references"), "seq")


def sources(spark, sf_dir) -> DataFrame:
    """The code base as text: a line for each import, then the definitions."""
    links = edges(spark, sf_dir).groupBy("src").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("from ."), F.regexp_extract("dst", r"/([^/]+)\.py$", 1), F.lit(" import f\n")))), "").alias("head"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", path(F.col("p_partkey")).alias("file_path"))
    body = F.concat(F.lit("LIMIT = "), F.col("p_size").cast("string"), F.lit("\n\n\ndef f():\n    return LIMIT\n"))
    return part.join(links, part.file_path == links.src, "left").select("file_path", F.concat(F.coalesce("head", F.lit("")), body).alias("source"))


#: A script with every kind of node, {n} the supplier's nation, {a} and {b} what it needs.
SCRIPT = """import main, {{ one as two, type Three }} from '{a}';
import {{ map }} from 'lodash';
export {{ x as y }} from '{b}';
export const MAX_{n} = {n}, helper = (v: number) => {{ const HIDDEN = 1; return v; }};
export type Key{n} = Foo | {{ name: Bar }};
export enum Level{n} {{ Low = 'a;{{', High }}
export interface Shape{n} {{
  area(): number;
}}
@Injectable()
export abstract class Store{n} {{
  constructor(private n: number) {{ super(); }}
  @log async load(key: string): Promise<void> {{
    return /["'{{]/g;
  }}
}}
export function greet{n}(name: string): string {{ return name; }}
const made = function () {{ const IN_EXPRESSION = 1; }};
"""
MODULE = """import json as j, os
from .m{a} import f as g

@app.route("/x")
class C{n}:
    LIMIT_{n} = 1

    @staticmethod
    def run(self):
        return 1

def top{n}():
    HIDDEN_X = 1
    return HIDDEN_X
"""


def _filled(template: str, **values: Column) -> Column:
    """The template as a column."""
    out = F.lit(template.replace("{{", "\x01").replace("}}", "\x02"))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return F.translate(out, "\x01\x02", "{}")


def script_path(key: Column) -> Column:
    """A folder's index file, a .ts or a .tsx file."""
    name = F.concat(F.lit(f"{ROOT}/web/s"), key.cast("string"))
    return F.concat(name, F.when(key % 3 == 0, "/index.ts").when(key % 3 == 1, ".ts").otherwise(".tsx"))


def _padded(key: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("// { not code\n"), (key % 4).cast("int")), text)


def scripts(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    to = lambda n: F.concat(F.when(k % 3 == 0, "../s").otherwise("./s"), (k - n).cast("string"))
    text = _filled(SCRIPT, a=to(1), b=to(2), n=F.col("s_nationkey").cast("string"))
    return table(spark, sf_dir, "supplier").select(script_path(k).alias("file_path"), _padded(k, text).alias("source"))


def modules(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.replace(_padded(k, _filled(MODULE, a=F.when(k == 0, "none").otherwise((k - 1).cast("string")), n=F.col("s_nationkey").cast("string"))), F.lit("// {"), F.lit("# ("))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit(f"{ROOT}/web/m"), k.cast("string"), F.lit(".py")).alias("file_path"), text.alias("source"))


def scores(spark, sf_dir, focus: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Scores after 20 rounds; ``known`` are the edges, if they are there already."""
    weights = {f"{ROOT}/pkg/p{focus}.py": rank.FOCUS_WEIGHT} if focus is not None else None
    made = rank.pagerank(files(spark, sf_dir), edges(spark, sf_dir) if known is None else known, rounds=20, tolerance=0.0, personalization=weights)
    return made.scores.withColumn("score", F.round("score", 6))


def seed() -> str:
    return f"{ROOT}/pkg/p{SEED}.py"


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def edges_distinct(spark, sf_dir):
    return edges(spark, sf_dir)


def out_degree(spark, sf_dir):
    return graph.out_degree(edges(spark, sf_dir))


def in_degree(spark, sf_dir):
    return graph.in_degree(edges(spark, sf_dir))


def dangling_files(spark, sf_dir):
    return graph.dangling(files(spark, sf_dir), edges(spark, sf_dir))


def parsed_corpus(spark, sf_dir) -> DataFrame:
    """The source text, extracted once."""
    return materialize(parse_sources(materialize(sources(spark, sf_dir), "sources")), "parsed")


def corpus_edges(spark, sf_dir):
    """Source text, extracted and resolved."""
    parsed = parsed_corpus(spark, sf_dir)
    return graph.build_edges(nodes_of(parsed), files(spark, sf_dir))


def corpus_definitions(spark, sf_dir):
    """Definitions found in the source text."""
    return _long(graph.definitions(nodes_of(parsed_corpus(spark, sf_dir))).select("file_path", "name", "kind", "start_line", "end_line"), "start_line", "end_line")


def _told(df: DataFrame) -> DataFrame:
    return _long(df.select("file_path", "name", "kind", "start_line", "end_line", F.array_join("references", ",").alias("refs"), "seq"), "start_line", "end_line", "seq")


def script_nodes(spark, sf_dir):
    """Every kind of node of a script, in order."""
    return _told(nodes_of(parse_sources(scripts(spark, sf_dir))))


def module_nodes(spark, sf_dir):
    """Every kind of node of a Python file, in order."""
    return _told(nodes_of(parse_sources(modules(spark, sf_dir))))


def script_edges(spark, sf_dir):
    """Relative imports of files and folders, re-exports, packages left out."""
    parsed = materialize(parse_sources(scripts(spark, sf_dir).unionByName(modules(spark, sf_dir))), "parsed")
    return graph.build_edges(nodes_of(parsed), parsed.select("file_path"))


def script_nodes_sql(spark, sf_dir):
    """The same rows by SQL text alone, with the table function."""
    register_function(spark)
    scripts(spark, sf_dir).createOrReplaceTempView("weft_scripts")
    return spark.sql("""
        SELECT s.file_path, n.name, n.kind, CAST(n.start_line AS BIGINT) AS start_line, CAST(n.end_line AS BIGINT) AS end_line,
               array_join(n.references, ',') AS refs, CAST(n.seq AS BIGINT) AS seq
        FROM weft_scripts s, LATERAL extract_nodes(s.file_path, s.source) n""")


def written_tree(spark, sf_dir) -> str:
    """The code base as files in a new folder, among others that a scan leaves out."""
    root = f"{shared_dir(spark)}/weftmap/tree-{uuid.uuid4().hex}"
    own = sources(spark, sf_dir).select(relative(F.col("file_path"), ROOT).alias("relative"), "source", F.regexp_extract("file_path", "p([0-9]+)", 1).alias("k"))
    others = F.array(*[F.concat(F.lit(a), "k", F.lit(b)) for a, b in (("node_modules/m", ".py"), ("pkg/.h", ".py"), ("pkg/dist/d", ".ts"), ("pkg/p", ".min.js"), ("pkg/p", ".md"), ("gen/a/g", ".py"), ("pkg/__s", ".pyc"))])
    decoys = own.where("k % 10 = 0").select(F.explode(others).alias("relative"), F.lit("X = 1\n").alias("source"))
    rules = spark.range(1).select(F.lit(".gitignore").alias("relative"), F.lit("gen/\n").alias("source"))
    write_tree(own.drop("k").unionByName(decoys).unionByName(rules), root)
    return root


def tree_scan(spark, sf_dir):
    """A tree on disk, listed, read and parsed by the executors."""
    scanned = scan(spark, written_tree(spark, sf_dir), content=True)
    return parse_sources(scanned, keep=("relative", "size")).select("relative", "size", F.size("nodes").cast("long").alias("n_nodes"))


def cache_refresh(spark, sf_dir):
    """A tree that changes after it was indexed: what a join with the cache finds, and the nodes of the index made from both."""
    root = written_tree(spark, sf_dir)
    build_index(spark, root)
    k = F.col("p_partkey")
    name = F.concat(F.lit("pkg/p"), k.cast("string"), F.lit(".py"))
    part = table(spark, sf_dir, "part")
    write_tree(part.where(k % 5 == 0).select(name.alias("relative"), F.lit("A_ONE = 1\nB_TWO = 2\n\ndef g(): pass\n").alias("source")), root)
    remove_files(part.where(k % 7 == 0).select(name.alias("relative")), root)
    write_tree(part.where(k % 11 == 0).select(F.concat(F.lit("pkg/q"), k.cast("string"), F.lit(".ts")).alias("relative"), F.lit("export class Q {}\n").alias("source")), root)
    status = materialize(cache.compare(scan(spark, root), cache.snapshot(spark, root, cache.read(root))), "status")
    index = build_index(spark, root, incremental=True)
    n = index.nodes.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_nodes"))
    found = status.withColumn("file_path", F.concat(F.lit(root + "/"), "relative"))
    return found.join(n, "file_path", "left").select("relative", "status", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"))


def fixed_decimals(spark, sf_dir):
    """Numbers as text with four decimals, most of them a hair from a tie."""
    x = (F.col("l_partkey") * 2 + 1) / 20_000.0
    rows = table(spark, sf_dir, "lineitem").select(x.alias("x")).unionByName(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + F.col("l_partkey") / 1024.0 / 7.0).alias("x"))).unionByName(table(spark, sf_dir, "part").select((0.0 - F.col("p_partkey") / 1024.0).alias("x"))).distinct()
    return rows.select(printed12(F.col("x")).alias("x"), fixed4(F.col("x")).alias("text"))


def import_candidates(spark, sf_dir):
    """How each import is tried: the dotted branch, file before package index."""
    from ..operators.resolve import candidates

    refs = nodes(spark, sf_dir).where("kind = 'import'")
    # an import's own tries are counted and compared in its row; imports, not tries, are grouped
    tried = refs.select("file_path", candidates(F.col("file_path"), F.col("name")).alias("tries"))
    told = tried.select("file_path", F.size("tries").alias("n"), F.array_min("tries").alias("least"), F.array_max("tries").alias("most"))
    return _long(told.groupBy("file_path").agg(F.sum("n").alias("n"), (F.max("n") - 1).alias("last"), F.min("least").alias("least"), F.max("most").alias("most")).where("n > 0"), "n", "last")


def forward_deps(spark, sf_dir):
    return graph.forward_deps(edges(spark, sf_dir), seed())


def reverse_deps(spark, sf_dir):
    return graph.reverse_deps(edges(spark, sf_dir), seed())


def impact_closure(spark, sf_dir):
    return depths(materialize(edges(spark, sf_dir), "edges"), seed())


def cyclic_edges(spark, sf_dir) -> DataFrame:
    """The edges, some of them both ways."""
    known = table(spark, sf_dir, "part").select("p_partkey")
    e = key_edges(spark, sf_dir)
    e = e.join(known, e.a == known.p_partkey, "left_semi").join(known, e.b == known.p_partkey, "left_semi")
    both = e.unionByName(e.where((F.col("a") + F.col("b")) % 5 == 0).select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return both.select(path(F.col("a")).alias("src"), path(F.col("b")).alias("dst"))


def impact_order(spark, sf_dir):
    """Dependents in breadth-first order, where files need each other: how many of a level come before each."""
    reached = impact(materialize(cyclic_edges(spark, sf_dir), "edges"), seed())
    place = F.row_number().over(Window.partitionBy("depth").orderBy("place"))
    return _long(reached.select("file_path", "depth", place.alias("place")), "depth", "place")


def impact_cyclic(spark, sf_dir):
    """Dependents where files need each other."""
    return depths(materialize(cyclic_edges(spark, sf_dir), "edges"), seed())


def impact_ranked(spark, sf_dir):
    reached = impact(materialize(edges(spark, sf_dir), "edges"), seed())
    return _long(ranked(reached, scores(spark, sf_dir)).drop("place"), "depth")


def pagerank_20(spark, sf_dir):
    return scores(spark, sf_dir)


def pagerank_focus_20(spark, sf_dir):
    return scores(spark, sf_dir, FOCUS)


def pagerank_kernel_20(spark, sf_dir):
    """The same rounds: the way through one task that this name stood for is gone."""
    return scores(spark, sf_dir)


def pagerank_converged(spark, sf_dir):
    """Rounds until the L1 difference is below the tolerance, and the scores then."""
    made = rank.pagerank(files(spark, sf_dir), edges(spark, sf_dir), tolerance=1e-4)
    return made.scores.select("file_path", F.round("score", 6).alias("score"), F.lit(made.iterations).cast("long").alias("rounds"), F.lit(made.converged).alias("converged"))


def rank_top_files(spark, sf_dir):
    return rank.top_files(files(spark, sf_dir), scores(spark, sf_dir))


def map_budgeted(spark, sf_dir):
    blocks = render.file_blocks(files(spark, sf_dir), nodes(spark, sf_dir), scores(spark, sf_dir), ROOT)
    return _long(render.budget_cut(blocks, 2048 * 3).select("file_path", "header", "length", "place", "total"), "place", "total", "length")


def map_text(spark, sf_dir):
    return render.render_map(files(spark, sf_dir), nodes(spark, sf_dir), scores(spark, sf_dir), ROOT)


def search_definitions(spark, sf_dir):
    return _long(search(nodes(spark, sf_dir), "WIDGET").select("file_path", "kind", "name", "start_line"), "start_line")


def search_trigrams(spark, sf_dir):
    """The same search by an inverted index of trigrams."""
    return _long(trigrams.build(nodes(spark, sf_dir)).search("WIDGET").select("file_path", "kind", "name", "start_line"), "start_line")


def search_by_kind(spark, sf_dir):
    return _long(search(nodes(spark, sf_dir), "", "constant").select("file_path", "kind", "name", "start_line"), "start_line")


def summary_counts(spark, sf_dir):
    return graph.counts(files(spark, sf_dir), nodes(spark, sf_dir), edges(spark, sf_dir)).select("files", F.col("nodes").alias("definitions"), "edges")


def stats_counts(spark, sf_dir):
    return graph.counts(files(spark, sf_dir), nodes(spark, sf_dir), edges(spark, sf_dir)).select("files", "definitions", "edges")


def definitions_per_file(spark, sf_dir):
    own = graph.definitions(nodes(spark, sf_dir)).withColumn("line", render.definition_line(F.col("kind"), F.col("name"), F.col("start_line")))
    met = own.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("start_line", "seq", "line"))).alias("l"))
    return met.select("file_path", "n", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"))


def context_text(spark, sf_dir):
    known = materialize(edges(spark, sf_dir), "edges")  # read for both ways and for the scores
    return render.context_text(seed(), nodes(spark, sf_dir), known, scores(spark, sf_dir, known=known), ROOT)


def json_entries(spark, sf_dir):
    rows = render.json_rows(files(spark, sf_dir), nodes(spark, sf_dir), scores(spark, sf_dir), ROOT)
    return rows.select("filePath", "score", F.size("definitions").cast("long").alias("n"), F.array_join(F.transform("definitions", lambda d: F.concat_ws("/", d["kind"], d["name"], d["startLine"].cast("string"), d["endLine"].cast("string"))), ",").alias("definitions"))


def json_document(spark, sf_dir):
    """The document's parts and where each starts."""
    return json_parts(files(spark, sf_dir), nodes(spark, sf_dir), edges(spark, sf_dir), scores(spark, sf_dir), ROOT)


def screaming_constants(spark, sf_dir):
    name = F.replace("p_type", F.lit(" "), F.lit("_"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).where(screaming(F.col("name")))


def utf16_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", units(F.coalesce("text", F.lit(""))).alias("units"))


def page_links(spark, sf_dir):
    """Local links in pages, as references that would be resolved."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="(/[^"]*)"'), 1)
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


def corpus_index(spark, sf_dir):
    """End to end: text to ranked map."""
    index = from_parsed(ROOT, parsed_corpus(spark, sf_dir))
    return render.render_map(index.files, index.nodes, index.scores, ROOT)


def queries() -> dict:
    return {f.__name__: f for f in (edges_distinct, out_degree, in_degree, dangling_files, corpus_edges, corpus_definitions, script_nodes, module_nodes, script_edges, script_nodes_sql, tree_scan, cache_refresh, fixed_decimals, import_candidates, forward_deps, reverse_deps, impact_closure, impact_cyclic, impact_order, impact_ranked, pagerank_20, pagerank_focus_20, pagerank_kernel_20, pagerank_converged, rank_top_files, map_budgeted, map_text, search_definitions, search_trigrams, search_by_kind, summary_counts, stats_counts, definitions_per_file, context_text, json_entries, json_document, screaming_constants, utf16_lengths, page_links, corpus_index)}


_P = f"'{ROOT}/pkg/p' || {{}} || '.py'"
_E = f"""e0 AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
 e1 AS (SELECT l_partkey AS a, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS b FROM e0),
 e AS (SELECT DISTINCT a, b, {_P.format('a')} AS src, {_P.format('b')} AS dst FROM e1 WHERE b IS NOT NULL AND a IN (SELECT p_partkey FROM part) AND b IN (SELECT p_partkey FROM part))"""
_F = f"f AS (SELECT p_partkey AS k, {_P.format('p_partkey')} AS file_path FROM part)"
_N = f"""own AS (SELECT {_P.format('p_partkey')} AS file_path, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')) AS name, 'constant' AS kind, 1 AS start_line, 0 AS seq FROM part
 UNION ALL SELECT {_P.format('p_partkey')}, replace(p_name, ' ', '_'), CASE WHEN p_size % 3 = 0 THEN 'class' ELSE 'function' END, p_size + 1, 1 FROM part),
 n AS (SELECT * FROM own UNION ALL SELECT src, '.p' || b, 'import', 2, 2 FROM e)"""
_L = "'  ' || kind || ' ' || name || ' (L' || start_line || ')'"


def _exact(x: str) -> str:
    """Four decimals of a double's exact value."""
    return f"round(printf('%.30f', {x})::DECIMAL(38, 30), 4)::VARCHAR"


def _rank(teleport: str, rounds: int = 20) -> str:
    """Scores after some rounds; each vertex has an edge of weight 0 to itself, so that it stays."""
    return f"""nn AS (SELECT count(*)::DOUBLE AS c FROM f), deg AS (SELECT a, count(*)::DOUBLE AS k FROM e GROUP BY a),
 w AS (SELECT e.a, e.b, 1 / deg.k AS x FROM e JOIN deg USING (a) UNION ALL SELECT k, k, 0 FROM f),
 t AS (SELECT f.k, {teleport} AS t FROM f, nn),
 r AS (SELECT 0 AS i, f.k AS v, 1 / nn.c AS s FROM f, nn
  UNION ALL SELECT q.i + 1, w.b, 0.85 * (sum(q.s * w.x) + max(q.d) * max(t.t)) + 0.15 * max(t.t)
  FROM (SELECT r.i, r.v, r.s, sum(CASE WHEN deg.a IS NULL THEN r.s ELSE 0 END) OVER () AS d FROM r LEFT JOIN deg ON deg.a = r.v WHERE r.i < {rounds}) q
  JOIN w ON w.a = q.v JOIN t ON t.k = w.b GROUP BY q.i, w.b),
 score AS (SELECT {_P.format('v')} AS file_path, round(s, 6) AS score FROM r WHERE i = {rounds})"""


def oracle_sql() -> dict[str, str]:
    seed_path, uniform = f"'{seed()}'", _rank("1 / nn.c")
    graph_sql, with_rank = f"WITH {_E}", f"WITH RECURSIVE {_E}, {_F}, {uniform}"
    blocks = f"""{_N}, body AS (SELECT file_path, sum(length({_L}) + 1) AS body FROM own GROUP BY file_path),
 bl AS (SELECT f.file_path, score, substr(f.file_path, {len(ROOT) + 2}) || ' [score: ' || {_exact('score')} || ']' AS header, body FROM f JOIN score USING (file_path) JOIN body USING (file_path)),
 cut AS (SELECT file_path, header, (length(header) + 1 + body)::BIGINT AS length, row_number() OVER o AS place, (sum(length(header) + 1 + body) OVER o)::BIGINT AS total FROM bl WINDOW o AS (ORDER BY score DESC, file_path ROWS UNBOUNDED PRECEDING)),
 fit AS (SELECT * FROM cut WHERE total <= {2048 * 3})"""
    ndef = f"(SELECT string_agg({_L}, chr(10) ORDER BY start_line, seq) FROM own WHERE file_path = {seed_path})"
    dep = "(SELECT string_agg('  ' || substr({0}, {1}), chr(10) ORDER BY {0}) FROM e WHERE {2} = {3})"
    cands = " UNION ALL ".join(f"SELECT {k} AS place, '{s}' AS s" for k, s in enumerate(["", ".ts", ".tsx", ".js", ".mjs", ".cjs", ".py", *[f"/index{x}" for x in (".ts", ".tsx", ".js", ".mjs", ".cjs", ".py")]]))
    at = f"'{ROOT}/web/s' || {{0}} || CASE {{0}} % 3 WHEN 0 THEN '/index.ts' WHEN 1 THEN '.ts' ELSE '.tsx' END"
    up = "CASE s_suppkey % 3 WHEN 0 THEN '../s' ELSE './s' END || (s_suppkey - {})"
    told = [(up.format(1), "import", 1, 1, "main,two,Three"), ("'lodash'", "import", 2, 2, "map"), (up.format(2), "export", 3, 3, "x"), ("'MAX_' || s_nationkey", "constant", 4, 4, ""), ("'helper'", "function", 4, 4, ""), ("'Key' || s_nationkey", "type", 5, 5, "Foo,name,Bar"), ("'Level' || s_nationkey", "enum", 6, 6, ""), ("'Shape' || s_nationkey", "interface", 7, 9, ""), ("'Store' || s_nationkey", "class", 11, 16, "Injectable"), ("'load'", "method", 13, 15, "log"), ("'greet' || s_nationkey", "function", 17, 17, ""), ("'IN_EXPRESSION'", "constant", 18, 18, "")]
    module = [("'j'", "import", 1, 1, "j,os"), ("'.m' || CASE s_suppkey WHEN 0 THEN 'none' ELSE (s_suppkey - 1)::VARCHAR END", "import", 2, 2, "g"), ("'C' || s_nationkey", "class", 5, 10, "app.route"), ("'LIMIT_' || s_nationkey", "constant", 6, 6, ""), ("'run'", "method", 9, 10, "staticmethod"), ("'top' || s_nationkey", "function", 12, 14, "")]
    rows = lambda path, nodes: " UNION ALL ".join(f"SELECT {path} AS file_path, {n} AS name, '{k}' AS kind, (s_suppkey % 4 + {a})::BIGINT AS start_line, (s_suppkey % 4 + {b})::BIGINT AS end_line, '{r}' AS refs, {i}::BIGINT AS seq FROM supplier" for i, (n, k, a, b, r) in enumerate(nodes))
    cyclic = "c AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e WHERE (a + b) % 5 = 0)"
    corpus = f"""{_F}, d AS (SELECT src, count(*) AS h FROM e GROUP BY src), g AS (SELECT file_path, coalesce(h, 0) AS h FROM f LEFT JOIN d ON d.src = f.file_path),
 r0 AS (SELECT i, v, s FROM r), moved AS (SELECT x.i, sum(abs(x.s - y.s)) AS delta FROM r0 x JOIN r0 y ON y.v = x.v AND y.i = x.i - 1 GROUP BY x.i), stop AS (SELECT min(i) AS i FROM moved WHERE delta < {rank.TOLERANCE}),
 last AS (SELECT {_P.format('v')} AS file_path, s AS score FROM r0, stop WHERE r0.i = stop.i),
 bl AS (SELECT file_path, score, substr(file_path, {len(ROOT) + 2}) || ' [score: ' || {_exact('score')} || ']' || chr(10) || '  constant LIMIT (L' || (h + 1) || ')' || chr(10) || '  function f (L' || (h + 4) || ')' || chr(10) AS block FROM g JOIN last USING (file_path)),
 cut AS (SELECT block, row_number() OVER o AS place, sum(length(block)) OVER o AS total FROM bl WINDOW o AS (ORDER BY score DESC, file_path ROWS UNBOUNDED PRECEDING)),
 fit AS (SELECT * FROM cut WHERE total <= {2048 * 3})"""
    moved = "d AS (SELECT x.i, sum(abs(x.s - y.s)) AS delta FROM r x JOIN r y ON y.v = x.v AND y.i = x.i - 1 GROUP BY x.i), stop AS (SELECT min(i) AS i FROM d WHERE delta < 1e-4)"
    size = "length('LIMIT = ' || p_size || chr(10) || chr(10) || chr(10) || 'def f():' || chr(10) || '    return LIMIT' || chr(10))"
    return {
        "script_nodes_sql": rows(at.format("s_suppkey"), told),
        "tree_scan": f"{graph_sql}, d AS (SELECT a, count(*) AS h, sum(length('from .p' || b || ' import f') + 1) AS l FROM e GROUP BY a) SELECT 'pkg/p' || p_partkey || '.py' AS relative, ({size} + coalesce(l, 0))::BIGINT AS size, 2 + coalesce(h, 0) AS n_nodes FROM part LEFT JOIN d ON a = p_partkey",
        "cache_refresh": f"{graph_sql}, d AS (SELECT a, count(*) AS h FROM e GROUP BY a), s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'removed' WHEN p_partkey % 5 = 0 THEN 'changed' ELSE 'kept' END AS status FROM part) SELECT 'pkg/p' || k || '.py' AS relative, status, CASE status WHEN 'removed' THEN 0 WHEN 'changed' THEN 3 ELSE 2 + coalesce(h, 0) END::BIGINT AS n_nodes FROM s LEFT JOIN d ON a = k UNION ALL SELECT 'pkg/q' || k || '.ts', 'added', 1 FROM s WHERE k % 11 = 0",
        "fixed_decimals": f"WITH x AS (SELECT (l_partkey * 2 + 1) / 20000.0::DOUBLE AS x FROM lineitem UNION SELECT l_suppkey + l_partkey / 1024.0::DOUBLE / 7.0::DOUBLE FROM lineitem UNION SELECT 0.0::DOUBLE - p_partkey / 1024.0::DOUBLE FROM part) SELECT printf('%.12f', x) AS x, {_exact('x')} AS text FROM x",
        "script_nodes": rows(at.format("s_suppkey"), told),
        "module_nodes": rows(f"'{ROOT}/web/m' || s_suppkey || '.py'", module),
        "script_edges": f"SELECT {at.format('s_suppkey')} AS src, {at.format('(s_suppkey - n)')} AS dst FROM supplier, (VALUES (1), (2)) v(n) WHERE s_suppkey >= n UNION ALL SELECT '{ROOT}/web/m' || s_suppkey || '.py', '{ROOT}/web/m' || (s_suppkey - 1) || '.py' FROM supplier WHERE s_suppkey >= 1",
        "impact_cyclic": f"WITH RECURSIVE {_E}, {cyclic}, z AS (SELECT {seed_path} AS p, 0 AS depth UNION SELECT c.src, z.depth + 1 FROM z JOIN c ON c.dst = z.p WHERE z.depth < 60) SELECT p AS file_path, min(depth)::BIGINT AS depth FROM z GROUP BY p",
        "impact_order": f"WITH RECURSIVE {_E}, {cyclic}, z AS (SELECT {seed_path} AS p, 0 AS depth, CAST([] AS VARCHAR[]) AS key UNION ALL SELECT c.src, z.depth + 1, min(list_append(z.key, c.src)) FROM z JOIN c ON c.dst = z.p WHERE z.depth < 20 GROUP BY c.src, z.depth), m AS (SELECT p, min(depth) AS depth, arg_min(key, depth) AS key FROM z GROUP BY p) SELECT p AS file_path, depth::BIGINT AS depth, row_number() OVER (PARTITION BY depth ORDER BY key) AS place FROM m",
        "pagerank_converged": f"WITH RECURSIVE {_E}, {_F}, {_rank('1 / nn.c', 60)}, {moved} SELECT {_P.format('v')} AS file_path, round(s, 6) AS score, stop.i::BIGINT AS rounds, true AS converged FROM r, stop WHERE r.i = stop.i",
        "corpus_index": f"WITH RECURSIVE {_E}, {_rank('1 / nn.c', 100).replace('nn AS (', _F + ', nn AS (', 1)}, {corpus.replace(_F + ', ', '')} SELECT string_agg(block, '' ORDER BY place) || '[~' || ceil(max(total) / 3.0)::BIGINT || ' tokens]' AS text FROM fit",
        "edges_distinct": f"{graph_sql} SELECT src, dst FROM e",
        "out_degree": f"{graph_sql} SELECT src AS file_path, count(*) AS out_degree FROM e GROUP BY src",
        "in_degree": f"{graph_sql} SELECT dst AS file_path, count(*) AS in_degree FROM e GROUP BY dst",
        "dangling_files": f"{graph_sql}, {_F} SELECT file_path FROM f WHERE k NOT IN (SELECT a FROM e)",
        "corpus_edges": f"{graph_sql} SELECT src, dst FROM e",
        "corpus_definitions": f"{graph_sql}, d AS (SELECT src, count(*) AS h FROM e GROUP BY src), {_F}, g AS (SELECT file_path, coalesce(h, 0) AS h FROM f LEFT JOIN d ON d.src = f.file_path) SELECT file_path, 'LIMIT' AS name, 'constant' AS kind, h + 1 AS start_line, h + 1 AS end_line FROM g UNION ALL SELECT file_path, 'f', 'function', h + 4, h + 5 FROM g",
        "import_candidates": f"{graph_sql}, c AS ({cands}), x AS (SELECT src AS file_path, place, '{ROOT}/pkg/p' || b || s AS candidate FROM e, c) SELECT file_path, count(*) AS n, max(place)::BIGINT AS last, min(candidate) AS least, max(candidate) AS most FROM x GROUP BY file_path",
        "forward_deps": f"{graph_sql} SELECT dst AS file_path FROM e WHERE src = {seed_path}",
        "reverse_deps": f"{graph_sql} SELECT src AS file_path FROM e WHERE dst = {seed_path}",
        "impact_closure": f"WITH RECURSIVE {_E}, z AS (SELECT {seed_path} AS p, 0 AS depth UNION SELECT e.src, z.depth + 1 FROM z JOIN e ON e.dst = z.p) SELECT p AS file_path, min(depth)::BIGINT AS depth FROM z GROUP BY p",
        "impact_ranked": f"{with_rank}, z AS (SELECT {seed_path} AS p, 0 AS depth UNION SELECT e.src, z.depth + 1 FROM z JOIN e ON e.dst = z.p) SELECT p AS file_path, min(depth)::BIGINT AS depth, max(score) AS score FROM z JOIN score ON score.file_path = z.p GROUP BY p",
        "pagerank_20": f"{with_rank} SELECT file_path, score FROM score",
        "pagerank_kernel_20": f"{with_rank} SELECT file_path, score FROM score",
        "pagerank_focus_20": f"WITH RECURSIVE {_E}, {_F}, {_rank(f'CASE WHEN f.k = {FOCUS} THEN 1.0 ELSE 0.0 END')} SELECT file_path, score FROM score",
        "rank_top_files": f"{with_rank} SELECT file_path, score FROM score ORDER BY score DESC, file_path LIMIT 10",
        "map_budgeted": f"{with_rank}, {blocks} SELECT file_path, header, length, place, total FROM fit",
        "map_text": f"{with_rank}, {blocks}, b AS (SELECT place, total, header || chr(10) || (SELECT string_agg({_L} || chr(10), '' ORDER BY start_line, seq) FROM own WHERE own.file_path = fit.file_path) AS block FROM fit) SELECT string_agg(block, '' ORDER BY place) || '[~' || ceil(max(total) / 3.0)::BIGINT || ' tokens]' AS text FROM b",
        "search_definitions": f"{graph_sql}, {_N} SELECT file_path, kind, name, start_line::BIGINT AS start_line FROM n WHERE contains(lower(name), 'widget')",
        "search_trigrams": f"{graph_sql}, {_N} SELECT file_path, kind, name, start_line::BIGINT AS start_line FROM n WHERE contains(lower(name), 'widget')",
        "search_by_kind": f"{graph_sql}, {_N} SELECT file_path, kind, name, start_line::BIGINT AS start_line FROM n WHERE kind = 'constant'",
        "summary_counts": f"{graph_sql}, {_N} SELECT (SELECT count(*) FROM part) AS files, (SELECT count(*) FROM n) AS definitions, (SELECT count(*) FROM e) AS edges",
        "stats_counts": f"{graph_sql}, {_N} SELECT (SELECT count(*) FROM part) AS files, (SELECT count(*) FROM own) AS definitions, (SELECT count(*) FROM e) AS edges",
        "definitions_per_file": f"{graph_sql}, {_N} SELECT file_path, count(*) AS n, string_agg({_L}, chr(10) ORDER BY start_line, seq) AS lines FROM own GROUP BY file_path",
        "context_text": f"{with_rank}, {_N} SELECT '# ' || substr({seed_path}, {len(ROOT) + 2}) || ' [score: ' || {_exact(f'(SELECT score FROM score WHERE file_path = {seed_path})')} || ']' || chr(10) || chr(10) || '## Definitions' || chr(10) || {ndef} || chr(10) || chr(10) || '## Dependencies' || chr(10) || coalesce({dep.format('dst', len(ROOT) + 2, 'src', seed_path)}, '(none)') || chr(10) || chr(10) || '## Dependents' || chr(10) || coalesce({dep.format('src', len(ROOT) + 2, 'dst', seed_path)}, '(none)') AS text",
        "json_entries": f"{with_rank}, {_N} SELECT substr(file_path, {len(ROOT) + 2}) AS \"filePath\", max(score) AS score, count(*) AS n, string_agg(kind || '/' || name || '/' || start_line || '/' || start_line, ',' ORDER BY start_line, seq) AS definitions FROM own JOIN score USING (file_path) GROUP BY file_path",
        "json_document": f"""{with_rank}, {_N},
 def AS (SELECT file_path, string_agg('        {{' || chr(10) || '          "name": "' || name || '",' || chr(10) || '          "kind": "' || kind || '",' || chr(10) || '          "startLine": ' || start_line || ',' || chr(10) || '          "endLine": ' || start_line || chr(10) || '        }}', ',' || chr(10) ORDER BY start_line, seq) AS defs FROM own GROUP BY file_path),
 entry AS (SELECT row_number() OVER (ORDER BY score DESC, file_path) AS place, '    {{' || chr(10) || '      "filePath": "' || substr(file_path, {len(ROOT) + 2}) || '",' || chr(10) || '      "score": ' || regexp_replace(printf('%.6f', score), '\\.?0+$', '') || ',' || chr(10) || '      "definitions": [' || chr(10) || defs || chr(10) || '      ]' || chr(10) || '    }}' AS t FROM def JOIN score USING (file_path)),
 head AS (SELECT '{{' || chr(10) || '  "metadata": {{' || chr(10) || '    "fileCount": ' || (SELECT count(*) FROM entry) || ',' || chr(10) || '    "edgeCount": ' || (SELECT count(*) FROM e) || ',' || chr(10) || '    "tokenCount": ' AS a, ',' || chr(10) || '    "rootDir": "{ROOT}"' || chr(10) || '  }},' || chr(10) || '  "files": [' || chr(10) AS b, chr(10) || '  ]' || chr(10) || '}}' AS tail),
 parts AS (SELECT place, CASE WHEN place > 1 THEN ',' || chr(10) ELSE '' END || t AS t FROM entry),
 whole AS (SELECT ceil((sum(length(t)) + max(length(a) + 1 + length(b) + length(tail))) / 3.0)::BIGINT AS tokens FROM parts, head),
 everything AS (SELECT 0 AS place, a || tokens || b AS t FROM head, whole UNION ALL SELECT place, t FROM parts UNION ALL SELECT 1000000000, tail FROM head)
 SELECT (sum(length(t)) OVER (ORDER BY place) - length(t))::BIGINT AS start, t AS text FROM everything""",
        "screaming_constants": "SELECT p_partkey, replace(p_type, ' ', '_') AS name FROM part WHERE regexp_full_match(replace(p_type, ' ', '_'), '[A-Z_][A-Z0-9_]*') AND length(p_type) > 1",
        "utf16_lengths": "SELECT doc_id, (length(coalesce(text, '')) + length(regexp_replace(coalesce(text, ''), '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::BIGINT AS units FROM documents",
        "page_links": "SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href=\"(/[^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id, href",
    }
