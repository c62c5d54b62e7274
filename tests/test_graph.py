"""Resolution, graph, ranks and closure on edges given directly."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmap.functions.paths import normal
from weftmap.operators import closure, graph, rank, trigrams
from weftmap.operators.closure import depths, impact, ranked
from weftmap.operators.resolve import resolve
from weftmap.plans.index import search
from weftmap.sources.shared import materialize_bucketed, shared_dir


def vertices(spark, names):
    return spark.createDataFrame([(n,) for n in names], "file_path string")


def edge_table(spark, pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


#: (file, reference, known files, which of them is met)
CASES = [
    ("/w/app/main.ts", "react", [], None),
    ("/w/app/main.ts", "fs:promises", ["/w/app/fs:promises"], None),
    ("/w/app/main.ts", "./parts/menu", ["/w/app/parts/menu.ts"], 0),
    ("/w/app/parts/menu.ts", "../theme", ["/w/app/theme.ts"], 0),
    ("/w/app/main.ts", "./shop", ["/w/app/shop/index.ts"], 0),
    ("/w/app/main.ts", "./shop", ["/w/app/shop/index.py", "/w/app/shop/index.cjs", "/w/app/shop/index.mjs"], 2),
    ("/w/app/main.ts", "./shop", ["/w/app/shop/index.ts", "/w/app/shop.py"], 1),
    ("/w/app/main.ts", "./view", ["/w/app/view.tsx"], 0),
    ("/w/app/main.ts", "./view", ["/w/app/view.py", "/w/app/view.cjs", "/w/app/view.js"], 2),
    ("/w/app/main.ts", "./view.tsx", ["/w/app/view.tsx"], 0),
    ("/w/app/main.ts", "./view", ["/w/app/view", "/w/app/view.ts"], 0),
    ("/w/app/main.ts", "./../boot", ["/w/boot.ts"], 0),
    ("/w/api/urls.py", ".handlers", ["/w/api/handlers.py"], 0),
    ("/w/api/urls.py", ".db.tables", ["/w/api/db/tables.py"], 0),
    ("/w/api/urls.py", "..conf", ["/w/conf.py"], 0),
    ("/w/api/v1/urls.py", "...conf", ["/w/conf.py"], 0),
    ("/w/api/v1/urls.py", "..", ["/w/api/__init__.py"], 0),
    ("/w/api/v1/urls.py", "..", [], None),
    ("/w/app/main.ts", "./missing", ["/w/app/present.ts"], None),
    ("/w/app/parts/menu.ts", "../theme.ts", ["/w/app/theme.ts"], None),
    ("/w/app/parts/menu.ts", "../../boot", ["/w/boot.ts", "/w/app/boot.ts"], 1),
    ("/w/app/main.ts", "../", ["/w/index.ts"], 0),
    ("/w/app/main.ts", "../", ["/w.ts"], None),
    ("/w/app/main.ts", "./view.js", ["/w/app/view.ts"], None),
    ("/w/app/tool.py", ".", ["/w/app/__init__.py"], None),
    ("/w/app/tool.py", ".sub", ["/w/app/sub/__init__.py"], None),
    ("/w/app/tool.py", ".sub", ["/w/app/sub.py", "/w/app/sub.ts"], 1),
    ("/top.ts", "./next", ["/next.ts"], 0),
    ("/top.ts", "./", ["/index.ts"], 0),
]


def resolved(spark, cases, how):
    """Each case in a tree of its own, below a numbered folder."""
    nodes, files = [], []
    for i, (path, ref, known, _) in enumerate(cases):
        nodes.append((f"{i}", ref, "import", f"/t{i}{path}"))
        files += [(f"/t{i}{k}",) for k in [path, *known]]
    got = resolve(spark.createDataFrame(nodes, "id string, name string, kind string, file_path string"), spark.createDataFrame(files, "file_path string"), how).collect()
    return {int(r["id"]): r["dst"] for r in got}


def test_resolution(spark):
    got = resolved(spark, CASES, "compat")
    for i, (_, ref, known, want) in enumerate(CASES):
        assert got.get(i) == (None if want is None else f"/t{i}{known[want]}"), (i, ref)


def test_strict_resolution(spark):
    cases = [
        ("/p/src/utils/a.ts", "../b.ts", ["/p/src/b.ts"], 0),
        ("/p/src/utils/a.ts", "../../x", ["/p/src/x.ts", "/p/x.ts"], 1),
        ("/p/src/a.ts", "./x.js", ["/p/src/x.ts"], 0),
        ("/p/src/a.py", ".", ["/p/src/__init__.py"], 0),
        ("/p/src/a.py", ".pkg", ["/p/src/pkg/__init__.py"], 0),
        ("/p/src/a.py", "..core", ["/p/core.py"], 0),
        ("/p/src/a.ts", "lodash", ["/p/src/lodash.ts"], None),
        ("/p/src/a.ts", "./x.js", ["/p/src/x.ts", "/p/src/x.js"], 1),
        ("/p/src/a.ts", "./x.js", ["/p/src/x.tsx", "/p/src/x.ts", "/p/src/x.js/index.py"], 2),
        ("/p/src/a.ts", "./x.mjs", ["/p/src/x.py"], None),
    ]
    got = resolved(spark, cases, "strict")
    assert {i: (f"/t{i}{k[w]}" if w is not None else None) for i, (_, _, k, w) in enumerate(cases)} == {i: got.get(i) for i in range(len(cases))}


def test_stems_are_made_once_and_edges_dealt_out_once(spark):
    """Neither a filter nor a second use makes them again, and what is told apart by file is shuffled by file alone."""
    nodes = spark.createDataFrame([("/r/a.py:.b:1", ".b", "import", "/r/a.py")], "id string, name string, kind string, file_path string")
    files = spark.createDataFrame([("/r/a.py",), ("/r/b.py",)], "file_path string")
    edges = graph.build_edges(nodes, files)
    plans = edges._jdf.queryExecution()
    assert plans.optimizedPlan().toString().count(r"^\.\w)") == 1
    assert len(re.findall(r"Exchange hashpartitioning\((?:id|src|file_path|name)#", plans.executedPlan().toString())) == 1
    assert [tuple(r) for r in edges.collect()] == [("/r/a.py", "/r/b.py")]


def test_normal_paths(spark):
    odd = ["/", "//", "/a", "/a/", "/a//b", "/a/./b", "/a/.", "/a/..", "/a/../b", "/../a", "/..a/.b/c..", "/a/...", "a/b", "a", "", "/a/b/", "/.", "/a\n", "/a/..\n", "/a\n/../b"]
    got = spark.createDataFrame([(p,) for p in [*odd, None]], "p string").select("p", normal(F.col("p")).alias("n"), normal(F.col("p"), keep_slash=True).alias("k")).collect()

    def plain(p):
        parts = []
        for x in p.split("/"):
            parts = parts[:-1] if x == ".." else parts if x in ("", ".") else [*parts, x]
        return "/" + "/".join(parts)

    assert {r["p"]: r["n"] for r in got} == {p: plain(p) for p in odd} | {None: None}
    assert {r["p"]: r["k"] for r in got} == {p: plain(p) + "/" * (p.endswith("/") and plain(p) != "/") for p in odd} | {None: None}


def test_edges_are_distinct_and_degrees_count(spark):
    nodes = spark.createDataFrame([("1", "./b", "import", "/p/a.ts"), ("2", "./b", "export", "/p/a.ts"), ("3", "./b", "function", "/p/a.ts"), ("4", "./a", "import", "/p/a.ts")], "id string, name string, kind string, file_path string")
    files = vertices(spark, ["/p/a.ts", "/p/b.ts"])
    e = graph.build_edges(nodes, files)
    assert {tuple(r) for r in e.collect()} == {("/p/a.ts", "/p/b.ts"), ("/p/a.ts", "/p/a.ts")}
    assert [tuple(r) for r in graph.out_degree(e).collect()] == [("/p/a.ts", 2)]
    assert {tuple(r) for r in graph.in_degree(e).collect()} == {("/p/a.ts", 1), ("/p/b.ts", 1)}
    assert [r[0] for r in graph.dangling(files, e).collect()] == ["/p/b.ts"]
    row = graph.counts(files, nodes, e).first()
    assert (row["files"], row["edges"], row["nodes"], row["definitions"]) == (2, 2, 4, 1)


GRAPHS = [
    ("ab", "", {}, None, None),
    ("a", "", {"a": 1.0}, None, 1),
    ("abc", "ab bc", {"a": 0.184417, "b": 0.341171, "c": 0.474412}, None, 20),
    ("abcdx", "ax bx cx dx", {"x": 0.523809, "a": 0.119048}, None, 38),
    ("abcd", "ab bc cd da", dict.fromkeys("abcd", 0.25), None, 1),
    ("abcde", "ab bc cd ec", {"a": 0.089432, "b": 0.165450, "c": 0.306083, "d": 0.349602, "e": 0.089432}, None, 25),
    ("abcde", "ab bc cd ec", {"a": 0.313812, "b": 0.266740, "c": 0.226729, "d": 0.192720, "e": 0.0}, {"a": 10.0}, 82),
    ("abcde", "ab bc cd ec", {"d": 1.0, "a": 0.0}, {"d": 1.0}, 4),
    ("abcde", "ab bc cd ec", {"a": 0.311298, "b": 0.264604, "c": 0.227559, "d": 0.193425, "e": 0.003113}, {"a": 100.0, "e": 1.0}, None),
    ("abcde", "ab bc cd ec", {"a": 0.089432, "d": 0.349602}, {"unknown": 5.0, "b": 0.0}, 25),
]


@pytest.mark.parametrize("case", GRAPHS)
def test_pagerank(spark, case):
    names, pairs, want, weights, iterations = case
    made = rank.pagerank(vertices(spark, names), edge_table(spark, [tuple(p) for p in pairs.split()]), personalization=weights)
    got = {r["file_path"]: r["score"] for r in made.scores.collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and made.converged
    for k, v in want.items():
        assert abs(got[k] - v) < 2e-6, k
    if iterations:
        assert made.iterations == iterations


def test_empty_graph(spark):
    made = rank.pagerank(vertices(spark, "a").limit(0), edge_table(spark, [("a", "b")]))
    assert made.scores.count() == 0 and made.iterations == 0 and made.converged


def plain_pagerank(names, pairs, weights, rounds, tolerance):
    at = {n: i for i, n in enumerate(names)}
    known = [(at[a], at[b]) for a, b in pairs if a in at and b in at]
    out = np.bincount([a for a, _ in known], minlength=len(names))
    given = np.array([(weights or {}).get(n, 0.0) for n in names])
    t = given / given.sum() if given.sum() > 0 else np.full(len(names), 1 / len(names))
    score = np.full(len(names), 1 / len(names))
    for done in range(1, rounds + 1):  # noqa: B007
        new = (0.85 * score[out == 0].sum() + 0.15) * t
        for a, b in known:
            new[b] += 0.85 * score[a] / out[a]
        moved, score = np.abs(new - score).sum(), new
        if moved < tolerance:
            return dict(zip(names, score, strict=True)), done, True
    return dict(zip(names, score, strict=True)), done, False


@pytest.mark.parametrize(("weights", "most"), [(None, 100_000), ({"v3": 2.0, "v5": 1.0}, 2)])
def test_rounds_are_the_plain_ones(spark, monkeypatch, weights, most):
    """Also where a file's edges lie in several parts."""
    monkeypatch.setattr(rank, "PART_EDGES", most)
    rng = np.random.default_rng(8)
    names = [f"v{i}" for i in range(30)]
    pairs = sorted({(names[a], names[b]) for a, b in rng.integers(0, 30, (50, 2))} | {("v1", n) for n in names[5:25]} | {("v1", "elsewhere")})
    made = rank.pagerank(vertices(spark, names), edge_table(spark, [*pairs, pairs[0]]), personalization=weights, rounds=12, tolerance=1e-3)
    want, rounds, converged = plain_pagerank(names, pairs, weights, 12, 1e-3)
    got = {r["file_path"]: r["score"] for r in made.scores.collect()}
    assert (made.iterations, made.converged) == (rounds, converged)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_round_shuffles_no_edges(spark):
    """Two exchanges: what files give and what they get. Edges and scores are read in their buckets."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = edge_table(spark, [("a", "b"), ("b", "a")])
    flows = rank.dealt_edges(edges, spark.sql("select 'a' src, 1 parts union all select 'b', 1"), n)
    state = materialize_bucketed(spark.sql("select 'a' file_path, 1.0D t, 1L k, 1 parts, 0.5D score, 0.5D old").repartition(n, "file_path"), "rank", n, "file_path")
    plan = rank.one_round(state, flows, 0.85, 0.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 == plan.count("Exchange ")
    assert "Exchange hashpartitioning(dst" in plan and plan.count("Bucketed: true") == 3
    above = plan[: plan.index("weftmap_flows")]
    assert "Exchange" not in above[above.rindex("ShuffledHashJoin") :]


def test_impact(spark):
    e = edge_table(spark, [("a", "b"), ("b", "c"), ("d", "c"), ("c", "a"), ("x", "y"), ("s", "s"), ("t", "s")])
    reach = lambda p: {r["file_path"]: r["depth"] for r in impact(e, p).collect()}
    assert reach("c") == {"c": 0, "b": 1, "d": 1, "a": 2}
    assert reach("y") == {"y": 0, "x": 1} and reach("x") == {"x": 0} and reach("unknown") == {"unknown": 0}
    assert reach("s") == {"s": 0, "t": 1}
    scores = spark.createDataFrame([("b", 0.2), ("a", 0.2), ("c", 0.6)], "file_path string, score double")
    assert [r["file_path"] for r in ranked(impact(e, "c"), scores).collect()] == ["c", "b", "a", "d"]


def test_breadth_first_order(spark):
    """A file is placed by the first that found it, then by path, not by path alone."""
    pairs = [("z", "r"), ("y", "r"), ("a", "z"), ("q", "y"), ("p", "z"), ("q", "z"), ("b", "y"), ("z", "q"), ("k", "a"), ("j", "q"), ("l", "b"), ("j", "b")]
    got = [r["file_path"] for r in impact(edge_table(spark, pairs), "r").orderBy("depth", "place").collect()]
    queue, seen = ["r"], {"r"}
    for at in queue:
        for a in sorted(a for a, b in pairs if b == at):
            if a not in seen:
                seen.add(a), queue.append(a)
    assert got == queue == ["r", "y", "z", "b", "q", "a", "p", "j", "l", "k"]
    ties = spark.createDataFrame([(x, 0.1) for x in "abpq"], "file_path string, score double")
    assert [r["file_path"] for r in ranked(impact(edge_table(spark, pairs), "r"), ties).collect()][:4] == ["b", "q", "a", "p"]


def test_trigram_search_is_the_scan(spark):
    names = ["loadItem", "LOAD", "oadl", "ab", "", None, "aaaa", "aaa", "Straße", "İstanbul", "x😀yz", "load load", "itemload", "daol"]
    rows = [(f"/p{i % 3}:{i}", n, "function" if i % 2 else "class", f"/p{i % 3}", i, i, [], 0) for i, n in enumerate(names)]
    nodes = spark.createDataFrame(rows, "id string, name string, kind string, file_path string, start_line int, end_line int, references array<string>, seq int")
    index = trigrams.build(nodes, 4)
    told = lambda df: [tuple(r) for r in df.drop("references").collect()]
    for text in ("load", "LOAD", "oad", "aaa", "aaaaa", "a", "", "ab", "item", "dload", "ß", "straße", "😀yz", "adl", "none at all", "d l"):
        for kind in (None, "class", "none"):
            assert told(index.search(text, kind)) == told(search(nodes, text, kind)), (text, kind)
    assert {r["name"] for r in index.candidates("adload").collect()} == set() and {r["name"] for r in index.candidates("load").collect()} == {"loadItem", "LOAD", "load load", "itemload"}
    plan = index.search("loa")._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 4" in plan and "In(gram" in plan or "EqualTo(gram" in plan


def test_long_chain(spark):
    e = edge_table(spark, [(f"n{i + 1:02}", f"n{i:02}") for i in range(20)])
    assert impact(e, "n00").count() == 21
    assert impact(e, "n20", reverse=False).count() == 21


def bfs(pairs, start):
    near = {}
    for a, b in pairs:
        near.setdefault(b, []).append(a)
    depth, queue = {start: 0}, [start]
    for at in queue:
        for a in near.get(at, []):
            if a not in depth:
                depth[a] = depth[at] + 1
                queue.append(a)
    return depth


def test_depths(spark):
    """Runs, cycles of files with one way in, arcs that shorten a long run, and random graphs; after 0 or 2 plain levels."""
    told = lambda df: {r["file_path"]: r["depth"] for r in df.collect()}
    run = [(f"n{i + 1}", f"n{i}") for i in range(20)]
    ring = [("u", "v"), ("v", "w"), ("w", "u"), ("hung", "u")]
    rng = random.Random(5)
    some = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(75)]
    for pairs in ([*run, *ring], [*run, ("n15", "n2"), ("m", "n20"), ("m", "n4"), ("k", "m"), ("n0", "n20")], [*run, *run, ("n0", "n0")], some, [], [("n1", "n0"), ("n0", "n1")]):
        for levels in (0, 2):
            assert told(depths(edge_table(spark, pairs), "n0", levels=levels)) == bfs(pairs, "n0"), (pairs, levels)
    assert told(depths(edge_table(spark, [(b, a) for a, b in some]), "n0", reverse=False, levels=1)) == bfs(some, "n0")
    assert told(depths(edge_table(spark, ring), "unknown", levels=1)) == {"unknown": 0}


def test_deep_chain_in_few_rounds(spark, monkeypatch):
    """3,000 files, one behind the other, with a branch at the end."""
    written = []
    monkeypatch.setattr(closure, "materialize", lambda df, label, make=closure.materialize: (written.append(label), make(df, label))[1])
    pairs = [(f"n{i + 1}", f"n{i}") for i in range(3000)] + [("far", "n2999"), ("n1", "far")]
    got = {r["file_path"]: r["depth"] for r in depths(edge_table(spark, pairs), "n0").collect()}
    assert got == bfs(pairs, "n0") and got["n3000"] == 3000
    rounds = [x for x in written if x in ("frontier", "runs", "nearer")]
    assert len(rounds) < 22 and "frontier" in rounds and "runs" in rounds


def test_dependencies(spark):
    e = edge_table(spark, [("a", "b"), ("b", "c"), ("d", "b")])
    names = lambda df: {r["file_path"] for r in df.collect()}
    assert names(graph.forward_deps(e, "a")) == {"b"} and names(graph.reverse_deps(e, "b")) == {"a", "d"} and names(graph.forward_deps(e, "zz")) == set()


def test_rounds_leave_one_table_of_ranks(spark):
    """Each round's table goes once the next is written."""
    folder = Path(shared_dir(spark).removeprefix("file://")) / "weftmap"
    before = set(folder.glob("rank-*"))
    got = rank.pagerank(vertices(spark, "abc"), edge_table(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")]), rounds=5, tolerance=0)
    assert got.iterations == 5 and abs(sum(r["score"] for r in got.scores.collect()) - 1) < 1e-9
    assert len(set(folder.glob("rank-*")) - before) == 1


def test_rounds_are_over_numbers(spark):
    """The tables of edges and of scores hold numbers; paths lie in the table of names alone."""
    folder = Path(shared_dir(spark).removeprefix("file://")) / "weftmap"
    before = set(folder.iterdir()) if folder.exists() else set()
    made = rank.pagerank(vertices(spark, "abc"), edge_table(spark, [("a", "b"), ("b", "c"), ("a", "b"), ("a", "x")]), rounds=2, tolerance=0)
    new = {p.name.split("-")[0]: p for p in set(folder.iterdir()) - before}
    for table, key in (("edges", "src"), ("edges", "dst"), ("rank", "file_path")):
        assert dict(spark.read.parquet(str(new[table])).dtypes)[key] == "bigint"
    assert spark.read.parquet(str(new["edges"])).count() == 2 and {r["file_path"] for r in made.scores.collect()} == set("abc")


def test_a_round_shuffles_a_number_for_a_file_and_block(spark, monkeypatch):
    """400 files with 20,000 edges: a round deals out rows of blocks, not of edges, and blocks' edges stay in their buckets."""
    rounds = []
    monkeypatch.setattr(rank, "packed_round", lambda *a, make=rank.packed_round: (rounds.append(make(*a)), rounds[-1])[1], raising=False)
    rng = np.random.default_rng(3)
    names = [f"v{i}" for i in range(400)]
    pairs = sorted({(names[a], names[b]) for a, b in rng.integers(0, 400, (20_000, 2))})
    made = rank.pagerank(vertices(spark, names), edge_table(spark, pairs), rounds=2, tolerance=0)
    got = {r["file_path"]: r["score"] for r in made.scores.collect()}
    want = plain_pagerank(names, pairs, None, 2, 0)[0]
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    plan = rounds[-1]._jdf.queryExecution().executedPlan().toString()
    # the scores of the blocks, for each of their two uses, and what they give
    assert len(rounds) == 2 and plan.count("Exchange hashpartitioning(block") == 2 and plan.count("Exchange hashpartitioning(to") == 1 and plan.count("Exchange ") == 3
    assert plan.count("Bucketed: true") == 2


@pytest.mark.parametrize("most", [0, 10**9])
def test_blocks_and_rows_give_the_same(spark, monkeypatch, most):
    """A block with too many edges makes the rounds go over rows; a dangling file, one without edges and one to itself."""
    monkeypatch.setattr(rank, "BLOCK_EDGES", most, raising=False)
    monkeypatch.setattr(rank, "BLOCK_FILES", 1, raising=False)
    names = [f"v{i}" for i in range(40)] + ["alone"]
    pairs = sorted({(f"v{i}", "v0") for i in range(30)} | {("v0", f"v{i}") for i in range(0, 40, 3)})
    made = rank.pagerank(vertices(spark, names), edge_table(spark, pairs), personalization={"alone": 3.0, "v1": 1.0}, rounds=7, tolerance=0)
    want = plain_pagerank(names, pairs, {"alone": 3.0, "v1": 1.0}, 7, 0)[0]
    got = {r["file_path"]: r["score"] for r in made.scores.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
