"""From files on disk to answers: discovery, cache, index, commands, server, stream."""

import io
import json
import os
import time

import pytest
from pyspark.sql import functions as F

import weftmap
from weftmap import cli
from weftmap.errors import DiscoveryError, ParseError, WeftError, log
from weftmap.plans import queries as q
from weftmap.plans.index import build_index, search
from weftmap.serve import TOOLS, Server, serve
from weftmap.sources import cache
from weftmap.sources.discover import discover
from weftmap.sources.files import parse_files, parse_sources, spread
from weftmap.sources.ignore import Ignore
from weftmap.sources.tree import LISTED, Walk, remove_files, scan, write_tree

FILES = {
    "shop.ts": "import { Basket } from './model';\nimport { net } from './price';\n\n/** All that is paid. */\nexport async function total(basket: Basket) {\n  let sum = 0;\n  for (const item of basket.items) sum += net(item);\n  return sum;\n}\n",
    "model.ts": "export enum Tax { Low, High }\n\nexport class Item {\n  price = 0;\n  tax = Tax.Low;\n}\n\nexport interface Basket {\n  items: Item[];\n}\n",
    "price.ts": "import { Item, Tax } from './model';\n\nexport const RATE_HIGH = 19;\nexport const net = (item: Item) => item.price;\n",
    "package.json": '{"dependencies": {"lodash": "1"}, "devDependencies": {"vitest": "2"}}',
    "README.md": "text",
}


def put(root, files):
    for name, source in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(source)


@pytest.fixture
def project(tmp_path):
    put(tmp_path, FILES)
    return str(tmp_path)


def names(root, *extra):
    return [os.path.relpath(p, root) for p in discover(str(root), extra)]


def test_discovery(tmp_path):
    put(tmp_path, dict.fromkeys(["a.ts", "b.tsx", "c.js", "d.mjs", "e.cjs", "f.py", "g.json", "h.md", "__init__.py", "B.ts", "i.jsx", "node_modules/x.ts", "src/dist/y.ts", "venv/z.py", ".hidden/a.ts", ".dot.ts", "x.min.js", "t.d.ts", "y.bundle.js", "src/gen.generated.ts", "src/important.generated.ts", "src/deep/skip.ts"], ""))
    put(tmp_path, {".gitignore": "# comment\n\n*.generated.ts\n!src/important.generated.ts\n!dist/\n", ".weftignore": "src/deep/\n"})
    os.symlink(tmp_path / "src", tmp_path / "link")
    assert names(tmp_path) == ["B.ts", "__init__.py", "a.ts", "b.tsx", "c.js", "d.mjs", "e.cjs", "f.py", "src/important.generated.ts"]
    assert "f.py" not in names(tmp_path, "*.py") and "src/important.generated.ts" in names(tmp_path, "*.generated.ts")
    with pytest.raises(DiscoveryError) as e:
        discover(str(tmp_path / "missing"))
    assert "does not exist" in e.value.message and e.value.hint and e.value.code == "DISCOVERY_ERROR"


@pytest.mark.parametrize(("rules", "path", "ignored"), [("*.log", "a/b.log", True), ("/a.ts", "b/a.ts", False), ("/a.ts", "a.ts", True), ("b/", "a/b/c.ts", True), ("b/", "a/b", False), ("a/**/z.ts", "a/z.ts", True), ("a/**/z.ts", "a/x/y/z.ts", True), ("**/t.ts", "t.ts", True), ("a/*", "a/b/c.ts", True), ("?.ts", "ab.ts", False), ("[ab].ts", "b.ts", True), ("[!ab].ts", "b.ts", False), ("*.ts\n!k.ts", "k.ts", False), ("d/\n!d/k.ts", "d/k.ts", True), ("\\!x", "!x", True), ("abc", "abcd", False)])
def test_ignore_rules(rules, path, ignored):
    assert Ignore().add(rules).ignores(path) is ignored


def test_parse(spark, project):
    rows = {os.path.basename(r["file_path"]): r for r in parse_files(spark, discover(project)).collect()}
    assert {k: len(r["nodes"]) for k, r in rows.items()} == {"shop.ts": 3, "model.ts": 3, "price.ts": 3}
    assert all(r["parse_time_ms"] >= 0 for r in rows.values())
    with pytest.raises(Exception, match="Failed to read"):
        parse_files(spark, [project + "/gone.ts"]).collect()
    assert issubclass(ParseError, WeftError)
    got = parse_sources(spark.createDataFrame([("/x.rs", "fn"), ("/y.py", None), ("/z.py", "def f(): pass")], "file_path string, source string")).collect()
    assert [len(r["nodes"]) for r in got] == [0, 0, 1]


def test_answers(spark, project):
    index = build_index(spark, project)
    assert {(os.path.basename(r["src"]), os.path.basename(r["dst"])) for r in index.edges.collect()} == {("shop.ts", "model.ts"), ("shop.ts", "price.ts"), ("price.ts", "model.ts")}
    scores = {os.path.basename(r["file_path"]): r["score"] for r in index.scores.collect()}
    assert abs(scores["model.ts"] - 0.520869) < 2e-6 and abs(scores["price.ts"] - 0.281551) < 2e-6 and abs(scores["shop.ts"] - 0.197580) < 2e-6
    assert index.ranked.iterations == 13
    assert q.map_text(index) == "model.ts [score: 0.5209]\n  enum Tax (L1)\n  class Item (L3)\n  interface Basket (L8)\nprice.ts [score: 0.2816]\n  constant RATE_HIGH (L3)\n  function net (L4)\nshop.ts [score: 0.1976]\n  function total (L5)\n[~67 tokens]"
    assert q.search_text(index, "TOT") == "1 match\n\nfunction total in shop.ts:L5" and q.search_text(index, "none at all") == "0 matches"
    assert q.search_text(index, "./model").startswith("2 matches\n\nimport ./model in price.ts:L1")
    assert search(index.nodes, "", "interface").count() == 1 and search(index.nodes, "", "nothing").count() == 0
    assert q.impact_text(index, project + "/model.ts").split("\n")[0] == "3 files affected"
    assert q.impact_text(index, project + "/shop.ts") == "1 file affected\n\nshop.ts [score: 0.1976]"
    assert q.impact_text(index, project + "/no.ts") == "1 file affected\n\nno.ts [score: 0.0000]"
    assert q.summary_text(index) == "## Project Stats\n  Files: 3\n  Definitions: 9\n  Edges: 3\n\n## Key Files\n  model.ts [score: 0.5209]\n  price.ts [score: 0.2816]\n  shop.ts [score: 0.1976]\n\n## Tech Stack\n  lodash\n  vitest"
    assert "  Definitions: 6\n  Edges:       3\n  Cache:       " in q.stats_text(index)
    assert json.loads(q.json_text(index))["metadata"]["edgeCount"] == 3
    focused = build_index(spark, project, focus="shop.ts")
    assert focused.ranked.iterations == 28
    index.views()
    assert spark.sql("SELECT count(*) FROM edges JOIN scores ON dst = file_path").first()[0] == 3


def test_packages(tmp_path):
    assert q.packages(str(tmp_path)) is None
    put(tmp_path, {"package.json": "{}"})
    assert q.packages(str(tmp_path)) == []
    put(tmp_path, {"package.json": "not json"})
    assert q.packages(str(tmp_path)) is None


def statuses(spark, root):
    rows = cache.compare(scan(spark, root), cache.snapshot(spark, root, cache.read(root))).collect()
    return {r["relative"]: r["status"] for r in rows}


def test_cache(spark, project, monkeypatch):
    assert cache.read(project) is None and q.cache_age(project) == "No cache"
    assert statuses(spark, project) == dict.fromkeys(["shop.ts", "model.ts", "price.ts"], "added")
    first = build_index(spark, project)
    want = sorted(map(tuple, first.nodes.drop("references").collect()))
    assert set(statuses(spark, project).values()) == {"kept"} and q.cache_age(project).endswith("ago")
    import weftmap.plans.index as plans

    parsed = []
    real = plans.parse_files
    monkeypatch.setattr(plans, "parse_files", lambda s, t: parsed.append(sorted(r["relative"] for r in t.collect())) or real(s, t))
    again = build_index(spark, project)
    assert not parsed and sorted(map(tuple, again.nodes.drop("references").collect())) == want
    time.sleep(0.01)
    put(project, {"price.ts": FILES["price.ts"] + "export function more() {}\n", "new.py": "X_Y = 1\n"})
    os.remove(project + "/shop.ts")
    assert statuses(spark, project) == {"shop.ts": "removed", "price.ts": "changed", "new.py": "added", "model.ts": "kept"}
    partly = build_index(spark, project, incremental=True)
    assert parsed == [["new.py", "price.ts"]] and partly.files.count() == 3
    assert {r["id"] for r in partly.nodes.where("file_path like '%price.ts'").collect()} >= {f"{project}/price.ts:more:5"}
    assert set(statuses(spark, project).values()) == {"kept"} and cache.read(project)["snapshot"] == 2
    put(project, {"new.py": "X_Z = 11\n"})
    whole = build_index(spark, project)
    assert parsed[1:] == [["model.ts", "new.py", "price.ts"]] and whole.files.count() == 3
    assert sorted(os.listdir(os.path.join(project, cache.FOLDER)))[-2:] == ["snapshot-2", "snapshot-3"]
    assert {r["name"] for r in partly.nodes.where("file_path like '%new.py'").collect()} == {"X_Y"}, "an index made before reads its own snapshot"
    cache.clear(project)
    assert cache.read(project) is None


def test_broken_manifests(spark, project):
    build_index(spark, project)
    manifest = os.path.join(project, cache.FOLDER, "manifest.json")
    for broken in ("{", "[]", '{"version": "x"}', '{"no": 1}'):
        put(project, {f"{cache.FOLDER}/manifest.json": broken})
        assert cache.read(project) is None
    for other in ('{"version": 99, "snapshot": 1}', '{"version": 1}'):
        put(project, {f"{cache.FOLDER}/manifest.json": other})
        assert cache.snapshot(spark, project, cache.read(project)).count() == 0
        assert build_index(spark, project).nodes.count() == 9
    os.remove(manifest)
    os.mkdir(manifest)
    with pytest.raises(OSError):
        cache.read(project)


def test_scan_is_what_discovery_finds(spark, tmp_path):
    """In few partitions and in many; contents, sizes and times; a tree named by a URI."""
    files = {f"{a}/{b}/_f{n}.py": f"X{n} = '{a}'\n" for a in "abc" for b in ("p", "__q", "dist", ".h") for n in range(3)}
    put(tmp_path, files | {"__init__.py": "", "top.ts": "é\n", ".gitignore": "b/\n*2.py\n", "c/skip/x.ts": "", "c/skip/deep/y.ts": ""})
    os.symlink(tmp_path / "a", tmp_path / "link")
    want = discover(str(tmp_path), ("c/skip/",))
    assert [os.path.relpath(p, tmp_path) for p in want] == ["__init__.py", *[f"{a}/{b}/_f{n}.py" for a in "ac" for b in ("__q", "p") for n in (0, 1)], "top.ts"]
    for n in (1, 3, 50):
        rows = scan(spark, str(tmp_path), ["c/skip/"], content=True, partitions=n).collect()
        assert sorted(r["file_path"] for r in rows) == want
        for r in rows:
            s = os.stat(r["file_path"])
            assert (r["size"], r["mtime_ms"]) == (s.st_size, s.st_mtime_ns / 1e6) and r["source"] == open(r["file_path"], encoding="utf-8").read()
    assert scan(spark, str(tmp_path), partitions=50).rdd.getNumPartitions() > 3
    uri = f"file://{tmp_path}"
    assert sorted(r["file_path"] for r in scan(spark, uri, ["c/skip/"]).collect()) == [f"file://{p}" for p in want]
    index = build_index(spark, uri, focus="top.ts")
    assert index.nodes.where("file_path like 'file:///%/a/p/%'").count() == 2 and cache.read(uri)["snapshot"] == 1
    assert q.inside(uri, "a/../top.ts") == uri + "/top.ts" and q.inside(uri, "../x") is None and q.packages(uri) is None
    assert q.map_text(index).startswith("top.ts [score: ")
    assert scan(spark, str(tmp_path / "c" / "skip")).count() == 2


def test_the_planner_holds_no_files(tmp_path, monkeypatch):
    """A folder's files are dealt in shares that the tasks pick from its listing; so are folders, where a level has too many."""
    import pickle

    from weftmap.sources import tree

    put(tmp_path, {f"flat/p{n}.py": "" for n in range(3000)} | {f"deep/d{n}/e/x.ts": "" for n in range(30)} | {"top.js": "", "flat/.dot.py": "", "flat/dist/x.py": "", "flat/a.min.js": ""})
    os.symlink(tmp_path / "top.js", tmp_path / "deep" / "linked.js")
    for gone, to in (("loop.py", "loop.py"), ("nowhere.py", "none.py"), ("folder.py", tmp_path / "flat")):
        os.symlink(to, tmp_path / "deep" / gone)
    want = sorted([*[f"flat/p{n}.py" for n in range(3000)], *[f"deep/d{n}/e/x.ts" for n in range(30)], "deep/linked.js", "top.js"])
    walk = Walk(str(tmp_path))
    for most in (10_000, 20, 1):
        monkeypatch.setattr(tree, "PLANNED_FOLDERS", most)
        for parts in (1, 2, 8, 64):
            made = walk.plan(parts)
            found = [[r for share in part.dealt for r, _, _ in walk.below(share)] for part in made]
            assert sorted(r for own in found for r in own) == want and len(made) <= parts
            assert len(pickle.dumps(made)) < 12_000 and all(".py" not in share.folder for part in made for share in part.dealt)
            assert parts != 8 or most == 1 or max(map(len, found)) < 1000


def test_trees_are_written_and_taken_away(spark, tmp_path):
    root = str(tmp_path / "new")
    rows = spark.createDataFrame([("a/b.py", "x = 1\n"), ("_c.ts", None), ("d.py", "é")], "relative string, source string")
    assert write_tree(rows, root) == 3 and write_tree(rows.limit(0), root) == 0
    assert {r["relative"]: r["source"] for r in scan(spark, root, content=True).collect()} == {"a/b.py": "x = 1\n", "_c.ts": "", "d.py": "é"}
    assert remove_files(spark.createDataFrame([("d.py",), ("none.py",), ("a",)], "relative string"), root) == 1
    assert {r["relative"] for r in scan(spark, root).collect()} == {"a/b.py", "_c.ts"}


def test_a_small_table_is_written_and_removed_by_all_cores(spark, tmp_path, monkeypatch):
    """Rows that lie in one partition are dealt out, once each."""
    from weftmap.sources import tree

    met, real = [], tree.spread
    monkeypatch.setattr(tree, "spread", lambda rows, **how: met.append(real(rows, **how)) or met[-1])
    root = str(tmp_path / "new")
    rows = spark.range(500).coalesce(1).selectExpr("concat('p', id, '.py') relative", "'X = 1\n' source")
    assert write_tree(rows, root) == 500 and len(os.listdir(root)) == 500
    assert remove_files(rows.where("relative like '%0.py'"), root) == 50 and len(os.listdir(root)) == 450
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert [m.rdd.getNumPartitions() for m in met] == [cores, cores]


def test_parsing_is_dealt_over_all_cores(spark):
    """A small input in one partition; a number that is asked for; a large input stays as it is."""
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    one = spark.range(100).coalesce(1).selectExpr("concat('/f', id, '.py') file_path", "concat('X_', id, ' = 1') source")
    assert parse_sources(one).rdd.getNumPartitions() == cores and parse_sources(one, 3).rdd.getNumPartitions() == 3
    assert parse_sources(one).where("size(nodes) = 1").count() == 100
    large = spark.range(0, 10**9, 1, 5).selectExpr("cast(id as string) file_path", "'x' source")
    assert spread(large).rdd.getNumPartitions() == 5


def test_registered_languages_reach_the_executors(spark):
    from weftmap.functions import extract as languages

    handlers, known = languages.registered()
    languages.register(".row", "rows", lambda path, source: [{"name": x, "kind": "constant", "start_line": n, "end_line": n, "references": []} for n, x in enumerate(source.split(), 1)])
    try:
        got = parse_sources(spark.createDataFrame([("/a.row", "x y"), ("/b.py", "")], "file_path string, source string")).collect()
    finally:
        languages.HANDLERS.clear(), languages.LANGUAGES.clear()
        languages.HANDLERS.update(handlers), languages.LANGUAGES.update(known)
    assert {r["file_path"]: [n["id"] for n in r["nodes"]] for r in got} == {"/a.row": ["/a.row:x:1", "/a.row:y:2"], "/b.py": []}


def test_empty_project(spark, tmp_path):
    index = build_index(spark, str(tmp_path))
    assert q.map_text(index) == "[~0 tokens]" and "Files: 0" in q.summary_text(index)


def test_commands(spark, project, capsys):
    def run(*args):
        out = io.StringIO()
        return cli.main(["--root", project, *args], spark, out), out.getvalue()

    assert run("map", "--budget", "10") == (0, "[~0 tokens]\n")
    assert run("map")[1].startswith("model.ts [score: 0.5209]")
    assert run("search", "Basket", "--kind", "interface")[1] == 'Search results for "Basket"\n1 match\n\n  interface Basket in model.ts:L8\n\n'
    assert run("impact", "model.ts")[1].startswith("Impact analysis: model.ts\n3 affected files\n\n  model.ts [score: 0.5209]\n")
    assert run("stats")[1].startswith("Weftmap Stats\n\n  Files:       3\n")
    for bad in ("0", "-1", "x"):
        assert run("map", "--budget", bad) == (1, "")
    assert "Error: Invalid budget value\nHint: Provide a positive integer" in capsys.readouterr().err
    assert cli.main(["--root", project + "/none", "stats"], spark, io.StringIO()) == 1
    assert run("map", "--budget", "12abc") == run("map", "--budget", "12.9") == run("map", "--budget", "12") and q.checked_budget(" +7.5x") == 7
    focused = run("map", "--focus", "shop.ts")
    assert focused[0] == 0 and focused[1].startswith("shop.ts [score: ") and focused == run("map", "shop.ts")
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0 and capsys.readouterr().out.strip() == weftmap.__version__


def test_unreadable_file_is_a_parse_error(spark, project, monkeypatch, capsys):
    import weftmap.plans.index as plans

    real = plans.scan
    gone = spark.createDataFrame([(f"{project}/gone.ts", "gone.ts", 1, 1.0)], LISTED)
    monkeypatch.setattr(plans, "scan", lambda *a: real(*a).unionByName(gone))
    with pytest.raises(ParseError) as e:
        build_index(spark, project, use_cache=False)
    assert e.value.message == f"Failed to read {project}/gone.ts: No such file or directory" and e.value.hint and e.value.code == "PARSE_ERROR"
    assert cli.main(["--root", project, "stats"], spark, io.StringIO()) == 1
    assert "Error: Failed to read" in capsys.readouterr().err


def test_log_goes_to_stderr(capsys):
    log("info", "hello", {"a": 1})
    got = capsys.readouterr()
    assert got.out == "" and got.err == '[weftmap:info] hello {"a":1}\n'


def test_server(spark, project):
    requests = [
        {"id": 1, "method": "initialize"},
        {"method": "notifications/initialized"},
        {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "total"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "impact", "arguments": {"path": "../../etc/passwd"}}},
        {"id": 5, "method": "tools/call", "params": {"name": "map", "arguments": {"budget": 40000}}},
        {"id": 6, "method": "resources/read", "params": {"uri": "weftmap://file/model.ts"}},
        {"id": 7, "method": "tools/call", "params": {"name": "context", "arguments": {"path": "nope.ts"}}},
        {"id": 8, "method": "nothing"},
        {"id": 9, "method": "tools/call", "params": {"name": "search", "arguments": {}}},
        {"id": 10, "method": "resources/read", "params": {"uri": "weftmap://file/../x"}},
        {"id": 11, "method": "resources/read", "params": {"uri": "weftmap://map"}},
        {"id": 12, "method": "tools/call", "params": {"name": "summary"}},
    ]
    out = io.StringIO()
    serve(spark, project, ["not json\n", "\n", *[json.dumps(r) for r in requests]], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    by = {r["id"]: r for r in got}
    text = lambda i: by[i]["result"]["content"][0]["text"]
    assert by[None]["error"]["code"] == -32700 and len(got) == 13
    assert [t["name"] for t in by[2]["result"]["tools"]] == ["map", "context", "search", "impact", "summary"]
    assert text(3) == "1 match\n\nfunction total in shop.ts:L5"
    assert text(4) == q.OUTSIDE and by[4]["result"]["isError"]
    assert by[5]["error"]["code"] == by[9]["error"]["code"] == -32602 and by[8]["error"]["code"] == -32601
    assert by[6]["result"]["contents"][0]["text"].startswith("# model.ts [score: 0.5209]") and "(none)" in text(7)
    assert by[10]["result"]["contents"][0]["text"] == q.OUTSIDE
    assert by[11]["result"]["contents"][0]["mimeType"] == "text/plain" and "Definitions: 9" in text(12)


def test_server_survives_any_request(spark, project):
    def broken(spark, root, focus=None):
        if focus:
            raise DiscoveryError("no such place", "look elsewhere")
        raise RuntimeError("job aborted\nand more")

    server, out = Server(spark, project, broken), io.StringIO()
    call = lambda name, **given: server.answer({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": given}})
    assert call("summary")["result"] == {"content": [{"type": "text", "text": "Error: job aborted"}], "isError": True}
    assert call("map", query="shop.ts")["result"]["content"][0]["text"] == "Error: no such place\nHint: look elsewhere"
    assert server.answer({"id": 2, "method": "resources/read", "params": {"uri": "weftmap://map"}})["error"]["code"] == -32603
    for bad in ([], 3, "x", None, {"id": 4}, {"id": 5, "method": 7}):
        assert server.answer(bad)["error"]["code"] == -32600
    for bad in ([1], "x"):
        assert server.answer({"id": 6, "method": "ping", "params": bad})["error"]["code"] == -32602
        assert server.answer({"id": 6, "method": "tools/call", "params": {"name": "search", "arguments": bad}})["error"]["code"] == -32602
    serve(spark, project, ["[]\n", "{\n", '{"id": 9, "method": "ping"}\n'], out)
    assert [json.loads(x).get("error", {}).get("code") for x in out.getvalue().splitlines()] == [-32600, -32700, None]
    put(project, {"a b/c d.ts": "export const DEEP_DOWN = 1;\n"})
    got = Server(spark, project).resource("weftmap://file/a%20b/c%20d.ts")["contents"][0]["text"]
    assert got.startswith("# a b/c d.ts") and "constant DEEP_DOWN (L1)" in got


def test_server_keeps_the_index_of_an_unchanged_tree(spark, project):
    made = []
    server = Server(spark, project, lambda *a: made.append(a[2]) or build_index(*a))
    ask = lambda name, **given: server.call(name, given)["content"][0]["text"]
    assert "Definitions: 9" in ask("summary") and ask("search", query="total").startswith("1 match")
    assert made == [None]
    ask("map", query="shop.ts"), ask("map", query="shop.ts")
    assert made == [None, project + "/shop.ts"]
    put(project, {"more.py": "AB = 1\n"})
    assert "Definitions: 10" in ask("summary") and made == [None, project + "/shop.ts", None]


def test_tool_schemas_are_small():
    assert len(json.dumps(TOOLS)) < 4000 and all(len(json.dumps(t)) < 1500 for t in TOOLS)
    assert Server


def test_stream(spark, tmp_path):
    from weftmap.streaming.watch import current, keep_parsed

    schema = "file_path string, source string, version long"
    given, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    rounds = [[("/r/a.py", "from .b import f\n", 1), ("/r/b.py", "def f(): pass\n", 1), ("/r/c.py", "X_Y = 1\n", 1)], [("/r/b.py", "def g(): pass\ndef h(): pass\n", 2), ("/r/c.py", None, 2)]]
    for rows in rounds:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(given)
        keep_parsed(spark.readStream.schema(schema).parquet(given), table, checkpoint, once=True).awaitTermination()
    index = current(spark, table, "/r")
    assert {r["file_path"] for r in index.files.collect()} == {"/r/a.py", "/r/b.py"}
    assert {r["name"] for r in index.nodes.collect()} == {".b", "g", "h"} and index.edges.count() == 1


def test_stream_is_compacted(spark, tmp_path):
    """Many batches, a base now and then: the same index, few folders, and late old versions change nothing."""
    from weftmap.streaming import watch

    table = str(tmp_path / "table")
    kept = {}
    for n in range(9):
        rows = [("/r/a.py", f"A_{n} = 1\n", n), (f"/r/f{n}.py", "X_Y = 1\n", 0), *([("/r/f1.py", None, 5)] if n == 2 else []), *([("/r/f1.py", "OLD_ONE = 1\n", 3)] if n == 7 else [])]
        latest = spark.createDataFrame(rows, "file_path string, source string, version long")
        parsed = parse_sources(latest).join(latest.select("file_path", "version", F.col("source").isNull().alias("gone")), "file_path")
        parsed.write.mode("overwrite").parquet(f"{table}/batch={n}")
        kept |= {r[0]: r[1] for r in rows if not (n == 7 and r[0] == "/r/f1.py")}
        if n % 3 == 2:
            watch.compact(spark, table)
    assert sorted(os.listdir(table)) == ["batch=6", "batch=7", "batch=8"] and sorted(os.listdir(table + "-base")) == ["upto=5", "upto=8"]
    index = watch.current(spark, table, "/r")
    assert {r["file_path"] for r in index.files.collect()} == {k for k, v in kept.items() if v is not None}
    assert {r["name"] for r in index.nodes.collect()} == {"A_8", "X_Y"}
    os.remove(f"{table}-base/upto=8/_SUCCESS")
    assert watch.current(spark, table, "/r").files.count() == len(kept) - 1
    watch.compact(spark, str(tmp_path / "nothing"))
    assert watch.current(spark, str(tmp_path / "nothing"), "/r").files.count() == 0
