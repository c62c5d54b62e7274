"""Maps, contexts and the JSON document."""

import json
import math
import random
from decimal import ROUND_HALF_UP, Context, Decimal

import pytest
from pyspark.sql import functions as F

from weftmap.functions.paths import normal, relative
from weftmap.functions.text import age, fixed4, printed12, units
from weftmap.operators import render
from weftmap.operators.document import json_parts

ROOT = "/project"


def index(spark, data):
    files = spark.createDataFrame([(f"{ROOT}/{f}",) for f, _, _ in data], "file_path string")
    scores = spark.createDataFrame([(f"{ROOT}/{f}", float(s)) for f, s, _ in data if s is not None], "file_path string, score double")
    nodes = [(f"{ROOT}/{f}:{n}:{line}", n, k, f"{ROOT}/{f}", line, line, [], i) for f, _, defs in data for i, (k, n, line) in enumerate(defs)]
    return files, spark.createDataFrame(nodes, "id string, name string, kind string, file_path string, start_line int, end_line int, references array<string>, seq int"), scores


def text(spark, data, budget=2048):
    files, nodes, scores = index(spark, data)
    return render.render_map(files, nodes, scores, ROOT, budget).first()["text"]


THREE = [("lib/core.py", 0.42, [("class", "Engine", 3), ("method", "run", 9), ("import", "os", 1)]), ("lib/io.py", 0.31, [("function", "load_all", 4)]), ("main.py", 0.27, [("constant", "LIMIT", 2)])]


def plain(data, budget=2048):
    """The map by its rules: best first, whole blocks while they fit three characters a token, and a footer."""
    out, used = "", 0
    for f, s, defs in sorted(data, key=lambda x: (-x[1], x[0])):
        block = f"{f} [score: {s:.4f}]\n" + "".join(f"  {k} {n} (L{line})\n" for k, n, line in sorted(defs, key=lambda d: d[2]) if k not in ("import", "export"))
        if used + len(block) > budget * 3:
            break
        out, used = out + block, used + len(block)
    return f"{out}[~{-(-used // 3)} tokens]"


def test_maps_by_their_rules(spark):
    alone = [("main.py", 1, [("function", "start", 1), ("type", "Options", 8)])]
    for data, budget in ((THREE, 2048), (THREE, 25), (THREE, 10), (THREE, 1), (alone, 2048), ([], 2048), ([(f, s, []) for f, s, _ in reversed(THREE)], 2048)):
        assert text(spark, data, budget) == plain(data, budget)
    assert text(spark, THREE, 25) == "lib/core.py [score: 0.4200]\n  class Engine (L3)\n  method run (L9)\n[~22 tokens]"


def test_ties_missing_scores_and_cut_at_first_overflow(spark):
    data = [("b.ts", 0.2, []), ("a.ts", 0.2, []), ("z.ts", None, []), ("big.ts", 0.15, [("function", "f" * 300, 1)])]
    assert text(spark, data).split("\n")[:2] == ["a.ts [score: 0.2000]", "b.ts [score: 0.2000]"]
    assert text(spark, data, 60) == "a.ts [score: 0.2000]\nb.ts [score: 0.2000]\n[~14 tokens]"
    assert "z.ts [score: 0.0000]" in text(spark, data)


@pytest.mark.parametrize("budget", [30, 100, 1000, 4000])
def test_budget_is_kept(spark, budget):
    data = [(f"src/file{i}.ts", 1 / (i + 1), [("function", f"func{c}{i}", 10 * (k + 1)) for k, c in enumerate("ABC")]) for i in range(200)]
    out = text(spark, data, budget)
    body, footer = out.rsplit("\n", 1) if "\n" in out else ("", out)
    said = int(footer[2:].split()[0])
    assert said <= budget and said == math.ceil((len(body) + (1 if body else 0)) / 3)


def test_context(spark):
    files, nodes, scores = index(spark, THREE)
    edges = spark.createDataFrame([(f"{ROOT}/lib/core.py", f"{ROOT}/{x}.py") for x in ("main", "lib/io")], "src string, dst string")
    of = lambda p: render.context_text(f"{ROOT}/{p}", nodes, edges, scores, ROOT).first()["text"]
    assert of("lib/core.py") == "# lib/core.py [score: 0.4200]\n\n## Definitions\n  class Engine (L3)\n  method run (L9)\n\n## Dependencies\n  lib/io.py\n  main.py\n\n## Dependents\n(none)"
    assert of("lib/io.py").endswith("## Dependencies\n(none)\n\n## Dependents\n  lib/core.py")
    assert of("none.ts") == "# none.ts [score: 0.0000]\n\n## Definitions\n(none)\n\n## Dependencies\n(none)\n\n## Dependents\n(none)"


def test_json(spark):
    files, nodes, scores = index(spark, [*THREE, ("src/d.ts", None, []), ("src/e.ts", 0.00000525, [])])
    edges = spark.createDataFrame([(f"{ROOT}/lib/core.py", f"{ROOT}/lib/io.py")] * 2, "src string, dst string")
    out = render.render_json(files, nodes, edges, scores, ROOT)
    got = json.loads(out)
    assert [f["filePath"] for f in got["files"]] == ["lib/core.py", "lib/io.py", "main.py", "src/e.ts", "src/d.ts"] and got["files"][4]["definitions"] == []
    assert got["files"][0]["definitions"] == [{"name": "Engine", "kind": "class", "startLine": 3, "endLine": 3}, {"name": "run", "kind": "method", "startLine": 9, "endLine": 9}]
    n = got["metadata"].pop("tokenCount")
    assert got["metadata"] == {"fileCount": 5, "edgeCount": 1, "rootDir": ROOT}
    assert n == math.ceil((len(out) - len(str(n)) + 1) / 3)
    assert out.startswith('{\n  "metadata": {\n    "fileCount": 5,') and '"score": 0.00000525' in out and '"score": 0,' in out and '"definitions": []' in out


def test_paths_and_lengths(spark):
    cases = ["/project/src/a.ts", "/project", "/projects/x", "/", "/other/a", "/project/a"]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    assert [r[0] for r in df.select(relative(F.col("p"), ROOT)).collect()] == ["src/a.ts", "", "../projects/x", "..", "../other/a", "a"]
    forms = {"/a/./b/../c": "/a/c", "/../a//b/": "/a/b", "/": "/", "/a/..": "/"}
    got = spark.createDataFrame([(k,) for k in forms], "p string").select("p", normal(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in got} == forms
    assert spark.createDataFrame([("a😀é",)], "t string").select(units(F.col("t"))).first()[0] == 4


def test_ages():
    assert [age(s) for s in (0, 1, 59, 60, 119, 120, 3600, 7200, 86400, 200000)] == ["0 seconds ago", "1 seconds ago", "59 seconds ago", "1 minute ago", "1 minute ago", "2 minutes ago", "1 hour ago", "2 hours ago", "1 day ago", "2 days ago"]


def test_four_decimals_are_exact(spark):
    """Ties, near ties on both sides, signs, sizes up to those without decimals."""
    rng, context = random.Random(4), Context(prec=80)
    given = [0.0, -0.0, 1.00005, 0.00005, 1e-7, -1e-7, 0.03125, -0.03125, 0.09375, 0.99995, 0.99994999, 2.5, 123456789.12345, 4.5e11 + 0.00005, 9e15 - 1, 5e-324]
    given += [(2 * rng.randrange(10**rng.randrange(1, 9)) + 1) / 20_000 for _ in range(60_000)]
    given += [math.nextafter((2 * rng.randrange(20_000) + 1) / 20_000, rng.choice([0, 2])) for _ in range(20_000)]
    given += [rng.uniform(-2, 2) * 10 ** rng.randrange(-8, 10) for _ in range(20_000)]
    rows = spark.createDataFrame([(x,) for x in given], "x double").select("x", fixed4(F.col("x")).alias("text")).collect()
    for x, text in rows:
        want = str(abs(Decimal(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP, context))
        assert text == ("-" if x < 0 else "") + want, x
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e16,), (None,)], "x double").select(fixed4(F.col("x"))).collect()
    assert [r[0] for r in odd] == ["NaN", "Infinity", "10000000000000000.0000", None]


def test_document_in_parts_is_the_document(spark):
    """Byte for byte, with odd names and numbers, ties, files without definitions, one file and none."""
    data = [("b.ts", 0.5, [("class", 'Q"\\é😀', 3), ("function", "f", 3)]), ("a.ts", 0.5, []), ("c.py", 1e-7, [("constant", "K", 1)]), ("d/é.py", None, [("import", "./x", 1)]), ("e.py", 0.00002, []), *[(f"m{i}.py", 1.0 + i % 3, [("function", f"f{i}", i)]) for i in range(30)]]
    for own in (data, data[:1], []):
        files, nodes, scores = index(spark, own) if own else (x.limit(0) for x in index(spark, data))
        edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "src string, dst string")
        want = render.render_json(files, nodes, edges, scores, ROOT)
        rows = sorted(tuple(r) for r in json_parts(files.repartition(5), nodes, edges, scores, ROOT).collect())
        assert "".join(t for _, t in rows) == want
        at = 0
        for start, text in rows:
            assert start == at
            at += len(text.encode("utf-16-le")) // 2


def test_printed12_is_exact(spark):
    rng = random.Random(12)
    given = [rng.choice((1, -1)) * rng.random() * 10.0 ** rng.randint(-14, 15) for _ in range(4000)] + [k / 8192 + rng.randint(0, 60_000) for k in range(0, 400)]
    given += [57748.509905133928, 0.1234567890125, 0.9999999999996, 0.9999999999994, 5e-13, 5e-324, 2.0**53 - 1, 2.0**52 + 0.5, 0.0]
    rows = spark.createDataFrame([(x,) for x in given], "x double").select("x", printed12(F.col("x")).alias("text")).collect()
    assert [r["text"] for r in rows] == ["%.12f" % r["x"] for r in rows]
    odd = spark.createDataFrame([(float("nan"),), (float("-inf"),), (None,)], "x double").select(printed12(F.col("x"))).collect()
    assert [r[0] for r in odd] == ["NaN", "-Infinity", None]
