"""Answers as parts, and the column forms of requests, ages and manifests."""

import random

from pyspark.sql import functions as F

from weftmap.functions.paths import within
from weftmap.functions.text import age, ago, package_names
from weftmap.operators import parts, render
from weftmap.plans.index import search

NODE = "id string, name string, kind string, file_path string, start_line int, end_line int, references array<string>, seq int"


def tables(spark, n=60):
    """A hub that n files need, one that needs itself, one alone; names that aren't ASCII, repeated edges."""
    names = ["/r/hub.ts", "/r/é😀.ts", "/r/lone.py", *[f"/r/u{i}.py" for i in range(n)]]
    edges = [(f"/r/u{i}.py", "/r/hub.ts") for i in range(n)] * 2 + [("/r/hub.ts", "/r/é😀.ts"), ("/r/é😀.ts", "/r/é😀.ts")]
    nodes = [("a", "Hub", "class", "/r/hub.ts", 3, 9, [], 1), ("b", "hüb😀", "function", "/r/hub.ts", 3, 3, [], 0), ("c", "./é", "import", "/r/hub.ts", 1, 1, [], 2), ("d", "Hub", "class", "/r/u1.py", 3, 9, [], 0)]
    return spark.createDataFrame(nodes, NODE).repartition(3), spark.createDataFrame(edges, "src string, dst string").repartition(5), spark.createDataFrame([(x, 1.0 / (i + 1)) for i, x in enumerate(names)], "file_path string, score double")


def joined(df):
    """The parts as one text; each begins where the one before ends."""
    rows = sorted(tuple(r) for r in df.collect())
    at = 0
    for start, text in rows:
        assert start == at
        at += len(text.encode("utf-16-le")) // 2
    return "".join(t for _, t in rows), len(rows)


def test_context_parts_are_the_context(spark):
    nodes, edges, scores = tables(spark)
    # a title, three heads, and a line for each entry or for none
    for path, lines in (("/r/hub.ts", 4 + 2 + 1 + 60), ("/r/é😀.ts", 4 + 1 + 1 + 2), ("/r/lone.py", 4 + 3), ("/r/unknown.py", 4 + 3)):
        text, n = joined(parts.context_parts(path, nodes, edges, scores, "/r"))
        assert text == render.context_text(path, nodes, edges, scores, "/r").first()["text"]
        assert n == lines


def test_hub_is_no_single_row(spark):
    """No row gathers the dependents."""
    nodes, edges, scores = tables(spark, 3000)
    made = parts.context_parts("/r/hub.ts", nodes, edges, scores, "/r")
    assert made.agg(F.max(F.length("text"))).first()[0] < 60 and made.count() == 3007


def test_search_and_impact_parts(spark):
    nodes, _, scores = tables(spark)
    assert joined(parts.search_parts(search(nodes, "hub"), "/r"))[0] == "2 matches\n\nclass Hub in hub.ts:L3\nclass Hub in u1.py:L3"
    assert joined(parts.search_parts(search(nodes, "hüb"), "/r"))[0] == "1 match\n\nfunction hüb😀 in hub.ts:L3"
    assert joined(parts.search_parts(search(nodes, "none such"), "/r")) == ("0 matches", 1)
    reached = scores.withColumn("depth", F.lit(1)).withColumn("place", F.lit(0))
    text, n = joined(parts.impact_parts(reached.where("score > 0.3"), "/r"))
    assert text == "3 files affected\n\nhub.ts [score: 1.0000]\né😀.ts [score: 0.5000]\nlone.py [score: 0.3333]" and n == 4
    assert joined(parts.impact_parts(reached.limit(1), "/r"))[0].startswith("1 file affected\n\n")
    assert joined(parts.impact_parts(reached.limit(0), "/r"))[0] == "0 files affected"


def test_ages_in_columns(spark):
    rng = random.Random(2)
    given = [-5.0, -0.5, 0.0, 0.9, 59.99, 60.0, 119.9, 120.0, 3599.0, 3600.0, 7199.0, 7200.0, 86399.0, 86400.0, 172800.0, 9e8, *[rng.uniform(0, 4e5) for _ in range(500)]]
    rows = spark.createDataFrame([(x,) for x in given], "s double").select("s", ago(F.col("s"))).collect()
    assert [r[1] for r in rows] == [age(r[0]) for r in rows]
    assert spark.createDataFrame([(None,)], "s double").select(ago(F.col("s"))).first()[0] is None


def test_requests_in_columns(spark):
    given = {"a.py": "/r/a.py", "": "/r", ".": "/r", "..": None, "../r/a": "/r/a", "/r": "/r", "/rr/a": None, "/r/../r/x/./y//z": "/r/x/y/z", "/../r/a": "/r/a", "a/../../b": None, None: None, "é😀": "/r/é😀"}
    rows = spark.createDataFrame([(k,) for k in given], "p string").select("p", within(F.col("p"), "/r")).collect()
    assert {r[0]: r[1] for r in rows} == given
    assert spark.range(1).select(within(F.lit("a"), "/"), within(F.lit("../../x"), "/")).first()[:] == ("/a", "/x")


def test_manifests_in_columns(spark):
    given = [
        ('{"dependencies": {"b": "1", "a": {"x": 1}}, "devDependencies": {"c": null}}', ["b", "a", "c"]),
        ('{"devDependencies": {"@s/é": "1"}}', ["@s/é"]),
        ("{}", []),
        ('{"dependencies": null}', []),
        ('{"dependencies": {}}', []),
        ("", None),
        ("[1]", None),
        ("{", None),
        (None, None),
    ]
    rows = spark.createDataFrame([(t,) for t, _ in given], "t string").select(package_names(F.col("t"))).collect()
    assert [r[0] for r in rows] == [w for _, w in given]
