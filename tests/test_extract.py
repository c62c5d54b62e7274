"""Definitions and imports found in source text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftmap.functions.extract import extract, language_of
from weftmap.schemas import KINDS


def told(path, source):
    return [(n["kind"], n["name"], n["start_line"], n["end_line"], n["references"]) for n in extract(path, source)]


TS = """import main, { one as two, type Three } from "pkg";
import * as all from './all';
import './effect';

export const MAX_SIZE = 10, helper = (x: number): { n: number } => { const HIDDEN_X = 1; return { n: x }; };
export type Key<T> = T extends string ? Foo : { name: Bar };
export enum Level { Low = 'a;{', High }
export interface Shape extends Base<{ a: 1 }> {
  area(): number;
}
@Injectable()
@Plain
export abstract class Store<T> extends Base(x) {
  private items: T[] = [];
  handler = (e: Event) => { this.run(/["'{]/g, `${a ? `}` : '{'}`); };
  constructor(private readonly n: number) { super(); }
  @log async *load<U>(key: U = {} as U): Promise<void> { yield 1 / 2 / 3; }
  get size(): number { return 1; }
  abstract missing(): void;
  static { init(); }
}
export function greet(name: string): string;
export function greet(name: any): any { function inner() {} return name; }
export async function* stream() {}
const notFunction = (() => 1)();
const classic = function () {};
export * from "./a"; export * as b from './b';
export { x as y, type z } from './c';
export default Store;
namespace Space { export const IN_SPACE = 1; }
const api = { get() { return 1; }, async post(a) {} };
"""


def test_typescript():
    assert told("/p/a.ts", TS) == [
        ("import", "pkg", 1, 1, ["main", "two", "Three"]),
        ("import", "./all", 2, 2, ["all"]),
        ("import", "./effect", 3, 3, []),
        ("constant", "MAX_SIZE", 5, 5, []),
        ("function", "helper", 5, 5, []),
        ("type", "Key", 6, 6, ["T", "Foo", "name", "Bar"]),
        ("enum", "Level", 7, 7, []),
        ("interface", "Shape", 8, 10, []),
        ("class", "Store", 13, 21, ["Plain", "Injectable"]),
        ("method", "load", 17, 17, ["log"]),
        ("method", "size", 18, 18, []),
        ("function", "greet", 23, 23, []),
        ("function", "inner", 23, 23, []),
        ("function", "stream", 24, 24, []),
        ("export", "./a", 27, 27, ["./a"]),
        ("export", "./b", 27, 27, ["./b"]),
        ("export", "./c", 28, 28, ["x", "z"]),
        ("constant", "IN_SPACE", 30, 30, []),
        ("method", "get", 31, 31, []),
        ("method", "post", 31, 31, []),
    ]


def test_jsx():
    source = "import React from 'react';\nexport const App = () => {\n  return (<div title=\"it's\">Don't {items.map(i => <b key={i}>{'}'}</b>)} <br/> stop</div>);\n};\nfunction Next() { return <></>; }\nconst LIMIT_A = a < b ? 1 : 2;\n"
    assert told("/p/a.tsx", source) == [("import", "react", 1, 1, ["React"]), ("function", "App", 2, 4, []), ("function", "Next", 5, 5, []), ("constant", "LIMIT_A", 6, 6, [])]


def test_constants_only_outside_functions():
    source = "if (x) { var IN_BLOCK = 1 }\nfunction f() { const IN_FUNCTION = 1 }\nclass C { m() { let IN_METHOD = 2 } }\nconst A = 1, _ = 2, __ = 3, A1_ = 4, lower = 5\n"
    assert [(n[0], n[1]) for n in told("/p/a.js", source)] == [("constant", "IN_BLOCK"), ("function", "f"), ("class", "C"), ("method", "m"), ("constant", "__"), ("constant", "A1_")]


PY = '''from . import utils
from ..core import base as b, other
from __future__ import annotations
import json as j, os.path
from os import *

LIMIT: int = 3
A_A = B_B = 1
lower, UP_PER = 1, 2


@cache
@app.route("/x")
@skip.me
async def view(x):
    INNER_X = 1
    class Local:
        def inner(self): pass
    import late


class Model(Base):
    LEVEL = 1

    @property
    def name(self) -> str:
        return """
class No:
"""
'''


def expected_python(kind):
    return [
        (kind, ".", 1, 1, ["utils"]),
        (kind, "..core", 2, 2, ["b", "other"]),
        ("import", "j", 4, 4, ["j", "os.path"]),
        ("import", "os", 5, 5, ["*"]),
        ("constant", "LIMIT", 7, 7, []),
        ("constant", "A_A", 8, 8, []),
        ("constant", "B_B", 8, 8, []),
        ("function", "view", 15, 19, ["cache", "app.route"]),
        ("class", "Local", 17, 18, []),
        ("function", "inner", 18, 18, []),
        ("import", "late", 19, 19, ["late"]),
        ("class", "Model", 22, 29, []),
        ("constant", "LEVEL", 23, 23, []),
        ("method", "name", 26, 29, ["property"]),
    ]


@pytest.mark.parametrize(("path", "kind"), [("/p/a.py", "import"), ("/p/__init__.py", "export")])
def test_python(path, kind):
    assert told(path, PY) == expected_python(kind)


def test_broken_python_still_gives_definitions():
    got = told("/p/a.py", "from .a import (b,\n    c as d)\nimport os\nX_Y = 1\n@deco\nclass A:\n    Q_Q = 2\n    def m(self):\n        print 'x'\n\ndef f(:\n    pass\n")
    assert got == [("import", ".a", 1, 2, ["b", "d"]), ("import", "os", 3, 3, ["os"]), ("constant", "X_Y", 4, 4, []), ("class", "A", 6, 9, ["deco"]), ("constant", "Q_Q", 7, 7, []), ("method", "m", 8, 9, []), ("function", "f", 11, 12, [])]


def test_ids_and_languages():
    nodes = extract("/p/a.py", "def f(): pass\ndef f(): pass\n")
    assert [n["id"] for n in nodes] == ["/p/a.py:f:1", "/p/a.py:f:2"] and [n["seq"] for n in nodes] == [0, 1]
    assert extract("/p/a.rs", "fn f() {}") == [] and extract("/p/a.ts", "") == []
    assert [language_of(f"x{e}") for e in (".ts", ".tsx", ".js", ".mjs", ".cjs", ".py", ".jsx", "")] == ["typescript", "tsx", "javascript", "javascript", "javascript", "python", None, None]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["import ", "export ", "class A ", "function f", "(", ")", "{", "}", "<", ">", "=>", "=", "const X_Y", " from 'a'", "`${", "`", "'", '"', "/", "\n", ";", ",", "type T ", "@d ", "interface I", ": ", "def f", "    ", "#", "enum E", "async ", "[", "]"]), max_size=40), st.sampled_from(["a.ts", "a.tsx", "a.py"]))
def test_any_text_is_survived(parts, name):
    for n in extract(f"/p/{name}", "".join(parts)):
        assert n["kind"] in KINDS and n["start_line"] <= n["end_line"] and n["name"] is not None


def test_function_expressions_are_no_scope():
    source = "const a = function () { const SEEN_A = 1; };\nexport default function () { const SEEN_B = 1; }\nfunction f() { const HIDDEN_A = 1; const b = function () { const HIDDEN_B = 1; }; }\nrun(function () { let SEEN_C = 2; });\nconst c = () => { const HIDDEN_C = 1; };\n"
    assert [n["name"] for n in extract("/p/a.ts", source)] == ["SEEN_A", "SEEN_B", "f", "SEEN_C", "c"]


def test_extraction_in_sql_text(spark):
    """The table function gives the rows of ``extract``, also for odd files, nulls and languages of one's own."""
    from weftmap.functions import extract as languages
    from weftmap.functions.extract.sql import register_function

    rows = [("/a.py", "from .b import f\n\ndef g(): pass\n"), ("/b.ts", "export class C { m() {} }"), ("/c.md", "# x"), ("/d.py", None), (None, "x"), ("/e.py", "def broken(:\n  pass"), ("/f.row", "p q")]
    handlers, known = languages.registered()
    languages.register(".row", "rows", lambda path, source: [{"name": x, "kind": "constant", "start_line": 1, "end_line": 1, "references": [path]} for x in source.split()])
    try:
        register_function(spark)
        want = sorted((path, n["id"], n["name"], n["kind"], n["start_line"], n["end_line"], tuple(n["references"]), n["seq"]) for path, source in rows for n in languages.extract(path or "", source or ""))
    finally:
        languages.HANDLERS.clear(), languages.LANGUAGES.clear()
        languages.HANDLERS.update(handlers), languages.LANGUAGES.update(known)
    spark.createDataFrame(rows, "file_path string, source string").createOrReplaceTempView("odd_sources")
    got = spark.sql("SELECT s.file_path, n.* FROM odd_sources s, LATERAL extract_nodes(s.file_path, s.source) n").collect()
    assert sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in got) == want and len(want) >= 6
    assert spark.sql("SELECT count(*) FROM extract_nodes('/x.py', 'A_B = 1')").first()[0] == 1
