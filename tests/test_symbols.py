import random
import time

import pytest
from sylvan import constants as K
from sylvan.functions import symbols as SF
from sylvan.operators import nodes as N
from sylvan.operators import outline
from sylvan.operators import symbols as S
from sylvan.plans import snapshot

SUMMARY = "repo string, path string, summary string"


def symbol_text(frame, rows):
    """Symbol text of one file from rows of a summary."""
    text = "\n".join([K.SUMMARY_MARKER] + [f"{r} (line {i + 1})" for i, r in enumerate(rows)])
    df = S.file_symbols(S.symbols(N.summary_parse(frame([("r", "p", text)], SUMMARY))))
    got = df.collect()
    return got[0]["symbols"] if got else None


CASES = [
    (["function_declaration: function doThing()"], "fn:doThing"),
    (["class_declaration: class Service", "  method_definition: start()", "  method_definition: stop()"], "cls:Service(start,stop)"),
    (["class_declaration: class Empty"], "cls:Empty"),
    (["import_statement: import { foo } from './bar/baz'"], "imp:baz"),
    (["function_declaration: function dup()"] * 2, "fn:dup"),
    (
        ["import_statement: import x from './x'", "class_declaration: class C", "function_declaration: function f()"],
        "cls:C fn:f imp:x",
    ),
    (
        [
            "namespace_declaration: namespace Demo {", "  class_declaration: public class Calculator",
            "    constructor_declaration: public Calculator(int seed)", "    method_declaration: public int Add(int value)",
        ],
        "cls:Calculator(Calculator,Add) mod:Demo",
    ),
    (["namespace_declaration: namespace Demo.App {"], "mod:Demo.App"),
    (["using_directive: using System.Collections.Generic;"], "imp:System.Collections.Generic"),
    (["using_directive: global using static A.B;"], "imp:A.B"),
    (["record_declaration: public record Point(int X, int Y);"], "cls:Point"),
    (["property_declaration: public string Name { get; set; }"], "var:Name"),
    (["export_statement: export interface X {"], "exp:interface"),
    (["method_declaration: func (s *T) Start() {"], "fn:func"),
    (["use_declaration: use a::b;"], None),
    (["trait_item: trait T {"], None),
    (["import_statement: import { , a }"], None),
    (["import_statement: from './'"], None),
    (["import_statement: import { a , b } "], "imp:a"),
    (["call: require('x/y.js')"], None),
    (["require_call: require('x/y.js')"], "imp:y"),
    (["no colon here"], None),
    # a row without a symbol still closes the class
    (["class_declaration: class A", "statement: x", "  method_definition: m()"], "cls:A fn:m"),
    (["class_declaration: class A", "  class_declaration: class B", "    method_definition: m()", "  method_definition: n()"], "cls:A(n),B(m)"),
    (["class_declaration: class A", "  method_definition: m()", "class_declaration: class A", "  method_definition: m()", "  method_definition: k()"], "cls:A(m,k)"),
    (["lexical_declaration: const a = 1", "export_statement: export default", "module: module M"], "exp:default var:a mod:M"),
]


@pytest.mark.parametrize("rows,expected", CASES)
def test_symbols_of_a_summary(frame, rows, expected):
    assert symbol_text(frame, rows) == expected


def test_parent_class_matches_a_stack(frame):
    rng = random.Random(2)
    rows = []
    for f in range(120):
        for seq in range(rng.randint(1, 25)):
            kind = rng.choice(["cls", "fn", "fn", "var", None])
            rows.append((f"r{f % 3}", f"p{f}", seq, rng.choice([0, 2, 4, 6]), kind, f"n{seq}"))

    expected = {}
    for f in {(r[0], r[1]) for r in rows}:
        stack = []
        for _, path, seq, indent, kind, name in sorted(r for r in rows if r[:2] == f):
            stack = [s for s in stack if s[0] < indent]
            if kind == "cls":
                stack.append((indent, name))
            elif kind == "fn":
                expected[(path, seq)] = stack[-1][1] if stack else None
    df = frame(rows, "repo string, path string, seq int, indent int, kind string, name string")
    got = {(r["path"], r["seq"]): r["parent_class"] for r in S.enclosing_class(df).filter("kind = 'fn'").collect()}
    assert got == expected


def test_signature(evaluate):
    values = ["a" * 100, "a" * 101, "f(" + "x" * 100 + ") {", "\t\tf()\nrest", "f()\r\nrest", "(" + "y" * 120]
    assert evaluate(SF.signature, values) == [
        "a" * 100, "a" * 97 + "...", "f(" + "x" * 100 + ") { ... }", "f()", "f()", "(" + "y" * 96 + "...",
    ]


def test_structural_and_generic(evaluate):
    types = ["function_item", "Class_Thing", "item", "impl_item", "call", "identifier", "statement_block", "package_clause"]
    assert evaluate(SF.is_structural, types) == [True, True, True, False, True, False, True, True]
    assert evaluate(SF.is_generic, types) == [False, False, False, False, False, True, True, False]


def test_depth_skips_member_bodies(frame):
    rows = [(["program", "class_declaration", "class_body"],), ([],), (["a", "b", "c", "d", "e"],), (["a", "b", "c", "declaration_list"],)]
    got = N.nodes_depth(frame(rows, "ancestor_types array<string>")).select("depth", "indent").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (2, 4), (3, 6)]


def test_summary_round_trip(frame):
    nodes = frame(
        [("r", "a.ts", 1, 2, "function_declaration", "function f()", 4), ("r", "a.ts", 0, 0, "class_declaration", "class A", 1)],
        "repo string, path string, seq int, indent int, node_type string, signature string, line int",
    )
    texts = frame([("r", "a.ts", "typescript"), ("r", "b.ts", "typescript"), ("r", "c.txt", None)], "repo string, path string, language string")
    summary = N.summary_text(texts, nodes)
    got = {r["path"]: r["summary"] for r in summary.collect()}
    assert got == {
        "a.ts": f"{K.SUMMARY_MARKER}\nclass_declaration: class A (line 1)\n  function_declaration: function f() (line 4)",
        "b.ts": K.SUMMARY_EMPTY,
        "c.txt": None,
    }
    back = [tuple(r) for r in N.summary_parse(summary).select("indent", "node_type", "signature", "line").orderBy("seq").collect()]
    assert back == [(0, "class_declaration", "class A", 1), (2, "function_declaration", "function f()", 4)]


SNIPPETS = [
    ("javascript", "// orders\nconst LIMIT = 10;\n\nfunction placeOrder(cart) {\n  if (!cart.length) { return null; }\n  return send(cart);\n}\n", "placeOrder"),
    ("jsx", "import React from 'react';\n\nfunction CartView({ items }) {\n  return <ul>{items.map((i) => <li key={i}>{i}</li>)}</ul>;\n}\n", "CartView"),
    ("typescript", "export interface Order {\n  id: string;\n}\n\nexport async function loadOrder(id: string): Promise<Order> {\n  return fetchJson(`/orders/${id}`);\n}\n", "loadOrder"),
    ("tsx", "export const Total = 1;\nexport function OrderBadge(props: Props): JSX.Element {\n  return <span>{props.count}</span>;\n}\n", "OrderBadge"),
    ("python", "import math\n\nclass Ledger:\n    \"\"\"class of accounts\"\"\"\n    def balance(self, day):\n        return math.fsum(self.rows[day])\n", "balance"),
    ("java", "package shop;\n\npublic final class Invoice {\n  private final long cents = 0;\n  public long total(int count) {\n    return cents * count;\n  }\n}\n", "Invoice"),
    ("kotlin", "package shop\n\nclass Basket {\n    fun addItem(item: Item): Boolean {\n        return items.add(item)\n    }\n}\n", "addItem"),
    ("go", "package shop\n\nimport \"fmt\"\n\nfunc PrintLabel(o Order) error {\n\tfmt.Println(o.ID)\n\treturn nil\n}\n", "PrintLabel"),
    ("rust", "use std::fmt;\n\npub struct Parcel {\n    weight: u32,\n}\n\nfn ship(p: &Parcel) -> bool {\n    p.weight < 100\n}\n", "ship"),
    ("cpp", "#include <vector>\n\nclass Shelf {\npublic:\n  int slots() const { return 12; }\n};\n", "Shelf"),
    ("c", "#include <stdio.h>\n\nint count_boxes(int rows, int columns) {\n  return rows * columns;\n}\n", "count_boxes"),
    ("csharp", "namespace Shop {\n  public class Register {\n    public decimal Close(int day) {\n      return Sum(day);\n    }\n  }\n}\n", "Close"),
    ("dart", "import 'dart:core';\n\nint stockOf(String item) {\n  return stock[item] ?? 0;\n}\n", "stockOf"),
    ("swift", "import Foundation\n\nfunc discount(_ price: Double) -> Double {\n    return price * 0.9\n}\n", "discount"),
]
TEXTS = "repo string, path string, size long, language string, content string"


def test_every_language_has_an_outline(frame):
    assert {s[0] for s in SNIPPETS} == set(K.LANGUAGE_EXTENSIONS)
    texts = frame([("r", lang, 1, lang, code) for lang, code, _ in SNIPPETS], TEXTS)
    found = {}
    for r in outline.outline_lines(texts).collect():
        found.setdefault(r["path"], []).append(r["node_text"])
    for lang, _, name in SNIPPETS:
        assert any(name in text for text in found[lang]), lang


INDEXED = [
    ("typescript", "export class Queue {\n  push() {}\n  drain() {}\n}\n", "cls:Queue(push,drain) exp:Queue"),
    ("typescript", "export function tally(rows: number[], start: number) {\n  return start;\n}\n", "fn:tally exp:tally"),
    ("javascript", "class Shelf {\n  stock() {}\n}\nfunction audit() {}\n", "cls:Shelf(stock) fn:audit"),
    ("csharp", SNIPPETS[11][1], "cls:Register(Close) mod:Shop"),
    ("cpp", SNIPPETS[9][1], "cls:Shelf(slots)"),
    ("python", "import os\nfrom a import b\n\nclass A:\n    def m(self):\n        def inner():\n            pass\n    async def n(self): pass\n\ndef f(): pass\n", "cls:A(m,n) fn:f imp:os,b"),
    ("java", "package p;\nimport a.B;\npublic class C {\n  private int x = 1;\n  public C(int a) {\n    if (a) { run(a); }\n    return new D();\n  }\n  @Override\n  public <T> void m(T t) throws E {\n  }\n}\n", "cls:C(C,m) imp:a var:x"),
    ("go", "package main\nimport \"fmt\"\ntype S struct {\n}\nfunc (s *S) Run() {\n}\nconst X = 1\n", "fn:func imp:fmt var:struct,X"),
    (None, "class A {\n}\n", None),
]

# no code: a string that opens a brace, classes in comments and docstrings
NO_CODE = [
    ("typescript", "const open = '{'; const n = 1;\nconst more = '{{{';\nfunction late() {\n}\n", "fn:late var:open,n,more"),
    ("javascript", "/*\nclass Ghost {\n  function ghost() {\n*/\nclass Real { // {\n  run() {\n  }\n}\n", "cls:Real(run)"),
    ("python", 'def f():\n    """class of\nimport this\n"""\n    x = "class Q:"  # class Z:\nclass Real:\n    pass\n', "cls:Real fn:f"),
    ("go", "package p\nvar q = `\nfunc Ghost() {\n`\nfunc Run() {\n}\n", "fn:Run var:q"),
    ("java", "class A {\n  String s = \"}}}\";\n  void m() {\n  }\n}\n", "cls:A(m) var:s"),
]


def test_strings_and_comments_are_no_code(frame):
    texts = frame([("r", f"f{i}", len(code), lang, code) for i, (lang, code, _) in enumerate(NO_CODE)], TEXTS)
    got = {r["path"]: r["symbols"] for r in snapshot.file_index(texts).collect()}
    assert got == {f"f{i}": expected for i, (*_, expected) in enumerate(NO_CODE)}


def test_file_index(frame):
    texts = frame([("r", f"f{i}", len(code), lang, code) for i, (lang, code, _) in enumerate(INDEXED)], TEXTS)
    got = {r["path"]: r for r in snapshot.file_index(texts).collect()}
    for i, (lang, code, expected) in enumerate(INDEXED):
        row = got[f"f{i}"]
        assert (row["symbols"], row["line_count"], row["language"]) == (expected, code.count("\n") + 1, lang)


def test_lines_and_depth(frame):
    code = "// a\n\nexport class A {\n  // {\n  // }\n  m() {\n    const x = 1;\n  }\n}\nfunction f() {}\n"
    texts = frame([("r", "a.ts", 1, "typescript", code)], TEXTS)
    got = [(r["line"], r["node_type"], r["depth"]) for r in outline.outline_lines(texts).orderBy("seq").collect()]
    assert got == [
        (3, "export_statement", 1), (3, "class_declaration", 2), (6, "method_definition", 3),
        (7, "lexical_declaration", 5), (10, "function_declaration", 1),
    ]


LONG_LINES = [
    "var a=" + ",".join(f"f{i}(x{i})" for i in range(30000)) + ";",
    " ".join(["word"] * 60000),
    "int f(" + "a),b(" * 60000,
    "static " * 40000,
    "foo bar(" + "x" * 300000 + ";y",
    "foo bar(" + "x) " * 100000 + "= ; y",
    "  m(" + "{" * 200000,
    "import " + "a, " * 90000,
    "export { " + "a, " * 90000,
]


def test_long_lines_take_time_in_proportion(frame):
    """Minified code, prose and worse, in one line of some hundred kilobytes."""
    rows = [("r", f"{lang}{i}", 1, lang, body) for lang in K.LANGUAGE_EXTENSIONS for i, body in enumerate(LONG_LINES)]
    texts = frame(rows, TEXTS)
    start = time.monotonic()
    assert snapshot.file_index(texts).count() == len(rows)
    assert time.monotonic() - start < 60


def test_one_exchange_for_the_index(frame):
    texts = frame([("r", "a.ts", 1, "typescript", "class A {}")], TEXTS)
    plan = snapshot.file_index(texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(repo" in plan and "Python" not in plan
