"""Outlines of code as people write it; all nodes written by hand."""

import time

import pytest
from pyspark.sql import functions as F

from sylvan import outline_rules as rules
from sylvan.operators import outline
from sylvan.plans import snapshot

TEXTS = "repo string, path string, size long, language string, content string"

CASES = {
    "typescript": (
        r"""import { a,
  b } from './x/y';
@Injectable()
export class A extends B {
  constructor(
    private x: Foo<string>,
    private y
  ) {
    const z = 1, w = 2;
  }
  async load(
    id
  ): T {
    return p.replace(/\/*$/, '') + `a ${ `b {` } {`;
  }
  get v(): number { return 1 }
  abstract q(a: string): void;
  static #n<T>(a: T): T { return a / 2 / 1; }
}
interface I {
  m(a: number): string;
  p: string;
}
export const f = (a) => { g(a); };
const open='{'; class C { foo() {} bar(a) { return a } }
function over(a: string): void;
function over(a: any) {}
foo(a);
describe('x', () => {
  function hidden() {}
});
export default async function main() {
  if (a) { later(b); }
  for (const k of list) { const inner = k; }
}
declare module 'm' { export type T = string; }
""",
        [
            (1, 1, "import_statement", "import { a,"),
            (4, 1, "export_statement", "export class A extends B {"),
            (4, 2, "class_declaration", "class A extends B {"),
            (5, 3, "method_definition", "constructor("),
            (9, 5, "lexical_declaration", "const z = 1, w = 2;"),
            (9, 6, "variable_declarator", "w = 2"),
            (11, 3, "method_definition", "async load("),
            (16, 3, "method_definition", "get v(): number { return 1 }"),
            (17, 3, "abstract_method_signature", "abstract q(a: string): void;"),
            (18, 3, "method_definition", "static #n<T>(a: T): T { return a / 2 / 1; }"),
            (20, 1, "interface_declaration", "interface I {"),
            (21, 2, "method_signature", "m(a: number): string;"),
            (24, 1, "export_statement", "export const f = (a) => { g(a); };"),
            (24, 2, "lexical_declaration", "const f = (a) => { g(a); };"),
            (25, 1, "lexical_declaration", "const open='{';"),
            (25, 1, "class_declaration", "class C { foo() {} bar(a) { return a } }"),
            (25, 2, "method_definition", "foo() {}"),
            (25, 2, "method_definition", "bar(a) { return a }"),
            (26, 1, "function_signature", "function over(a: string): void;"),
            (27, 1, "function_declaration", "function over(a: any) {}"),
            (32, 1, "export_statement", "export default async function main() {"),
            (32, 2, "function_declaration", "async function main() {"),
            (34, 6, "lexical_declaration", "const inner = k;"),
            (36, 1, "module", "declare module 'm' { export type T = string; }"),
            (36, 3, "export_statement", "export type T = string;"),
            (36, 4, "type_alias_declaration", "type T = string;"),
        ],
    ),
    "java": (
        """package p;
import java.util.List;
@Override public class C<T extends A> implements D {
  private int x = 1, y = 2;
  static { init(); }
  @Override public void f() {
    int n = 3;
    return x;
  }
  abstract int g(String a,
     int b);
  @Test
  @Timeout(value = 1, unit = S)
  public <K> List<K> h(K k) throws E
  {
    for (int i = 0; i < 3; i++) { run(i); }
    final String s = "}{", t = "x";
  }
  C(int a) { super(a); }
  enum Color { RED, BLUE }
}
interface J { void m(int a); }
@interface Marker { int value() default 1; }
record P(int a, int b) { }
""",
        [
            (1, 1, "package_declaration", "package p;"),
            (2, 1, "import_declaration", "import java.util.List;"),
            (3, 1, "class_declaration", "@Override public class C<T extends A> implements D {"),
            (4, 2, "field_declaration", "private int x = 1, y = 2;"),
            (4, 3, "variable_declarator", "y = 2"),
            (6, 2, "method_declaration", "@Override public void f() {"),
            (7, 4, "local_variable_declaration", "int n = 3;"),
            (10, 2, "method_declaration", "abstract int g(String a,"),
            (14, 2, "method_declaration", "public <K> List<K> h(K k) throws E"),
            (17, 4, "local_variable_declaration", 'final String s = "}{", t = "x";'),
            (17, 5, "variable_declarator", 't = " "'),
            (19, 2, "constructor_declaration", "C(int a) { super(a); }"),
            (20, 2, "enum_declaration", "enum Color { RED, BLUE }"),
            (22, 1, "interface_declaration", "interface J { void m(int a); }"),
            (22, 2, "method_declaration", "void m(int a);"),
            (23, 1, "annotation_type_declaration", "@interface Marker { int value() default 1; }"),
            (23, 2, "method_declaration", "int value() default 1;"),
            (24, 1, "record_declaration", "record P(int a, int b) { }"),
        ],
    ),
    "cpp": (
        """#include <vector>
namespace n {
template<class T> class Box {
public:
  Box(int a) : x(a) {}
  virtual ~Box() = default;
  virtual int area(int w) const = 0;
  bool operator==(const Box& o) const { return true; }
  int n = 3;
};
}
int counter = 0;
int Foo::bar(int a,
   int b)
{
  int q = 2;
  const char* s = R"x(class Q {)" {)x";
  if (q) { run(q); }
}
extern "C" {
int z(void);
}
extern "C" int one(int a) { return a; }
using std::string;
enum class E { A };
struct P { int x; } p;
static const int LIMIT = 10;
""",
        [
            (1, 1, "preproc_include", "#include <vector>"),
            (2, 1, "namespace_definition", "namespace n {"),
            (3, 2, "class_specifier", "template<class T> class Box {"),
            (5, 3, "function_definition", "Box(int a) : x(a) {}"),
            (6, 3, "function_declarator", "virtual ~Box() = default;"),
            (7, 3, "function_declarator", "virtual int area(int w) const = 0;"),
            (8, 3, "function_definition", "bool operator==(const Box& o) const { return true; }"),
            (9, 3, "field_declaration", "int n = 3;"),
            (12, 1, "declaration", "int counter = 0;"),
            (13, 1, "function_definition", "int Foo::bar(int a,"),
            (16, 3, "declaration", "int q = 2;"),
            (17, 3, "declaration", 'const char* s = R"x(class Q {)" {)x";'),
            (20, 1, "linkage_specification", 'extern "C" {'),
            (21, 2, "function_declarator", "int z(void);"),
            (23, 1, "function_definition", 'extern "C" int one(int a) { return a; }'),
            (24, 1, "using_declaration", "using std::string;"),
            (25, 1, "enum_specifier", "enum class E { A };"),
            (26, 1, "struct_specifier", "struct P { int x; }"),
            (26, 2, "field_declaration", "int x;"),
            (27, 1, "declaration", "static const int LIMIT = 10;"),
        ],
    ),
    "rust": (
        """use std::fmt;
#[derive(Debug)] pub struct S {
  a: u8,
}
pub extern "C" fn g() { let q = 1; }
mod m {
  impl<T> Tr for S<T> {
    fn h(&self) -> u8 { 1 }
    const N: u8 = 1;
  }
  pub(crate) trait U { fn sig(&self); }
}
macro_rules! mac { () => { fn no() {} } }
static LIMIT: u8 = 2;
type Alias = u8;
pub async unsafe fn long<'a, T>(
    x: &'a T,
) -> Result<T, E>
where
    T: Clone,
{
    if let Some(y) = x { let z = r#"fn no() {"#; }
    match x { _ => {} }
}
""",
        [
            (1, 1, "use_declaration", "use std::fmt;"),
            (2, 1, "struct_item", "#[derive(Debug)] pub struct S {"),
            (5, 1, "function_item", 'pub extern "C" fn g() { let q = 1; }'),
            (5, 3, "let_declaration", "let q = 1;"),
            (6, 1, "mod_item", "mod m {"),
            (7, 2, "impl_item", "impl<T> Tr for S<T> {"),
            (8, 3, "function_item", "fn h(&self) -> u8 { 1 }"),
            (9, 3, "const_item", "const N: u8 = 1;"),
            (11, 2, "trait_item", "pub(crate) trait U { fn sig(&self); }"),
            (11, 3, "function_signature_item", "fn sig(&self);"),
            (13, 1, "macro_definition", "macro_rules! mac { () => { fn no() {} } }"),
            (13, 5, "function_item", "fn no() {}"),
            (14, 1, "static_item", "static LIMIT: u8 = 2;"),
            (15, 1, "type_item", "type Alias = u8;"),
            (16, 1, "function_item", "pub async unsafe fn long<'a, T>("),
            (22, 5, "let_declaration", 'let z = r#"fn no() {"#;'),
        ],
    ),
    "go": (
        """package p

import (
\t"fmt"
)

var limit = 1
func f(a int) (int, error) {
\tx, y := 1, `{`
\tif z := g(); z { q := 2 }
\tvar w int
}
type I interface {
\tRun(a int) error
}
type S struct {
\tA int
}
func (s *S) Long(
\ta int,
) error {
}
""",
        [
            (1, 1, "package_clause", "package p"),
            (3, 1, "import_declaration", "import ("),
            (7, 1, "var_declaration", "var limit = 1"),
            (8, 1, "function_declaration", "func f(a int) (int, error) {"),
            (9, 3, "short_var_declaration", "x, y := 1, `{`"),
            (10, 5, "short_var_declaration", "q := 2"),
            (11, 3, "var_declaration", "var w int"),
            (13, 1, "type_declaration", "type I interface {"),
            (14, 4, "method_spec", "Run(a int) error"),
            (16, 1, "type_declaration", "type S struct {"),
            (19, 1, "method_declaration", "func (s *S) Long("),
        ],
    ),
    "python": (
        '''import os
from a import b
@dec(x,
     y)
class A(B):
  """class of
def no(): pass"""
  def m(self,
        b={"k": ")"}):
    def inner():
      pass
  if x:
    def n(self): pass
  async def k(self): return "def q():"
def f(): pass
x = {
  "class Z": 1,
}
''',
        [
            (1, 1, "import_statement", "import os"),
            (2, 1, "import_from_statement", "from a import b"),
            (5, 1, "class_definition", "class A(B):"),
            (8, 3, "function_definition", "def m(self,"),
            (10, 5, "function_definition", "def inner():"),
            (13, 5, "function_definition", "def n(self): pass"),
            (14, 3, "function_definition", 'async def k(self): return "def q():"'),
            (15, 1, "function_definition", "def f(): pass"),
        ],
    ),
    "csharp": (
        """using System;
global using A = B.C;
namespace N
{
  [Attr(1)] public class A : B
  {
    public string P { get; set; }
    int n = 3;
    public A(int x) : base(x) { }
    public int M(int a) => a;
    void L() { var q = @"\\"; int Local(int z) { return z; } }
    public abstract void Abs(
      int a);
  }
  public record struct R(int X);
  interface I { void Do(); }
}
""",
        [
            (1, 1, "using_directive", "using System;"),
            (2, 1, "using_directive", "global using A = B.C;"),
            (3, 1, "namespace_declaration", "namespace N"),
            (5, 2, "class_declaration", "[Attr(1)] public class A : B"),
            (7, 3, "property_declaration", "public string P { get; set; }"),
            (8, 3, "field_declaration", "int n = 3;"),
            (9, 3, "constructor_declaration", "public A(int x) : base(x) { }"),
            (10, 3, "method_declaration", "public int M(int a) => a;"),
            (11, 3, "method_declaration", 'void L() { var q = @"\\"; int Local(int z) { return z; } }'),
            (11, 5, "local_declaration_statement", 'var q = @"\\";'),
            (11, 5, "local_function_statement", "int Local(int z) { return z; }"),
            (12, 3, "method_declaration", "public abstract void Abs("),
            (15, 2, "record_declaration", "public record struct R(int X);"),
            (16, 2, "interface_declaration", "interface I { void Do(); }"),
            (16, 3, "method_declaration", "void Do();"),
        ],
    ),
    "kotlin": (
        """package p
import a.b
data class A(
  val x: Int
) : B() {
  fun m(
    a: Int
  ): Int = a
  companion object { val k = 1 }
  constructor(s: String) : this(1) { }
  override suspend fun <T> q(t: T) { val y = "}" }
}
enum class E { A, B }
fun interface F { fun run() }
@JvmStatic inline fun top(block: () -> Unit) { block() }
""",
        [
            (1, 1, "package_header", "package p"),
            (2, 1, "import_header", "import a.b"),
            (3, 1, "class_declaration", "data class A("),
            (6, 2, "function_declaration", "fun m("),
            (9, 2, "companion_object", "companion object { val k = 1 }"),
            (9, 3, "property_declaration", "val k = 1"),
            (10, 2, "secondary_constructor", "constructor(s: String) : this(1) { }"),
            (11, 2, "function_declaration", "override suspend fun <T> q(t: T) { val y = \"}\" }"),
            (11, 4, "property_declaration", 'val y = "}"'),
            (13, 1, "class_declaration", "enum class E { A, B }"),
            (14, 1, "class_declaration", "fun interface F { fun run() }"),
            (14, 2, "function_declaration", "fun run()"),
            (15, 1, "function_declaration", "@JvmStatic inline fun top(block: () -> Unit) { block() }"),
        ],
    ),
    "swift": (
        """import Foundation
@objc class A: B {
  let x = 1
  func m(a: Int) -> Int { return a }
  init(
    a: Int
  ) { }
  class func make() -> A { }
}
protocol P { func q(a: Int) }
public indirect enum E { case a }
private extension A { var y: Int { 1 } }
""",
        [
            (1, 1, "import_declaration", "import Foundation"),
            (2, 1, "class_declaration", "@objc class A: B {"),
            (3, 2, "property_declaration", "let x = 1"),
            (4, 2, "function_declaration", "func m(a: Int) -> Int { return a }"),
            (5, 2, "init_declaration", "init("),
            (8, 2, "function_declaration", "class func make() -> A { }"),
            (10, 1, "protocol_declaration", "protocol P { func q(a: Int) }"),
            (10, 2, "function_declaration", "func q(a: Int)"),
            (11, 1, "class_declaration", "public indirect enum E { case a }"),
            (12, 1, "class_declaration", "private extension A { var y: Int { 1 } }"),
            (12, 2, "property_declaration", "var y: Int { 1 }"),
        ],
    ),
    "dart": (
        """import 'a.dart';
class A extends B {
  int n = 3;
  A(this.n);
  A.named() : n = 1;
  void m(int a) { var q = 1; }
  Future<int> g() async => 1;
  int abs(int a);
}
int counter = 0;
mixin M { }
""",
        [
            (1, 1, "import_or_export", "import 'a.dart';"),
            (2, 1, "class_definition", "class A extends B {"),
            (3, 2, "declaration", "int n = 3;"),
            (4, 2, "constructor_signature", "A(this.n);"),
            (5, 2, "constructor_signature", "A.named() : n = 1;"),
            (6, 2, "function_signature", "void m(int a) { var q = 1; }"),
            (6, 4, "local_variable_declaration", "var q = 1;"),
            (7, 2, "function_signature", "Future<int> g() async => 1;"),
            (8, 2, "function_signature", "int abs(int a);"),
            (10, 1, "declaration", "int counter = 0;"),
            (11, 1, "mixin_declaration", "mixin M { }"),
        ],
    ),
    "c": (
        """#include <stdio.h>
int a = 1, b = 2;
static int f(int x)
{
  int counter = 0;
  while (x--) { counter += g(x); }
  return counter;
}
int g(int);
typedef struct S { int q; } S;
char *
names(void) { return 0; }
""",
        [
            (1, 1, "preproc_include", "#include <stdio.h>"),
            (2, 1, "declaration", "int a = 1, b = 2;"),
            (3, 1, "function_definition", "static int f(int x)"),
            (5, 3, "declaration", "int counter = 0;"),
            (9, 1, "function_declarator", "int g(int);"),
            (10, 1, "struct_specifier", "typedef struct S { int q; }"),
            (12, 1, "function_definition", "names(void) { return 0; }"),
        ],
    ),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [("r", lang, len(code), lang, code) for lang, (code, _) in CASES.items()]
    out = {}
    for r in outline.outline_lines(spark.createDataFrame(rows, TEXTS)).orderBy("path", "seq").collect():
        out.setdefault(r["path"], []).append((r["line"], r["depth"], r["node_type"], r["node_text"]))
    return out


@pytest.mark.parametrize("language", list(CASES))
def test_outline_of_code(found, language):
    assert found[language] == CASES[language][1]


def test_many_statements_on_one_line_take_time_in_proportion(frame):
    """Minified code: thousands of functions in one line."""
    code = "".join(f"function f{i}(a,b){{var x{i}=1;return a/b/{i}}}" for i in range(4000))
    texts = frame([("r", "a.js", len(code), "javascript", code)], TEXTS)
    start = time.monotonic()
    nodes = outline.outline_lines(texts).groupBy("node_type").count().collect()
    assert time.monotonic() - start < 60
    assert {r["node_type"]: r["count"] for r in nodes} == {"function_declaration": 4000, "variable_declaration": 4000}


def test_symbols_of_members_and_variables(frame):
    code = "abstract class A {\n  abstract m(a: string): void;\n  run(\n    b\n  ) {\n  }\n}\nlet p = 1, q = 2;\n"
    row = snapshot.file_index(frame([("r", "a.ts", 1, "typescript", code)], TEXTS)).first()
    assert row["symbols"] == "cls:A(m,run) var:p,q"


def test_hidden_text_is_found_in_one_pass(spark):
    rows = [
        ("c", 'a("x\\"y"); // ü𝒳 "\nb /* 1\n 2 */ c\n'),
        ("python", "# a 'b'\nx = 'y' # z"),
    ]
    code = spark.createDataFrame(rows, "language string, content string")
    made = code.select("content", outline.blanked(F.col("content"), F.col("language")).alias("code"))
    for r in made.collect():
        assert len(r["code"]) == len(r["content"])
        assert [i for i, x in enumerate(r["code"]) if x == "\n"] == [i for i, x in enumerate(r["content"]) if x == "\n"]
    c, python = (r["code"] for r in made.collect())
    assert c == 'a("  " ");' + " " * 8 + "\nb     \n      c\n"
    assert python == " " * 7 + "\nx = ' '" + " " * 4
    # the pattern of a language is looked for once per text
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(rules.OPAQUE["python"]) == 1
