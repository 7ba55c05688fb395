"""The given tables seen as a corpus of files.

The tables hold prose and web pages. These views turn whole tables into files,
code, outline nodes and requests with expressions that ``workload.oracle``
repeats in SQL. Every row of the table gives a row (or a line) of the view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.code import CYCLE, LINES

# --- fixed lists, shared with the SQL side ---------------------------------
FILE_DIRS = [
    "", "src/", "src/core/", "lib/util/", "test/unit/", ".github/wf/",
    "a/b/c/d/e/f/g/h/i/", "a/b/c/d/e/f/g/h/i/j/", "build/out/", "docs/_x/",
    "pkg/tests/", "src/.cache/",
]
FILE_EXTS = [
    ".ts", ".tsx", ".js", ".PY", ".go", ".rs", ".java", ".md", "", ".d.ts",
    ".kt", ".cs", ".swift", ".c", ".hpp", ".TXT", ".log",
]
CODE_DIRS = ["", "src/", "src/core/", "lib/", "app/models/", "tools/"]
PAGE_DIRS = [
    "", "src/", "lib/", "test/", "x/test/", "node_modules/", "x/tmp/", ".cache/", "docs/",
]
# node type and node text; @ is a word of the line, ~ the whole line, which
# otherwise stands behind the text as a comment
NODES = [
    ("function_declaration", "function @(a, b) {"),
    ("class_declaration", "class @ {"),
    ("method_definition", "@(~) {"),
    ("import_statement", "import { @ } from './x/@.ts'"),
    ("export_statement", "export const @ = 1;"),
    ("lexical_declaration", "const @ = ~"),
    ("namespace_declaration", "namespace A.@ {"),
    ("using_directive", "using System.@;"),
    ("interface_declaration", "export interface @ {"),
    ("constructor_declaration", "public @(int seed)"),
    ("property_declaration", "public string @ { get; set; }"),
    ("import_statement", "import { @, b } "),
    ("identifier", "@"),
    ("use_declaration", "use a::@;"),
    ("comment", "// ~"),
    ("record_declaration", "public record @(int X, int Y);"),
    ("expression_statement", "~"),
    ("call_expression", "~"),
    ("class_body", "{ ~ }"),
    ("Function_Item", "fn @(a: i32)"),
    ("require_call", "require('a/b/@.js')"),
    ("export_clause", "export { @ , c }"),
    ("enum_item", "enum"),
    ("statement", "\t ~"),
    ("package_clause", "x"),
    ("module", "@ module"),
]
# what starts a comment that goes to the end of its line
COMMENT_MARKS = {".py": "# ", ".md": "> "}
NODE_COMMENT = " // "
ANCESTORS = [
    ["program"],
    ["program", "class_declaration", "class_body"],
    ["program", "export_statement", "class_declaration", "class_body"],
    ["source_file", "namespace_declaration", "declaration_list", "class_declaration", "declaration_list"],
    ["program", "class_declaration", "class_body"],
    ["program", "function_declaration", "statement_block", "expression_statement", "call_expression", "arguments"],
    [],
]
IGNORE_FILES = {
    "": "# notes\n\n*.log\n/test\nbuild/\n!en*.log\nsrc/**/de*\n*.txt  \n",
    "src": "*.ts\r\n!fr*.ts\r\ncore/\r\n",
}
SETTINGS = [
    None,
    "{}",
    '{"maxDepth": 7, "outputFormat": "raw"}',
    '{"maxDepth": 0, "generateSyntaxTree": false}',
    "{ not valid json",
    '{"outputFormat": "nonsense", "exclude": []}',
    '{"exclude": ["**/*.spec.ts", "docs"], "maxFileSize": 2048}',
    '{"generateSyntaxTree": true, "filesToExtract": ["a.ts", "b.ts"], "maxDepth": 3}',
    '{"maxDepth": 3} and more',
]
PROFILE_PATHS = [
    ".gitignore", ".snapshot/config.json", "package.json", "pyproject.toml", "Cargo.toml",
    "go.mod", "pubspec.yaml", "README.md", "sub/package.json",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as_table(rows: DataFrame) -> DataFrame:
    """Compute the columns once, as if they were stored.

    Without this the filters of a query would be merged into the expressions
    above and compute the content of a file again for every test on it.
    """
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def _sized(rows: DataFrame) -> DataFrame:
    return _as_table(rows).withColumn("size", F.octet_length("content").cast("long"))


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _word(line: Column) -> Column:
    found = F.regexp_extract(line, "[A-Za-z]+", 0)
    return F.when(F.length(found) > 0, found).otherwise(F.lit("x"))


def _repo(doc_id: Column) -> Column:
    return F.concat("source", F.lit("/r"), F.floor(doc_id / 500).cast("string"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files; some binary, hidden, deep or lock files."""
    i, text = F.col("doc_id"), F.col("text")
    name = (
        F.when(i % 23 == 0, F.concat(F.lit("p"), i.cast("string"), F.lit("/yarn.lock")))
        .when(i % 29 == 0, F.concat(F.lit("v"), i.cast("string"), F.lit("/.git/config")))
        .when(i % 37 == 0, F.concat(F.lit(".hidden"), i.cast("string")))
        .otherwise(F.concat("lang", i.cast("string"), _pick(FILE_EXTS, i % 17)))
    )
    n = F.length(text)
    body = (
        F.when(i % 11 == 0, F.concat(F.lit("\0"), text))
        .when(i % 19 == 0, F.concat(F.repeat(F.lit("\x01"), n), text))
        .when(i % 13 == 0, F.concat(F.repeat(F.lit("\x02"), F.floor(n / 4).cast("int")), text))
        .otherwise(text)
    )
    return _sized(
        table(spark, sf_dir, "documents").select(
            "doc_id",
            _repo(i).alias("repo"),
            F.concat(_pick(FILE_DIRS, i % 12), name).alias("path"),
            body.cast("binary").alias("content"),
        )
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as source code: every line of text gives a line of code and
    a comment that holds all of it."""
    i = F.col("doc_id")
    exts = list(LINES)
    ext = _pick(exts, i % len(exts))
    lines = F.array(*[F.array(*[F.lit(x) for x in LINES[e]]) for e in exts])
    templates = F.get(lines, (i % len(exts)).cast("int"))
    mark = _pick([COMMENT_MARKS.get(e, "// ") for e in exts], i % len(exts))
    code = F.transform(
        F.split("text", "\n", -1),
        lambda line, n: F.concat(
            F.replace(
                F.get(templates, (n % CYCLE).cast("int")),
                F.lit("¤"),
                F.concat(_word(line), (n % 3).cast("string")),
            ),
            F.lit("\n"),
            mark,
            line,
        ),
    )
    return _sized(
        table(spark, sf_dir, "documents").select(
            _repo(i).alias("repo"),
            F.concat(_pick(CODE_DIRS, i % 7 % 6), "lang", i.cast("string"), ext).alias("path"),
            F.array_join(code, "\n").cast("binary").alias("content"),
        )
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents`` as outline nodes."""
    pick = ((F.col("seq") + F.col("doc_id")) % len(NODES)).cast("int")
    types = F.get(F.array(*[F.lit(t) for t, _ in NODES]), pick)
    shown = [t if "~" in t else f"{t}{NODE_COMMENT}~" for _, t in NODES]
    texts = F.get(F.array(*[F.lit(t) for t in shown]), pick)
    above = F.get(
        F.array(*[F.array(*[F.lit(a) for a in x]).cast("array<string>") for x in ANCESTORS]),
        (F.col("seq") % len(ANCESTORS)).cast("int"),
    )
    i = F.col("doc_id")
    return _as_table(
        table(spark, sf_dir, "documents")
        .select(
            "doc_id",
            _repo(i).alias("repo"),
            F.concat(F.lit("d"), i.cast("string"), F.lit(".ts")).alias("path"),
            F.posexplode(F.split("text", "\n", -1)).alias("seq", "raw"),
        )
        .select(
            "repo",
            "path",
            "seq",
            types.alias("node_type"),
            F.replace(F.replace(texts, F.lit("@"), _word(F.col("raw"))), F.lit("~"), F.col("raw")).alias(
                "node_text"
            ),
            above.alias("ancestor_types"),
            (F.col("seq") + 1).alias("line"),
        )
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as files of three repositories; the first page of a path counts."""
    i = F.col("page_id")
    tail = F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1)
    name = F.when(F.endswith(tail, F.lit("/")), F.concat(tail, F.lit("index.html"))).otherwise(tail)
    body = F.when(i % 11 == 0, F.concat(F.lit("\0"), "html")).otherwise(F.col("html"))
    rows = table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("url", "^https?://[^/]*?([a-z]+[.][a-z]+)/", 1).alias("repo"),
        F.concat(_pick(PAGE_DIRS, i % 9), name).alias("path"),
        body.alias("body"),
    )
    return (
        rows.groupBy("repo", "path")
        .agg(F.min_by("body", "page_id").cast("binary").alias("content"))
        .withColumn("size", F.octet_length("content").cast("long"))
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per page: exact, by name, by glob, a directory, or absent."""
    i = F.col("page_id")
    tail = F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1)
    name = F.when(F.endswith(tail, F.lit("/")), F.concat(tail, F.lit("index.html"))).otherwise(tail)
    base = F.substring_index(name, "/", -1)
    ask = (
        F.when(i % 7 == 0, F.concat(_pick(PAGE_DIRS, i % 9), name))
        .when(i % 7 == 1, base)
        .when(i % 7 == 2, F.concat(F.lit("gone"), i.cast("string"), F.lit(".x")))
        .when(i % 7 == 3, F.concat(F.lit("./"), _pick(PAGE_DIRS, i % 9), F.lit("q/../"), name))
        .when(i % 7 == 4, F.concat(_pick(PAGE_DIRS, i % 9), F.substring_index(name, "/", 1)))
        .when(i % 7 == 5, name)
        .otherwise(F.concat(F.substring(base, 1, 1), F.lit("?*")))
    )
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^https?://[^/]*?([a-z]+[.][a-z]+)/", 1).alias("repo"),
        i.alias("req_no"),
        ask.alias("requested"),
    )


def ignore_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignore files of the repositories in ``files``; every third has the inner one."""
    repos = files(spark, sf_dir).select("repo").distinct()
    rows = F.array(
        *[
            F.struct(
                F.lit(f"{base}/.gitignore" if base else ".gitignore").alias("path"),
                F.lit(content).cast("binary").alias("content"),
            )
            for base, content in IGNORE_FILES.items()
        ]
    )
    return (
        repos.select("repo", F.inline(rows))
        .filter((F.col("path") == ".gitignore") | (F.length("repo") % 2 == 0))
        .withColumn("size", F.octet_length("content").cast("long"))
    )


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings text of one project per document; eight different ones."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/d"), i.cast("string")).alias("repo"),
        _pick(SETTINGS, i % len(SETTINGS)).alias("config_json"),
    )


def repo_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of the repositories of ``files`` and ``code_files``."""
    repos = table(spark, sf_dir, "documents").select(_repo(F.col("doc_id")).alias("repo")).distinct()
    return repos.select(
        "repo", _pick(SETTINGS, F.ascii(F.substring("repo", 4, 1)) % len(SETTINGS)).alias("config_json")
    )


def profile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as root-level files of small projects."""
    i = F.col("doc_id")
    body = (
        F.when(i % 9 == 0, F.replace("text", F.lit("\nE"), F.lit("\n#")))
        .when(i % 9 == 1, F.coalesce(_pick(SETTINGS, F.floor(i / 9) % len(SETTINGS)), F.lit("")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/q"), F.floor(i / 100).cast("string")).alias("repo"),
        _pick(PROFILE_PATHS, i % 9).alias("path"),
        body.cast("binary").alias("content"),
    )
