import random

from pyspark.sql import functions as F

from sylvan import constants as K
from sylvan.functions import language, paths


def test_extension(evaluate):
    values = ["src/app.ts", "x.d.ts", "Makefile", ".gitignore", "a.b/c", "a.", "A.TS", ".a.b"]
    assert evaluate(paths.extension, values) == [".ts", ".ts", "", "", "", ".", ".TS", ".b"]


def test_language(evaluate):
    values = [
        "src/app.ts", "src/app.tsx", "src/app.js", "main.py", "main.go", "lib.rs", "src/Program.cs",
        "scripts/build.csx", "Program.CS", "App.TS", "Views/Index.cshtml", "notes.xyz", "Makefile",
        "readme.txt", "a.h++", "x.kts",
    ]
    expected = [
        "typescript", "tsx", "javascript", "python", "go", "rust", "csharp", "csharp", "csharp",
        "typescript", None, None, None, None, "cpp", "kotlin",
    ]
    assert evaluate(language.detect_language, values) == expected
    assert evaluate(language.is_supported, ["a.ts", "a.txt"]) == [True, False]


def test_every_extension_has_its_language(evaluate):
    pairs = [(e, lang) for lang, exts in K.LANGUAGE_EXTENSIONS.items() for e in exts]
    assert len(pairs) == 28 and len(K.LANGUAGE_EXTENSIONS) == 14
    assert evaluate(language.detect_language, ["f" + e for e, _ in pairs]) == [x for _, x in pairs]


def test_short_name(evaluate):
    assert evaluate(language.short_name, ["javascript", "tsx", "csharp", "java", None]) == [
        "js", "tsx", "cs", "java", "text",
    ]


def test_depth_and_hidden(evaluate):
    assert evaluate(paths.depth, ["a", "a/b", "a/b/c"]) == [1, 2, 3]
    values = [".x/a", "a/.x", "_x/a", "a/__init__.py", "a.b/c"]
    assert evaluate(paths.is_hidden, values) == [True, True, False, False, False]


def test_normalized(evaluate):
    values = ["a/b", "./a", "a/./b", "a/../b", "../b", "/a", "a//b/", ".", "", "a/..", "x/../../y"]
    expected = ["a/b", "a", "a/b", "b", None, None, "a/b", "", "", "", None]
    assert evaluate(paths.normalized, values) == expected


def test_ancestors_and_suffixes(evaluate):
    assert evaluate(paths.ancestor_dirs, ["a", "a/b", "a/b/c"]) == [[], ["a"], ["a", "a/b"]]
    assert evaluate(paths.path_suffixes, ["a", "a/b/c"]) == [["a"], ["c", "b/c", "a/b/c"]]
    # what is left in front of a suffix must not be hidden
    assert evaluate(paths.path_suffixes, ["a/.b/c", ".a/b/.c", "a/.b"]) == [
        [".b/c", "a/.b/c"], [".a/b/.c"], [".b", "a/.b"],
    ]


def test_path_score(evaluate):
    cases = {
        "src/a.ts": -16, "lib/x/a.ts": -9, "a.ts": 2, "x/test/a.ts": 36, "test/a.ts": 4,
        "src/__tests__/a.ts": 16, "a.ts.bak": 52, "x/tmp/a.ts": 46, "utils/a": -6, "pages/a": -6,
        "components/specs/a": 26, "SRC/A.ts": -16, "x/Temp/y.TMP": 96,
    }
    assert evaluate(paths.path_score, list(cases)) == list(cases.values())


def test_path_order_is_language_aware(frame):
    names = ["a", "B", "b", "_x", "a-b", "z", "é", "A/z", "a.ts"]
    df = frame([(n,) for n in names], "path string")
    got = [r["path"] for r in df.orderBy(paths.path_order(F.col("path")), "path").collect()]
    assert got == ["_x", "a", "a-b", "a.ts", "A/z", "b", "B", "é", "z"]


def test_tree_key_is_preorder(frame):
    """Against a recursive walk over a nested dict."""
    rng = random.Random(11)
    names = ["a", "b", "a-b", "a.ts", "B", "z z", "_x"]
    files = sorted({"/".join(rng.choices(names, k=rng.randint(1, 4))) + f".{i}" for i in range(200)})
    dirs = {"/".join(f.split("/")[:k]) for f in files for k in range(1, f.count("/") + 1)}

    def walk(prefix):
        here = [d for d in dirs if d.rpartition("/")[0] == prefix]
        for d in sorted(here, key=lambda p: p.rpartition("/")[2]):
            yield d + "/"
            yield from walk(d)
        yield from sorted(
            (f for f in files if f.rpartition("/")[0] == prefix), key=lambda p: p.rpartition("/")[2]
        )

    kind = "array<struct<kind:int,name:string>>"
    df = frame([(f, False) for f in files] + [(d, True) for d in dirs], "path string, dir boolean")
    keyed = df.select(
        F.when(F.col("dir"), F.concat("path", F.lit("/"))).otherwise(F.col("path")).alias("p"),
        F.when(F.col("dir"), paths.tree_key(F.col("path"), True).cast(kind))
        .otherwise(paths.tree_key(F.col("path"), False).cast(kind))
        .alias("key"),
    )
    assert [r["p"] for r in keyed.orderBy("key").collect()] == list(walk(""))
