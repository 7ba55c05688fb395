import random
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from sylvan.functions import globs
from sylvan.operators import filters, ignore
from sylvan.operators import settings as cfg
from sylvan.plans import discovery
from sylvan.sources import corpus


def kept(df):
    return sorted(r["path"] for r in df.select("path").collect())


@pytest.fixture
def files(frame):
    def make(paths, size=1, content=b"x"):
        return frame([("r", p, size, content) for p in paths], "repo string, path string, size long, content binary")

    return make


def test_limits_are_inclusive(frame):
    df = frame([("r", "a", 10), ("r", "b", 11)], "repo string, path string, size long")
    assert kept(filters.max_size(df, 10)) == ["a"]
    deep = frame([("r", "/".join("abcdefghij")), ("r", "/".join("abcdefghijk"))], "repo string, path string")
    assert kept(filters.max_depth(deep, 10)) == ["a/b/c/d/e/f/g/h/i/j"]
    assert kept(filters.max_depth(deep, 0)) == []


def test_builtin_excludes(files):
    df = files(["yarn.lock", "a/b/Cargo.lock", "a/yarn.locks", ".git/x", "a/.git/b/c", "git/x", ".snapshot/o", "go.sum"])
    assert kept(filters.exclude_builtin(df)) == ["a/yarn.locks", "git/x"]
    assert kept(filters.exclude_builtin(files([".tool/x", ".snapshot/x"]), ".tool")) == [".snapshot/x"]


def test_user_globs(files):
    paths = ["src/a.spec.ts", "a.spec.ts", "docs/x/y", "docs", "mydocs/x", "x/docs/y", "lib/a.js", "lib/b.ts", "q1.c", "q12.c"]
    df = files(paths)
    assert kept(filters.exclude_globs(df, ["**/*.spec.ts"])) == sorted(p for p in paths if "spec" not in p)
    assert kept(filters.exclude_globs(df, ["docs"])) == sorted(set(paths) - {"docs/x/y", "docs"})
    assert kept(filters.exclude_globs(df, ["**/docs/**"])) == sorted(set(paths) - {"docs/x/y", "docs", "x/docs/y"})
    assert kept(filters.exclude_globs(df, ["lib/*.{js,ts}", "q?.c"])) == sorted(set(paths) - {"lib/a.js", "lib/b.ts", "q1.c"})
    assert kept(filters.exclude_globs(df, [])) == sorted(paths)
    for same in ("docs/", "docs/**", "./docs", "doc*/**", "d?cs"):
        assert kept(filters.exclude_globs(df, [same])) == sorted(set(paths) - {"docs/x/y", "docs"}), same
        own = df.select("path", globs.exclude_regex_column(F.array(F.lit(same))).alias("re"))
        assert kept(own.filter(~globs.matches(F.col("path"), F.col("re")))) == sorted(set(paths) - {"docs/x/y", "docs"}), same


GLOBS = [
    "*.py", "src/**/a?.ts", "{a,b}.js", "{a,b,cc}x,y{d,e}", "a(b).c", "[!x]y", "**", "**/x", "x/**", "[a-c]1",
    "a+b", "x{", "a.b", "src/*", "**/*.spec.ts", "{src/z,b1}", r"a\+b", "?", "[^x]y",
]
NAMES = [
    "a.py", "x/a.py", "src/ab.ts", "src/q/w/ab.ts", "a.js", "c.js", "ax,ye", "ccx,yd", "a(b).c", "zy", "xy",
    "x", "q/x", "x/q", "x/q/w", "b1", "d1", "a+b", "aab", "x{", "axb", "a.b", "src/z", "k.spec.ts", "k/l.spec.ts",
]


def glob_model(glob, name):
    """A glob read character by character, without regular expressions."""
    if not glob:
        return not name
    if glob.startswith("**/"):
        rest = glob[3:]
        return glob_model(rest, name) or any(
            c == "/" and i and glob_model(rest, name[i + 1 :]) for i, c in enumerate(name)
        )
    if glob == "**":
        return bool(name)
    if glob[0] == "*":
        rest = glob.lstrip("*")
        return any(glob_model(rest, name[i:]) for i in range(len(name.split("/")[0]) + 1))
    if glob[0] == "?":
        return bool(name) and name[0] != "/" and glob_model(glob[1:], name[1:])
    if glob[0] == "{" and "," in glob[: glob.find("}") + 1]:
        end = glob.index("}")
        return any(glob_model(choice + glob[end + 1 :], name) for choice in glob[1:end].split(","))
    if glob[0] == "[" and "]" in glob[2:]:
        end = glob.index("]", 2)
        body, negated = glob[1:end], glob[1] in "!^"
        chars = body[negated:]
        spans = {chr(c) for x, y in re.findall("(.)-(.)", chars) for c in range(ord(x), ord(y) + 1)}
        inside = bool(name) and name[0] in spans | set(re.sub(".-.", "", chars))
        return bool(name) and name[0] != "/" and inside != negated and glob_model(glob[end + 1 :], name[1:])
    if glob[0] == "\\" and len(glob) > 1:
        glob = glob[1:]
    return name[:1] == glob[0] and glob_model(glob[1:], name[1:])


def test_globs_agree_with_a_model(frame):
    rows = frame([(g, n) for g in GLOBS for n in NAMES], "g string, n string").select(
        "g", "n", globs.matches(F.col("n"), F.concat(F.lit("^"), globs.glob_regex_column(F.col("g")), F.lit("$"))).alias("hit")
    )
    for r in rows.collect():
        assert r["hit"] == glob_model(r["g"], r["n"]), r


def test_every_entry_point_reads_globs_alike(frame):
    """Arguments and settings, on patterns of which some are odd."""
    rng = random.Random(5)
    odd = ["{src/a,docs}", "a**b", r"a\*b", "{a}", "[z-a].ts", "[[:alpha:]]*", "src/*", "**/b"]
    odd += ["".join(rng.choices(["a", "b", "/", "*", "**/", "?", "{a,b}", "[ab]", "."], k=rng.randint(1, 5))) for _ in range(30)]
    paths = ["src/a/x", "docs/y", "ab", "a/b", "a*b", "a", "{a}", "z.ts", "src/a", "b", "b/a.b", "axb", "q/b/c"]
    df = frame([("r", p, 1, b"") for p in paths], "repo string, path string, size long, content binary")
    for glob in odd:
        settings = frame([("r", 9, 9, [glob])], "repo string, max_depth int, max_file_size long, exclude array<string>")
        by_argument = kept(filters.exclude_globs(df, [glob]))
        gone = {r["path"] for r in discovery.rejected_by_settings(df, settings).collect()}
        assert by_argument == sorted(set(paths) - gone), glob


def test_any_pattern_gives_a_valid_regex(frame):
    rng = random.Random(1)
    odd = ["".join(rng.choices("ab[]{}()*?!\\^$.|+-,/&#", k=rng.randint(1, 8))) for _ in range(3000)]
    df = frame([(p,) for p in odd], "p string")
    for translate in (globs.glob_regex_column, globs.ignore_regex_column):
        hits = df.select(globs.matches(F.lit("a/b"), translate(F.col("p"))).alias("h"))
        assert hits.count() == len(odd) and hits.agg(F.count_if("h")).first()[0] >= 0


def _ignored(spark, tree, ignore_case=False):
    rows = [("r", p, c.encode()) for p, c in tree.items()]
    df = spark.createDataFrame(rows, "repo string, path string, content binary")
    return {r["path"] for r in ignore.ignored_paths_by(df, df, ignore_case).collect()}


def test_ignore_rules(spark):
    tree = {p: "" for p in [
        "a.log", "x/a.log", "keep.log", "dist/a", "x/dist/a", "build/o", "x/build/o", "x/build", "a/b", "a/q/b",
        "a/q/w/b", "nested/n.tmp", "nested/d/n.tmp", "n.tmp", "# c", "Up.LOG",
    ]}
    del tree["x/build/o"]
    tree[".gitignore"] = "# c\n\n*.log\n/dist\nbuild/\n!keep.log\na/**/b\n"
    tree["nested/.gitignore"] = "*.tmp\r\n"
    gone = _ignored(spark, tree)
    assert gone == {"a.log", "x/a.log", "dist/a", "build/o", "a/b", "a/q/b", "a/q/w/b", "nested/n.tmp", "nested/d/n.tmp"}
    assert _ignored(spark, tree, True) - gone == {"Up.LOG"}


def test_nothing_below_a_dropped_directory_comes_back(spark):
    tree = {"d/a.txt": "", "d/b.txt": "", "e/a.txt": "", ".gitignore": "d/\n!d/a.txt\ne/*\n!e/a.txt\n"}
    assert _ignored(spark, tree) == {"d/a.txt", "d/b.txt"}


def test_ignore_rules_agree_with_git(spark, tmp_path):
    rng = random.Random(7)
    parts = ["a", "b", "src", "x.log", "y.txt", "foo", "lib1", "Z"]
    lines = [
        "*.log", "/a", "b/", "!x.log", "src/*.txt", "a/**/b", "**/foo", "foo/**", "lib?", "[ab]", "!foo/", "src",
        "/src/a", "*", "!*/", "!*.txt", "y.*", "\\!x", "a/b", "lib[0-9]", "[!a-y]", "x.log ", "# no", "", "**/src/*",
    ]
    for round_no in range(12):
        paths = {"/".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(60)}
        # a path cannot be file and directory at once
        paths = {p for p in paths if not any(q.startswith(p + "/") for q in paths)}
        tree = {p: "" for p in paths}
        tree[".gitignore"] = "\n".join(rng.sample(lines, 5))
        for base in ("a", "src", "foo/b"):
            if any(p.startswith(base + "/") for p in paths):
                tree[base + "/.gitignore"] = "\n".join(rng.sample(lines, 3))
        root = tmp_path / str(round_no)
        for p, content in tree.items():
            (root / p).parent.mkdir(parents=True, exist_ok=True)
            (root / p).write_text(content)
        subprocess.run(["git", "init", "-q", str(root)], check=True)
        found = subprocess.run(
            ["git", "-c", "core.ignorecase=false", "-c", "core.excludesFile=/dev/null", "check-ignore", "--no-index", "--stdin"],
            cwd=root, input="\n".join(tree), capture_output=True, text=True,
        )
        assert _ignored(spark, tree) == set(found.stdout.split("\n")) - {""}, tree


def test_scope(files):
    df = filters.scope_dir(files(["src/a/b.ts", "src/c.ts", "srcs/d.ts", "e.ts"]), "./src/".lstrip("./"))
    assert kept(df) == ["a/b.ts", "c.ts"]


SETTINGS_SCHEMA = "repo string, config_json string"


def test_settings_precedence(frame):
    rows = [
        ("all", '{"maxDepth": 7, "maxFileSize": 5, "outputFormat": "raw", "exclude": ["**/*.spec.ts"]}'),
        ("zero", '{"maxDepth": 0, "generateSyntaxTree": false}'),
        ("none", None),
        ("bad", "{ not valid json"),
        ("odd", '{"outputFormat": "nonsense"}'),
        ("half", '{"maxDepth": 3, "maxFileSize": 9'),
    ]
    df = frame(rows, SETTINGS_SCHEMA)
    got = {r["repo"]: r for r in cfg.settings_resolve(df).collect()}
    assert (got["all"]["max_depth"], got["all"]["output_format"], got["all"]["exclude"]) == (7, "raw", ["**/*.spec.ts"])
    assert (got["zero"]["max_depth"], got["zero"]["generate_syntax_tree"]) == (0, False)
    for repo in ("none", "bad", "odd", "half"):
        r = got[repo]
        assert (r["max_depth"], r["max_file_size"], r["output_format"], r["exclude"]) == (10, 1048576, "compact", [])
    given = cfg.settings_resolve(df, max_depth=3, output_format="compact").collect()
    assert {r["max_depth"] for r in given} == {3} and {r["output_format"] for r in given} == {"compact"}
    with pytest.raises(ValueError):
        cfg.settings_resolve(df, output_format="xml")


def test_settings_file_of_a_corpus(frame):
    df = frame([("r", ".snapshot/config.json", b"{}"), ("r", "config.json", b"x")], "repo string, path string, content binary")
    assert [(r["repo"], r["config_json"]) for r in cfg.settings_rows(df).collect()] == [("r", "{}")]


def test_discover(frame):
    rows = [
        ("r", "src/a.ts", 3, b"abc"), ("r", "src/.h.ts", 3, b"abc"), ("r", "yarn.lock", 3, b"abc"),
        ("r", "big.ts", 2_000_000, b"abc"), ("r", "x.log", 3, b"abc"), ("r", ".gitignore", 5, b"*.log"),
        ("r", "e/x.ts", 3, b"abc"), ("s", "x.log", 3, b"abc"), ("s", "a/b/c.py", 3, b"abc"), ("s", "z.bin", 3, b"a\0c"),
    ]
    df = frame(rows, "repo string, path string, size long, content binary")
    plain = discovery.discover(df, exclude=["e"])
    got = sorted((r["repo"], r["path"], r["language"]) for r in plain.collect())
    assert got == [("r", "src/a.ts", "typescript"), ("s", "a/b/c.py", "python"), ("s", "x.log", None), ("s", "z.bin", None)]
    assert "z.bin" not in kept(discovery.read_texts(plain))
    settings = cfg.settings_resolve(frame([("s", '{"maxDepth": 2, "exclude": ["*.log"]}')], SETTINGS_SCHEMA))
    own = discovery.discover(df, settings=settings, gitignore=False)
    assert kept(own) == ["e/x.ts", "src/a.ts", "x.log", "z.bin"]
    assert kept(discovery.discover(df, scope="src")) == ["a.ts"]
    apart = corpus.project_files(df)
    assert kept(apart) == [".gitignore"]
    again = discovery.discover(df, exclude=["e"], ignore_files=apart)
    assert sorted((r["repo"], r["path"], r["language"]) for r in again.collect()) == got


def test_size_limit_reaches_the_scan(spark, tmp_path, frame):
    frame([("r", "a.ts", 3, b"abc")], "repo string, path string, size long, content binary").write.parquet(str(tmp_path / "f"))
    df = discovery.discover(spark.read.parquet(str(tmp_path / "f")), gitignore=False).select("repo", "path", "size")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(size,1048576)" in plan and "content" not in plan.split("ReadSchema")[1]


def test_bucketed_table_keeps_content_in_place(spark, frame):
    rows = [("r", f"a{i}.ts" if i % 2 else f"a{i}.log", 1, b"x") for i in range(50)] + [("r", ".gitignore", 5, b"*.log")]
    df = frame(rows, "repo string, path string, size long, content binary")
    spark.sql("DROP TABLE IF EXISTS corpus_files")
    corpus.save_bucketed(df, "corpus_files", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = discovery.discover(spark.table("corpus_files"))
        assert found.count() == 25
        plan = found._jdf.queryExecution().executedPlan().toString()
        # the left side of the anti join: scan, filter, sort, and no exchange
        left = plan.split("LeftAnti")[1].split("Exchange")[0]
        assert "FileScan" in left and "content" in left
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE corpus_files")


def test_an_argument_outweighs_settings(frame):
    df = frame([("r", p, 5, b"x") for p in ("a.ts", "a/b.ts", "a/b/c.ts")], "repo string, path string, size long, content binary")
    own = cfg.settings_resolve(frame([("r", '{"maxDepth": 2, "maxFileSize": 9}')], "repo string, config_json string"))
    found = lambda **k: kept(discovery.discover(df, settings=own, gitignore=False, **k))
    assert found() == ["a.ts", "a/b.ts"]
    assert found(max_depth=1) == ["a.ts"] and len(found(max_depth=3)) == 3
    assert found(max_file_size=4) == [] and found(max_depth=0) == []


def test_validity_of_settings(frame):
    texts = ['{"maxDepth": 3, "maxDepth": 4}', '{"maxDepth": 3} trailing', '{"maxDepth": 3', "{'maxDepth': 3}", "", None, " {} ", '{"maxDepth": 3}{}']
    rows = frame([(str(i), t) for i, t in enumerate(texts)], "repo string, config_json string")
    got = {r["repo"]: r["max_depth"] for r in cfg.settings_resolve(rows).collect()}
    assert [got[str(i)] for i in range(len(texts))] == [4, 10, 10, 10, 10, 10, 10, 10]
