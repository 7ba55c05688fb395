import glob
import os

import pytest

from sylvan import constants as K
from sylvan.operators import settings as cfg
from sylvan.operators import stats
from sylvan.plans import discovery, snapshot
from sylvan.sources import corpus, sinks, staging

TEXTS = "repo string, path string, size long, language string, content string"
ROWS = [
    ("org/demo", "z.ts", 8, "typescript", "let z = 1"),
    ("org/demo", "src/core/a.ts", 9, "typescript", "export class A {\n  m() {}\n}"),
    ("org/demo", "notes.txt", 2, None, "no\n"),
    ("org/demo", "src/b.js", 3, "javascript", "function b() {}"),
    ("org/two", "a.py", 3, "python", "def f(): pass"),
]


@pytest.fixture
def texts(frame):
    return frame(ROWS, TEXTS)


COMPACT = [
    "# demo (4 files, 7 lines)",
    "text:1 js:1 ts:2",
    "",
    K.LEGEND,
    K.LEGEND_FORMAT,
    "",
    "src/",
    "  core/",
    "    a.ts cls:A(m) exp:A",
    "  b.js fn:b",
    "notes.txt",
    "z.ts var:z",
]
RAW = (
    "# demo (4 files, 7 lines)\ntext:1 js:1 ts:2\n\n"
    "=== notes.txt ===\nno\n\n\n=== src/b.js ===\nfunction b() {}\n\n"
    "=== src/core/a.ts ===\nexport class A {\n  m() {}\n}\n\n=== z.ts ===\nlet z = 1\n"
)


def test_compact_snapshot(texts):
    lines = snapshot.compact_snapshot(texts).filter("repo = 'org/demo'").orderBy(*snapshot.compact_order())
    # languages come in the order of their first path: notes.txt, src/b.js, src/core/a.ts
    assert [r["line"] for r in lines.collect()] == COMPACT


def test_raw_snapshot(texts):
    blocks = snapshot.raw_snapshot(texts).filter("repo = 'org/demo'").orderBy(*snapshot.raw_order())
    assert "\n".join(r["block"] for r in blocks.collect()) == RAW


def test_header_of_a_scope(texts):
    head = stats.header_row(texts.selectExpr("*", "1L as line_count"), scope="src/core").filter("repo = 'org/two'").first()
    assert head["header"] == "# core (1 files, 1 lines)"


def test_written_snapshot_is_in_order(texts, frame, spark, tmp_path):
    many = frame([("org/big", f"d{i % 7}/f{i}.txt", 1, None, f"text {i}") for i in range(2000)], TEXTS)
    all_texts = texts.unionByName(many)
    lines = snapshot.compact_snapshot(all_texts)
    # small ranges would be merged into one file
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sinks.write_lines(lines, snapshot.compact_order(), str(tmp_path / "compact"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    def read(kind, repo):
        parts = sorted(glob.glob(str(tmp_path / kind / f"repo={repo.replace('/', '%2F')}" / "part-*.txt")))
        return "".join(open(p, encoding="utf-8").read() for p in parts), len(parts)

    assert read("compact", "org/demo")[0] == "\n".join(COMPACT) + "\n"
    text, n_parts = read("compact", "org/big")
    expected = [r["line"] for r in lines.filter("repo = 'org/big'").orderBy(*snapshot.compact_order()).collect()]
    # the large project is cut into several files, in order
    assert n_parts > 1 and text.splitlines() == expected
    sinks.write_lines(snapshot.raw_snapshot(texts), snapshot.raw_order(), str(tmp_path / "raw"), "block")
    assert read("raw", "org/demo")[0] == RAW + "\n"


def test_report(texts):
    index = staging.stage(snapshot.file_index(texts))
    row = stats.snapshot_report(index, snapshot.compact_lines(index)).filter("repo = 'org/demo'").first()
    original = sum(len(r[4]) for r in ROWS if r[0] == "org/demo")
    generated = len("\n".join(COMPACT))
    assert (row["n_files"], row["original_bytes"], row["generated_bytes"]) == (4, original, generated)
    assert row["ratio"] == f"{generated / original * 100:.1f}%" and row["band"] == "red"
    assert row["space_saved"] is None and row["space_added"] == f"{(generated - original) / 1024:.1f} KB"
    assert row["generated_tokens"] == -(-generated // 4)
    raw = stats.snapshot_report(index, snapshot.raw_snapshot(texts).withColumnRenamed("block", "line"), "raw")
    assert "ratio" not in raw.columns


def test_bands(evaluate):
    assert evaluate(stats.band, [9.99, 10.0, 24.9, 25.0], "double") == ["green", "yellow", "yellow", "red"]


def test_total_size_rounds_once(frame):
    facts = stats.with_facts(frame([("r", "a", "abcd"), ("r", "b", "efgh"), ("r", "c", "i"), ("r", "d", "j")], "repo string, path string, content string"))
    assert tuple(stats.total_size(facts).first()) == ("r", 10, "10.0 B", 3)


def test_prompts_and_formats(texts, frame):
    settings = cfg.settings_resolve(frame([("org/two", '{"outputFormat": "raw"}')], "repo string, config_json string"))
    rows = snapshot.llm_input(texts, settings).orderBy("repo", *snapshot.llm_order()).collect()
    by_repo = {repo: [r for r in rows if r["repo"] == repo] for repo in ("org/demo", "org/two")}
    assert {r["format"] for r in by_repo["org/demo"]} == {"compact"} and {r["format"] for r in by_repo["org/two"]} == {"raw"}
    demo = [r["line"] for r in by_repo["org/demo"]]
    assert demo[0] == K.PROMPT_COMPACT and demo[1] == "" and demo[2:] == COMPACT
    two = [r["line"] for r in by_repo["org/two"]]
    assert two == [K.PROMPT_RAW, "", "# two (1 files, 1 lines)", "py:1", "", "=== a.py ===\ndef f(): pass\n"]


def test_prompt_wording():
    compact, raw, request = K.PROMPT_COMPACT, K.PROMPT_RAW, K.PROMPT_REQUEST
    for part in ("compact structural index", "fn (functions)", "cls:ClassName(method1,method2)", "ask for it by its relative path"):
        assert part in compact
    assert "complete source" in raw and "=== relative/path ===" in raw and "ask for it by its relative path" not in raw
    for part in ("JSON array", "```json", '["src/a.ts", "src/b.ts"]'):
        assert part in request


def test_repo_profile(frame):
    rows = [
        ("a", ".gitignore", "# c\n\n*.log\n  \n #x\nbuild/\n"), ("a", ".snapshot/config.json", '{"exclude": ["x", "y"], "outputFormat": "raw"}'),
        ("a", "go.mod", ""), ("a", "package.json", "{}"), ("b", ".snapshot/config.json", "{bad"), ("b", "sub/go.mod", ""),
        ("c", "x", ""), ("d", ".snapshot/config.json", '{"outputFormat": "xml"}'),
    ]
    df = frame([(r, p, c.encode()) for r, p, c in rows], "repo string, path string, content binary")
    got = {r["repo"]: tuple(r)[1:] for r in stats.repo_profile(df).collect()}
    assert got["a"] == (True, 3, True, True, True, 2, "package.json,go.mod")
    assert got["b"] == (False, None, True, False, None, None, "")
    assert got["c"] == (False, None, False, None, None, None, "")
    assert got["d"] == (False, None, True, True, False, 0, "")


def test_tree_source(spark, tmp_path):
    files = {
        "one/a.py": b"x", "one/__init__.py": b"", "one/_p/q.py": b"q", "one/.env": b"e", "one/d/e/f/g.ts": b"gg", "two/z": b"\0\1", "two/__tests__/t.js": b"t",
    }
    for p, body in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(body)
    df = corpus.read_tree(spark, str(tmp_path))
    assert {f"{r['repo']}/{r['path']}": bytes(r["content"]) for r in df.collect()} == files
    assert all(r["size"] == len(r["content"]) for r in df.collect())
    one = corpus.read_tree(spark, str(tmp_path / "one"), repos="single", min_partitions="2")
    assert {r["path"] for r in one.collect()} == {p[4:] for p in files if p.startswith("one/")}
    assert {r["repo"] for r in one.collect()} == {"one"}
    found = discovery.read_texts(discovery.discover(df))
    assert {r["path"] for r in found.collect()} == {"a.py", "__init__.py", "_p/q.py", "d/e/f/g.ts", "__tests__/t.js"}


def test_tree_source_skips_what_is_no_file_or_too_big(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "small").write_bytes(b"x" * 10)
    (tmp_path / "r" / "big").write_bytes(b"x" * 11)
    os.mkfifo(tmp_path / "r" / "pipe")
    os.symlink(tmp_path / "r" / "gone", tmp_path / "r" / "dangling")
    assert {r["path"] for r in corpus.read_tree(spark, str(tmp_path)).collect()} == {"small", "big"}
    assert [r["path"] for r in corpus.read_tree(spark, str(tmp_path), max_size="10").collect()] == ["small"]


def test_staged_tables_go_to_the_shared_folder(spark, frame):
    df = staging.stage(frame([("r", 1)], "repo string, n int"))
    assert df.collect()[0]["n"] == 1
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(os.path.abspath(folder) in f for f in df.inputFiles())
