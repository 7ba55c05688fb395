import fnmatch
import random

from sylvan import constants as K
from sylvan.operators import lookup
from sylvan.plans import extraction

FILES = "repo string, path string, content binary"
REQUESTS = "repo string, req_no int, requested string"


def score(path):
    low, total = path.lower(), 2 * (path.count("/") + 1)
    total += sum(n for start, n in K.START_SCORES if low.startswith(start))
    return total + sum(n for parts, n in K.CONTAINS_SCORES if any(p in low for p in parts))


def model(request, paths):
    """Reference behaviour for one request: (path, strategy, hits)."""
    parts = []
    for part in request.split("/"):
        if part == "..":
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    norm = "/".join(parts)
    if norm in paths:
        return norm, "exact", []
    if any(p.startswith(norm + "/") for p in paths) or not norm:
        return None, "exact", []
    skip = set(K.SEARCH_SKIP_DIRS)
    hits = []
    request = request.removeprefix("**/")
    for p in paths:
        steps, wanted = p.split("/"), request.split("/")
        front, tail = steps[: -len(wanted)], steps[-len(wanted):]
        if any(s.startswith(".") for s in front) or skip & set(steps) or len(steps) < len(wanted):
            continue
        # a wildcard does not stand for a leading dot
        if all(
            fnmatch.fnmatchcase(a, b) and not (a.startswith(".") and b[0] in "*?[") for a, b in zip(tail, wanted)
        ):
            hits.append(p)
    hits.sort(key=lambda p: (score(p), len(p), p))
    return (hits[0], "search", hits) if hits else (None, None, [])


def test_resolve_against_brute_force(frame):
    rng = random.Random(4)
    dirs = ["src", "lib", "test", "x", "node_modules", ".cache", "tmp", "dist", "__tests__"]
    names = ["a.ts", "b.ts", "index.js", "a.ts.bak", ".env", "dist"]
    trees = {}
    for repo in ("r0", "r1", "r2"):
        paths = {"/".join([*rng.choices(dirs, k=rng.randint(0, 3)), rng.choice(names)]) for _ in range(60)}
        trees[repo] = {p for p in paths if not any(q.startswith(p + "/") for q in paths)}
    requests = []
    for repo, paths in trees.items():
        pool = [*names, "src/a.ts", "x/index.js", "./src/../x/a.ts", "src", "lib/", "gone.x", "*.js", "?.ts", "src/*", "x/?.ts", "test/./a.ts", ".cache/a.ts", ".env", "*/.env", "*nv", ".*", "**/.env", "dist"]
        requests += [(repo, i, rng.choice([*pool, rng.choice(sorted(paths))])) for i in range(60)]
    files = frame([(r, p, b"x") for r, ps in trees.items() for p in ps], FILES)
    asked = frame(requests, REQUESTS)
    got = {(r["repo"], r["req_no"]): r for r in lookup.resolve(asked, files).collect()}
    assert len(got) == len(requests)
    for repo, i, request in requests:
        path, strategy, hits = model(request, trees[repo])
        row = got[(repo, i)]
        assert (row["path"], row["strategy"]) == (path, strategy), request
        assert row["n_matches"] == (len(hits) if strategy == "search" else int(path is not None)), request
    others = {}
    for r in lookup.alternatives(asked, files).collect():
        others.setdefault((r["repo"], r["requested"]), set()).add(r["path"])
    for repo, _, request in requests:
        path, strategy, hits = model(request, trees[repo])
        if strategy == "search":
            assert others.get((repo, request), set()) == set(hits[1:])


def test_wildcards_meet_only_files_with_their_rarest_piece(frame):
    rng = random.Random(8)
    dirs = ["src", "lib", "src/core", "web/app"]
    paths = [f"{rng.choice(dirs)}/{rng.choice(['view', 'model', 'util'])}{i}.{rng.choice(['ts', 'js', 'py'])}" for i in range(600)]
    paths += ["src/Makefile", "lib/readme.md", "web/app/a", "a", "x.c"]
    files = frame([("r", p, b"x") for p in paths], FILES)
    asked = ["readme*", "*77.ts", "view1?.js", "{lib,web}/*.md", "M[a-z]kefile", "?", "*.c", "none*.zip", "src/core/view?.ts", "lib*/m*9.py", "*"]
    requests = frame([("r", i, a) for i, a in enumerate(asked)], REQUESTS)
    met = lookup._glob_candidates(files, lookup._names(requests), K.SETTINGS_DIR)
    tested = {}
    for row in met.collect():
        for p in row["patterns"]:
            tested.setdefault(p["requested"], set()).add(row["path"])
    hits = {}
    for row in lookup.resolve_search(requests, files).collect():
        hits.setdefault(row["requested"], set()).add(row["path"])
    for name in asked:
        assert hits.get(name, set()) <= tested.get(name, set()), name
        body = name.replace("{lib,web}", "@").replace("[a-z]", "?")
        steps = body.split("/")
        want = {
            p for p in paths
            if len(p.split("/")) >= len(steps)
            and all(
                a in ("lib", "web") if b == "@" else fnmatch.fnmatchcase(a, b)
                for a, b in zip(p.split("/")[-len(steps):], steps)
            )
        }
        assert hits.get(name, set()) == want, name
    assert "none*.zip" not in tested and tested["readme*"] == {"lib/readme.md"} and tested["*.c"] == {"x.c"}
    assert len(tested["*77.ts"]) < 12 and len(tested["M[a-z]kefile"]) == 1
    # only wildcards without a fixed character meet every file
    assert {n for n, t in tested.items() if len(t) == len(paths)} == {"?", "*"}


def test_best_hits_are_found_without_a_sort_of_the_hits(frame):
    files = frame([("r", f"{d}/{n}", b"x") for d in ("b", "a", "c/d") for n in ("x.ts", "y.ts")], FILES)
    requests = frame([("r", 0, "x.ts"), ("r", 1, "*.ts"), ("r", 2, "y.ts")], REQUESTS)
    best = lookup.resolve_best(requests, files)
    got = {r["requested"]: (r["path"], r["score"], r["n_matches"]) for r in best.collect()}
    assert got == {"x.ts": ("a/x.ts", 4, 3), "*.ts": ("a/x.ts", 4, 6), "y.ts": ("a/y.ts", 4, 3)}
    plan = best._jdf.queryExecution().executedPlan().toString()
    # text is compared among equal hits only
    sorted_by = [line for line in plan.splitlines() if "SortAggregate" in line]
    assert all("min(path" in line and "rank" not in line for line in sorted_by)


def test_one_hot_name(frame):
    """A third of all files share a name; a request for it is asked for often."""
    files = frame([("r", f"d{i}/index.js" if i % 3 else f"d{i}/u{i}.js", b"x") for i in range(3000)], FILES)
    asked = frame([("r", i, "index.js") for i in range(500)], REQUESTS)
    got = lookup.resolve(asked, files).groupBy("path", "n_matches").count().collect()
    assert [tuple(r) for r in got] == [("d1/index.js", 2000, 500)]


def test_many_globs_go_in_bundles(frame):
    files = frame([("r", f"d/f{i}.ts", b"x") for i in range(300)], FILES)
    asked = frame([("r", i, f"f{i}.?s") for i in range(300)], REQUESTS)
    got = {r["req_no"]: r["path"] for r in lookup.resolve(asked, files).collect()}
    assert got == {i: f"d/f{i}.ts" for i in range(300)}


def test_extraction(frame):
    files = frame(
        [("r", "src/a.ts", "aé\n".encode()), ("r", "b.bin", b"\0x"), ("r", "q/c.ts", b"c"), ("r", "node_modules/n.js", b"n"), ("s", "z", b"")],
        FILES,
    )
    asked = frame(
        [("r", 0, "c.ts"), ("r", 1, "src/a.ts"), ("r", 2, "b.bin"), ("r", 3, "src"), ("r", 4, "nope"), ("r", 5, "c.ts"), ("r", 6, "n.js"), ("r", 7, "node_modules/n.js")],
        REQUESTS,
    )
    extracted = extraction.extract(asked, files)
    blocks = [r["block"] for r in lookup.extract_blocks(extracted).orderBy("req_no").collect()]
    assert blocks == [
        "=== q/c.ts ===\n\nc\n", "=== src/a.ts ===\n\naé\n\n", "=== q/c.ts ===\n\nc\n", "=== node_modules/n.js ===\n\nn\n",
    ]
    missing = [(r["requested"], r["status"]) for r in lookup.missing_requests(extracted).orderBy("req_no").collect()]
    assert missing == [("b.bin", "binary"), ("src", "directory"), ("nope", "not_found"), ("n.js", "not_found")]
    report = lookup.extract_report(extracted).first().asDict()
    assert report == {
        "repo": "r", "requested": 8, "found": 4, "extracted": 4, "missing": 4, "bytes": 7, "formatted": "7.0 B", "tokens": 2,
    }


def test_request_lists(frame):
    rows = frame(
        [("a", " x.ts ,, src/y.ts,", ["z"]), ("b", " , ", ["p", "q", "p"]), ("c", None, ["z"]), ("d", "", None)],
        "repo string, files string, fallback array<string>",
    )
    got = sorted(tuple(r) for r in lookup.requests_from_list(rows).collect())
    assert got == [("a", 0, "x.ts"), ("a", 1, "src/y.ts"), ("b", 0, "p"), ("b", 1, "q"), ("b", 2, "p"), ("c", 0, "z")]
    replies = frame(
        [("a", f'Here:\n```json\n["src/a.ts", "src/a.ts", "b"]\n```\nbye'), ("b", '["x"]'), ("c", "no array")],
        "repo string, reply string",
    )
    got = sorted(tuple(r) for r in lookup.requests_from_json(replies).collect())
    assert got == [("a", 0, "src/a.ts"), ("a", 1, "src/a.ts"), ("a", 2, "b"), ("b", 0, "x")]


def test_prompt_for_requests_is_read_back(frame):
    replies = frame([("r", K.PROMPT_REQUEST)], "repo string, reply string")
    assert [r["requested"] for r in lookup.requests_from_json(replies).collect()] == ["src/a.ts", "src/b.ts"]


def test_no_nested_loops(frame):
    files = frame([("r", "a", b"x")], FILES)
    asked = frame([("r", 0, "a")], REQUESTS)
    plan = lookup.resolve(asked, files)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
