"""The queries in plain SQL, for another engine to check the results.

Views and operators are written again here with CTEs; only fixed lists and
patterns are shared with the Spark side.
"""

from __future__ import annotations

from sylvan import constants as K
from workload import code
from workload import views as V
from workload.code import CYCLE, LINES


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def qlist(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def qin(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def pick(values, index: str) -> str:
    return f"list_extract({qlist(values)}, ({index})::INT + 1)"


SPACE = f"[{K.SPACE_SET}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def base(path: str) -> str:
    return f"list_extract(str_split({path}, '/'), -1)"


def ext(path: str) -> str:
    return f"regexp_extract({base(path)}, '^.+(\\.[^.]*)$', 1)"


def n_of(x: str, mark: str) -> str:
    return f"(length({x}) - length(replace({x}, {mark}, '')))"


def depth(path: str) -> str:
    return f"len(str_split({path}, '/'))"


def units(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def tokens(n: str) -> str:
    return f"(({n} + 3) // 4)::BIGINT"


def tenths(n: str, unit: int) -> str:
    t = f"((20 * ({n})::HUGEINT + {unit}) // {2 * unit})"
    return f"({t} // 10) || '.' || ({t} % 10)"


def format_bytes(n: str) -> str:
    cases = [f"WHEN {n} = 0 THEN '0 B'"]
    for i, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        cases.append(f"WHEN {n} < {1024 ** (i + 1)} THEN {tenths(n, 1024**i)} || ' {unit}'")
    return "CASE " + " ".join(cases) + " END"


def format_count(n: str) -> str:
    def of(unit: int, mark: str) -> str:
        # an exact quarter rounds up, all else is decided by the stored double
        return (
            f"CASE WHEN {n} % {unit} = {unit // 4} THEN ({n} // {unit}) || '.3{mark}' "
            f"ELSE printf('%.1f', {n}::DOUBLE / {unit}) || '{mark}' END"
        )

    return f"CASE WHEN {n} < 1000 THEN ({n})::VARCHAR WHEN {n} < 1000000 THEN {of(1000, 'k')} ELSE {of(1000000, 'm')} END"


_EXT_CASE = "\n".join(
    f"WHEN lower({{e}}) IN {qin(exts)} THEN {q(lang)}" for lang, exts in K.LANGUAGE_EXTENSIONS.items()
)


def language(path: str) -> str:
    return "CASE " + _EXT_CASE.replace("{e}", ext(path)) + " END"


_CONTROLS = [f"{b:02X}" for b in [*range(1, 9), 11, *range(14, 32), 127]]


def is_binary(content: str) -> str:
    pairs = f"regexp_extract_all(substr(hex({content}), 1, {2 * K.BINARY_SAMPLE_BYTES}), '..')"
    return (
        f"(strlen({content}) > 0 AND (list_contains({pairs}, '00') OR "
        f"len(list_filter({pairs}, lambda b: b IN {qin(_CONTROLS)})) > 0.3 * len({pairs})))"
    )


def short(lang: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in K.LANGUAGE_SHORT_NAMES.items())
    return f"CASE coalesce({lang}, 'text') {cases} ELSE coalesce({lang}, 'text') END"


def word(line: str) -> str:
    return f"CASE WHEN regexp_extract({line}, '[A-Za-z]+') <> '' THEN regexp_extract({line}, '[A-Za-z]+') ELSE 'x' END"


HIDDEN = "regexp_matches(path, '(^|/)\\.')"
BUILTIN = (
    f"({base('path')} IN {qin(K.LOCKFILES)} OR regexp_matches(path, '(^|/)(\\.git|\\.snapshot)(/|$)'))"
)
# the user globs of the exclude_user query, by hand
USER_REGEX = (
    r"^(docs|([^/]+/)*[^/]*\.rs|lib|(a|x)/b/[^/]*/d|([^/]+/)*fr[^/][^/]\.[^/]*)(/.*)?$"
)

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


def sql(final: str, *deps: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in CTES[name][0]:
                visit(dep)
            order.append(name)

    for dep in deps:
        visit(dep)
    parts = [f"{name} AS MATERIALIZED (\n{CTES[name][1]}\n)" for name in order]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final


# --- views -------------------------------------------------------------------
cte(
    "files",
    [],
    f"""SELECT *, strlen(content)::BIGINT AS size FROM (
SELECT doc_id, source || '/r' || (doc_id // 500) AS repo,
  {pick(V.FILE_DIRS, 'doc_id % 12')} || CASE
    WHEN doc_id % 23 = 0 THEN 'p' || doc_id || '/yarn.lock'
    WHEN doc_id % 29 = 0 THEN 'v' || doc_id || '/.git/config'
    WHEN doc_id % 37 = 0 THEN '.hidden' || doc_id
    ELSE lang || doc_id || {pick(V.FILE_EXTS, 'doc_id % 17')} END AS path,
  CASE WHEN doc_id % 11 = 0 THEN chr(0) || text
    WHEN doc_id % 19 = 0 THEN repeat(chr(1), length(text)) || text
    WHEN doc_id % 13 = 0 THEN repeat(chr(2), length(text) // 4) || text
    ELSE text END AS content
FROM documents)""",
)
cte(
    "texts",
    ["files"],
    f"""SELECT *, {language('path')} AS language, {n_of('content', 'chr(10)')} + 1 AS line_count,
  strlen(content) AS bytes, {units('content')} AS units
FROM files WHERE NOT {is_binary('content')}""",
)
_codes = list(LINES)
cte(
    "code_files",
    [],
    f"""SELECT *, strlen(content)::BIGINT AS size FROM (
SELECT source || '/r' || (doc_id // 500) AS repo,
  {pick(V.CODE_DIRS, 'doc_id % 7 % 6')} || lang || doc_id || {pick(_codes, f'doc_id % {len(_codes)}')} AS path,
  array_to_string(list_transform(str_split(text, chr(10)), lambda line, n:
    replace(list_extract(list_extract([{', '.join(qlist(LINES[c]) for c in _codes)}], (doc_id % {len(_codes)})::INT + 1), ((n - 1) % {CYCLE})::INT + 1),
      '¤', ({word('line')}) || ((n - 1) % 3)) || chr(10) || {pick([V.COMMENT_MARKS.get(c, '// ') for c in _codes], f'doc_id % {len(_codes)}')} || line), chr(10)) AS content
FROM documents)""",
)
cte(
    "code_texts",
    ["code_files"],
    f"""SELECT *, {language('path')} AS language, {n_of('content', 'chr(10)')} + 1 AS line_count,
  strlen(content) AS bytes, {units('content')} AS units FROM code_files""",
)
_n = len(V.NODES)
_above = ", ".join((qlist(a) if a else "[]::VARCHAR[]") for a in V.ANCESTORS)
cte(
    "raw_nodes",
    [],
    f"""SELECT repo, path, seq, line,
  {pick([t for t, _ in V.NODES], f'(seq + doc_id) % {_n}')} AS node_type,
  replace(replace({pick([t if '~' in t else t + V.NODE_COMMENT + '~' for _, t in V.NODES], f'(seq + doc_id) % {_n}')}, '@', {word('raw')}), '~', raw) AS node_text,
  list_extract([{_above}], (seq % {len(V.ANCESTORS)})::INT + 1) AS ancestor_types
FROM (SELECT doc_id, source || '/r' || (doc_id // 500) AS repo, 'd' || doc_id || '.ts' AS path,
    unnest(str_split(text, chr(10))) AS raw,
    (generate_subscripts(str_split(text, chr(10)), 1) - 1)::INT AS seq,
    generate_subscripts(str_split(text, chr(10)), 1)::INT AS line
  FROM documents)""",
)
_TAIL = "regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1)"
cte(
    "page_names",
    [],
    f"""SELECT page_id, html, regexp_extract(url, '^https?://[^/]*?([a-z]+[.][a-z]+)/', 1) AS repo,
  {pick(V.PAGE_DIRS, 'page_id % 9')} AS dir,
  CASE WHEN ends_with({_TAIL}, '/') THEN {_TAIL} || 'index.html' ELSE {_TAIL} END AS name
FROM pages""",
)
cte(
    "page_files",
    ["page_names"],
    """SELECT repo, dir || name AS path,
  arg_min(CASE WHEN page_id % 11 = 0 THEN chr(0) || html ELSE html END, page_id) AS content
FROM page_names GROUP BY ALL""",
)
cte(
    "requests",
    ["page_names"],
    f"""SELECT repo, page_id AS req_no, CASE page_id % 7
  WHEN 0 THEN dir || name
  WHEN 1 THEN {base('name')}
  WHEN 2 THEN 'gone' || page_id || '.x'
  WHEN 3 THEN './' || dir || 'q/../' || name
  WHEN 4 THEN dir || str_split(name, '/')[1]
  WHEN 5 THEN name
  ELSE substr({base('name')}, 1, 1) || '?*' END AS requested
FROM page_names""",
)

# --- ignore files ------------------------------------------------------------
# the rules of views.IGNORE_FILES, translated by hand
_RULES = [
    ("", 3, r"^(.*/)?[^/]*\.log$", False, False),
    ("", 4, r"^test$", False, False),
    ("", 5, r"^(.*/)?build$", False, True),
    ("", 6, r"^(.*/)?en[^/]*\.log$", True, False),
    ("", 7, r"^src/(.*/)?de[^/]*$", False, False),
    ("", 8, r"^(.*/)?[^/]*\.txt$", False, False),
    ("src", 1, r"^(.*/)?[^/]*\.ts$", False, False),
    ("src", 2, r"^(.*/)?fr[^/]*\.ts$", True, False),
    ("src", 3, r"^(.*/)?core$", False, True),
]
cte(
    "rules",
    ["files"],
    f"""SELECT * FROM (SELECT DISTINCT repo FROM files), (VALUES
  {', '.join(f"({q(b)}, {n}, {q(r)}, {neg}, {d})" for b, n, r, neg, d in _RULES)}
  ) AS v(base_dir, rule_no, regex, negated, dir_only)
WHERE base_dir = '' OR length(repo) % 2 = 0""",
)
cte(
    "all_paths",
    ["files", "rules"],
    """SELECT repo, path FROM files
UNION ALL SELECT DISTINCT repo, CASE WHEN base_dir = '' THEN '.gitignore' ELSE base_dir || '/.gitignore' END
FROM rules""",
)
cte(
    "steps",
    ["all_paths"],
    """SELECT repo, path, k, array_to_string(str_split(path, '/')[1:k], '/') AS step,
  k < len(str_split(path, '/')) AS is_dir
FROM (SELECT repo, path, unnest(range(1, len(str_split(path, '/')) + 1)) AS k FROM all_paths)""",
)
cte(
    "ignored",
    ["steps", "rules"],
    """SELECT DISTINCT repo, path FROM (
  SELECT s.repo, s.path, s.k, arg_max(NOT r.negated, length(r.base_dir) * 1000 + r.rule_no) AS dropped
  FROM steps s JOIN rules r ON s.repo = r.repo
    AND (r.base_dir = '' OR starts_with(s.step, r.base_dir || '/'))
    AND (s.is_dir OR NOT r.dir_only)
    AND regexp_matches(CASE WHEN r.base_dir = '' THEN s.step ELSE substr(s.step, length(r.base_dir) + 2) END, '(?i)' || r.regex)
  GROUP BY ALL) WHERE dropped""",
)

# --- settings ----------------------------------------------------------------


def resolved_settings(source: str) -> str:
    doc = "CASE WHEN json_valid(config_json) THEN config_json::JSON END"
    listed = lambda f: f"array_to_string(json_extract_string(doc, '$.{f}[*]'), ',')"
    has = lambda f: f"json_type(doc, '$.{f}') = 'ARRAY'"
    return f"""SELECT repo, CASE WHEN {has('exclude')} THEN {listed('exclude')} ELSE '' END AS exclude,
  coalesce((doc->>'$.maxDepth')::INT, 10) AS max_depth,
  coalesce((doc->>'$.maxFileSize')::BIGINT, 1048576) AS max_file_size,
  coalesce((doc->>'$.generateSyntaxTree')::BOOLEAN, false) AS generate_syntax_tree,
  CASE WHEN doc->>'$.outputFormat' = 'raw' THEN 'raw' ELSE 'compact' END AS output_format,
  CASE WHEN {has('filesToExtract')} THEN {listed('filesToExtract')} END AS files_to_extract
FROM (SELECT repo, {doc} AS doc FROM {source})"""


_n_settings = len(V.SETTINGS)
cte(
    "settings",
    [],
    f"SELECT source || '/d' || doc_id AS repo, {pick(V.SETTINGS, f'doc_id % {_n_settings}')} AS config_json FROM documents",
)
cte(
    "repo_settings",
    [],
    f"""SELECT DISTINCT source || '/r' || (doc_id // 500) AS repo,
  {pick(V.SETTINGS, f'ascii(substr(source, 4, 1)) % {_n_settings}')} AS config_json FROM documents""",
)
cte("repo_limits", ["repo_settings"], resolved_settings("repo_settings"))

# --- nodes and symbols -------------------------------------------------------


def signature(text: str) -> str:
    line = trim(f"str_split({text}, chr(10))[1]")
    return f"""CASE WHEN length({line}) <= 100 THEN {line}
  WHEN contains({line}, '(') AND contains({line}, ')') THEN substr({line}, 1, instr({line}, ')')) || ' {{ ... }}'
  ELSE substr({line}, 1, 97) || '...' END"""


def kind(t: str) -> str:
    cases = " ".join(
        f"WHEN {' OR '.join(f'contains({t}, {q(p)})' for p in parts)} THEN {q(name)}"
        for name, parts in K.KIND_SUBSTRINGS
    )
    return f"CASE {cases} END"


def first_match(sig: str, patterns: list[str]) -> str:
    full = [p.replace("IDENT", K.IDENT).replace(r"\s", SPACE) for p in patterns]
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({sig}, {q(p)}, 1), '')" for p in full) + ")"


def name(kind_col: str, sig: str) -> str:
    imp = first_match(sig, K.NAME_PATTERNS["imp"])
    exp = first_match(sig, K.NAME_PATTERNS["exp"])
    rest = " ".join(
        f"WHEN '{k}' THEN {first_match(sig, K.NAME_PATTERNS[k])}" for k in ("fn", "cls", "mod", "var")
    )
    return f"""nullif(CASE {kind_col} WHEN 'imp' THEN CASE WHEN contains({imp}, '/')
    THEN regexp_replace(list_extract(str_split({imp}, '/'), -1), '\\.(js|ts|jsx|tsx)$', '')
    ELSE {trim(f"str_split({imp}, ',')[1]")} END
  WHEN 'exp' THEN {trim(f"str_split({exp}, ',')[1]")} {rest} END, '')"""


STRUCTURAL = (
    f"(regexp_matches(lower(node_type), {q('|'.join(K.STRUCTURAL_SUBSTRINGS))}) OR node_type IN {qin(K.STRUCTURAL_TYPES)})"
    f" AND node_type NOT IN {qin(K.GENERIC_TYPES + K.MEMBER_BODY_TYPES)}"
)
LOGICAL_DEPTH = f"len(list_filter(ancestor_types, lambda t: t NOT IN {qin(K.MEMBER_BODY_TYPES)}))"
cte(
    "structural",
    ["raw_nodes"],
    f"""SELECT * FROM (SELECT *, {signature('node_text')} AS signature FROM raw_nodes WHERE {STRUCTURAL})
WHERE length(signature) > 1""",
)
cte(
    "nodes",
    ["structural"],
    f"""SELECT *, 2 * least(depth, 3) AS indent FROM (SELECT *, {LOGICAL_DEPTH}::INT AS depth FROM structural)
WHERE depth <= 4""",
)


def symbol_ctes(prefix: str, nodes: str) -> None:
    """classified → symbols → texts per file, from a CTE of nodes."""
    cte(
        f"{prefix}named",
        [nodes],
        f"""SELECT * REPLACE (CASE WHEN name IS NULL THEN NULL ELSE kind END AS kind) FROM (
SELECT *, {name('kind', 'signature')} AS name FROM (SELECT *, {kind('node_type')} AS kind FROM {nodes}))""",
    )
    # the stack, literally: the last class before with a smaller indent that no
    # row in between closes
    cte(
        f"{prefix}parents",
        [f"{prefix}named"],
        f"""SELECT f.repo, f.path, f.seq, arg_max(c.name, c.seq) AS parent_class
FROM {prefix}named f JOIN {prefix}named c ON f.repo = c.repo AND f.path = c.path
  AND c.seq < f.seq AND c.indent < f.indent AND f.kind = 'fn' AND c.kind = 'cls'
WHERE NOT EXISTS (SELECT 1 FROM {prefix}named k WHERE k.repo = f.repo AND k.path = f.path
  AND k.seq > c.seq AND k.seq < f.seq AND k.indent <= c.indent)
GROUP BY ALL""",
    )
    cte(
        f"{prefix}symbols",
        [f"{prefix}named", f"{prefix}parents"],
        f"""SELECT n.repo, n.path, n.seq, n.kind, n.name, p.parent_class
FROM {prefix}named n LEFT JOIN {prefix}parents p USING (repo, path, seq) WHERE n.kind IS NOT NULL""",
    )
    cte(
        f"{prefix}classes",
        [f"{prefix}symbols"],
        f"""SELECT repo, path, owner AS class_name, min(seq) AS first_seq,
  string_agg(method, ',' ORDER BY seq) AS methods FROM (
  SELECT repo, path, CASE WHEN parent_class IS NULL THEN name ELSE parent_class END AS owner,
    CASE WHEN parent_class IS NOT NULL THEN name END AS method, min(seq) AS seq
  FROM {prefix}symbols WHERE kind = 'cls' OR parent_class IS NOT NULL GROUP BY ALL)
GROUP BY ALL""",
    )
    ranks = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(K.KIND_ORDER))
    cte(
        f"{prefix}file_symbols",
        [f"{prefix}symbols", f"{prefix}classes"],
        f"""SELECT repo, path, string_agg(kind || ':' || names, ' ' ORDER BY CASE kind {ranks} END) AS symbols FROM (
  SELECT repo, path, 'cls' AS kind, string_agg(class_name || coalesce('(' || methods || ')', ''), ',' ORDER BY first_seq) AS names
  FROM {prefix}classes GROUP BY ALL
  UNION ALL
  SELECT repo, path, kind, string_agg(name, ',' ORDER BY seq) FROM (
    SELECT repo, path, kind, name, min(seq) AS seq FROM {prefix}symbols
    WHERE kind <> 'cls' AND parent_class IS NULL GROUP BY ALL) GROUP BY ALL)
GROUP BY ALL""",
    )


symbol_ctes("", "nodes")

_DOC_TEXTS = "SELECT source || '/r' || (doc_id // 500) AS repo, 'd' || doc_id || '.ts' AS path, doc_id FROM documents"
cte(
    "summaries",
    ["nodes"],
    f"""SELECT d.repo, d.path, CASE WHEN d.doc_id % 5 > 0 THEN coalesce({q(K.SUMMARY_MARKER)} || chr(10) || r.rows, {q(K.SUMMARY_EMPTY)}) END AS summary
FROM ({_DOC_TEXTS}) d LEFT JOIN (
  SELECT repo, path, string_agg(repeat(' ', indent) || node_type || ': ' || signature || ' (line ' || line || ')', chr(10) ORDER BY seq) AS rows
  FROM nodes GROUP BY ALL) r USING (repo, path)""",
)

# --- outline -----------------------------------------------------------------
# what every line of code has, written by hand
_expected = ", ".join(
    f"({q(ext)}, {line}, {order}, {follow}, {q(t)}, {q(text)}, {q(above)})"
    for ext, line, order, follow, t, text, above in code.nodes()
)
cte(
    "code_words",
    [],
    f"""SELECT repo, path, ext, i, n_lines, ({word('raw')}) || (i % 3) AS w FROM (
  SELECT source || '/r' || (doc_id // 500) AS repo, {pick(_codes, f'doc_id % {len(_codes)}')} AS ext,
    {pick(V.CODE_DIRS, 'doc_id % 7 % 6')} || lang || doc_id || ext AS path,
    unnest(str_split(text, chr(10))) AS raw, generate_subscripts(str_split(text, chr(10)), 1) - 1 AS i,
    len(str_split(text, chr(10))) AS n_lines
  FROM documents)""",
)
cte(
    "outline",
    ["code_words"],
    f"""SELECT repo, path, 8 * i + k AS seq, node_type, replace(text, '¤', w) AS node_text,
  (1 + CASE WHEN above = '' THEN 0 ELSE len(list_filter(str_split(above, '>'), lambda t: t NOT IN {qin(K.MEMBER_BODY_TYPES)})) END)::INT AS depth,
  2 * i + 1 AS line, CASE WHEN above = '' THEN 'program' ELSE 'program>' || above END AS ancestors
FROM code_words JOIN (VALUES {_expected}) e(ext, line_no, k, follow, node_type, text, above)
  ON code_words.ext = e.ext AND i % {CYCLE} = line_no AND i + follow < n_lines""",
)
cte(
    "code_nodes",
    ["outline"],
    f"""SELECT *, 2 * least(depth, 3) AS indent FROM (
  SELECT repo, path, seq, node_type, {signature('node_text')} AS signature, depth FROM outline WHERE {STRUCTURAL})
WHERE length(signature) > 1 AND depth <= 4""",
)
symbol_ctes("code_", "code_nodes")

# --- snapshots ---------------------------------------------------------------


def heads(texts: str) -> str:
    return f"""SELECT repo, '# ' || {base('repo')} || ' (' || n_files || ' files, ' || ({format_count('n_lines')}) || ' lines)' AS header, languages
FROM (SELECT repo, count(*) AS n_files, sum(line_count)::BIGINT AS n_lines FROM {texts} GROUP BY ALL)
JOIN (SELECT repo, string_agg({short('lang')} || ':' || n, ' ' ORDER BY first_path) AS languages FROM (
  SELECT repo, coalesce(language, 'text') AS lang, count(*) AS n, min(path) AS first_path FROM {texts} GROUP BY ALL)
  GROUP BY ALL) USING (repo)"""


def dirs(source: str) -> str:
    return f"""SELECT DISTINCT repo, array_to_string(str_split(path, '/')[1:k], '/') AS dir FROM (
  SELECT repo, path, unnest(range(1, {depth('path')})) AS k FROM {source})"""


def tree(source: str) -> str:
    """position and line of every directory and file of (repo, path, symbols)."""
    steps = "list_transform(str_split({p}, '/'), lambda s, i: CASE WHEN i = {n} AND {leaf} THEN '1:' ELSE '0:' END || s)"
    of = lambda p, leaf: "array_to_string(" + steps.format(p=p, n=depth(p), leaf=leaf) + ", '/')"
    return f"""SELECT repo, {of('dir', 'false')} AS position,
  repeat('  ', {depth('dir')} - 1) || {base('dir')} || '/' AS line FROM ({dirs(source)})
UNION ALL SELECT repo, {of('path', 'true')},
  repeat('  ', {depth('path')} - 1) || {base('path')} || coalesce(' ' || symbols, '') FROM {source}"""


cte(
    "discovered",
    ["texts"],
    f"SELECT * FROM texts WHERE NOT {HIDDEN} AND NOT {BUILTIN} AND {depth('path')} <= 10 AND size <= 1048576",
)
cte("raw_heads", ["discovered"], heads("discovered"))
cte("code_heads", ["code_texts"], heads("code_texts"))
cte(
    "code_index",
    ["code_texts", "code_file_symbols"],
    "SELECT t.*, s.symbols FROM code_texts t LEFT JOIN code_file_symbols s USING (repo, path)",
)


def head_lines(source: str, fixed: list[str], opening: list[str], column: str, position: str) -> str:
    texts = [q(x) for x in opening] + ["header", "languages"] + [q(x) for x in fixed]
    return f"""SELECT repo, (i - 1 - {len(opening)})::INT AS section, '' AS {position}, {column} FROM (
  SELECT repo, unnest([{', '.join(texts)}]) AS {column}, generate_subscripts([{', '.join(texts)}], 1) AS i FROM {source})"""


def compact(opening: list[str] = []) -> str:  # noqa: B006
    fixed = ["", K.LEGEND, K.LEGEND_FORMAT, ""]
    return f"""{head_lines('code_heads', fixed, opening, 'line', 'position')}
UNION ALL SELECT repo, 6, position, line FROM ({tree('code_index')})"""


def raw(head_source: str, texts: str, opening: list[str] = []) -> str:  # noqa: B006
    return f"""{head_lines(head_source, [''], opening, 'block', 'path')}
UNION ALL SELECT repo, 3, path, '=== ' || path || ' ===' || chr(10) || content || chr(10) FROM {texts}"""


cte("compact_lines", ["code_heads", "code_index"], compact())

# --- lookup ------------------------------------------------------------------
cte("names", ["requests"], "SELECT DISTINCT repo, requested FROM requests")
cte("page_dirs", ["page_files"], dirs("page_files"))
cte(
    "exact",
    ["names", "page_files", "page_dirs"],
    """SELECT n.repo, n.requested, f.path, d.dir IS NOT NULL AS is_dir FROM (
  SELECT *, regexp_replace(regexp_replace(requested, '^\\./', ''), '[^/]+/\\.\\./', '') AS norm FROM names) n
LEFT JOIN page_files f ON f.repo = n.repo AND f.path = n.norm
LEFT JOIN page_dirs d ON d.repo = n.repo AND d.dir = n.norm""",
)


def score(path: str) -> str:
    p = f"lower({path})"
    parts = [f"2 * {depth(path)}"]
    parts += [f"CASE WHEN starts_with({p}, {q(s)}) THEN {n} ELSE 0 END" for s, n in K.START_SCORES]
    parts += [
        f"CASE WHEN {' OR '.join(f'contains({p}, {q(x)})' for x in xs)} THEN {n} ELSE 0 END"
        for xs, n in K.CONTAINS_SCORES
    ]
    return "(" + " + ".join(parts) + ")::INT"


_SKIPPED = "regexp_matches(path, '(^|/)(node_modules|dist|build|coverage)(/|$)')"
cte(
    "hits",
    ["names", "page_files"],
    f"""SELECT n.repo, n.requested, f.path, {score('f.path')} AS score
FROM names n JOIN (SELECT * FROM page_files WHERE NOT {_SKIPPED}) f ON f.repo = n.repo AND
  CASE WHEN contains(n.requested, '?') THEN regexp_matches(f.path, '^([^./][^/]*/)*' || substr(n.requested, 1, 1) || '[^/][^/]*$')
  WHEN f.path = n.requested THEN true
  ELSE ends_with(f.path, '/' || n.requested)
    AND NOT regexp_matches('/' || substr(f.path, 1, length(f.path) - length(n.requested)), '/\\.') END""",
)
cte(
    "best",
    ["hits"],
    """SELECT * EXCLUDE (rn) FROM (SELECT repo, requested, path, score, count(*) OVER (PARTITION BY repo, requested) AS n_matches,
  row_number() OVER (PARTITION BY repo, requested ORDER BY score, length(path), path) AS rn FROM hits) WHERE rn = 1""",
)
cte(
    "resolved",
    ["requests", "exact", "best"],
    """SELECT r.repo, r.requested, r.req_no,
  CASE WHEN e.path IS NOT NULL THEN e.path WHEN NOT e.is_dir THEN b.path END AS path,
  CASE WHEN e.path IS NOT NULL OR e.is_dir THEN 'exact' WHEN b.path IS NOT NULL THEN 'search' END AS strategy,
  e.is_dir, CASE WHEN e.path IS NOT NULL THEN 1 WHEN e.is_dir THEN 0 ELSE coalesce(b.n_matches, 0) END::BIGINT AS n_matches
FROM requests r JOIN exact e USING (repo, requested) LEFT JOIN best b USING (repo, requested)""",
)
cte(
    "extracted",
    ["resolved", "page_files"],
    f"""SELECT r.*, f.content, CASE WHEN r.path IS NULL THEN CASE WHEN r.is_dir THEN 'directory' ELSE 'not_found' END
  WHEN {is_binary('f.content')} THEN 'binary' ELSE 'extracted' END AS status
FROM resolved r LEFT JOIN page_files f USING (repo, path)""",
)

_conv = "conv_id || '/' || turn AS repo"
ORACLE_SQL: dict[str, str] = {
    "files_scan": sql("SELECT repo, path, size FROM files", "files"),
    "requests_from_list": f"""SELECT repo, (i - 1)::INT AS req_no, requested FROM (
SELECT repo, unnest(names) AS requested, generate_subscripts(names, 1) AS i FROM (
SELECT {_conv}, CASE WHEN len(listed) > 0 AND conv_id % 5 > 0 THEN listed ELSE ['README.md', 'src/a.ts'] END AS names FROM (
SELECT *, list_filter(list_transform(str_split(text, ','), lambda x: {trim('x')}), lambda x: length(x) > 0) AS listed
FROM conversations)))""",
    "requests_from_json": f"""SELECT {_conv}, (generate_subscripts(str_split(text, ' '), 1) - 1)::INT AS req_no,
unnest(str_split(text, ' ')) AS requested FROM conversations WHERE turn % 3 < 2""",
    "settings_resolve": sql(resolved_settings("settings"), "settings"),
    "file_extension": sql(f"SELECT repo, path, {ext('path')} AS extension FROM files", "files"),
    "detect_language": sql(f"SELECT repo, path, {language('path')} AS language FROM files", "files"),
    "supported_only": sql(f"SELECT repo, path FROM files WHERE {language('path')} IS NOT NULL", "files"),
    "path_depth": sql(f"SELECT repo, path, {depth('path')}::INT AS depth FROM files", "files"),
    "decode_text": sql("SELECT repo, path, content FROM files", "files"),
    "line_count": sql("SELECT repo, path, line_count::BIGINT AS line_count FROM texts", "texts"),
    "size_info": sql(
        f"SELECT repo, path, bytes::BIGINT AS bytes, {format_bytes('bytes')} AS formatted, {tokens('units')} AS tokens FROM texts",
        "texts",
    ),
    "format_bytes": f"""SELECT l_orderkey, l_linenumber, {format_bytes('n')} AS formatted
FROM (SELECT *, l_orderkey * l_partkey * l_linenumber AS n FROM lineitem)""",
    "format_count": f"""SELECT l_orderkey, l_linenumber, {format_count('n')} AS formatted
FROM (SELECT *, l_orderkey * l_linenumber * 50 AS n FROM lineitem)""",
    "filter_size": sql("SELECT repo, path, size FROM files WHERE size <= 4096", "files"),
    "filter_depth": sql(f"SELECT repo, path FROM files WHERE {depth('path')} <= 10", "files"),
    "filter_hidden": sql(f"SELECT repo, path FROM files WHERE NOT {HIDDEN}", "files"),
    "exclude_builtin": sql(f"SELECT repo, path FROM files WHERE NOT {BUILTIN}", "files"),
    "exclude_user": sql(
        f"SELECT repo, path FROM files WHERE NOT {BUILTIN} AND NOT regexp_matches(path, {q(USER_REGEX)})", "files"
    ),
    "exclude_gitignore": sql(
        "SELECT repo, path FROM all_paths WHERE (repo, path) NOT IN (SELECT (repo, path) FROM ignored)",
        "all_paths",
        "ignored",
    ),
    "ignore_rules": sql("SELECT repo, base_dir, rule_no, negated, dir_only FROM rules", "rules"),
    "scope_dir": sql(
        f"""SELECT repo, substr(path, 5) AS path, {depth('substr(path, 5)')}::INT AS depth FROM files
WHERE starts_with(path, 'a/b/') AND {depth('substr(path, 5)')} <= 8""",
        "files",
    ),
    "binary_detect": sql(f"SELECT repo, path, {is_binary('content')} AS is_binary FROM files", "files"),
    "text_files": sql("SELECT repo, path, size, language FROM texts", "texts"),
    "discover": sql(
        f"""SELECT f.repo, f.path, f.size, {ext('path')} AS extension, {language('path')} AS language
FROM files f JOIN repo_limits s USING (repo)
WHERE NOT {HIDDEN} AND NOT {BUILTIN} AND NOT regexp_matches(path, '^pkg/[^/]*(/.*)?$')
  AND {depth('path')} <= s.max_depth AND f.size <= s.max_file_size
  AND NOT (s.exclude <> '' AND regexp_matches(path, '^(([^/]+/)*[^/]*\\.spec\\.ts|docs)(/.*)?$'))
  AND (f.repo, path) NOT IN (SELECT (repo, path) FROM ignored)""",
        "files",
        "repo_limits",
        "ignored",
    ),
    "outline_lines": sql(
        "SELECT repo, path, node_type, node_text, depth, line::INT AS line, ancestors FROM outline", "outline"
    ),
    "nodes_structural": sql("SELECT repo, path, seq, node_type, signature FROM structural", "structural"),
    "nodes_depth": sql(
        f"""SELECT repo, path, seq, depth, 2 * least(depth, 3) AS indent FROM (
SELECT *, {LOGICAL_DEPTH}::INT AS depth FROM raw_nodes) WHERE depth <= 4""",
        "raw_nodes",
    ),
    "node_signature": sql(f"SELECT repo, path, seq, {signature('node_text')} AS signature FROM raw_nodes", "raw_nodes"),
    "summary_text": sql("SELECT * FROM summaries", "summaries"),
    # a summary read back gives the nodes, numbered by their row behind the marker
    "summary_parse": sql(
        f"""SELECT repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY seq)::INT AS seq, indent, line,
  {trim('node_type')} AS node_type, {trim('signature')} AS signature
FROM nodes WHERE regexp_extract(path, '[0-9]+')::INT % 5 > 0""",
        "nodes",
    ),
    "symbol_kind": sql(f"SELECT repo, path, seq, {kind('node_type')} AS kind FROM raw_nodes", "raw_nodes"),
    "symbol_names": sql("SELECT repo, path, seq, kind, name FROM named", "named"),
    "import_names": sql("SELECT repo, path, seq, signature, name FROM named WHERE kind = 'imp'", "named"),
    "enclosing_class": sql("SELECT repo, path, seq, name, parent_class FROM symbols WHERE kind = 'fn'", "symbols"),
    "names_by_kind": sql(
        """SELECT repo, path, kind, string_agg(name, ',' ORDER BY seq) AS names FROM (
SELECT repo, path, kind, name, min(seq) AS seq FROM symbols GROUP BY ALL) GROUP BY ALL""",
        "symbols",
    ),
    "class_methods": sql("SELECT repo, path, class_name, first_seq, methods FROM classes", "classes"),
    "file_symbols": sql("SELECT repo, path, symbols FROM file_symbols", "file_symbols"),
    "repo_totals": sql(
        """SELECT repo, count(*) AS n_files, sum(line_count)::BIGINT AS n_lines, sum(size)::BIGINT AS total_size
FROM texts GROUP BY ALL""",
        "texts",
    ),
    "lang_distribution": sql(f"SELECT repo, languages FROM ({heads('texts')})", "texts"),
    "total_size": sql(
        f"""SELECT repo, bytes, {format_bytes('bytes')} AS formatted, {tokens('units')} AS tokens FROM (
SELECT repo, sum(bytes)::BIGINT AS bytes, sum(units)::BIGINT AS units FROM texts GROUP BY ALL)""",
        "texts",
    ),
    "header_row": sql(f"SELECT repo, header FROM ({heads('texts')})", "texts"),
    "repo_profile": f"""WITH rows AS (SELECT source || '/q' || (doc_id // 100) AS repo, {pick(V.PROFILE_PATHS, 'doc_id % 9')} AS path,
  CASE doc_id % 9 WHEN 0 THEN replace(text, chr(10) || 'E', chr(10) || '#')
    WHEN 1 THEN coalesce({pick(V.SETTINGS, f'(doc_id // 9) % {_n_settings}')}, '') ELSE text END AS body
  FROM documents)
SELECT repo, coalesce(bool_or(path = '.gitignore'), false) AS has_ignore_file,
  max(CASE WHEN path = '.gitignore' THEN len(list_filter(str_split(body, chr(10)), lambda x: {trim('x')} <> '' AND NOT starts_with(x, '#'))) END)::INT AS n_ignore_rules,
  coalesce(bool_or(path = '.snapshot/config.json'), false) AS has_settings,
  bool_or(CASE WHEN path = '.snapshot/config.json' THEN body <> '' AND json_valid(body) END) AS settings_valid,
  bool_or(CASE WHEN path = '.snapshot/config.json' AND body <> '' AND json_valid(body) THEN NOT contains(body, 'nonsense') END) AS format_valid,
  max(CASE WHEN path = '.snapshot/config.json' AND body <> '' AND json_valid(body) THEN CASE WHEN contains(body, 'spec.ts') THEN 2 ELSE 0 END END)::INT AS n_excludes,
  array_to_string(list_filter({qlist(K.MANIFESTS)}, lambda m: list_contains(list(path), m)), ',') AS manifests
FROM rows GROUP BY repo""",
    "path_order": sql(
        """SELECT repo, str_split(path, '/')[1] AS top, path,
  lag(path) OVER (PARTITION BY repo, str_split(path, '/')[1] ORDER BY path) AS previous_path FROM page_files""",
        "page_files",
    ),
    "dir_rows": sql(dirs("page_files"), "page_files"),
    "tree_lines": sql(tree("(SELECT *, NULL::VARCHAR AS symbols FROM page_files)"), "page_files"),
    "raw_snapshot": sql(raw("raw_heads", "discovered"), "raw_heads", "discovered"),
    "compact_snapshot": sql("SELECT * FROM compact_lines", "compact_lines"),
    "snapshot_report": sql(
        f"""SELECT repo, n_files, original_bytes, {format_bytes('original_bytes')} AS original_size, {tokens('original_units')} AS original_tokens,
  generated_bytes, {format_bytes('generated_bytes')} AS generated_size, {tokens('generated_units')} AS generated_tokens,
  CASE WHEN original_bytes > generated_bytes THEN {tenths('(original_bytes - generated_bytes)', 1024)} || ' KB' END AS space_saved,
  CASE WHEN original_bytes < generated_bytes THEN {tenths('(generated_bytes - original_bytes)', 1024)} || ' KB' END AS space_added,
  CASE WHEN original_bytes > 0 THEN printf('%.1f', generated_bytes::DOUBLE / original_bytes * 100.0) || '%' END AS ratio,
  CASE WHEN original_bytes = 0 THEN NULL WHEN generated_bytes * 100 < original_bytes * 10 THEN 'green'
    WHEN generated_bytes * 100 < original_bytes * 25 THEN 'yellow' ELSE 'red' END AS band
FROM (SELECT repo, count(*) AS n_files, sum(bytes)::BIGINT AS original_bytes, sum(units)::BIGINT AS original_units FROM code_texts GROUP BY ALL)
JOIN (SELECT repo, strlen(string_agg(line, chr(10)))::BIGINT AS generated_bytes, {units('string_agg(line, chr(10))')} AS generated_units
  FROM compact_lines GROUP BY ALL) USING (repo)""",
        "code_texts",
        "compact_lines",
    ),
    "llm_input": sql(
        f"""SELECT repo, output_format AS format, section, position, line FROM (
SELECT 'compact' AS output_format, * FROM ({compact([K.PROMPT_COMPACT, ''])})
UNION ALL SELECT 'raw', repo, section, path, block FROM ({raw('code_heads', 'code_texts', [K.PROMPT_RAW, ''])}))
JOIN repo_limits USING (repo, output_format)""",
        "code_heads",
        "code_index",
        "code_texts",
        "repo_limits",
    ),
    "request_input": sql(f"SELECT DISTINCT repo, {q(K.PROMPT_REQUEST)} AS prompt FROM code_texts", "code_texts"),
    "raw_report": sql(
        f"""SELECT repo, n_files, original_bytes, {format_bytes('original_bytes')} AS original_size, {tokens('original_units')} AS original_tokens,
  generated_bytes, {format_bytes('generated_bytes')} AS generated_size, {tokens('generated_units')} AS generated_tokens,
  CASE WHEN original_bytes > generated_bytes THEN {tenths('(original_bytes - generated_bytes)', 1024)} || ' KB' END AS space_saved,
  CASE WHEN original_bytes < generated_bytes THEN {tenths('(generated_bytes - original_bytes)', 1024)} || ' KB' END AS space_added
FROM (SELECT repo, count(*) AS n_files, sum(bytes)::BIGINT AS original_bytes, sum(units)::BIGINT AS original_units FROM discovered GROUP BY ALL)
JOIN (SELECT repo, (sum(strlen(block)) + count(*) - 1)::BIGINT AS generated_bytes, (sum({units('block')}) + count(*) - 1)::BIGINT AS generated_units
  FROM ({raw('raw_heads', 'discovered')}) GROUP BY ALL) USING (repo)""",
        "raw_heads",
        "discovered",
    ),
    "path_score": sql(f"SELECT repo, path, {score('path')} AS score FROM page_files", "page_files"),
    "resolve_exact": sql("SELECT * FROM exact", "exact"),
    "resolve_search": sql("SELECT repo, requested, path, score FROM hits", "hits"),
    "resolve_best": sql("SELECT repo, requested, path, score, n_matches FROM best", "best"),
    "search_alternatives": sql(
        """SELECT h.repo, h.requested, h.path, h.score FROM hits h JOIN best b USING (repo, requested)
WHERE h.path <> b.path""",
        "hits",
        "best",
    ),
    "resolve": sql("SELECT * FROM resolved", "resolved"),
    "missing_requests": sql(
        "SELECT repo, req_no, requested, status FROM extracted WHERE status <> 'extracted'", "extracted"
    ),
    "extract_blocks": sql(
        """SELECT repo, req_no, '=== ' || path || ' ===' || chr(10) || chr(10) || content || chr(10) AS block
FROM extracted WHERE status = 'extracted'""",
        "extracted",
    ),
    "extract_report": sql(
        f"""SELECT repo, requested, extracted AS found, extracted, requested - extracted AS missing, bytes,
  {format_bytes('bytes')} AS formatted, {tokens('units')} AS tokens FROM (
SELECT repo, count(*) AS requested, count(*) FILTER (status = 'extracted') AS extracted,
  coalesce(sum(strlen(content)) FILTER (status = 'extracted'), 0)::BIGINT AS bytes,
  coalesce(sum({units('content')}) FILTER (status = 'extracted'), 0)::BIGINT AS units
FROM extracted GROUP BY ALL)""",
        "extracted",
    ),
}
