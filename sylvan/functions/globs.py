"""Glob patterns as regular expressions, as column expressions.

Patterns of arguments, settings, ignore files and searches all go through the
same translation. For an argument it is a literal, which Catalyst folds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an exclude glob can do without: a match takes everything below it, so
# ``dir/**``, ``dir/`` and ``./dir`` all say ``dir``.
_REDUNDANT = r"^\./|(?<!\*\*)/\*\*$|/$"


# Private-use characters that stand for finished parts of a regex while a
# pattern column is rewritten step by step.
_QUOTE, _ONE, _DEEP, _BELOW, _ANY, _OPEN, _CLOSE, _EITHER, _OR, _DONE, _SHOWN = (
    chr(0xE000 + i) for i in range(11)
)
_NOT_HIDDEN = r"(?!\.)"
_MARKS = [
    (_QUOTE, "\\"),
    (_ONE, "[^/]"),
    (_SHOWN, _NOT_HIDDEN),
    (_ANY, "[^/]*"),
    (_OPEN, "["),
    (_CLOSE, "]"),
    (_EITHER, "(?:"),
    (_OR, "|"),
    (_DONE, ")"),
]
# spans of directories, with and without hidden ones
_SPANS = {
    True: [(_DEEP, "(?:[^/]+/)*"), (_BELOW, ".+")],
    False: [
        (_DEEP, f"(?:{_NOT_HIDDEN}[^/]+/)*"),
        (_BELOW, f"(?:{_NOT_HIDDEN}[^/]+/)*{_NOT_HIDDEN}[^/]+"),
    ],
}
_CLASS = r"([A-Za-z0-9_.~@#%+=,; -]+)"


def _body_regex(pattern: Column, choices: bool, hidden: bool = True) -> Column:
    """Wildcards, classes and choices as a regex; anything else as itself.

    Always a valid regex; null for a reversed range such as ``[z-a]``. Unless
    ``hidden``, a wildcard does not match the dot that a name starts with.
    """
    free = f"(?<!{_QUOTE})"
    # a backslash takes the special meaning off the next character
    body = F.regexp_replace(pattern, r"\\([A-Za-z0-9/])", "$1")
    body = F.regexp_replace(body, r"\\(.)", f"{_QUOTE}$1")
    body = F.regexp_replace(body, free + r"\\", "")
    # character classes of plain characters and ranges
    body = F.regexp_replace(body, free + r"\[[!^]" + _CLASS + r"\]", f"{_OPEN}^$1{_CLOSE}")
    body = F.regexp_replace(body, free + r"\[" + _CLASS + r"\]", f"{_OPEN}$1{_CLOSE}")
    ranges = F.regexp_extract_all(
        body, F.lit(f"(?<=[{_OPEN}^A-Za-z0-9])([^{_CLOSE}]-[^{_CLOSE}])")
    )
    is_reversed = F.exists(
        ranges, lambda r: F.substring(r, 1, 1) > F.substring(r, 3, 1)
    )
    if choices:
        body = F.regexp_replace(
            body, free + r"\{([^{}]*,[^{}]*)" + free + r"\}", f"{_EITHER}$1{_DONE}"
        )
        # the commas of a choice, reached from its start without leaving it
        body = F.regexp_replace(
            body, f"(?:(?<={_EITHER})|\\G(?!^))((?:{_QUOTE},|[^{_DONE},])*),", f"$1{_OR}"
        )
    # **/ spans any number of directories, /** everything below
    body = F.regexp_replace(body, free + r"\?", _ONE)
    body = F.regexp_replace(body, r"(?:^|(?<=/))\*\*/", _DEEP)
    body = F.regexp_replace(body, r"(?:^|(?<=/))\*\*$", _BELOW)
    body = F.regexp_replace(body, free + r"\*+", _ANY)
    # whatever is left and special stands for itself
    body = F.regexp_replace(
        body, f"(?<![{_QUOTE}{_OPEN}])" + r"([+()|^$*?{}\[\]])", f"{_QUOTE}$1"
    )
    body = F.regexp_replace(body, free + r"\.", f"{_QUOTE}.")
    if not hidden:
        body = F.regexp_replace(
            body, f"(^|/|{_DEEP}|{_EITHER}|{_OR})(?=[{_ONE}{_ANY}{_OPEN}])", f"$1{_SHOWN}"
        )
    for mark, text in [*_MARKS, *_SPANS[hidden]]:
        body = F.replace(body, F.lit(mark), F.lit(text))
    return F.when(~is_reversed, body)


def glob_regex_column(glob: Column, hidden: bool = True) -> Column:
    """Regex of a glob, without anchors; null for a reversed range."""
    return _body_regex(glob, choices=True, hidden=hidden)


def search_regex_column(glob: Column) -> Column:
    """Regex of ``**/glob`` over whole paths; only a dot in the glob finds hidden names."""
    return F.concat(
        F.lit(f"^(?:{_NOT_HIDDEN}[^/]+/)*"), glob_regex_column(glob, hidden=False), F.lit("$")
    )


def exclude_regex_column(globs: Column) -> Column:
    """One regex for an array of globs; a matching directory takes all below it.
    Null when there is none."""
    bodies = F.filter(
        F.transform(
            globs,
            lambda g: glob_regex_column(F.regexp_replace(g, _REDUNDANT, "")),
        ),
        lambda regex: regex.isNotNull(),
    )
    joined = F.concat(F.lit("^(?:"), F.array_join(bodies, "|"), F.lit(")(?:/.*)?$"))
    return F.when(F.size(bodies) > 0, joined)


def has_glob_chars(name: Column) -> Column:
    return name.rlike(r"[*?{}\[\]]")


# Ends of a file name within its pieces.
_FIRST, _LAST = chr(0xE00B), chr(0xE00C)
PIECE = 3


def _grams(text: Column) -> Column:
    """Every run of ``PIECE`` characters of a text."""
    last = F.length(text) - (PIECE - 1)
    all_of = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, PIECE))
    return F.when(last >= 1, all_of).otherwise(F.array().cast("array<string>"))


def path_pieces(path: Column) -> Column:
    """What a wildcard can be found by: the runs of three characters of the file
    name with its ends, its first and its last character, the directories above
    it (``src/``), and the empty piece, which every file has."""
    parts = F.split(path, "/", -1)
    name = F.element_at(parts, -1)
    above = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda d: F.concat(d, F.lit("/")))
    ends = F.array(
        F.concat(F.lit(_FIRST), F.substring(name, 1, 1)), F.concat(F.substring(name, -1, 1), F.lit(_LAST)), F.lit("")
    )
    return F.array_distinct(F.concat(_grams(F.concat(F.lit(_FIRST), name, F.lit(_LAST))), ends, above))


def glob_pieces(glob: Column) -> Column:
    """Pieces that every file has which a wildcard fits; never none.

    They come from the characters of the last step that stand for themselves:
    those behind the last slash, choice, class or escape. Steps without any
    wildcard count where the glob has no choice, class or escape at all.
    """
    tail = F.regexp_extract(glob, r"([^/{}\[\]\\]*)\z", 1)
    head = F.substring(glob, F.lit(1), F.length(glob) - F.length(tail))
    opening = F.when((head == "") | F.endswith(head, F.lit("/")), F.lit(_FIRST)).otherwise(F.lit(""))
    closing = F.when(F.length(tail) > 0, F.lit(_LAST)).otherwise(F.lit(""))
    runs = F.split(F.concat(opening, tail, closing), r"[*?]+", -1)
    grams = F.flatten(F.transform(runs, _grams))
    ends = F.filter(runs, lambda r: (F.length(r) == 2) & (F.startswith(r, F.lit(_FIRST)) | F.endswith(r, F.lit(_LAST))))
    steps = F.regexp_extract_all(glob, F.lit(r"(?:^|(?<=/))([^/*?]+/)"), F.lit(1))
    steps = F.when(glob.rlike(r"[{}\[\]\\]"), F.slice(steps, 1, 0)).otherwise(steps)
    return F.array_distinct(F.concat(grams, ends, steps, F.array(F.lit(""))))


def ignore_regex_column(rule: Column) -> Column:
    """Regex of an ignore-file rule, relative to the directory of its file.

    The rule has lost its ``!`` and its trailing ``/``. A rule with a slash at
    its start or middle is anchored, any other holds at every depth below.
    """
    body = _body_regex(F.regexp_replace(rule, "^/", ""), choices=False)
    anchored = rule.rlike("^/|/.")
    return F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), body, F.lit("$"))


def matches(text: Column, regex: Column) -> Column:
    """Regex test for patterns that are data.

    Unlike ``rlike``, this compiles a pattern again only when it differs from
    the one of the row before.
    """
    return F.regexp_instr(text, regex) > 0
