"""Signature, kind and name of outline nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sylvan import constants as K
from sylvan.functions import text as T


def _filled(pattern: str) -> str:
    return pattern.replace("IDENT", K.IDENT).replace(r"\s", f"[{K.SPACE_SET}]")


def is_structural(node_type: Column) -> Column:
    return F.lower(node_type).rlike("|".join(K.STRUCTURAL_SUBSTRINGS)) | node_type.isin(
        K.STRUCTURAL_TYPES
    )


def is_generic(node_type: Column) -> Column:
    return node_type.isin(K.GENERIC_TYPES + K.MEMBER_BODY_TYPES)


def first_line(node_text: Column) -> Column:
    return T.trim(F.substring_index(node_text, "\n", 1))


def signature(node_text: Column) -> Column:
    """First line of a node, trimmed, cut when it is too long."""
    return shortened(first_line(node_text))


def shortened(line: Column) -> Column:
    """A trimmed line; behind its arguments, or at a fixed length, when it is long."""
    close = F.instr(line, ")")
    cut_at_call = F.concat(F.substr(line, F.lit(1), close), F.lit(" { ... }"))
    return (
        F.when(F.length(line) <= K.SIGNATURE_LIMIT, line)
        .when(F.contains(line, F.lit("(")) & (close > 0), cut_at_call)
        .otherwise(F.concat(F.substring(line, 1, K.SIGNATURE_CUT), F.lit("...")))
    )


def kind(node_type: Column) -> Column:
    """Symbol kind; the first test that holds decides, even without a name."""
    out = None
    for name, parts in K.KIND_SUBSTRINGS:
        hit = reduce(lambda a, b: a | b, [F.contains(node_type, F.lit(p)) for p in parts])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def _first_match(sig: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches anywhere; empty without any.

    The patterns become one regex whose alternatives are tried in order, each
    at every position before the next gets its turn. One pass replaces a chain
    of extractions, which Spark would evaluate several times over.
    """
    tries = "|".join(f".*?{_filled(p)}" for p in patterns)
    groups = "".join(f"${i + 1}" for i in range(len(patterns)))
    return F.regexp_replace(sig, f"(?s)^(?:{tries}|).*\\z", groups)


def found_text(kind_col: Column, sig: Column) -> Column:
    """What the name patterns of a kind capture; empty when none of them fits."""
    out = None
    for name, patterns in K.NAME_PATTERNS.items():
        text = _first_match(sig, patterns)
        out = F.when(kind_col == name, text) if out is None else out.when(kind_col == name, text)
    return out


def name_from(kind_col: Column, found: Column) -> Column:
    """Name of a symbol from its captured text; may be empty.

    Imports of a module path are named by its last step, lists of names by
    their first.
    """
    module = F.regexp_replace(F.substring_index(found, "/", -1), K.IMPORT_SUFFIX, "")
    first = T.trim(F.substring_index(found, ",", 1))
    return (
        F.when((kind_col == "imp") & F.contains(found, F.lit("/")), module)
        .when(kind_col.isin("imp", "exp"), first)
        .otherwise(found)
    )
