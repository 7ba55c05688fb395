"""Path columns. Paths are relative to the repository root, ``/`` separated."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sylvan import constants as K


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot of the base name; none for ``Makefile``, ``.gitignore``."""
    return F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]*)\z", 1)


def depth(path: Column) -> Column:
    """Number of path segments; 1 for a file at the root."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) + 1


def is_hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def project_name(repo: Column) -> Column:
    return basename(repo)


def segments(path: Column) -> Column:
    return F.split(path, "/", -1)


def ancestor_dirs(path: Column) -> Column:
    """Array of the directories above a file, outermost first; may be empty."""
    parts = segments(path)
    return F.when(
        depth(path) > 1,
        F.transform(
            F.sequence(F.lit(1), depth(path) - 1),
            lambda n: F.array_join(F.slice(parts, 1, n), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def path_suffixes(path: Column) -> Column:
    """``a/b/c`` → ``[c, b/c, a/b/c]``: every name a search could ask for.

    Without the suffixes that leave a hidden directory in front: a hidden name
    is found only when it is asked for.
    """
    parts = segments(path)
    n_parts = F.size(parts)
    # the first hidden step must be part of the suffix
    hidden = F.transform(parts, lambda s: F.startswith(s, F.lit(".")))
    first_hidden = F.array_position(hidden, F.lit(True)).cast("int")
    shortest = F.when(first_hidden == 0, 1).otherwise(n_parts - first_hidden + 1)
    return F.transform(
        F.sequence(shortest, n_parts),
        lambda n: F.array_join(F.slice(parts, n_parts - n + 1, n), "/"),
    )


def tree_key(path: Column, is_dir: bool) -> Column:
    """Sort key of a tree line: array order is the tree order.

    Directories come before files at every level, each followed at once by
    what it holds.
    """
    parts = segments(path)
    last_kind = 0 if is_dir else 1
    n = F.size(parts)
    return F.transform(
        parts,
        lambda name, i: F.struct(
            F.when(i == n - 1, F.lit(last_kind)).otherwise(F.lit(0)).alias("kind"),
            name.alias("name"),
        ),
    )


def path_order(path: Column) -> Column:
    """Language-aware order of file paths; end a sort with the path itself."""
    return F.collate(path, "UNICODE")


def normalized(path: Column) -> Column:
    """Resolve ``.``, ``..`` and doubled slashes; null outside the repository."""
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), done)
            .when(
                (part == "..") & (F.size(done) > 0) & (F.get(done, F.size(done) - 1) != ".."),
                F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
            )
            .otherwise(F.array_append(done, part))
        )

    flat = F.array_join(F.aggregate(segments(path), empty, step), "/")
    outside = F.startswith(path, F.lit("/")) | flat.rlike(r"^\.\.(/|$)")
    return F.when(~outside, flat)


def path_score(path: Column) -> Column:
    """Preference of a search hit; the lowest is the best."""
    lower = F.lower(path)
    score = depth(path) * K.DEPTH_SCORE
    for prefix, points in K.START_SCORES:
        score = score + F.when(F.startswith(lower, F.lit(prefix)), points).otherwise(0)
    for parts, points in K.CONTAINS_SCORES:
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(lower, F.lit(part))
        score = score + F.when(hit, points).otherwise(0)
    return score


def in_any_dir(path: Column, names: list[str]) -> Column:
    """True where a step of the path, a directory or the file, has such a name.

    This is what the globs ``**/name/**`` match.
    """
    alternatives = "|".join(re.escape(name) for name in names)
    return path.rlike(f"(^|/)({alternatives})(/|\\z)")
