"""Ignore files: rules of a project that drop files from its snapshot.

A rule file holds for its own directory and below. For every directory on the
way to a file, and the file itself, the last matching rule decides; a file
below a dropped directory stays dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan import constants as K
from sylvan.functions import globs, paths, text
from sylvan.operators.joins import join_hot

# Rule files below these directories are not read.
_UNREAD_DIRS = ["node_modules", "flow-typed", "coverage", ".git"]


def _rule(line: Column, number: Column) -> Column:
    """One line as a rule; ``regex`` is null for blank lines and comments."""
    line = F.regexp_replace(line, r"\r\z", "")
    # trailing blanks go unless a backslash keeps them
    line = F.regexp_replace(line, r"(?<!\\)[ \t]+\z", "")
    negated = F.startswith(line, F.lit("!"))
    body = F.when(negated, F.substr(line, F.lit(2))).otherwise(line)
    dir_only = F.endswith(body, F.lit("/"))
    bare = F.regexp_replace(body, r"/+\z", "")
    is_rule = ~F.startswith(line, F.lit("#")) & (F.length(bare) > 0)
    # a trailing slash does not anchor a rule, one before it does
    return F.struct(
        (number + 1).cast("int").alias("rule_no"),
        F.when(is_rule, globs.ignore_regex_column(bare)).alias("regex"),
        negated.alias("negated"),
        dir_only.alias("dir_only"),
    )


def rule_files(files: DataFrame) -> DataFrame:
    """Rules per ignore file: ``repo, base_dir, rules ARRAY<STRUCT>``, in order."""
    path = F.col("path")
    rules = F.filter(
        F.transform(F.split(text.decode_text(F.col("content")), "\n"), _rule),
        lambda r: r["regex"].isNotNull(),
    )
    return (
        # the suffix test reaches the scan
        files.filter(
            F.endswith(path, F.lit(K.IGNORE_FILE))
            & (paths.basename(path) == K.IGNORE_FILE)
            & ~paths.in_any_dir(path, _UNREAD_DIRS)
        )
        .select(
            "repo",
            F.regexp_replace(path, r"/?[^/]*\z", "").alias("base_dir"),
            rules.alias("rules"),
        )
        .filter(F.size("rules") > 0)
    )


def ignore_rules(files: DataFrame) -> DataFrame:
    """One row per rule: ``repo, base_dir, rule_no, regex, negated, dir_only``."""
    return rule_files(files).select("repo", "base_dir", F.inline("rules"))


def _runs(rules: Column) -> Column:
    """Neighbouring rules with the same effect as one alternation.

    Most files then need one regex test per directory level.
    """
    empty = F.array().cast("array<struct<regex:string,negated:boolean,dir_only:boolean>>")

    def run(regex: Column, rule: Column) -> Column:
        return F.struct(
            regex.alias("regex"), rule["negated"].alias("negated"), rule["dir_only"].alias("dir_only")
        )

    def step(done: Column, rule: Column) -> Column:
        n = F.size(done)
        last = F.get(done, n - 1)
        same = (n > 0) & (last["negated"] == rule["negated"]) & (last["dir_only"] == rule["dir_only"])
        joined = F.concat(last["regex"], F.lit("|"), rule["regex"])
        return F.when(
            same, F.array_append(F.slice(done, F.lit(1), F.greatest(n - 1, F.lit(0))), run(joined, rule))
        ).otherwise(F.array_append(done, run(rule["regex"], rule)))

    return F.aggregate(rules, empty, step)


def _verdicts(path: Column, base: Column, runs: Column, ignore_case: bool) -> Column:
    """What one rule file says about each step on the way to a file.

    One entry per directory, outermost first, and one for the file: true for
    dropped, false for kept, null where no rule matches.
    """
    flag = F.lit("(?i)" if ignore_case else "")
    silent = F.lit(None).cast("boolean")

    def verdict(step: Column, is_dir: bool) -> Column:
        below = (base == "") | F.startswith(step, F.concat(base, F.lit("/")))
        rest = F.when(base == "", step).otherwise(F.substr(step, F.length(base) + 2))

        def by_run(said: Column, run: Column) -> Column:
            hit = globs.matches(rest, F.concat(flag, run["regex"]))
            applies = F.lit(True) if is_dir else ~run["dir_only"]
            return F.when(applies & hit, ~run["negated"]).otherwise(said)

        return F.when(below, F.aggregate(runs, silent, by_run))

    return F.array_append(
        F.transform(paths.ancestor_dirs(path), lambda d: verdict(d, True)), verdict(path, False)
    )


def _dropped(sets: Column) -> Column:
    """Deeper rule files overrule outer ones; one dropped step drops the file."""
    n_steps = F.size(sets[0]["verdicts"])

    def at(i: Column) -> Column:
        return F.aggregate(
            sets,
            F.lit(None).cast("boolean"),
            lambda said, one: F.coalesce(F.get(one["verdicts"], i), said),
        )

    return F.exists(F.sequence(F.lit(0), n_steps - 1), lambda i: F.coalesce(at(i), F.lit(False)))


def ignored_paths_by(
    files: DataFrame, sources: DataFrame, ignore_case: bool = True
) -> DataFrame:
    """``repo, path`` of every file that the ignore files in ``sources`` drop.

    Only names travel, never content. A file meets the rule files of its own
    ancestor directories, found by equality on ``(repo, base_dir)``, so the
    work per file is bounded by its depth, not by the rules of its project.
    Rules are applied where they meet the file: behind that only names with
    a match, and a few booleans, are shuffled.
    """
    rules = rule_files(sources).select("repo", "base_dir", _runs(F.col("rules")).alias("runs"))
    path, base = F.col("path"), F.col("base_dir")
    levels = F.array_prepend(paths.ancestor_dirs(path), F.lit(""))
    met = join_hot(
        files.select("repo", "path").select("repo", "path", F.explode(levels).alias("base_dir")),
        rules,
        ["repo", "base_dir"],
        "inner",
        spread="path",
    )
    said = met.select(
        "repo",
        "path",
        F.length(base).alias("n"),
        _verdicts(path, base, F.col("runs"), ignore_case).alias("verdicts"),
    ).filter(F.exists("verdicts", lambda v: v.isNotNull()))
    return (
        said.groupBy("repo", "path")
        # at most one entry per directory level
        .agg(F.array_sort(F.collect_list(F.struct("n", "verdicts"))).alias("sets"))
        .filter(_dropped(F.col("sets")))
        .select("repo", "path")
    )


def exclude_ignored(files: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Drop the files that the ignore files among them name."""
    dropped = ignored_paths_by(files, files, ignore_case)
    return files.join(dropped, ["repo", "path"], "left_anti")
