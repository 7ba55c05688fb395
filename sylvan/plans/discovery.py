"""Which files of a corpus belong to a snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan import constants as K
from sylvan.functions import globs, paths
from sylvan.operators import filters, ignore
from sylvan.operators.joins import join_hot


def rejected_by_settings(
    files: DataFrame,
    settings: DataFrame,
    max_depth: int | None = None,
    max_file_size: int | None = None,
) -> DataFrame:
    """``repo, path`` of files that their project's own limits drop.

    ``settings`` is the result of ``settings_resolve``; a project without a row
    has the defaults, and an argument outweighs both. Only names and sizes are
    joined.
    """
    limits = settings.select(
        "repo",
        "max_depth",
        "max_file_size",
        globs.exclude_regex_column(F.col("exclude")).alias("exclude_regex"),
    )
    joined = join_hot(files.select("repo", "path", "size"), limits, ["repo"], "left", "path")
    path = F.col("path")
    deepest = F.coalesce(F.lit(max_depth).cast("int"), "max_depth", F.lit(K.DEFAULT_MAX_DEPTH))
    largest = F.coalesce(
        F.lit(max_file_size).cast("long"), "max_file_size", F.lit(K.DEFAULT_MAX_FILE_SIZE)
    )
    too_deep, too_big = paths.depth(path) > deepest, F.col("size") > largest
    named = F.coalesce(globs.matches(path, F.col("exclude_regex")), F.lit(False))
    return joined.filter(too_deep | too_big | named).select("repo", "path")


def discover(
    files: DataFrame,
    *,
    settings: DataFrame | None = None,
    exclude: list[str] | None = None,
    max_depth: int | None = None,
    max_file_size: int | None = None,
    gitignore: bool = True,
    ignore_files: DataFrame | None = None,
    scope: str | None = None,
    settings_dir: str = K.SETTINGS_DIR,
) -> DataFrame:
    """Files of the snapshot, with ``extension`` and ``language``, content kept.

    Tests on a file alone are plain filters. What depends on the project (its
    settings, its ignore files) becomes a list of rejected names, made without
    touching content, and one anti join: when the list is small Spark
    broadcasts it and content is not shuffled at all. A limit is the argument,
    else that of the project's settings, else the default.

    ``ignore_files`` is a table that holds the ignore files, when the corpus
    stores them apart (``corpus.project_files``); without it they are picked
    from ``files``, which reads the content column once more.
    """
    rules = files if ignore_files is None else ignore_files
    if scope:
        files = filters.scope_dir(files, scope)
        rules = filters.scope_dir(rules, scope)
    kept = filters.visible(filters.exclude_builtin(files, settings_dir))
    kept = filters.exclude_globs(kept, exclude or [])
    rejected = []
    if settings is None:
        largest = K.DEFAULT_MAX_FILE_SIZE if max_file_size is None else max_file_size
        deepest = K.DEFAULT_MAX_DEPTH if max_depth is None else max_depth
        kept = filters.max_depth(filters.max_size(kept, largest), deepest)
    else:
        rejected.append(rejected_by_settings(kept, settings, max_depth, max_file_size))
    if gitignore:
        # rule files are hidden themselves, so they come from the unfiltered table
        rejected.append(ignore.ignored_paths_by(kept, rules))
    if rejected:
        names = reduce(DataFrame.unionByName, rejected)
        kept = kept.join(names, ["repo", "path"], "left_anti")
    return filters.with_language(kept)


def read_texts(discovered: DataFrame) -> DataFrame:
    """Text files only: ``repo, path, size, language, content STRING``."""
    return filters.text_files(discovered).select(
        "repo", "path", "size", "language", "content"
    )
