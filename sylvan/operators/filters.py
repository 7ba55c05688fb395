"""Row-local file filters. None of them shuffles; those on ``size`` and
``path`` reach the scan, so that content of dropped files is not decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan import constants as K
from sylvan.functions import globs, language, paths, text


def with_language(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.withColumn("extension", paths.extension(path)).withColumn(
        "language", language.detect_language(path)
    )


def supported_only(files: DataFrame) -> DataFrame:
    return files.filter(language.is_supported(F.col("path")))


def max_size(files: DataFrame, limit: int = K.DEFAULT_MAX_FILE_SIZE) -> DataFrame:
    return files.filter(F.col("size") <= limit)


def max_depth(files: DataFrame, limit: int = K.DEFAULT_MAX_DEPTH) -> DataFrame:
    return files.filter(paths.depth(F.col("path")) <= limit)


def visible(files: DataFrame) -> DataFrame:
    return files.filter(~paths.is_hidden(F.col("path")))


def exclude_builtin(files: DataFrame, settings_dir: str = K.SETTINGS_DIR) -> DataFrame:
    """Drop lockfiles and the two tool directories, at any depth."""
    path = F.col("path")
    return files.filter(
        ~paths.basename(path).isin(K.LOCKFILES)
        & ~paths.in_any_dir(path, [K.VCS_DIR, settings_dir])
    )


def exclude_globs(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Drop files that a glob names, and everything below a named directory."""
    if not patterns:
        return files
    regex = globs.exclude_regex_column(F.array(*[F.lit(p) for p in patterns]))
    return files.filter(~F.coalesce(globs.matches(F.col("path"), regex), F.lit(False)))


def scope_dir(files: DataFrame, directory: str) -> DataFrame:
    """Only one subtree; paths and depth count from it."""
    prefix = directory.strip("/") + "/"
    if prefix == "/":
        return files
    return files.filter(F.startswith("path", F.lit(prefix))).withColumn(
        "path", F.substr("path", F.lit(len(prefix) + 1))
    )


def text_files(files: DataFrame) -> DataFrame:
    """Drop binary files and decode the rest."""
    return files.filter(~text.is_binary(F.col("content"))).withColumn(
        "content", text.decode_text(F.col("content"))
    )
