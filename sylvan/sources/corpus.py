"""Corpus tables: from parquet, or from a directory tree.

Spark's own binary-file source hides names that start with ``_``, so that
``__init__.py`` would be lost; the directory source below does not.
"""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sylvan import constants as K
from sylvan.functions import paths

FILES_SCHEMA = "repo string, path string, size bigint, content binary"


def read_table(spark: SparkSession, location: str) -> DataFrame:
    """A files table in parquet."""
    return spark.read.parquet(location).select("repo", "path", "size", "content")


def save_bucketed(files: DataFrame, table: str, buckets: int) -> None:
    """Store a files table bucketed by file name.

    Lists of rejected or requested names are then joined with it without
    shuffling content, whatever the length of the list. A bucket holds files
    of all projects, so a large project fills no bucket more than others.
    """
    files.select("repo", "path", "size", "content").repartition(
        buckets, "repo", "path"
    ).write.bucketBy(buckets, "repo", "path").sortBy("repo", "path").saveAsTable(table)


def project_files(files: DataFrame, settings_dir: str = K.SETTINGS_DIR) -> DataFrame:
    """The few files that describe a project: ignore, settings and manifest files.

    Stored apart once (they are tiny), they spare discovery and profiles a
    pass over the content of the whole corpus.
    """
    path = F.col("path")
    root_names = [f"{settings_dir}/{K.SETTINGS_FILE}", *K.MANIFESTS]
    # the suffix test reaches the scan
    is_ignore = F.endswith(path, F.lit(K.IGNORE_FILE)) & (paths.basename(path) == K.IGNORE_FILE)
    return files.filter(is_ignore | path.isin(root_names))


class _Subtree(InputPartition):
    def __init__(self, repo: str, root: str, below: str, recurse: bool):
        super().__init__(None)
        self.repo, self.root, self.below, self.recurse = repo, root, below, recurse


class TreeReader(DataSourceReader):
    """Splits the tree by directory; executors list and read the files."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.by_child = options.get("repos", "children") == "children"
        self.wanted = int(options.get("min_partitions", "64"))
        # files above it are not opened
        self.max_size = int(options["max_size"]) if "max_size" in options else None

    def partitions(self):
        roots = [("", os.path.basename(self.root))]
        if self.by_child:
            roots = [(d, d) for d in _dirs_of(self.root)]
        todo = [(repo, os.path.join(self.root, d).rstrip("/"), "") for d, repo in roots]
        parts: list[_Subtree] = []
        # open directories level by level until there is enough to hand out
        while todo and len(todo) + len(parts) < self.wanted:
            level = []
            for repo, root, below in todo:
                parts.append(_Subtree(repo, root, below, False))
                here = os.path.join(root, below)
                level += [(repo, root, os.path.join(below, d)) for d in _dirs_of(here)]
            todo = level
        return parts + [_Subtree(*t, True) for t in todo]

    def read(self, part):
        top = os.path.join(part.root, part.below)
        for folder, dirs, names in os.walk(top):
            if not part.recurse:
                dirs.clear()
            for name in names:
                full = os.path.join(folder, name)
                try:
                    found = os.stat(full)
                    # pipes and sockets are no files; unreadable files are skipped
                    if not stat.S_ISREG(found.st_mode) or self._too_big(found.st_size):
                        continue
                    with open(full, "rb") as handle:
                        content = handle.read()
                except OSError:
                    continue
                yield part.repo, os.path.relpath(full, part.root), len(content), content

    def _too_big(self, size: int) -> bool:
        return self.max_size is not None and size > self.max_size


def _dirs_of(folder: str) -> list[str]:
    with os.scandir(folder) as entries:
        return sorted(e.name for e in entries if e.is_dir(follow_symlinks=False))


class TreeSource(DataSource):
    """``spark.read.format("source_tree").load(folder)``.

    Options: ``repos`` is ``children`` (each sub-folder is a repository) or
    ``single``; ``min_partitions`` is how far the tree is split up front;
    ``max_size`` leaves larger files out without opening them.
    """

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return FILES_SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


def read_tree(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").options(**options).load(folder)
