"""Snapshot files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_lines(rows: DataFrame, order: list, folder: str, column: str = "line") -> None:
    """Write ``repo`` and a text column as ordered text files, one folder per repo.

    Rows are range-partitioned by project and position, so a project of any
    size is cut into consecutive part files, never held by one task; the part
    files of a folder, taken in name order, are the snapshot.
    """
    (
        rows.repartitionByRange("repo", *order)
        .sortWithinPartitions("repo", *order)
        .select("repo", column)
        .write.partitionBy("repo")
        .text(folder)
    )
