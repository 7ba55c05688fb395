"""A boundary that keeps columns from being computed again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(rows: DataFrame) -> DataFrame:
    """The same rows, their columns computed here.

    Without this, a later filter is moved below the projection and its columns
    are put into it, once for every use.
    """
    return rows.select(F.inline(F.array(F.struct(*(F.col(c) for c in rows.columns)))))
