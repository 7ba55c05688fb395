"""Extraction of requested files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sylvan.operators import lookup
from sylvan.sources.staging import stage


def extract(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests with status and text, from request names to file content.

    Names are resolved first, without content, and written once; the result is
    what content is then joined with.
    """
    return lookup.extract_rows(stage(lookup.resolve(requests, files)), files)
