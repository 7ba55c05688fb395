"""Language of a file, from its extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sylvan import constants as K
from sylvan.functions import paths


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


_BY_EXTENSION = {
    ext: language for language, exts in K.LANGUAGE_EXTENSIONS.items() for ext in exts
}


def detect_language(path: Column) -> Column:
    """One of 14 languages, or null; the file is kept either way."""
    # A map literal of 28 entries stays in the projection: no join needed.
    return _literal_map(_BY_EXTENSION)[F.lower(paths.extension(path))]


def is_supported(path: Column) -> Column:
    return detect_language(path).isNotNull()


def short_name(language: Column) -> Column:
    language = F.coalesce(language, F.lit(K.NO_LANGUAGE))
    return F.coalesce(_literal_map(K.LANGUAGE_SHORT_NAMES)[language], language)
