"""Project settings: JSON text per project, resolved against arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan import constants as K
from sylvan.functions import text

SETTINGS_SCHEMA = (
    "exclude array<string>, maxDepth int, maxFileSize bigint, "
    "generateSyntaxTree boolean, outputFormat string, filesToExtract array<string>"
)


def settings_rows(files: DataFrame, settings_dir: str = K.SETTINGS_DIR) -> DataFrame:
    """``repo, config_json`` from the settings files of a corpus."""
    return files.filter(F.col("path") == f"{settings_dir}/{K.SETTINGS_FILE}").select(
        "repo", text.decode_text(F.col("content")).alias("config_json")
    )


_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def is_json(value: Column) -> Column:
    """Whether a text is one JSON value and nothing behind it; keys may repeat."""
    listed = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>", _STRICT)
    return F.coalesce(F.size(listed) == 1, F.lit(False))


def parsed(config_json: Column) -> Column:
    """Settings as a struct; malformed JSON has no field at all. The last of a
    repeated key counts."""
    return F.when(is_json(config_json), F.from_json(config_json, SETTINGS_SCHEMA))


def settings_resolve(
    settings: DataFrame,
    *,
    max_depth: int | None = None,
    max_file_size: int | None = None,
    generate_syntax_tree: bool | None = None,
    output_format: str | None = None,
) -> DataFrame:
    """Per field: the argument, else the project's value, else the default.

    ``0`` and ``false`` are values. An unknown format in the settings reads as
    the default, an unknown format as an argument is an error.
    """
    if output_format is not None and output_format not in K.FORMATS:
        raise ValueError(f"output_format must be one of {K.FORMATS}, not {output_format!r}")
    cfg = settings.withColumn("cfg", parsed(F.col("config_json")))

    def field(argument, name: str, default, kind: str) -> Column:
        return F.coalesce(
            F.lit(argument).cast(kind), F.col(f"cfg.{name}"), F.lit(default).cast(kind)
        )

    fmt = field(output_format, "outputFormat", K.DEFAULT_FORMAT, "string")
    return cfg.select(
        "repo",
        F.coalesce("cfg.exclude", F.array().cast("array<string>")).alias("exclude"),
        field(max_depth, "maxDepth", K.DEFAULT_MAX_DEPTH, "int").alias("max_depth"),
        field(max_file_size, "maxFileSize", K.DEFAULT_MAX_FILE_SIZE, "bigint").alias(
            "max_file_size"
        ),
        field(generate_syntax_tree, "generateSyntaxTree", False, "boolean").alias(
            "generate_syntax_tree"
        ),
        F.when(fmt.isin(K.FORMATS), fmt)
        .otherwise(F.lit(K.DEFAULT_FORMAT))
        .alias("output_format"),
        F.col("cfg.filesToExtract").alias("files_to_extract"),
    )
