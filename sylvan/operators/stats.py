"""Totals per project. All of them are partial aggregates first, so that a
project with a large share of the files costs no more than any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan import constants as K
from sylvan.functions import language as L
from sylvan.functions import paths
from sylvan.functions import text as T
from sylvan.operators import settings as cfg


def with_facts(texts: DataFrame) -> DataFrame:
    """Add ``line_count``, ``bytes`` and ``units`` (UTF-16 length) of a text."""
    content = F.col("content")
    return (
        texts.withColumn("line_count", T.line_count(content))
        .withColumn("bytes", T.byte_length(content))
        .withColumn("units", T.utf16_length(content))
    )


_SUMS = {"line_count": "n_lines", "size": "total_size", "bytes": "bytes", "units": "units"}


def language_heads(facts: DataFrame) -> DataFrame:
    """``repo, lang, n, first_key`` and the sums of the facts there are.

    The one aggregate over the files; whatever a head shows is rolled up from
    its rows, of which a project has as many as languages.
    """
    path = F.col("path")
    sums = [F.sum(fact).alias(name) for fact, name in _SUMS.items() if fact in facts.columns]
    return facts.groupBy(
        "repo", F.coalesce("language", F.lit(K.NO_LANGUAGE)).alias("lang")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(paths.path_order(path).alias("o"), path.alias("p"))).alias("first_key"),
        *sums,
    )


def rolled_up(heads: DataFrame) -> DataFrame:
    """One row per project from ``language_heads``: ``repo, n_files, languages`` and the sums.

    ``languages`` is ``ts:15 js:1``, in order of first path. At most 15 entries
    per project meet here.
    """
    entry = F.concat(L.short_name(F.col("lang")), F.lit(":"), F.col("n").cast("string"))
    sums = [F.sum(name).alias(name) for name in _SUMS.values() if name in heads.columns]
    return heads.withColumn("entry", entry).groupBy("repo").agg(
        F.sum("n").alias("n_files"),
        F.expr("listagg(entry, ' ') WITHIN GROUP (ORDER BY first_key)").alias("languages"),
        *sums,
    )


def repo_totals(facts: DataFrame) -> DataFrame:
    """``repo, n_files, n_lines, total_size``."""
    return facts.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("line_count").alias("n_lines"),
        F.sum("size").alias("total_size"),
    )


def lang_distribution(facts: DataFrame) -> DataFrame:
    """``repo, languages``: ``ts:15 js:1``, languages in order of first path."""
    return rolled_up(language_heads(facts)).select("repo", "languages")


def total_size(facts: DataFrame) -> DataFrame:
    """Size of all texts of a project taken as one: one rounding, at the end."""
    return (
        facts.groupBy("repo")
        .agg(F.sum("bytes").alias("bytes"), F.sum("units").alias("units"))
        .select(
            "repo",
            "bytes",
            T.format_bytes(F.col("bytes")).alias("formatted"),
            T.tokens_of(F.col("units")).alias("tokens"),
        )
    )


def _header(scope: str | None) -> Column:
    root = F.concat("repo", F.lit("/" + scope.strip("/"))) if scope else F.col("repo")
    return F.concat(
        F.lit("# "),
        paths.project_name(root),
        F.lit(" ("),
        F.col("n_files").cast("string"),
        F.lit(" files, "),
        T.format_count(F.col("n_lines")),
        F.lit(" lines)"),
    )


def header_row(facts: DataFrame, scope: str | None = None) -> DataFrame:
    """``repo, header``: ``# name (N files, L lines)``."""
    return repo_totals(facts).select("repo", _header(scope).alias("header"))


def repo_heads(facts: DataFrame, scope: str | None = None) -> DataFrame:
    """``repo, header, languages``, from one aggregate over the files."""
    return rolled_up(language_heads(facts)).select("repo", _header(scope).alias("header"), "languages")


def band(ratio: Column) -> Column:
    return (
        F.when(ratio < K.GREEN_BELOW, "green").when(ratio < K.YELLOW_BELOW, "yellow").otherwise("red")
    )


def snapshot_report(
    facts: DataFrame, lines: DataFrame, output_format: str = "compact"
) -> DataFrame:
    """Run report per project: sizes before and after, ratio, saved or added.

    ``lines`` is a snapshot, ``repo, line``: joined by newlines it is the
    output text. The ratio is given for the compact format only.
    """
    before = (
        facts.groupBy("repo")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.sum("bytes").alias("original_bytes"),
            F.sum("units").alias("original_units"),
        )
    )
    line = F.col("line")
    after = (
        lines.groupBy("repo")
        .agg(
            (F.sum(T.byte_length(line)) + F.count(F.lit(1)) - 1).alias("generated_bytes"),
            (F.sum(T.utf16_length(line)) + F.count(F.lit(1)) - 1).alias("generated_units"),
        )
    )
    original, generated = F.col("original_bytes"), F.col("generated_bytes")
    saved = original - generated
    kilobytes = F.concat(T.one_decimal(F.abs(saved) / 1024.0), F.lit(" KB"))
    out = before.join(after, "repo").select(
        "repo",
        "n_files",
        "original_bytes",
        T.format_bytes(original).alias("original_size"),
        T.tokens_of(F.col("original_units")).alias("original_tokens"),
        "generated_bytes",
        T.format_bytes(generated).alias("generated_size"),
        T.tokens_of(F.col("generated_units")).alias("generated_tokens"),
        F.when(saved > 0, kilobytes).alias("space_saved"),
        F.when(saved < 0, kilobytes).alias("space_added"),
    )
    if output_format != "compact":
        return out
    # an empty original has no ratio
    ratio = F.when(original > 0, generated.cast("double") / original * 100.0)
    return out.withColumn(
        "ratio", F.concat(T.one_decimal(ratio), F.lit("%"))
    ).withColumn("band", F.when(original > 0, band(ratio)))


def repo_profile(files: DataFrame, settings_dir: str = K.SETTINGS_DIR) -> DataFrame:
    """What a project has at its root: ignore file, settings, manifests.

    The test on the path reaches the scan; a second, one-column pass over the
    files keeps the projects that have none of these.
    """
    path = F.col("path")
    settings_path = f"{settings_dir}/{K.SETTINGS_FILE}"
    is_ignore, is_settings = path == K.IGNORE_FILE, path == settings_path
    rows = files.filter(path.isin(K.IGNORE_FILE, settings_path, *K.MANIFESTS)).select(
        "repo", "path", F.when(is_ignore | is_settings, T.decode_text(F.col("content"))).alias("body")
    )
    body = F.col("body")
    n_rules = F.size(
        F.filter(
            F.split(body, "\n", -1),
            lambda x: (F.length(T.trim(x)) > 0) & ~F.startswith(x, F.lit("#")),
        )
    )
    valid = is_settings & cfg.is_json(body)
    parsed = cfg.parsed(body)
    fmt = parsed["outputFormat"]
    known_format = fmt.isNull() | (fmt == "") | fmt.isin(K.FORMATS)
    manifests = F.array(*[F.lit(m) for m in K.MANIFESTS])
    found = rows.groupBy("repo").agg(
        F.max(is_ignore).alias("has_ignore_file"),
        F.max(F.when(is_ignore, n_rules)).alias("n_ignore_rules"),
        F.max(is_settings).alias("has_settings"),
        F.max(F.when(is_settings, cfg.is_json(body))).alias("settings_valid"),
        F.max(F.when(valid, known_format)).alias("format_valid"),
        F.max(F.when(valid, F.coalesce(F.size(parsed["exclude"]), F.lit(0)))).alias("n_excludes"),
        # at most five names, in the order of the list
        F.array_join(
            F.array_intersect(manifests, F.collect_set(F.when(path.isin(K.MANIFESTS), path))), ","
        ).alias("manifests"),
    )
    return (
        files.select("repo")
        .distinct()
        .join(found, "repo", "left")
        .withColumn("has_ignore_file", F.coalesce("has_ignore_file", F.lit(False)))
        .withColumn("has_settings", F.coalesce("has_settings", F.lit(False)))
        .withColumn("manifests", F.coalesce("manifests", F.lit("")))
    )
