"""Snapshots as tables of ordered lines or blocks.

A snapshot stays a table: ``repo``, sort columns, text. No step builds the
whole text of a project in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan import constants as K
from sylvan.functions import paths
from sylvan.functions import symbols as SF
from sylvan.operators import nodes as N
from sylvan.operators import outline, stats
from sylvan.operators import symbols as S
from sylvan.operators.joins import join_hot
from sylvan.sources.staging import stage

_FACTS = ["size", "language", "line_count", "bytes", "units"]
TREE_SECTION = 6
RAW_SECTION = 3
KEY_TYPE = "array<struct<kind:int,name:string>>"


def file_index(texts: DataFrame) -> DataFrame:
    """One narrow row per file: facts and symbol text. Reads content once.

    Nodes are found, classified and named where the content is; what is
    shuffled, by file, is one row of kind and name per node. Every step from
    there to the symbol text stays in that partitioning.
    """
    facts = stats.with_facts(texts).withColumn("facts", F.struct(*_FACTS))
    named = S.classified(_signed(outline.outline_rows(facts, carry=["facts"])))
    placed = outline.with_position(named.drop("node_type", "node_text", "signature"), deepest=K.MAX_NODE_DEPTH)
    shown = F.col("depth") <= K.MAX_NODE_DEPTH
    nested = S.enclosing_class(
        placed.withColumn("kind", F.when(shown, F.col("kind"))).withColumn(
            "indent", F.when(shown & F.col("is_node"), N.shown_indent(F.col("depth")))
        )
    )
    return S.file_symbols(nested, facts=["facts"]).select("repo", "path", "facts.*", "symbols")


def _signed(rows: DataFrame) -> DataFrame:
    """The node filters, but as nulls: the rows with facts must not get lost.

    The text of an outline row is a trimmed line already.
    """
    node_type, node_text = F.col("node_type"), F.col("node_text")
    is_node = (
        SF.is_structural(node_type)
        & ~SF.is_generic(node_type)
        & (F.length(node_text) > 1)
    )
    return (
        rows.withColumn("is_node", F.coalesce(is_node, F.lit(False)))
        .withColumn("signature", F.when(F.col("is_node"), SF.shortened(node_text)))
        .withColumn("node_type", F.when(F.col("is_node"), node_type))
    )


def dir_rows(files: DataFrame) -> DataFrame:
    """Every directory once: ``repo, path``, without a trailing slash."""
    return files.select(
        "repo", F.explode(paths.ancestor_dirs(F.col("path"))).alias("path")
    ).distinct()


def _indented(path: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), paths.depth(path) - 1), text)


def tree_lines(index: DataFrame) -> DataFrame:
    """``repo, key, line``: directories and files with symbols, in tree order of ``key``."""
    path = F.col("path")
    name = paths.basename(path)
    dirs = dir_rows(index).select(
        "repo",
        paths.tree_key(path, is_dir=True).cast(KEY_TYPE).alias("key"),
        _indented(path, F.concat(name, F.lit("/"))).alias("line"),
    )
    files = index.select(
        "repo",
        paths.tree_key(path, is_dir=False).cast(KEY_TYPE).alias("key"),
        _indented(path, F.concat_ws(" ", name, "symbols")).alias("line"),
    )
    return dirs.unionByName(files)


def _head_lines(
    facts: DataFrame, fixed: list[str], scope: str | None, opening: list[str] | None
) -> DataFrame:
    """Opening lines, header, languages and fixed lines: ``repo, section, line``.

    Sections count from 0 for the header; opening lines are negative.
    """
    opening = opening or []
    heads = stats.repo_heads(facts, scope)
    lines = F.array(
        *[F.lit(x) for x in opening], "header", "languages", *[F.lit(x) for x in fixed]
    )
    return heads.select("repo", F.posexplode(lines).alias("pos", "line")).select(
        "repo", (F.col("pos") - len(opening)).alias("section"), "line"
    )


def compact_lines(
    index: DataFrame, scope: str | None = None, opening: list[str] | None = None
) -> DataFrame:
    """``repo, section, key, line`` from a file index (staged by the caller)."""
    head = _head_lines(index, ["", K.LEGEND, K.LEGEND_FORMAT, ""], scope, opening)
    none = F.array().cast(KEY_TYPE)
    return head.select("repo", "section", none.alias("key"), "line").unionByName(
        tree_lines(index).select("repo", F.lit(TREE_SECTION).alias("section"), "key", "line")
    )


def compact_snapshot(
    texts: DataFrame, scope: str | None = None, opening: list[str] | None = None
) -> DataFrame:
    """Compact snapshot: ``repo, section, key, line``, ordered by the middle two.

    The index is written once and read three times (header, directories,
    files); content is read once.
    """
    return compact_lines(stage(file_index(texts)), scope, opening)


def raw_snapshot(
    texts: DataFrame, scope: str | None = None, opening: list[str] | None = None
) -> DataFrame:
    """Raw snapshot: ``repo, section, path, block``, ordered by section and path.

    Blocks are projections of the files, not shuffled here; the sink sorts.
    """
    head = _head_lines(stats.with_facts(texts), [""], scope, opening)
    blocks = texts.select(
        "repo",
        F.lit(RAW_SECTION).alias("section"),
        "path",
        F.concat(F.lit("=== "), "path", F.lit(" ===\n"), "content", F.lit("\n")).alias("block"),
    )
    return head.select(
        "repo", "section", F.lit("").alias("path"), F.col("line").alias("block")
    ).unionByName(blocks)


def compact_order() -> list[Column]:
    return [F.col("section"), F.col("key")]


def raw_order() -> list[Column]:
    return [F.col("section"), paths.path_order(F.col("path")), F.col("path")]


def of_format(texts: DataFrame, settings: DataFrame, output_format: str) -> DataFrame:
    """Texts of the projects whose resolved settings ask for a format.

    Projects without settings have the default. Only the list of projects with
    the other format is joined.
    """
    others = settings.filter(F.col("output_format") != K.DEFAULT_FORMAT).select("repo").distinct()
    how = "left_anti" if output_format == K.DEFAULT_FORMAT else "left_semi"
    return join_hot(texts, others, ["repo"], how, "path")


def llm_input(texts: DataFrame, settings: DataFrame) -> DataFrame:
    """Instruction text and snapshot per project, in the format it asks for.

    ``repo, format, section, key, path, line``: section -2 is the instruction,
    -1 a blank, then the snapshot, ordered as in ``llm_order``. It stays rows,
    as every snapshot here, so a project of any size fits; joined by newlines
    in order it is the input text.
    """
    compact = compact_snapshot(
        of_format(texts, settings, "compact"), opening=[K.PROMPT_COMPACT, ""]
    )
    raw = raw_snapshot(of_format(texts, settings, "raw"), opening=[K.PROMPT_RAW, ""])
    return compact.select(
        "repo", F.lit("compact").alias("format"), "section", "key", F.lit("").alias("path"), "line"
    ).unionByName(
        raw.select(
            "repo",
            F.lit("raw").alias("format"),
            "section",
            F.array().cast(KEY_TYPE).alias("key"),
            "path",
            F.col("block").alias("line"),
        )
    )


def request_input(texts: DataFrame) -> DataFrame:
    """``repo, prompt``: the instruction to ask for files, for every project with texts.

    The answers are read by ``lookup.requests_from_json``.
    """
    return texts.select("repo").distinct().withColumn("prompt", F.lit(K.PROMPT_REQUEST))


def llm_order() -> list[Column]:
    return [F.col("section"), F.col("key"), paths.path_order(F.col("path")), F.col("path")]


def sort_text(key: Column) -> Column:
    """A tree key as text: kinds and names, one step per slash. It shows where a
    line belongs; only the key itself sorts in tree order."""
    return F.array_join(
        F.transform(key, lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), s["name"])), "/"
    )
