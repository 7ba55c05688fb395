"""Operators on outline nodes, from line patterns or from any other source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan import constants as K
from sylvan.functions import symbols as S
from sylvan.functions import text as T


def shown_indent(depth: Column) -> Column:
    return F.least(depth, F.lit(K.MAX_INDENT_DEPTH)) * 2


def nodes_structural(nodes: DataFrame) -> DataFrame:
    """Keep nodes that carry structure and a text of more than one character.

    Works on ``node_type`` and ``node_text`` (the source text of the node);
    adds ``signature``.
    """
    kept = nodes.filter(
        S.is_structural(F.col("node_type"))
        & ~S.is_generic(F.col("node_type"))
        & (F.length(S.first_line(F.col("node_text"))) > 1)
    )
    return kept.withColumn("signature", S.first_line(F.col("node_text"))).withColumn(
        "signature", S.shortened(F.col("signature"))
    )


def nodes_depth(nodes: DataFrame) -> DataFrame:
    """Logical depth from ``ancestor_types``: member-body wrappers do not count.

    Keeps depth up to 4 and adds ``depth`` and ``indent``.
    """
    logical = F.size(
        F.filter("ancestor_types", lambda t: ~t.isin(K.MEMBER_BODY_TYPES))
    )
    return with_indent(nodes.withColumn("depth", logical))


def with_indent(nodes: DataFrame) -> DataFrame:
    """Cut at the deepest level shown and add ``indent``."""
    return nodes.filter(F.col("depth") <= K.MAX_NODE_DEPTH).withColumn(
        "indent", shown_indent(F.col("depth"))
    )


def node_row(indent: Column, node_type: Column, signature: Column, line: Column) -> Column:
    return F.concat(
        F.repeat(F.lit(" "), indent),
        node_type,
        F.lit(": "),
        signature,
        F.lit(" (line "),
        line.cast("string"),
        F.lit(")"),
    )


def summary_text(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Summary per file: marker and one row per node, or the empty sentinel.

    Files without a language have no summary. The rows of one file meet in one
    group, which the file size limit bounds.
    """
    rows = (
        nodes.withColumn(
            "row", node_row(F.col("indent"), F.col("node_type"), F.col("signature"), F.col("line"))
        )
        .groupBy("repo", "path")
        .agg(F.expr("listagg(row, '\\n') WITHIN GROUP (ORDER BY seq)").alias("rows"))
    )
    summary = F.coalesce(
        F.concat(F.lit(K.SUMMARY_MARKER + "\n"), F.col("rows")), F.lit(K.SUMMARY_EMPTY)
    )
    return texts.join(rows, ["repo", "path"], "left").select(
        "repo", "path", F.when(F.col("language").isNotNull(), summary).alias("summary")
    )


def summary_parse(summaries: DataFrame) -> DataFrame:
    """Rows of a summary: ``repo, path, seq, indent, line, node_type, signature``.

    Rows without a colon stay, with a null type: they still close the classes
    that they are not nested in.
    """
    raw = F.col("raw")
    body = F.col("body")
    tail = r"\(line (\d+)\)\z"
    content = F.when(
        body.rlike(tail), F.regexp_replace(body, f"[{K.SPACE_SET}]*" + tail, "")
    ).otherwise(body)
    colon = F.instr(F.col("content"), ":")
    return (
        summaries.filter(F.length("summary") > 0)
        .select("repo", "path", F.posexplode(F.split("summary", "\n", -1)).alias("seq", "raw"))
        .withColumn("body", T.trim(raw))
        .filter(
            (F.length("body") > 0)
            & ~F.startswith(body, F.lit("==="))
            & (body != K.SUMMARY_EMPTY)
        )
        .withColumn("content", content)
        .select(
            "repo",
            "path",
            "seq",
            T.indent_width(raw).alias("indent"),
            F.regexp_extract(body, tail, 1).try_cast("int").alias("line"),
            F.when(colon > 0, T.trim(F.substring_index("content", ":", 1))).alias("node_type"),
            F.when(colon > 0, T.trim(F.substr("content", colon + 1))).alias("signature"),
        )
    )
