"""Symbols: classified, named nodes, and their text per file.

All steps work per ``(repo, path)``. Rows partitioned that way once (by the
first window) stay there: the wider grouping keys below need no new exchange.
A group is one file, which the file size limit bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan import constants as K
from sylvan.functions import symbols as S

_FILE = ["repo", "path"]
# Indents at which a class can enclose something: the deepest shown is 6.
CLASS_INDENTS = (0, 2, 4)


def classified(nodes: DataFrame) -> DataFrame:
    """Add ``kind`` and ``name``; both are null for rows that give no symbol."""
    kind, name = F.col("kind"), F.col("name")
    return (
        nodes.withColumn("kind", S.kind(F.col("node_type")))
        .withColumn("name", S.found_text(kind, F.col("signature")))
        .withColumn("name", S.name_from(kind, name))
        .withColumn("kind", F.when(name != "", kind))
        .withColumn("name", F.when(name != "", name))
    )


def enclosing_class(rows: DataFrame) -> DataFrame:
    """Add ``parent_class`` to functions: the class they are nested in.

    A class at indent L is open for a row when it is the last row before it
    with an indent of L or less; the deepest open class below the row's own
    indent encloses it. Rows with a null indent take no part.
    """
    before = (
        Window.partitionBy(*_FILE).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    )
    parent = None
    for level in sorted(CLASS_INDENTS, reverse=True):
        here = (F.col("kind") == "cls") & (F.col("indent") == level)
        last = F.last(
            F.when(
                F.col("indent") <= level,
                F.struct(F.coalesce(here, F.lit(False)).alias("open"), F.col("name").alias("name")),
            ),
            ignorenulls=True,
        ).over(before)
        hit = (F.lit(level) < F.col("indent")) & last["open"]
        parent = F.when(hit, last["name"]) if parent is None else parent.when(hit, last["name"])
    return rows.withColumn("parent_class", F.when(F.col("kind") == "fn", parent))


def symbols(nodes: DataFrame) -> DataFrame:
    """``repo, path, seq, line, kind, name, parent_class`` of each symbol."""
    return (
        enclosing_class(classified(nodes))
        .filter(F.col("kind").isNotNull())
        .select(*_FILE, "seq", "line", "kind", "name", "parent_class")
    )


def _in_order(seq: str, value: str) -> Column:
    """Distinct values of a group, joined by commas in order of appearance."""
    by_seq = F.array_sort(F.collect_list(F.struct(seq, value)))
    return F.array_join(F.array_distinct(F.transform(by_seq, lambda x: x[value])), ",")


def names_by_kind(symbol_rows: DataFrame) -> DataFrame:
    """Distinct names per file and kind, in order of first appearance."""
    return symbol_rows.groupBy(*_FILE, "kind").agg(_in_order("seq", "name").alias("names"))


def _entries(symbol_rows: DataFrame, facts: list[str]) -> DataFrame:
    """Entries behind a file name: classes with methods, and plain names.

    ``methods`` is empty for an entry without any.
    """
    keep = [F.first(c, ignorenulls=True).alias(c) for c in facts]
    is_method = F.col("parent_class").isNotNull()
    rows = (
        symbol_rows.withColumn("grp", F.when(is_method, "cls").otherwise(F.col("kind")))
        .withColumn("owner", F.when(is_method, F.col("parent_class")).otherwise(F.col("name")))
        .withColumn("method", F.when(is_method, F.col("name")))
    )
    return rows.groupBy(*_FILE, "grp", "owner").agg(
        F.min("seq").alias("first_seq"), _in_order("seq", "method").alias("methods"), *keep
    )


def class_methods(symbol_rows: DataFrame) -> DataFrame:
    """Classes per file with their methods; same-named classes merge.

    ``repo, path, class_name, first_seq, methods``, the methods joined by
    commas in order of first appearance, null without any.
    """
    return (
        _entries(symbol_rows, [])
        .filter(F.col("grp") == "cls")
        .select(
            *_FILE,
            F.col("owner").alias("class_name"),
            "first_seq",
            F.when(F.col("methods") != "", F.col("methods")).alias("methods"),
        )
    )


def file_symbols(symbol_rows: DataFrame, facts: list[str] | None = None) -> DataFrame:
    """Symbol text per file: ``cls:A(m,n),B fn:f imp:… exp:… var:… mod:…``.

    Rows with a null kind keep their file in the result, with null symbols.
    ``facts`` are columns carried along, taken from the row that has them.
    """
    facts = facts or []
    keep = [F.first(c, ignorenulls=True).alias(c) for c in facts]
    entry = F.when(
        F.col("methods") != "", F.concat("owner", F.lit("("), "methods", F.lit(")"))
    ).otherwise(F.col("owner"))
    by_seq = F.array_sort(F.collect_list(F.struct("first_seq", "grp", "entry")))

    def part(kind: Column) -> Column:
        mine = F.filter("entries", lambda e: e["grp"] == kind)
        names = F.array_join(F.transform(mine, lambda e: e["entry"]), ",")
        return F.when(F.size(mine) > 0, F.concat(kind, F.lit(":"), names))

    # groups without an entry are null, which the join leaves out
    text = F.array_join(F.transform(F.array(*[F.lit(k) for k in K.KIND_ORDER]), part), " ")
    return (
        _entries(symbol_rows, facts)
        .withColumn("entry", entry)
        .groupBy(*_FILE)
        .agg(by_seq.alias("entries"), *keep)
        .withColumn("symbols", F.when(text != "", text))
        .select(*_FILE, "symbols", *facts)
    )
