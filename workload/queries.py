"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.functions import language, paths, symbols as S, text as T
from sylvan.operators import filters, ignore, lookup, nodes as N, outline, settings as cfg, stats
from sylvan.operators import symbols as SY
from sylvan.plans import discovery, extraction, snapshot
from workload import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SIZE_LIMIT = 4096
USER_GLOBS = ["docs", "**/*.rs", "lib/**", "{a,x}/b/*/d", "**/fr??.*"]


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _texts(spark, sf_dir):
    return filters.text_files(filters.with_language(V.files(spark, sf_dir)))


def _facts(spark, sf_dir):
    return stats.with_facts(_texts(spark, sf_dir))


def _code_texts(spark, sf_dir):
    return filters.text_files(filters.with_language(V.code_files(spark, sf_dir)))


def _nodes(spark, sf_dir):
    return N.nodes_depth(N.nodes_structural(V.nodes(spark, sf_dir)))


def _symbols(spark, sf_dir):
    return SY.symbols(_nodes(spark, sf_dir))


# --- sources ----------------------------------------------------------------
@query
def files_scan(spark, sf_dir):
    return V.files(spark, sf_dir).select("repo", "path", "size")


@query
def requests_from_list(spark, sf_dir):
    rows = V.table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("repo"),
        F.when(F.col("conv_id") % 5 == 0, " , ,").otherwise(F.col("text")).alias("files"),
        F.array(F.lit("README.md"), F.lit("src/a.ts")).alias("fallback"),
    )
    return lookup.requests_from_list(rows)


@query
def requests_from_json(spark, sf_dir):
    words = F.to_json(F.split("text", " "))
    rows = V.table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("repo"),
        F.when(F.col("turn") % 3 == 0, words)
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), words, F.lit("\n```\nDone.")))
        .otherwise(F.lit("nothing here"))
        .alias("reply"),
    )
    return lookup.requests_from_json(rows)


@query
def settings_resolve(spark, sf_dir):
    return cfg.settings_resolve(V.settings(spark, sf_dir), max_file_size=None, max_depth=None).select(
        "repo",
        F.array_join("exclude", ",").alias("exclude"),
        "max_depth",
        "max_file_size",
        "generate_syntax_tree",
        "output_format",
        F.array_join("files_to_extract", ",").alias("files_to_extract"),
    )


# --- projections ------------------------------------------------------------
@query
def file_extension(spark, sf_dir):
    return V.files(spark, sf_dir).select("repo", "path", paths.extension(F.col("path")).alias("extension"))


@query
def detect_language(spark, sf_dir):
    return V.files(spark, sf_dir).select(
        "repo", "path", language.detect_language(F.col("path")).alias("language")
    )


@query
def supported_only(spark, sf_dir):
    return filters.supported_only(V.files(spark, sf_dir)).select("repo", "path")


@query
def path_depth(spark, sf_dir):
    return V.files(spark, sf_dir).select("repo", "path", paths.depth(F.col("path")).alias("depth"))


@query
def decode_text(spark, sf_dir):
    return V.files(spark, sf_dir).select("repo", "path", T.decode_text(F.col("content")).alias("content"))


@query
def line_count(spark, sf_dir):
    return _texts(spark, sf_dir).select("repo", "path", T.line_count(F.col("content")).alias("line_count"))


@query
def size_info(spark, sf_dir):
    content = F.col("content")
    return _texts(spark, sf_dir).select(
        "repo",
        "path",
        T.byte_length(content).alias("bytes"),
        T.format_bytes(T.byte_length(content)).alias("formatted"),
        T.tokens_of(T.utf16_length(content)).alias("tokens"),
    )


@query
def format_bytes(spark, sf_dir):
    size = (F.col("l_orderkey") * F.col("l_partkey") * F.col("l_linenumber")).cast("long")
    return V.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", T.format_bytes(size).alias("formatted")
    )


@query
def format_count(spark, sf_dir):
    count = (F.col("l_orderkey") * F.col("l_linenumber") * 50).cast("long")
    return V.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", T.format_count(count).alias("formatted")
    )


# --- filters ----------------------------------------------------------------
@query
def filter_size(spark, sf_dir):
    return filters.max_size(V.files(spark, sf_dir), SIZE_LIMIT).select("repo", "path", "size")


@query
def filter_depth(spark, sf_dir):
    return filters.max_depth(V.files(spark, sf_dir)).select("repo", "path")


@query
def filter_hidden(spark, sf_dir):
    return filters.visible(V.files(spark, sf_dir)).select("repo", "path")


@query
def exclude_builtin(spark, sf_dir):
    return filters.exclude_builtin(V.files(spark, sf_dir)).select("repo", "path")


@query
def exclude_user(spark, sf_dir):
    """The always-on rules and the user's, added up."""
    kept = filters.exclude_builtin(V.files(spark, sf_dir))
    return filters.exclude_globs(kept, USER_GLOBS).select("repo", "path")


@query
def exclude_gitignore(spark, sf_dir):
    files = V.files(spark, sf_dir).select("repo", "path", "size", "content")
    return ignore.exclude_ignored(files.unionByName(V.ignore_sources(spark, sf_dir))).select(
        "repo", "path"
    )


@query
def ignore_rules(spark, sf_dir):
    return ignore.ignore_rules(V.ignore_sources(spark, sf_dir)).select(
        "repo", "base_dir", "rule_no", "negated", "dir_only"
    )


@query
def scope_dir(spark, sf_dir):
    scoped = filters.max_depth(filters.scope_dir(V.files(spark, sf_dir), "a/b"), 8)
    return scoped.select("repo", "path", paths.depth(F.col("path")).alias("depth"))


@query
def binary_detect(spark, sf_dir):
    return V.files(spark, sf_dir).select("repo", "path", T.is_binary(F.col("content")).alias("is_binary"))


@query
def text_files(spark, sf_dir):
    return _texts(spark, sf_dir).select("repo", "path", "size", "language")


@query
def discover(spark, sf_dir):
    """All discovery filters with ignore files and per-project settings."""
    files = V.files(spark, sf_dir).select("repo", "path", "size", "content")
    settings = cfg.settings_resolve(V.repo_settings(spark, sf_dir))
    found = discovery.discover(
        files.unionByName(V.ignore_sources(spark, sf_dir)), settings=settings, exclude=["pkg/*"]
    )
    return found.select("repo", "path", "size", "extension", "language")


# --- outline and symbols ----------------------------------------------------
@query
def outline_lines(spark, sf_dir):
    nodes = outline.outline_lines(_code_texts(spark, sf_dir)).drop("seq")
    return nodes.withColumn("ancestors", F.array_join("ancestor_types", ">")).drop("ancestor_types")


@query
def nodes_structural(spark, sf_dir):
    return N.nodes_structural(V.nodes(spark, sf_dir)).select("repo", "path", "seq", "node_type", "signature")


@query
def nodes_depth(spark, sf_dir):
    return N.nodes_depth(V.nodes(spark, sf_dir)).select("repo", "path", "seq", "depth", "indent")


@query
def node_signature(spark, sf_dir):
    return V.nodes(spark, sf_dir).select(
        "repo", "path", "seq", S.signature(F.col("node_text")).alias("signature")
    )


@query
def summary_text(spark, sf_dir):
    texts = V.table(spark, sf_dir, "documents").select(
        V._repo(F.col("doc_id")).alias("repo"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"),
        F.when(F.col("doc_id") % 5 > 0, "typescript").alias("language"),
    )
    return N.summary_text(texts, _nodes(spark, sf_dir))


@query
def summary_parse(spark, sf_dir):
    return N.summary_parse(summary_text(spark, sf_dir)).select(
        "repo", "path", "seq", "indent", "line", "node_type", "signature"
    )


@query
def symbol_kind(spark, sf_dir):
    return V.nodes(spark, sf_dir).select(
        "repo", "path", "seq", S.kind(F.col("node_type")).alias("kind")
    )


@query
def symbol_names(spark, sf_dir):
    return SY.classified(_nodes(spark, sf_dir)).select("repo", "path", "seq", "kind", "name")


@query
def import_names(spark, sf_dir):
    named = SY.classified(_nodes(spark, sf_dir)).filter("kind = 'imp'")
    return named.select("repo", "path", "seq", "signature", "name")


@query
def enclosing_class(spark, sf_dir):
    return _symbols(spark, sf_dir).filter("kind = 'fn'").select(
        "repo", "path", "seq", "name", "parent_class"
    )


@query
def names_by_kind(spark, sf_dir):
    return SY.names_by_kind(_symbols(spark, sf_dir))


@query
def class_methods(spark, sf_dir):
    return SY.class_methods(_symbols(spark, sf_dir))


@query
def file_symbols(spark, sf_dir):
    return SY.file_symbols(_symbols(spark, sf_dir))


# --- aggregates -------------------------------------------------------------
@query
def repo_totals(spark, sf_dir):
    return stats.repo_totals(_facts(spark, sf_dir))


@query
def lang_distribution(spark, sf_dir):
    return stats.lang_distribution(_facts(spark, sf_dir))


@query
def total_size(spark, sf_dir):
    return stats.total_size(_facts(spark, sf_dir))


@query
def header_row(spark, sf_dir):
    return stats.header_row(_facts(spark, sf_dir))


@query
def repo_profile(spark, sf_dir):
    return stats.repo_profile(V.profile_files(spark, sf_dir))


# --- order and tree ---------------------------------------------------------
@query
def path_order(spark, sf_dir):
    """Every page path with the one before it in its repository and top directory."""
    path = F.col("path")
    top = F.substring_index("path", "/", 1)
    before = Window.partitionBy("repo", "top").orderBy(paths.path_order(path), path)
    return (
        V.page_files(spark, sf_dir)
        .select("repo", top.alias("top"), "path")
        .withColumn("previous_path", F.lag("path").over(before))
    )


@query
def dir_rows(spark, sf_dir):
    return snapshot.dir_rows(V.page_files(spark, sf_dir)).select("repo", F.col("path").alias("dir"))


@query
def tree_lines(spark, sf_dir):
    index = V.page_files(spark, sf_dir).withColumn("symbols", F.lit(None).cast("string"))
    return snapshot.tree_lines(index).select(
        "repo", snapshot.sort_text(F.col("key")).alias("position"), "line"
    )


# --- snapshots --------------------------------------------------------------
@query
def raw_snapshot(spark, sf_dir):
    found = discovery.discover(V.files(spark, sf_dir))
    return snapshot.raw_snapshot(discovery.read_texts(found))


@query
def compact_snapshot(spark, sf_dir):
    found = discovery.discover(V.code_files(spark, sf_dir))
    return snapshot.compact_snapshot(discovery.read_texts(found)).select(
        "repo", "section", snapshot.sort_text(F.col("key")).alias("position"), "line"
    )


@query
def snapshot_report(spark, sf_dir):
    found = discovery.discover(V.code_files(spark, sf_dir))
    index = snapshot.stage(snapshot.file_index(discovery.read_texts(found)))
    return stats.snapshot_report(index, snapshot.compact_lines(index))


@query
def llm_input(spark, sf_dir):
    found = discovery.discover(V.code_files(spark, sf_dir))
    settings = cfg.settings_resolve(V.repo_settings(spark, sf_dir))
    rows = snapshot.llm_input(discovery.read_texts(found), settings)
    position = F.when(F.col("format") == "compact", snapshot.sort_text(F.col("key")))
    return rows.select(
        "repo", "format", "section", position.otherwise(F.col("path")).alias("position"), "line"
    )


@query
def request_input(spark, sf_dir):
    return snapshot.request_input(_code_texts(spark, sf_dir))


@query
def raw_report(spark, sf_dir):
    """The run report of the raw format, over all texts of ``files``."""
    found = discovery.discover(V.files(spark, sf_dir))
    texts = discovery.read_texts(found)
    lines = snapshot.raw_snapshot(texts).withColumnRenamed("block", "line")
    return stats.snapshot_report(stats.with_facts(texts), lines, "raw")


# --- lookup -----------------------------------------------------------------
@query
def path_score(spark, sf_dir):
    return V.page_files(spark, sf_dir).select("repo", "path", paths.path_score(F.col("path")).alias("score"))


def _lookup(spark, sf_dir):
    return V.requests(spark, sf_dir), V.page_files(spark, sf_dir)


@query
def resolve_exact(spark, sf_dir):
    return lookup.resolve_exact(*_lookup(spark, sf_dir))


@query
def resolve_search(spark, sf_dir):
    return lookup.resolve_search(*_lookup(spark, sf_dir))


@query
def resolve_best(spark, sf_dir):
    return lookup.resolve_best(*_lookup(spark, sf_dir))


@query
def search_alternatives(spark, sf_dir):
    return lookup.alternatives(*_lookup(spark, sf_dir))


@query
def resolve(spark, sf_dir):
    return lookup.resolve(*_lookup(spark, sf_dir))


def _extracted(spark, sf_dir):
    return extraction.extract(*_lookup(spark, sf_dir))


@query
def missing_requests(spark, sf_dir):
    return lookup.missing_requests(_extracted(spark, sf_dir))


@query
def extract_blocks(spark, sf_dir):
    return lookup.extract_blocks(_extracted(spark, sf_dir))


@query
def extract_report(spark, sf_dir):
    return lookup.extract_report(_extracted(spark, sf_dir))
