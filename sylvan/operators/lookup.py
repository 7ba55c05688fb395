"""File requests: find the file that a requested name means.

A request is first a path. Only when no file or directory has that path, the
name is searched: any file whose path ends with it, outside a few well-known
directories and not below a hidden one, and the best by a score wins. The work goes over
distinct names, so a name that is asked for often is looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan import constants as K
from sylvan.functions import globs, paths
from sylvan.functions import text as T
from sylvan.operators.joins import join_hot

_NAME = ["repo", "requested"]
PATTERN_BUNDLE = 64
_LENGTH_BITS = 32


def requests_from_list(rows: DataFrame) -> DataFrame:
    """``repo, files STRING, fallback ARRAY<STRING>`` → one row per request.

    ``files`` is a comma-separated list; without any name in it the fallback
    (the list in the settings) counts.
    """
    listed = F.filter(
        F.transform(F.split(F.coalesce("files", F.lit("")), ","), T.trim),
        lambda name: F.length(name) > 0,
    )
    chosen = F.when(F.size(listed) > 0, listed).otherwise(F.col("fallback"))
    return rows.select("repo", F.posexplode(chosen).alias("req_no", "requested"))


def requests_from_json(replies: DataFrame) -> DataFrame:
    """``repo, reply`` → one row per path in the fenced JSON array of a reply.

    A reply without a fence is read as the array itself. Order and repeats stay.
    """
    fenced = F.regexp_extract("reply", r"(?s)```json[ \t\r]*\n(.*?)```", 1)
    body = F.when(F.length(fenced) > 0, fenced).otherwise(F.col("reply"))
    return replies.select(
        "repo",
        F.posexplode(F.from_json(body, "array<string>")).alias("req_no", "requested"),
    )


def _rank(path: Column) -> Column:
    """Preference of a hit as one number: score, then length. The lowest is the best."""
    return paths.path_score(path).cast("long") * (1 << _LENGTH_BITS) + F.length(path)


def _score_of(rank: Column) -> Column:
    return F.shiftright(rank, _LENGTH_BITS).cast("int")


def _first_paths(hits: DataFrame, least: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, best_path``: of the hits with the least rank of their name, the first path.

    Only the few hits that are equal in score and length are compared as text;
    the least rank itself is a number, which aggregates without a sort.
    """
    equal = join_hot(hits, least.select(*keys, "rank"), [*keys, "rank"], "left_semi", spread="path")
    return equal.groupBy(*keys).agg(F.min("path").alias("best_path"))


def _keys_of_file(path: Column, settings_dir: str) -> Column:
    """Every name that can lead to a file: its path, its directories, and, when
    a search may find it, its path suffixes."""
    def entry(key: Column, is_file: bool, is_dir: bool, rank: Column) -> Column:
        return F.struct(
            key.alias("key"),
            F.lit(is_file).alias("is_file"),
            F.lit(is_dir).alias("is_dir"),
            rank.cast("long").alias("rank"),
        )

    itself = F.array(entry(path, True, False, F.lit(None)))
    above = F.transform(
        paths.ancestor_dirs(path), lambda d: entry(d, False, True, F.lit(None))
    )
    below = F.transform(paths.path_suffixes(path), lambda s: entry(s, False, False, _rank(path)))
    return F.concat(itself, above, F.when(_is_searchable(path, settings_dir), below).otherwise(F.slice(itself, 1, 0)))


def _is_searchable(path: Column, settings_dir: str) -> Column:
    return ~paths.in_any_dir(path, [*K.SEARCH_SKIP_DIRS, settings_dir])


def _names(requests: DataFrame) -> DataFrame:
    return (
        requests.select(*_NAME)
        .distinct()
        .withColumn("norm", paths.normalized(F.col("requested")))
        .withColumn("is_glob", globs.has_glob_chars(F.col("requested")))
    )


def _known(files: DataFrame, names: DataFrame, settings_dir: str) -> DataFrame:
    """What the corpus has under each wanted name, one row per ``repo, key``.

    One pass over the file names. Names shared by many files (``src``,
    ``index.js``) are spread while they are matched and reduced to one row per
    task before they are shuffled again. A minimum of numbers finds the best
    hits; ``_with_search`` adds the path.
    """
    wanted = (
        names.select("repo", F.explode(F.array("requested", "norm")).alias("key"))
        .filter(F.col("key").isNotNull())
        .distinct()
    )
    return (
        _met(files, wanted, settings_dir)
        .groupBy("repo", "key")
        .agg(
            F.max("is_file").alias("is_file"),
            F.max("is_dir").alias("is_dir"),
            F.min("rank").alias("rank"),
            F.count("rank").alias("n_hits"),
        )
    )


def _met(files: DataFrame, wanted: DataFrame, settings_dir: str) -> DataFrame:
    """The names of files that are wanted: ``repo, path, key, is_file, is_dir, rank``."""
    names = F.inline(_keys_of_file(F.col("path"), settings_dir))
    rows = files.select("repo", "path").select("repo", "path", names)
    return join_hot(rows, wanted, ["repo", "key"], "left_semi", spread="path")


def _with_exact(names: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``path`` and ``is_dir`` of the normalised request."""
    at = known.select("repo", F.col("key").alias("norm"), "is_file", F.col("is_dir").alias("found_dir"))
    norm = F.col("norm")
    return (
        names.join(at, ["repo", "norm"], "left")
        .withColumn("path", F.when(F.col("is_file"), norm))
        .withColumn(
            "is_dir",
            F.coalesce("found_dir", F.lit(False)) | F.coalesce(norm == "", F.lit(False)),
        )
    )


def resolve_exact(
    requests: DataFrame, files: DataFrame, settings_dir: str = K.SETTINGS_DIR
) -> DataFrame:
    """``repo, requested, path, is_dir`` per distinct request; path null on a miss.

    No filter applies here: a hidden or excluded file can be asked for by path.
    A request that names a directory has ``is_dir`` true and no path.
    """
    names = _names(requests)
    return _with_exact(names, _known(files, names, settings_dir)).select(*_NAME, "path", "is_dir")


def _glob_candidates(files: DataFrame, names: DataFrame, settings_dir: str) -> DataFrame:
    """Files and the wildcards to test them on: ``repo, path, any, patterns``.

    An inverted index over pieces of file names: of the pieces that a wildcard
    cannot do without, the one that the fewest files of its project have leads
    to its candidates. A wildcard with a piece that no file has meets none; one
    without any fixed character (``*``) meets all. Wildcards of one piece go in
    bundles of about ``PATTERN_BUNDLE``, with one regex for all of them first.
    """
    path = F.col("path")
    pieces = names.select(*_NAME, F.explode(globs.glob_pieces(F.col("requested"))).alias("piece"))
    searchable = files.select("repo", "path").filter(_is_searchable(path, settings_dir))
    asked = join_hot(searchable, names.select("repo").distinct(), ["repo"], "left_semi", "path")
    index = asked.select("repo", "path", F.explode(globs.path_pieces(path)).alias("piece"))
    wanted = pieces.select("repo", "piece").distinct()
    sizes = (
        join_hot(index, wanted, ["repo", "piece"], "left_semi", "path")
        .groupBy("repo", "piece")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # one name with its few pieces is a group
    rarest = Window.partitionBy(*_NAME).orderBy("n", "piece")
    chosen = (
        pieces.join(sizes, ["repo", "piece"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("at", F.row_number().over(rarest))
        .filter("at = 1 AND n > 0")
        .select(*_NAME, "piece")
    )
    counts = chosen.groupBy("repo", "piece").agg(
        F.ceil(F.count(F.lit(1)) / PATTERN_BUNDLE).cast("int").alias("n_bundles")
    )
    regex = globs.search_regex_column(F.col("requested"))
    bundles = (
        chosen.join(counts, ["repo", "piece"])
        .groupBy("repo", "piece", F.pmod(F.xxhash64("requested"), "n_bundles").alias("bundle"))
        .agg(F.collect_list(F.struct("requested", regex.alias("regex"))).alias("patterns"))
        .withColumn("any", F.array_join(F.col("patterns.regex"), "|"))
    )
    return join_hot(index, bundles, ["repo", "piece"], "inner", "path").select("repo", "path", "any", "patterns")


def _glob_hits(files: DataFrame, names: DataFrame, settings_dir: str) -> DataFrame:
    """Names with wildcards: ``repo, requested, path`` of the candidates that fit."""
    path = F.col("path")
    met = _glob_candidates(files, names, settings_dir).filter(globs.matches(path, F.col("any")))
    hits = F.filter("patterns", lambda p: globs.matches(path, p["regex"]))
    return met.select("repo", "path", F.explode(hits).alias("hit")).select(
        "repo", F.col("hit.requested").alias("requested"), "path"
    )


def _best(hits: DataFrame) -> DataFrame:
    """Best hit per name: ``repo, requested, rank, n_hits, best_path``. Numbers
    combine before the shuffle; no sort over the hits."""
    ranked = hits.select(*_NAME, "path", _rank(F.col("path")).alias("rank"))
    least = ranked.groupBy(*_NAME).agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n_hits"))
    return least.join(_first_paths(ranked, least, _NAME), _NAME)


def resolve_search(
    requests: DataFrame, files: DataFrame, settings_dir: str = K.SETTINGS_DIR
) -> DataFrame:
    """All hits of a search: ``repo, requested, path, score``.

    A path ends with the requested name exactly when the name is one of its
    suffixes, so this is an equality join, never a comparison of all pairs.
    """
    names = _names(requests)
    path = F.col("path")
    suffixes = (
        files.select("repo", "path")
        .filter(_is_searchable(path, settings_dir))
        .select("repo", "path", F.explode(paths.path_suffixes(path)).alias("requested"))
    )
    plain = names.filter(~F.col("is_glob")).select(*_NAME)
    hits = join_hot(suffixes, plain, _NAME, "left_semi", spread="path").select(*_NAME, "path")
    wild = _glob_hits(files, names.filter("is_glob"), settings_dir).select(*_NAME, "path")
    return hits.unionByName(wild).withColumn("score", paths.path_score(path).cast("int"))


def _with_search(
    names: DataFrame, known: DataFrame, files: DataFrame, settings_dir: str
) -> DataFrame:
    """Add ``rank``, ``n_hits`` and ``best_path`` of the search for a name; null without a hit."""
    plain = names.filter(~F.col("is_glob")).select(*_NAME)
    at = known.filter("n_hits > 0").select("repo", F.col("key").alias("requested"), "rank", "n_hits")
    at = at.join(plain, _NAME, "left_semi")
    keys = at.select("repo", F.col("requested").alias("key"))
    hits = _met(files, keys, settings_dir).filter(F.col("rank").isNotNull())
    hits = hits.select("repo", F.col("key").alias("requested"), "path", "rank")
    found = at.join(_first_paths(hits, at, _NAME), _NAME)
    wild = _best(_glob_hits(files, names.filter("is_glob"), settings_dir))
    return names.join(found.unionByName(wild), _NAME, "left")


def resolve_best(
    requests: DataFrame, files: DataFrame, settings_dir: str = K.SETTINGS_DIR
) -> DataFrame:
    """``repo, requested, path, score, n_matches``: the preferred hit per name.

    Ties go to the shorter path, then by path.
    """
    names = _names(requests)
    return (
        _with_search(names, _known(files, names, settings_dir), files, settings_dir)
        .filter("n_hits > 0")
        .select(
            *_NAME,
            F.col("best_path").alias("path"),
            _score_of(F.col("rank")).alias("score"),
            F.col("n_hits").alias("n_matches"),
        )
    )


def alternatives(
    requests: DataFrame, files: DataFrame, settings_dir: str = K.SETTINGS_DIR
) -> DataFrame:
    """The other hits of names with more than one, as rows."""
    best = resolve_best(requests, files, settings_dir).filter("n_matches > 1").select(
        *_NAME, F.col("path").alias("best_path")
    )
    return (
        join_hot(resolve_search(requests, files, settings_dir), best, _NAME, "inner", spread="path")
        .filter("path <> best_path")
        .select(*_NAME, "path", "score")
    )


def resolve(
    requests: DataFrame, files: DataFrame, settings_dir: str = K.SETTINGS_DIR
) -> DataFrame:
    """``repo, req_no, requested, path, strategy, is_dir, n_matches`` per request."""
    names = _names(requests)
    known = _known(files, names, settings_dir)
    exact = _with_exact(names, known)
    # only a miss is searched
    missed = F.col("path").isNull() & ~F.col("is_dir")
    answers = _with_search(exact, known, files, settings_dir).select(
        *_NAME,
        F.when(missed, F.col("best_path")).otherwise(F.col("path")).alias("path"),
        F.when(~missed, "exact").when(F.col("n_hits") > 0, "search").alias("strategy"),
        "is_dir",
        F.when(missed, F.coalesce("n_hits", F.lit(0)))
        .otherwise(F.col("path").isNotNull().cast("long"))
        .alias("n_matches"),
    )
    # a name may be asked for very often
    return join_hot(requests, answers, _NAME, "inner", "req_no")


def extract_rows(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Requests with the text of their file; null text where there is none.

    ``resolved`` (staged by the caller) is the small side: where its measured
    size allows, Spark broadcasts it and content is not shuffled. A file asked
    for many times is repeated once per request, as the output has it.
    """
    found = resolved.filter(F.col("path").isNotNull())
    read = found.join(files.select("repo", "path", "content"), ["repo", "path"])
    binary = T.is_binary(F.col("content"))
    texts = read.withColumn("status", F.when(binary, "binary").otherwise("extracted")).withColumn(
        "content", F.when(F.col("status") == "extracted", T.decode_text(F.col("content")))
    )
    others = (
        resolved.filter(F.col("path").isNull())
        .withColumn("status", F.when(F.col("is_dir"), "directory").otherwise("not_found"))
        .withColumn("content", F.lit(None).cast("string"))
    )
    return texts.unionByName(others)


def missing_requests(extracted: DataFrame) -> DataFrame:
    """Requests without output: ``repo, req_no, requested, status``."""
    return extracted.filter("status <> 'extracted'").select(
        "repo", "req_no", "requested", "status"
    )


def extract_blocks(extracted: DataFrame) -> DataFrame:
    """``repo, req_no, block``: delimiter, blank, text, blank, in request order."""
    return extracted.filter("status = 'extracted'").select(
        "repo",
        "req_no",
        F.concat(F.lit("=== "), "path", F.lit(" ===\n\n"), "content", F.lit("\n")).alias("block"),
    )


def extract_report(extracted: DataFrame) -> DataFrame:
    """Counts and total size per project.

    The names without output are the rows of ``missing_requests``.
    """
    done = F.col("status") == "extracted"
    content = F.when(done, F.col("content"))
    return (
        extracted.groupBy("repo")
        .agg(
            F.count(F.lit(1)).alias("requested"),
            F.count_if(done).alias("found"),
            F.count_if(done).alias("extracted"),
            F.count_if(~done).alias("missing"),
            F.coalesce(F.sum(T.byte_length(content)), F.lit(0)).alias("bytes"),
            F.coalesce(F.sum(T.utf16_length(content)), F.lit(0)).alias("units"),
        )
        .select(
            "repo",
            "requested",
            "found",
            "extracted",
            "missing",
            "bytes",
            T.format_bytes(F.col("bytes")).alias("formatted"),
            T.tokens_of(F.col("units")).alias("tokens"),
        )
    )
