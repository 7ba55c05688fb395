"""Quality scores: ridge regression on random Fourier features of document statistics.

Each whole text gives some statistics (lengths, shares of kinds of characters,
repetition of words, runs and lines). Random Fourier features approximate a
Gaussian kernel over them. The normal equations of the ridge regression are
sums over rows: every partition of the labelled rows adds its own, one for each
fold. From sums without a fold come out-of-fold scores of all labelled rows;
isotonic regression on them, over fine bins, calibrates the scores of the model
of all folds. All labelled rows count; only sums of fixed size reach the driver.

Null and empty texts have statistics of zero and get a score as any other.
Labels that are null are left out; a document with several labels has their
mean. Without any label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FEATURES = 256
FOLDS = 3
RIDGE = 1e-3
#: Width of the kernel in standard deviations of the statistics, times the root of their number.
WIDTH = 0.5
#: Fine bins of raw scores for the isotonic step.
BINS = 400
#: Partitions of labelled rows that add up normal equations.
PARTIALS = 64

LETTER, UPPER, DIGIT, MARK, SYMBOL, BLANK, LINE, HIGH = range(8)
NAMES = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "mark", "symbol", "blank", "line", "high",
    "unique_words", "repeated_next", "top_share", "unique_runs", "unique_lines", "log_line", "short_words", "long_words",
)


def _kinds() -> np.ndarray:
    table = np.full(256, SYMBOL, np.int64)
    table[97:123], table[65:91], table[48:58], table[128:] = LETTER, UPPER, DIGIT, HIGH
    table[[ord(c) for c in ".,;:!?'\"()-"]] = MARK
    table[[32, 9]] = BLANK
    table[[10, 13]] = LINE
    return table


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different hashes in each text, and how often the commonest stands."""
    keys = (doc.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20))
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    own = (keys[first] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, own, np.diff(np.append(first, len(keys))))
    return np.bincount(own, minlength=n), most


def statistics(column: pa.Array) -> Iterator[np.ndarray]:
    """A row of ``NAMES`` for each text, chunk by chunk."""
    raw, offsets = common.texts_buffer(column)
    table, lines = common.folding(common.NOT_SPACE), np.arange(256, dtype=np.uint8)
    lines[[10, 13]] = common.GAP
    kinds, powers = _kinds(), common.Powers()
    for lo, hi in common.chunks(offsets):
        n = hi - lo
        own, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        size = np.diff(at)
        doc = np.repeat(np.arange(n), size)
        share = np.bincount(doc * 8 + kinds[own], minlength=8 * n).reshape(n, 8) / np.maximum(size, 1)[:, None]
        words = common.Words(own, at, table)
        hashes, count = words.hashes(powers), words.counts()
        of = np.repeat(np.arange(n), count)
        unique, most = _distinct(of, hashes, n)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        runs = common.windows(hashes, 4)
        inside = common.whole(words.first, 4, len(hashes))
        unique_runs, _ = _distinct(of[: len(runs)][inside], runs[inside], n)
        all_runs = np.maximum(count - 3, 0)
        text_lines = common.Words(own, at, lines)
        n_lines = text_lines.counts()
        unique_lines, _ = _distinct(np.repeat(np.arange(n), n_lines), text_lines.hashes(powers), n)
        length = words.end - words.start
        some = np.maximum(count, 1)
        yield np.stack(
            [
                np.log1p(size),
                np.log1p(count),
                np.bincount(of, weights=length, minlength=n) / some,
                *(share[:, k] for k in (UPPER, DIGIT, MARK, SYMBOL, BLANK, LINE, HIGH)),
                unique / some,
                np.bincount(of, weights=same, minlength=n) / some,
                most / some,
                unique_runs / np.maximum(all_runs, 1),
                unique_lines / np.maximum(n_lines, 1),
                np.log1p(size / np.maximum(n_lines, 1)),
                np.bincount(of, weights=length <= 2, minlength=n) / some,
                np.bincount(of, weights=length >= 12, minlength=n) / some,
            ],
            axis=1,
        )


def with_statistics(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id`` and ``stats`` of all documents, written once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.zeros((0, len(NAMES))), *statistics(batch.column(1))]
            flat = np.vstack(rows)
            stats = common.list_array(flat.ravel(), np.full(len(flat), len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], ["doc_id", "stats"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = documents.schema[doc_id].dataType.simpleString()
    return common.stage(rows.mapInArrow(run, f"doc_id {kind}, stats array<double>"), "statistics")


def fourier(model: dict, stats: np.ndarray) -> np.ndarray:
    """Random Fourier features with a constant."""
    z = (stats - model["mean"]) / model["scale"]
    out = np.cos(np.clip(z, -8, 8) @ model["w"] + model["b"]) * np.sqrt(2 / FEATURES)
    return np.hstack([out, np.ones((len(out), 1))])


def isotonic(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing values closest to ``label`` in order of ``score`` (pooled neighbours)."""
    pools: list[list[float]] = []
    for i in np.argsort(score, kind="stable").tolist():
        pools.append([label[i] * weight[i], weight[i], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, w, n = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + w, pools[-1][2] + n]
    out = np.empty(len(score))
    out[np.argsort(score, kind="stable")] = np.repeat([t / w for t, w, _ in pools], [int(n) for *_, n in pools])
    return out


def fit(labelled: DataFrame) -> dict | None:
    """A model from ``stats`` and ``label`` (0 to 1); None without rows."""
    p = len(NAMES)
    # equal statistics (copies) fall into one fold
    rows = common.stage(
        labelled.select("stats", F.col("label").cast("double").alias("label"))
        .withColumn("fold", F.pmod(F.xxhash64("stats"), F.lit(FOLDS)).cast("int"))
        .coalesce(PARTIALS),
        "labelled",
    )
    moments = rows.agg(
        F.count("*").alias("n"),
        F.array(*(F.avg(F.get("stats", F.lit(i))) for i in range(p))).alias("mean"),
        F.array(*(F.stddev_pop(F.get("stats", F.lit(i))) for i in range(p))).alias("scale"),
    ).first()
    if not moments["n"]:
        return None
    rng = np.random.default_rng(11)
    model = {
        "mean": np.array(moments["mean"]),
        "scale": np.maximum(np.array(moments["scale"]), 1e-6),
        "w": rng.normal(size=(p, FEATURES)) / (WIDTH * np.sqrt(p)),
        "b": rng.uniform(0, 2 * np.pi, FEATURES),
    }
    shared = rows.sparkSession.sparkContext.broadcast(model)
    size = FEATURES + 1

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            fold = batch.column(2).to_numpy()
            flat = batch.column(0).flatten().to_numpy().reshape(-1, p)
            label = batch.column(1).to_numpy()
            for k in range(FOLDS):
                x = fourier(shared.value, flat[fold == k])
                total[k] += x.T @ np.hstack([x, label[fold == k][:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = rows.mapInArrow(sums, "sums binary").rdd.map(lambda r: np.frombuffer(r[0]).reshape(FOLDS, size, size + 1))
    total = parts.treeReduce(lambda a, b: a + b)

    def solve(s: np.ndarray) -> np.ndarray:
        n = max(s[size - 1, size - 1], 1.0)  # the constant, summed
        return np.linalg.solve(s[:, :size] + RIDGE * n * np.eye(size), s[:, size])

    model["beta"] = solve(total.sum(axis=0))
    held_out = [solve(total.sum(axis=0) - total[k]) for k in range(FOLDS)]
    outer = rows.sparkSession.sparkContext.broadcast({**model, "folds": held_out})

    def bins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, ones = np.zeros(BINS + 1), np.zeros(BINS + 1)
        for batch in batches:
            fold, label = batch.column(2).to_numpy(), batch.column(1).to_numpy()
            x = fourier(outer.value, batch.column(0).flatten().to_numpy().reshape(-1, p))
            raw = (x * np.stack(outer.value["folds"])[fold]).sum(axis=1)
            at = np.rint(np.clip(raw, 0, 1) * BINS).astype(int)
            count += np.bincount(at, minlength=BINS + 1)
            ones += np.bincount(at, weights=label, minlength=BINS + 1)
        columns = [pa.array(np.arange(BINS + 1)), pa.array(count), pa.array(ones)]
        yield pa.RecordBatch.from_arrays(columns, ["bin", "n", "ones"])

    found = rows.mapInArrow(bins, "bin long, n double, ones double").groupBy("bin").agg(F.sum("n"), F.sum("ones"))
    table = np.array(sorted(map(tuple, found.filter("sum(n) > 0").collect())))
    model["at"] = table[:, 0] / BINS
    model["value"] = isotonic(table[:, 0], table[:, 2] / table[:, 1], table[:, 1])
    return model


def score(rows: DataFrame, model: dict | None) -> DataFrame:
    """``score`` and ``predicted`` for rows with ``stats``, other columns kept."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    p = len(NAMES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, out = shared.value, np.full(batch.num_rows, 0.5)
            if model is not None and batch.num_rows:
                stats = batch.column(batch.schema.get_field_index("stats")).flatten().to_numpy().reshape(-1, p)
                raw = fourier(model, stats) @ model["beta"]
                # a raw score within a pool moves the calibrated one by a hair, so that order survives
                out = np.clip(np.interp(raw, model["at"], model["value"]) + 1e-6 * (np.clip(raw, 0, 1) - 0.5), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out), pa.array((out >= 0.5).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"],
            )

    return rows.mapInArrow(run, f"{common.ddl(rows)}, score double, predicted int")
