"""Approximate nearest neighbours with learned partitions.

On a bounded sample of the vectors a neighbour graph is built and cut into
equally large parts by recursive spectral bisection, so that few neighbours are
in different parts. A small neural network learns, for a vector, in which parts
its neighbours are. It gives every vector of the table its part, and routes a
query to its most probable parts, as many as held-out sample queries need for
the wanted recall. All vectors of those parts are ranked by exact distance.

Vectors that are null, zero, hold null or non-finite components, or have
another length than most, take no part, as rows without an id. Of rows with
equal vectors all are candidates; ties go to the smaller id. Rows with one id
are one query and one candidate: an id stands at most once among the neighbours
of another, by the smallest distance between vectors of the two. Tables of every
size are cut into parts and searched through the network; only a table with
fewer than ``LEAST_SHARE`` different vectors for each of two parts is one part.
``exact=True`` searches all. Parts are cut into blocks
of about ``BLOCK`` vectors and ``QUERIES`` queries, whatever their size, so a
part that holds most rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bound on the vectors that graph and network are made from.
SAMPLE = 4096
#: Vectors in a part, about, and most parts.
PART, MOST_PARTS = 2048, 64
#: Parts of small tables, and sample vectors that a part needs.
LEAST_PARTS, LEAST_SHARE = 8, 16
NEIGHBOURS = 10
RECALL = 0.97
BLOCK, QUERIES = 4096, 512
HIDDEN, EPOCHS, RATE, BATCH = 128, 30, 2e-3, 256


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest rows of each row, itself left out, block by block."""
    out = []
    norm = (x * x).sum(axis=1)
    for lo in range(0, len(x), 512):
        d = norm[None, :] - 2 * x[lo : lo + 512] @ x.T
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, k, axis=1)[:, :k])
    return np.vstack(out)


def bisect(near: np.ndarray, parts: int) -> np.ndarray:
    """Part of each node of a neighbour graph; parts differ by one node in size at most per cut.

    Each cut orders the nodes by the second eigenvector of the random walk on
    the graph between them and splits the order in the middle.
    """
    n, k = near.shape
    u, v = np.repeat(np.arange(n), k), near.ravel()
    label = np.zeros(n, np.int64)
    rng = np.random.default_rng(3)
    done = 1
    while done < parts:
        inside = label[u] == label[v]
        a, b = u[inside], v[inside]
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1.0
        weight = np.bincount(label, weights=degree, minlength=done)
        y = rng.normal(size=n)
        for _ in range(60):
            mean = np.bincount(label, weights=degree * y, minlength=done) / np.maximum(weight, 1)
            y = y - mean[label]
            walk = np.bincount(a, weights=y[b], minlength=n) + np.bincount(b, weights=y[a], minlength=n) + y
            y = 0.5 * (y + walk / degree)
            size = np.sqrt(np.bincount(label, weights=y * y, minlength=done))
            y = y / np.maximum(size, 1e-12)[label]
        order = np.lexsort((np.arange(n), y, label))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.searchsorted(label[order], label[order])
        half = np.bincount(label, minlength=done) // 2
        label = 2 * label + (place >= half[label])
        done *= 2
    return label


def shares(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of each part for rows of vectors."""
    z = (x - model["mean"]) / model["scale"]
    h = np.maximum(z @ model["w1"] + model["b1"], 0)
    s = h @ model["w2"] + model["b2"]
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, target: np.ndarray) -> dict:
    """A network with one hidden layer whose output comes close to ``target`` (Adam, cross entropy)."""
    rng = np.random.default_rng(5)
    d, parts = x.shape[1], target.shape[1]
    model = {
        "mean": x.mean(axis=0),
        "scale": np.maximum(x.std(), 1e-12),
        "w1": rng.normal(size=(d, HIDDEN)) * np.sqrt(2 / d),
        "b1": np.zeros(HIDDEN),
        "w2": rng.normal(size=(HIDDEN, parts)) * np.sqrt(1 / HIDDEN),
        "b2": np.zeros(parts),
    }
    names = ("w1", "b1", "w2", "b2")
    first, second = ({k: np.zeros_like(model[k]) for k in names} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            some = order[lo : lo + BATCH]
            z = (x[some] - model["mean"]) / model["scale"]
            h = np.maximum(z @ model["w1"] + model["b1"], 0)
            out = (shares(model, x[some]) - target[some]) / len(some)
            back = (out @ model["w2"].T) * (h > 0)
            slopes = {"w1": z.T @ back, "b1": back.sum(axis=0), "w2": h.T @ out, "b2": out.sum(axis=0)}
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * slopes[k]
                second[k] = 0.999 * second[k] + 0.001 * slopes[k] ** 2
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                model[k] = model[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return model


def fit(x: np.ndarray, parts: int, recall: float = RECALL) -> dict:
    """A model from sample vectors: the network and the number of parts to search."""
    near = neighbours(x, min(NEIGHBOURS, len(x) - 1))
    label = bisect(near, parts)
    target = np.zeros((len(x), parts))
    for column in (label[:, None], near):
        kinds = label[column] if column is near else column
        np.add.at(target, (np.repeat(np.arange(len(x)), kinds.shape[1]), kinds.ravel()), 1)
    target /= target.sum(axis=1, keepdims=True)
    test = np.arange(len(x)) % 10 == 0
    # held-out queries tell how many parts are needed; every vector's part is the network's first choice
    model = train(x[~test], target[~test])
    p = shares(model, x)
    part = p.argmax(axis=1)
    rank = np.empty_like(p, dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-p, axis=1, kind="stable"), np.arange(parts)[None, :], axis=1)
    ranks = np.take_along_axis(rank, part[near], axis=1)[test].ravel()
    found = np.cumsum(np.bincount(ranks, minlength=parts)) / max(len(ranks), 1)
    return {**model, "parts": parts, "probes": min(int(np.searchsorted(found, recall)) + 1, parts)}


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id`` and ``v`` of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.filter(~bad & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def search(
    vectors: DataFrame,
    is_query,
    *,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    recall: float = RECALL,
    exact: bool = False,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (distance) of the ``k`` nearest.

    ``is_query`` is a condition on ``vec_id`` that says which rows are queries
    too. A query's own id is no candidate of it. ``recall`` is the share of
    neighbours that held-out queries have to find; ``exact`` leaves the parts out.
    """
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, vec_id, vector)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], empty)
    rows, n = rows.filter(F.size("v") == sizes["d"]), sizes["count"]
    parts, model = 1, None
    if not exact:
        # by the hash of the vector, so that copies count once
        draw = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / float(1 << 30)
        sample = rows.filter(draw < min(1.0, 1.2 * SAMPLE / n)).select("v").distinct().orderBy(F.xxhash64("v"))
        x = matrix(sample.limit(SAMPLE).toArrow()["v"])
        while parts * 2 * LEAST_SHARE <= len(x) and parts < max(LEAST_PARTS, min(MOST_PARTS, n // PART)):
            parts *= 2
        if parts > 1:
            model = fit(x, parts, recall)
    shared = spark.sparkContext.broadcast(model)

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.zeros(batch.num_rows, np.int64)
            if shared.value is not None and batch.num_rows:
                part = shares(shared.value, matrix(batch.column(1))).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], ["vec_id", "v", "part"])

    placed = common.stage(rows.mapInArrow(label, "vec_id long, v array<double>, part int"), "parts")
    held = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("ids")).collect()
    counts, ids_in = {r["part"]: r["n"] for r in held}, {r["part"]: r["ids"] for r in held}
    asked = placed.filter(is_query(F.col("vec_id"))).distinct()

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.array([ids_in.get(p, 0) for p in range(parts)])
        for batch in batches:
            if not batch.num_rows:
                continue
            p = np.ones((batch.num_rows, 1))
            if shared.value is not None:
                p = shares(shared.value, matrix(batch.column(1)))
            order = np.argsort(-p, axis=1, kind="stable")
            probes = 1 if shared.value is None else shared.value["probes"]
            # as many more parts as it takes to see k others at all
            seen = np.cumsum(size[order], axis=1) - size[order]
            take = (np.arange(order.shape[1])[None, :] < probes) | (seen < k + 1)
            query, column = np.nonzero(take & (size[order] > 0))
            batch = batch.take(pa.array(query))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(order[query, column], pa.int32())], ["query_id", "q", "part"]
            )

    routed = common.stage(asked.mapInArrow(route, "query_id long, q array<double>, part int"), "routed")
    queries = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    if not queries:
        return spark.createDataFrame([], empty)
    blocks = {p: -(-c // BLOCK) for p, c in counts.items()}
    crowds = {p: -(-c // QUERIES) for p, c in queries.items()}

    def number(of: dict[int, int]):
        return F.element_at(F.create_map(*(F.lit(x) for p, c in of.items() for x in (p, c))), F.col("part"))

    def spread(column: str, of: dict[int, int]):
        return F.pmod(F.xxhash64(column), number(of)).cast("int")

    left = placed.filter(F.col("part").isin(list(queries))).select(
        "vec_id",
        "v",
        "part",
        spread("vec_id", blocks).alias("block"),
        F.explode(F.sequence(F.lit(0), number(crowds) - 1)).alias("crowd"),
    )
    right = routed.select(
        "query_id",
        "q",
        "part",
        F.explode(F.sequence(F.lit(0), number(blocks) - 1)).alias("block"),
        spread("query_id", crowds).alias("crowd"),
    )

    def rank(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(candidates) and len(queries):
            x, q = matrix(candidates["v"]), matrix(queries["q"])
            ids, own = candidates["vec_id"].to_numpy(), queries["query_id"].to_numpy()
            by_id = np.argsort(ids, kind="stable")
            x, ids = x[by_id], ids[by_id]
            lead = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            norm = (x * x).sum(axis=1)
            for i in range(len(q)):
                rough = norm - 2 * (x @ q[i])
                rough[ids == own[i]] = np.inf
                least = np.minimum.reduceat(rough, lead)  # one for each id
                left = int(np.isfinite(least).sum())
                if not left:
                    continue
                edge = np.partition(least, min(k, left) - 1)[min(k, left) - 1]
                near = np.flatnonzero(rough <= edge + 1e-9 * (1 + abs(edge) + norm.max()))
                exact = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], exact))
                best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])[:k]]
                out[0] += [own[i]] * len(best)
                out[1] += ids[near][best].tolist()
                out[2] += exact[best].tolist()
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    keys = ["part", "block", "crowd"]
    near = (
        left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
    )
    # an id may have several vectors; both steps share one shuffle
    near = near.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
