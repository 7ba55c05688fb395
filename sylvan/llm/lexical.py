"""Ranked lexical search: short lists summed first, then one more iterator among the long ones.

``search`` ranks all documents for each item. The documents are dealt into
shards of some text; a shard holds the posting lists of the asked terms, made
where the text is and written once. Counts over all documents give the
weights. In a shard, the lists of an item's rare terms are summed term at a
time into accumulators. The accumulators, sorted by document and bounded by
their largest sum, are then one iterator beside the long lists, all of which
advance document at a time: a block of documents whose bounds together stay
below the worst score still ranked is skipped in every list. A task keeps the
ranking of each item from shard to shard; Spark merges those of the tasks.

Items come to the driver in blocks of at most ``ITEM_BYTES`` of text, each
answered by an index of its own terms. Terms are told apart by 64-bit hashes.

Null texts have no terms; an item without terms has no rows. Equal items count
once, equal document rows each on their own. A null document id ranks behind
the others of its score, a null item id is an item. Empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BEST = 20
#: Text of one shard, and of one block of items.
SHARD_BYTES, ITEM_BYTES = 1 << 24, 1 << 25
#: Documents that are skipped together, and blocks that are scored together.
BLOCK, RUN = 128, 16
#: A list is short that holds at most one in so many documents of its shard.
SHORT = 16
WORDS = common.folding(common.LETTERS_DIGITS)
N_DOCS, N_TERMS = -1, -2

SHARDS = "ids array<bigint>, n binary, first binary, doc binary, tf binary"


def _ints(x: np.ndarray, kind: type) -> pa.Array:
    return pa.array([x.astype(kind).tobytes()], pa.binary())


# --- the index ---------------------------------------------------------------
class Builder:
    """Postings of one shard."""

    def __init__(self, terms: np.ndarray, powers: common.Powers) -> None:
        self.terms, self.powers = terms, powers
        self.ids, self.n, self.doc, self.term, self.tf = [], [], [], [], []
        self.size = self.count = 0

    def add(self, ids: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> None:
        words = common.Words(raw, offsets, WORDS)
        per_doc = words.counts()
        hashes = words.hashes(self.powers)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = self.terms[at] == hashes
        doc = np.repeat(np.arange(len(per_doc)), per_doc)[hit]
        key, tf = np.unique(doc * len(self.terms) + at[hit], return_counts=True)
        self.doc.append(key // len(self.terms) + self.count)
        self.term.append(key % len(self.terms))
        self.tf.append(tf)
        self.ids.append(ids)
        self.n.append(per_doc)
        self.count += len(per_doc)
        self.size += len(raw)

    def finish(self) -> pa.RecordBatch:
        """The shard: documents by ascending id, lists by term, documents ascending in each."""
        ids = pa.chunked_array(self.ids, pa.int64()).combine_chunks()
        n, doc, term, tf = (np.concatenate(x) for x in (self.n, self.doc, self.term, self.tf))
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        order = np.lexsort((ids.fill_null(0).to_numpy(), ~known))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by_term = np.lexsort((place[doc], term))
        first = np.searchsorted(term[by_term], np.arange(len(self.terms) + 1))
        sorted_ids = ids.take(pa.array(order))
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), sorted_ids)
        arrays = [
            listed, _ints(n[order], np.int64), _ints(first, np.int64),
            _ints(place[doc][by_term], np.int32), _ints(tf[by_term], np.int64),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["ids", "n", "first", "doc", "tf"])


def build_index(documents: DataFrame, terms: np.ndarray, *, doc_id: str, text: str) -> DataFrame:
    """Shards with the lists of some terms (sorted hashes), written to the shared folder."""

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = common.Powers()
        builder = Builder(terms, powers)
        for batch in batches:
            raw, offsets = common.texts_buffer(batch.column(1))
            for lo, hi in common.chunks(offsets):
                ids = batch.column(0).slice(lo, hi - lo)
                builder.add(ids, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                if builder.size > SHARD_BYTES:
                    yield builder.finish()
                    builder = Builder(terms, powers)
        if builder.count:
            yield builder.finish()

    rows = documents.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    return common.stage(rows.mapInArrow(shards, SHARDS), "lexical-shards")


def statistics(index: DataFrame) -> dict[int, int]:
    """Documents that hold each term, documents with terms, and all terms; one number per asked term."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, total = None, 0, 0
        for batch in batches:
            for n, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lengths, size = np.frombuffer(n, np.int64), np.diff(np.frombuffer(first, np.int64))
                held = size if held is None else held + size
                docs += int((lengths > 0).sum())
                total += int(lengths.sum())
        if held is not None:
            has = np.flatnonzero(held)
            keys = np.concatenate([has, [N_DOCS, N_TERMS]])
            sums = np.concatenate([held[has], [docs, total]])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["k", "v"])

    rows = index.select("n", "first").mapInArrow(partial, "k long, v long")
    return {r["k"]: r["v"] for r in rows.groupBy("k").agg(F.sum("v").alias("v")).collect()}


# --- one shard ---------------------------------------------------------------
class Ranking:
    """The best documents of an item so far: scores, ids, and which ids are known."""

    def __init__(self, best: int) -> None:
        self.best = best
        self.score, self.id, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def worst(self) -> int:
        """A document below this score cannot be ranked."""
        return int(self.score[-1]) if len(self.score) == self.best else 1

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        score, ids, known = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.known, known)))
        order = np.lexsort((ids, ~known, -score))[: self.best]
        self.score, self.id, self.known = score[order], ids[order], known[order]


class Shard:
    """Posting lists with what each document adds to a score, and their bounds per block."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        ids = row["ids"].values
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        n = np.frombuffer(row["n"].as_py(), np.int64)
        self.first = np.frombuffer(row["first"].as_py(), np.int64)
        self.doc = np.frombuffer(row["doc"].as_py(), np.int32)
        tf = np.frombuffer(row["tf"].as_py(), np.int64)
        m = 75 + (25 * n * n_docs) // n_terms
        each = np.repeat(weights, np.diff(self.first))
        self.gain = each * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.doc]))
        self.blocks = -(-len(n) // BLOCK)
        self.bounds: dict[int, np.ndarray] = {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.first[term], self.first[term + 1]
        return self.doc[a:b], self.gain[a:b]

    def block_bounds(self, doc: np.ndarray, gain: np.ndarray) -> np.ndarray:
        out = np.zeros(self.blocks, np.int64)
        np.maximum.at(out, doc // BLOCK, gain)
        return out

    def term_bounds(self, term: int) -> np.ndarray:
        if term not in self.bounds:
            self.bounds[term] = self.block_bounds(*self.postings(term))
        return self.bounds[term]

    def accumulators(self, terms: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Short lists, term at a time: sorted documents and their sums."""
        if not terms:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        lists = [(*self.postings(t), times) for t, times in terms]
        doc = np.concatenate([d for d, _, _ in lists])
        gain = np.concatenate([g * times for _, g, times in lists])
        order = np.argsort(doc, kind="stable")
        doc = doc[order]
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        return doc[starts], np.add.reduceat(gain[order], starts) if len(doc) else gain

    def rank(self, item: list[tuple[int, int]], ranking: Ranking) -> None:
        """Score the documents of this shard for one item: (term, times) each."""
        size = {t: int(self.first[t + 1] - self.first[t]) for t, _ in item}
        held = [x for x in item if size[x[0]]]
        if not held:
            return
        limit = max(len(self.ids) // SHORT, 1)
        iterators = [(*self.accumulators([x for x in held if size[x[0]] <= limit]), 1)]
        long = [x for x in held if size[x[0]] > limit]
        bounds = self.block_bounds(*iterators[0][:2])
        for term, times in long:
            iterators.append((*self.postings(term), times))
            bounds = bounds + self.term_bounds(term) * times
        least = ranking.worst()
        for _, gain, times in iterators:  # so many documents reach this much by one iterator alone
            if len(gain) >= ranking.best:
                least = max(least, int(np.partition(gain, -ranking.best)[-ranking.best]) * times)
        open_blocks = np.flatnonzero(bounds >= least)
        at = 0
        while at < len(open_blocks):
            lo = int(open_blocks[at])
            if bounds[lo] < max(least, ranking.worst()):
                at += 1
                continue
            hi = lo + 1
            at += 1
            while at < len(open_blocks) and open_blocks[at] == hi and hi - lo < RUN:
                hi, at = hi + 1, at + 1
            self._score(lo * BLOCK, min(hi * BLOCK, len(self.ids)), iterators, ranking, least)

    def _score(self, lo: int, hi: int, iterators: list, ranking: Ranking, least: int) -> None:
        score = np.zeros(hi - lo, np.int64)
        for doc, gain, times in iterators:
            a, b = np.searchsorted(doc, (lo, hi))
            score[doc[a:b] - lo] += gain[a:b] * times
        good = np.flatnonzero(score >= max(least, ranking.worst()))
        if len(good):
            ranking.add(score[good], self.ids[lo + good], self.known[lo + good])


# --- the search --------------------------------------------------------------
def read_items(texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Sorted hashes of all terms, and the terms of each item with how often each stands there."""
    raw, offsets = common.texts_buffer(texts)
    words = common.Words(raw, offsets, WORDS)
    hashes = words.hashes(common.Powers())
    terms = np.unique(hashes)
    number = np.searchsorted(terms, hashes)
    items = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        which, times = np.unique(number[a:b], return_counts=True)
        items.append(list(zip(which.tolist(), times.tolist(), strict=True)))
    return terms, items


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _empty(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")


def _search_block(documents: DataFrame, items: pa.Table, kind: str, best: int, doc_id: str, text: str) -> DataFrame | None:
    terms, asked = read_items(items["text"].combine_chunks())
    if not len(terms):
        return None
    index = build_index(documents, terms, doc_id=doc_id, text=text)
    counts = statistics(index)
    n_docs, n_terms = counts.get(N_DOCS, 0), counts.get(N_TERMS, 0)
    if not n_docs:
        return None
    weights = np.array([weight(n_docs, counts.get(t, 0)) for t in range(len(terms))], np.int64)
    item_ids = items["item_id"].combine_chunks()

    def ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rankings = [Ranking(best) for _ in asked]
        for batch in batches:
            for k in range(len(batch)):
                row = {name: batch.column(c)[k] for c, name in enumerate(batch.schema.names)}
                shard = Shard(row, weights, n_docs, n_terms)
                for item, ranking in zip(asked, rankings, strict=True):
                    shard.rank(item, ranking)
        for k, r in enumerate(rankings):
            if len(r.score):
                item = item_ids.take(pa.array(np.full(len(r.score), k)))
                found = pa.array(r.id, mask=~r.known)
                number = pa.array(np.full(len(r.score), k, np.int32))
                yield pa.RecordBatch.from_arrays([number, item, found, pa.array(r.score)], ["no", "item_id", "doc_id", "score"])

    found = index.mapInArrow(ranked, f"no int, item_id {kind}, doc_id long, score long")
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).drop("no")


def search(
    documents: DataFrame,
    items: DataFrame,
    *,
    best: int = BEST,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of each item."""
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()
    kind = asked.schema["item_id"].dataType.simpleString()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // ITEM_BYTES + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    parts = []
    for b in range(blocks):
        found = _search_block(documents, asked.filter(part == b).toArrow(), kind, best, doc_id, text)
        if found is not None:
            parts.append(found)
    if not parts:
        parts = [_empty(documents.sparkSession, kind).withColumn("rank", F.lit(0))]
    return reduce(DataFrame.unionByName, parts).select("item_id", "rank", "doc_id", "score")
