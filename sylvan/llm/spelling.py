"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

Every letter belongs to one of eight groups (its code point modulo 8), and a
word is arranged by how many letters of each group it has, one group after
another. An inserted letter adds one to one count, a deleted one takes one
away, a replaced one does both or neither. So the words near a word are in
leaves that a depth-first search reaches with a surplus of one and a deficit
of one to spend; words of such leaves are compared letter by letter.

``count_words`` counts words over all texts, ``near_words`` finds all pairs,
``group_variants`` adds forms and roots. The trie is cut below its upper
levels into shards, so deep that none holds more than ``SHARD`` words; a word
is kept in one shard and visits the few that its budget reaches. A task holds
the words of one shard and streams the visitors.

Null texts have no words; a null id counts as an empty one. Repeated rows count
as often as they stand. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

GROUPS = 8
#: Words of a shard that a task holds at once.
SHARD = 10_000
MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: One in so many occurrences loses a letter, by the hash of id and word.
NOISE = 199
#: Search steps and letters compared at once.
STEPS, CELLS = 1 << 17, 1 << 21
#: Bytes of text between two rounds of counting.
ROUND = 1 << 24
#: Longer words get their hash one by one.
LONG = 64
LATIN_LEAD = 0xC3


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[LATIN_LEAD] = True


# --- words of texts ----------------------------------------------------------
def letters_only(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with every byte outside A-Z, a-z and U+00C0 to U+00FF as a gap."""
    inside = LETTER[raw]
    behind = np.zeros(len(raw), bool)
    behind[1:] = raw[:-1] == LATIN_LEAD
    return np.where(inside | (behind & (raw & 0xC0 == 0x80)), raw, np.uint8(common.GAP))


def _gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte runs one after another, and n + 1 offsets."""
    offsets = np.concatenate([[0], np.cumsum(length)])
    return data[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])], offsets


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of what stands before (as a finished CRC-32) followed by the word."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    state = (before ^ np.uint32(0xFFFFFFFF))[order]
    at, size = start[order], -length[order]
    for j in range(min(LONG, int(-size[0]) if len(size) else 0)):
        k = int(np.searchsorted(size, -j, "left"))
        state[:k] = CRC[(state[:k] ^ data[at[:k] + j]) & 255] ^ (state[:k] >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > LONG):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(before[i]))
    return out


def _occurrences(ids: list[bytes], raw: np.ndarray, offsets: np.ndarray) -> Iterator[pa.Array]:
    """Words of enough letters of some texts, every occurrence, after the noise."""
    words = common.Words(letters_only(raw), offsets, LOWER)
    data = words.folded
    letters = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    n = letters[words.end] - letters[words.start]
    keep = np.flatnonzero(n >= MIN_LETTERS)
    start, end, n = words.start[keep], words.end[keep], n[keep]
    prefix = np.array([zlib.crc32(i + b":") for i in ids], np.uint32)
    h = hash_words(data, start, end, np.repeat(prefix, words.counts())[keep])
    noisy = h % NOISE == 0
    some, at = _gathered(data, start[~noisy], (end - start)[~noisy])
    yield pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(some))
    hit = noisy & (n > MIN_LETTERS)
    changed = []
    for a, b, x in zip(start[hit], end[hit], h[hit].tolist(), strict=True):
        word = data[a:b].tobytes().decode()
        changed.append(word[: x % len(word)] + word[x % len(word) + 1 :])
    yield pa.array(changed, pa.large_string())


def count_words(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: words of at least six letters and how often they occur.

    Counts are made within some texts at a time, then by Spark over all.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            found = pa.chunked_array(held, pa.large_string()).value_counts()
            return pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])

        for batch in batches:
            ids = [str(i).encode() if i is not None else b"" for i in batch.column(0).to_pylist()]
            raw, offsets = common.texts_buffer(batch.column(1))
            for lo, hi in common.chunks(offsets):
                part = raw[offsets[lo] : offsets[hi]]
                held += _occurrences(ids[lo:hi], part, offsets[lo : hi + 1] - offsets[lo])
                size += len(part)
                if size > ROUND:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = documents.select(F.col(doc_id).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- the trie ----------------------------------------------------------------
POWERS = common.Powers()


class WordList:
    """Words as code points, with their letter-group counts and hashes of their halves."""

    def __init__(self, words: pa.Array) -> None:
        self.texts = words.to_pylist()
        self.length = np.array([len(w) for w in self.texts], np.int64)
        self.points = np.frombuffer("".join(self.texts).encode("utf-32-le"), np.uint32)
        self.start = np.cumsum(self.length) - self.length
        owner = np.repeat(np.arange(len(self.texts)), self.length)
        flat = np.bincount(owner * GROUPS + self.points % GROUPS, minlength=len(self.texts) * GROUPS)
        self.counts = flat.reshape(-1, GROUPS).astype(np.int64)
        up, down = POWERS.upto(len(self.points) + 1)
        sums = np.zeros(len(self.points) + 1, np.uint64)
        np.cumsum((self.points + np.uint64(1)) * up[: len(self.points)], out=sums[1:])
        end = self.start + self.length
        #: first and last half, and those of a word that is one letter shorter
        self.halves = []
        for half in (self.length // 2, np.maximum(self.length - 1, 0) // 2):
            first = (sums[self.start + half] - sums[self.start]) * down[self.start]
            last = (sums[end] - sums[end - half]) * down[end - half]
            self.halves.append((first, last))


class Trie:
    """Letter-group counts of words, level by level; a leaf is a run of words in ``order``."""

    def __init__(self, counts: np.ndarray) -> None:
        levels = counts.shape[1]
        self.order = np.lexsort(counts.T[::-1]) if counts.size else np.arange(len(counts))
        ordered = counts[self.order]
        self.base = int(counts.max(initial=0)) + 3
        node = np.zeros(len(ordered), np.int64)
        self.children = []
        for level in range(levels):
            key = node * self.base + ordered[:, level] + 1
            unique, node = np.unique(key, return_inverse=True)
            self.children.append(unique)
        self.first = np.searchsorted(node, np.arange(node[-1] + 2 if len(node) else 1))

    def leaves(
        self, counts: np.ndarray, surplus: np.ndarray, deficit: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaves that the budgets of the queries reach: (query, leaf), some at a time.

        A depth-first search that takes up to ``STEPS`` of its branches together.
        """
        n, levels = len(counts), len(self.children)
        if not n or not len(self.order):
            return
        stack = [(0, np.arange(n), np.zeros(n, np.int64), surplus, deficit)]
        while stack:
            level, query, node, more, less = stack.pop()
            if len(query) > STEPS:
                half = len(query) // 2
                stack += [(level, *(x[s] for x in (query, node, more, less))) for s in (slice(half, None), slice(half))]
                continue
            if level == levels:
                yield query, node
                continue
            known, found = self.children[level], []
            for step, can in ((0, None), (1, less > 0), (-1, more > 0)):
                pick = slice(None) if can is None else np.flatnonzero(can)
                value = counts[query[pick], level] + step
                key = node[pick] * self.base + value + 1
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                ok = (known[at] == key) & (value >= 0) & (value + 2 < self.base)
                found.append([x[ok] for x in (query[pick], at, more[pick] - (step < 0), less[pick] - (step > 0))])
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*found, strict=True))))

    def words(self, query: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) of all words of the leaves, some at a time."""
        size = self.first[leaf + 1] - self.first[leaf]
        total = np.concatenate([[0], np.cumsum(size)])
        lo = 0
        while lo < len(leaf):
            hi = max(int(np.searchsorted(total, total[lo] + STEPS, "right")) - 1, lo + 1)
            n = size[lo:hi]
            inside = np.arange(total[hi] - total[lo]) - np.repeat(total[lo:hi] - total[lo], n)
            yield np.repeat(query[lo:hi], n), self.order[np.repeat(self.first[leaf[lo:hi]], n) + inside]
            lo = hi


def share_half(a: WordList, i: np.ndarray, b: WordList, j: np.ndarray) -> np.ndarray:
    """Which pairs can be one edit apart: what the edit does not touch has a half of the shorter word."""
    more = a.length[i] - b.length[j]
    out = np.zeros(len(i), bool)
    for difference, of_a, of_b in ((0, 0, 0), (1, 1, 0), (-1, 0, 1)):
        k = np.flatnonzero(more == difference)
        ia, jb = i[k], j[k]
        out[k] = (a.halves[of_a][0][ia] == b.halves[of_b][0][jb]) | (a.halves[of_a][1][ia] == b.halves[of_b][1][jb])
    return out


def one_edit(a: WordList, i: np.ndarray, b: WordList, j: np.ndarray) -> np.ndarray:
    """Which pairs differ by exactly one inserted, deleted or replaced letter."""
    out = np.zeros(len(i), bool)
    la, lb = a.length[i], b.length[j]
    short, long = np.minimum(la, lb), np.maximum(la, lb)
    order = np.argsort(long, kind="stable")
    order = order[(long - short <= 1)[order]]
    lo = 0
    while lo < len(order):
        # equal lengths are few; a block takes as many pairs as its longest word allows
        size = np.arange(1, len(order) - lo + 1) * long[order[lo:]]
        hi = lo + max(int(np.searchsorted(size, CELLS, "right")), 1)
        k = order[lo:hi]
        width = int(long[k[-1]])
        column = np.arange(width)
        within = column < short[k, None]

        def letters(w: WordList, at: np.ndarray, size: np.ndarray, column=column) -> np.ndarray:
            place = w.start[at][:, None] + np.minimum(column, size[:, None] - 1)
            return w.points[place]

        def backwards(w: WordList, at: np.ndarray, size: np.ndarray, column=column) -> np.ndarray:
            place = w.start[at][:, None] + np.maximum(size[:, None] - 1 - column, 0)
            return w.points[place]

        same = (letters(a, i[k], la[k]) == letters(b, j[k], lb[k])) & within
        ahead = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        equal = la[k] == lb[k]
        replaced = equal & (short[k] - same.sum(axis=1) == 1)
        tail = (backwards(a, i[k], la[k]) == backwards(b, j[k], lb[k])) & within
        behind = np.where(tail.all(axis=1), width, np.argmin(tail, axis=1))
        out[k] = replaced | (~equal & (np.minimum(ahead, short[k]) + np.minimum(behind, short[k]) >= short[k]))
        lo = hi
    return out


def _shard(prefix: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(prefix, np.int32)]


def _visits(words: WordList, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Rows of words, prefixes, and what is left of surplus and deficit.

    Only prefixes behind the own one in order are visited, so that words of
    different shards meet once.
    """
    own = words.counts[:, :depth]
    everyone = np.arange(len(own))
    for up in range(depth):
        step = own.copy()
        step[:, up] += 1
        yield everyone, step, 1, 0
        for down in range(up + 1, depth):
            both = np.flatnonzero(own[:, down] > 0)
            pair = step[both]
            pair[:, down] -= 1
            yield both, pair, 0, 0


def depth_of(words: DataFrame, shard: int = SHARD) -> int:
    """Levels of the trie above the cut, so that no shard has more words than ``shard``."""

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = WordList(batch.column(0)).counts
            for depth in range(1, GROUPS):
                key = pa.array(_shard(counts[:, :depth]), pa.binary())
                found = key.value_counts()
                rows = [pa.array(np.full(len(found), depth, np.int32)), found.field(0), found.field(1)]
                yield pa.RecordBatch.from_arrays(rows, ["depth", "prefix", "n"])

    sizes = words.select("word").mapInArrow(prefixes, "depth int, prefix binary, n long")
    largest = sizes.groupBy("depth", "prefix").agg(F.sum("n").alias("n")).groupBy("depth").agg(F.max("n"))
    return min((d for d, n in largest.collect() if n <= shard), default=GROUPS)


def near_words(words: DataFrame, *, depth: int | None = None) -> DataFrame:
    """``word, n, near, near_n``: each pair of near words once."""
    depth = depth or depth_of(words)

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = WordList(batch.column(0))
            own = pa.array(_shard(listed.counts[:, :depth]), pa.binary())
            yield rows(batch, own, 0, 1, 1)
            for which, prefix, surplus, deficit in _visits(listed, depth):
                if len(which):
                    yield rows(batch.take(pa.array(which)), pa.array(_shard(prefix), pa.binary()), 1, surplus, deficit)

    def rows(batch: pa.RecordBatch, shard: pa.Array, role: int, surplus: int, deficit: int) -> pa.RecordBatch:
        constant = [pa.array(np.full(len(batch), x, np.int8)) for x in (role, surplus, deficit)]
        return pa.RecordBatch.from_arrays([shard, *constant, *batch.columns], ["shard", "role", "surplus", "deficit", "word", "n"])

    shape = "shard binary, role byte, surplus byte, deficit byte, word string, n long"
    spread = words.select("word", "n").mapInArrow(dealt, shape)
    met = spread.repartition("shard").sortWithinPartitions("shard", "role")
    return met.mapInArrow(_searched(depth), "word string, n long, near string, near_n long")


def _searched(depth: int):
    """The search within the shards of a partition, which come one after another, owners first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, trie, listed, count = None, [], None, None, None

        def pairs(asked: WordList, n: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, own: bool):
            for query, leaf in trie.leaves(asked.counts[:, depth:], surplus, deficit):
                for i, j in trie.words(query, leaf):
                    if own:
                        i, j = i[i < j], j[i < j]
                    for test in (share_half, one_edit):
                        hit = test(asked, i, listed, j)
                        i, j = i[hit], j[hit]
                    left, right = pa.array([asked.texts[x] for x in i], pa.string()), pa.array([listed.texts[x] for x in j], pa.string())
                    yield pa.RecordBatch.from_arrays([left, pa.array(n[i]), right, pa.array(count[j])], ["word", "n", "near", "near_n"])

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal trie, listed, count, held
            table = pa.Table.from_batches(held)
            held = []
            listed, count = WordList(table["word"].combine_chunks()), table["n"].to_numpy()
            trie = Trie(listed.counts[:, depth:])
            one = np.ones(len(count), np.int8)
            yield from pairs(listed, count, one, one, True)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if keys[lo] != shard:
                    if held:
                        yield from built()
                    shard, held, trie = keys[lo], [], None
                part = batch.slice(lo, hi - lo)
                role = part.column(1).to_numpy()
                owners = int(np.searchsorted(role, 1))
                if owners:
                    held.append(part.slice(0, owners))
                if owners < len(part):
                    if held:
                        yield from built()
                    if trie is not None:  # else nobody lives there
                        guests = part.slice(owners)
                        asked = WordList(guests.column(4))
                        yield from pairs(asked, guests.column(5).to_numpy(), guests.column(2).to_numpy(), guests.column(3).to_numpy(), False)
        if held:
            yield from built()

    return run


# --- forms and roots ---------------------------------------------------------
def follow(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the end of each chain, by doubling the steps.

    Counts grow along a chain by a factor, so chains are short and have an end.
    """
    ends = forms.select("word", F.col("form").alias("root"))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = ends.join(further, "root", "left")
        ends = common.stage(
            joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "spelling-roots",
        )
        if not ends.filter("moved").limit(1).count():
            return ends.drop("moved")


def group_variants(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    depth: int | None = None,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word that occurs often enough."""
    counted = count_words(documents, doc_id=doc_id, text=text).filter(F.col("n") >= min_count)
    words = common.stage(counted, "spelling-words")
    near = near_words(words, depth=depth)
    both = near.select(
        F.inline(
            F.array(
                F.struct(F.col("word"), F.col("near").alias("other"), F.col("near_n").alias("other_n")),
                F.struct(F.col("near").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")),
            )
        )
    )
    # the best is found in two plain aggregates: the largest count, then the first word that has it
    best = Window.partitionBy("word")
    top = both.withColumn("top", F.max("other_n").over(best))
    facts = top.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.max("other_n").alias("other_n"),
        F.min(F.when(F.col("other_n") == F.col("top"), F.col("other"))).alias("other"),
    )
    is_form = F.col("other_n") >= ratio * F.col("n")
    found = common.stage(
        words.join(facts, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("other")).alias("form"),
            F.when(is_form, F.col("other_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = follow(found.filter("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
