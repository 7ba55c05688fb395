"""Benchmark decontamination with a broadcast hash set of test windows.

An item's text is lower-cased (A-Z) and cut into words (letters a-z, digits,
all bytes above ASCII). Every ``size`` consecutive words are a window; an item
with fewer words, but not none, is one window. Document windows that are in
the hash set are compared word by word with the item's before they count.

Null and empty texts have no words. An item without words or without an id
marks nothing; items that share an id count as one. Repeated documents are
each judged alone. Columns beside the text are passed through and never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIZE = 10
#: Windows that one broadcast may hold (8 bytes of hash and about 80 of text
#: each). A larger benchmark is scanned block by block.
MAX_WINDOWS = 1_000_000


def benchmark_windows(rows: list, size: int) -> dict:
    """Of a block of items: by window length, by hash, by window the item ids."""
    table, powers = common.folding(common.LETTERS_DIGITS), common.Powers()
    found: dict[int, dict[int, dict[bytes, set]]] = {}
    for item_id, text in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        words = common.Words(raw, np.array([0, len(raw)]), table)
        n = len(words.start)
        if not n:
            continue
        length = min(n, size)
        pieces = words.texts(0, n)
        of_length = found.setdefault(length, {})
        for i, h in enumerate(common.windows(words.hashes(powers), length).tolist()):
            of_length.setdefault(h, {}).setdefault(b" ".join(pieces[i : i + length]), set()).add(item_id)
    return found


class Matcher:
    """Finds the windows of a block in a chunk of documents."""

    def __init__(self, found: dict) -> None:
        self.found = found
        self.sorted = {k: np.array(sorted(v), np.uint64) for k, v in found.items()}
        self.shift, self.filters = {}, {}
        for k, v in self.sorted.items():
            bits = max(16, len(v).bit_length() + 4)
            self.shift[k] = np.uint64(64 - bits)
            self.filters[k] = np.zeros(1 << bits, bool)
            self.filters[k][v >> self.shift[k]] = True

    def hits(self, words: common.Words, hashes: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """Verified hits: number of the first word, number of words, item ids."""
        for length, wanted in self.sorted.items():
            mine = common.windows(hashes, length)
            if not len(mine):
                continue
            maybe = self.filters[length][mine >> self.shift[length]]
            maybe &= common.whole(words.first, length, len(hashes))
            at = np.flatnonzero(maybe)
            place = np.minimum(np.searchsorted(wanted, mine[at]), len(wanted) - 1)
            for i in at[wanted[place] == mine[at]].tolist():
                items = self.found[length][int(mine[i])].get(b" ".join(words.texts(i, i + length)))
                if items:
                    yield i, length, items


OUT = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])


def _scan(batches: Iterable[pa.RecordBatch], text: str, blocks: list) -> Iterator[pa.RecordBatch]:
    """Add to each text its number of words, the hit words as a flat list of
    byte places and word numbers, and the items."""
    table, powers = common.folding(common.LETTERS_DIGITS), common.Powers()
    matchers = [Matcher(block.value) for block in blocks]
    for batch in batches:
        raw, offsets = common.texts_buffer(batch.column(batch.schema.get_field_index(text)))
        n_words, spans, items = [], [], []
        for lo, hi in common.chunks(offsets):
            base = offsets[lo]
            words = common.Words(raw[base : offsets[hi]], offsets[lo : hi + 1] - base, table)
            hashes = words.hashes(powers)
            marks: dict[int, list] = {}
            ids: dict[int, set] = {}
            for matcher in matchers:
                for i, length, of in matcher.hits(words, hashes):
                    doc = int(np.searchsorted(words.first, i, "right")) - 1
                    marks.setdefault(doc, []).append((i, i + length))
                    ids.setdefault(doc, set()).update(of)
            n_words.extend(words.counts().tolist())
            for doc in range(hi - lo):
                flat = []
                for a, b in merged(marks.get(doc, [])):
                    begin, end = words.start[a] - words.offsets[doc], words.end[b - 1] - words.offsets[doc]
                    flat += [a - words.first[doc], b - words.first[doc], begin, end]
                spans.append([int(x) for x in flat])
                items.append(sorted(ids.get(doc, ())))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(v, f.type) for v, f in zip((n_words, spans, items), OUT, strict=True))],
            [*batch.schema.names, *OUT.names],
        )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges joined, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, size: int, limit: int) -> Iterator[list]:
    """Items in blocks of at most about ``limit`` windows; one longer item is a
    block of its own. The blocks come from the shuffle one at a time."""
    rows, n = [], 0
    for row in benchmark.toLocalIterator():
        most = max(len(row[1]) // 2 - size + 2, 1)
        if rows and n + most > limit:
            yield rows
            rows, n = [], 0
        rows.append((row[0], row[1]))
        n += most
    if rows:
        yield rows


def _marked(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = SIZE,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    spark = documents.sparkSession
    items = (
        benchmark.select(F.col(item_id).cast("long"), F.col(item_text))
        .filter(F.col(item_id).isNotNull() & (F.length(item_text) > 0))
        .distinct()
    )
    at = f"_c{documents.columns.index(text)}"
    df = common.inner(documents)
    schema, marks = common.ddl(df), "n_words long, spans array<long>, items array<long>"
    done = False
    for rows in benchmark_blocks(items, size, max_windows):
        block = spark.sparkContext.broadcast(benchmark_windows(rows, size))
        if not done:
            df = df.mapInArrow(lambda it, b=block: _scan(it, at, [b]), f"{schema}, {marks}")
            done = True
            continue
        before = common.stage(df, "decontaminate").withColumnsRenamed({"n_words": "_w", "spans": "_s", "items": "_i"})
        wide = f"{schema}, _w long, _s array<long>, _i array<long>, {marks}"
        df = before.mapInArrow(lambda it, b=block: _scan(it, at, [b]), wide)
        quads = F.transform(
            F.sequence(F.lit(0), (F.size("both") / 4 - 1).cast("int")),
            lambda i: F.slice("both", i * 4 + 1, 4),
        )
        df = (
            df.withColumn("both", F.concat("_s", "spans"))
            .withColumn("spans", F.when(F.size("both") == 0, F.col("both")).otherwise(_union(F.array_sort(quads))))
            .withColumn("items", F.array_sort(F.array_distinct(F.concat("_i", "items"))))
            .drop("_w", "_s", "_i", "both")
        )
    return df if done else df.mapInArrow(lambda it: _scan(it, at, []), f"{schema}, {marks}")


def mark(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents with ``n_words``, ``spans`` and ``items``; these replace columns of the same name.

    Options: ``text``, ``item_id`` and ``item_text`` name the columns, ``size``
    is the length of a window. ``spans`` has four numbers for each hit range:
    first word, word behind the last, first byte, byte behind the last.
    ``items`` has the item ids, sorted. A benchmark of up to ``max_windows``
    windows is one broadcast and one scan. A larger one is scanned in blocks,
    one scan for each, with the marks written between; neither the driver nor
    a task holds more than one block.
    """
    df = _marked(documents, benchmark, **options)
    return df.select(*common.outer(df, documents.columns, tuple(OUT.names)), *OUT.names)


def _union(quads):
    """Ranges of four numbers each, sorted, joined where they touch; flat again."""

    def add(flat, q):
        n = F.size(flat)
        longer = F.element_at(q, 2) > F.get(flat, n - 3)
        last = F.concat(
            F.slice(flat, F.lit(1), n - 3),
            F.array(
                F.when(longer, F.element_at(q, 2)).otherwise(F.get(flat, n - 3)),
                F.get(flat, n - 2),
                F.when(longer, F.element_at(q, 4)).otherwise(F.get(flat, n - 1)),
            ),
        )
        joined = (n > 0) & (F.element_at(q, 1) <= F.get(flat, n - 3))
        return F.when(joined, last).otherwise(F.concat(flat, q))

    return F.aggregate(quads, F.array().cast("array<long>"), add)


def report(marked: DataFrame) -> DataFrame:
    """The digest of each marked document: words, hit words, items and their SHA-256."""
    hit = F.aggregate(
        F.transform("spans", lambda x, i: F.when(i % 4 == 0, -x).when(i % 4 == 1, x).otherwise(F.lit(0))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return marked.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def remove_documents(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with their own columns."""
    df = _marked(documents, benchmark, **options).filter(F.size("items") == 0)
    return df.select(*common.outer(df, documents.columns))


def remove_spans(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """All documents; the bytes from the first to the last word of each hit range are cut."""
    marked = _marked(documents, benchmark, text=text, **options)
    names = [f"_c{i}" for i in range(len(documents.columns))]
    at = documents.columns.index(text)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for row, flat in enumerate(batch.column(len(names) + 1).to_pylist()):
                if flat:
                    raw = texts[row].encode()
                    edges = [0, *(x for i in range(0, len(flat), 4) for x in flat[i + 2 : i + 4]), len(raw)]
                    texts[row] = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
            columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(batch.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays(columns, names)

    df = marked.mapInArrow(cut, common.ddl(marked.select(*names)))
    return df.select(*common.outer(df, documents.columns))
