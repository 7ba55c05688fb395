"""Best-fit packing of documents into sequences by the sum of squares.

A document longer than a sequence is cut into full pieces and a rest; nothing
else is cut. A piece is placed where the sum over all gaps of the squared
number of open sequences with that gap becomes smallest: into an open sequence
(the fullest, if some are equal) or a new one. Full sequences are closed.
Pieces are dealt by a hash to groups of about ``GROUP`` pieces, which are packed
side by side, longest pieces first; what a group wastes is a few open sequences.

Null and empty texts have the end id only. Repeated documents are each packed.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
END_ID = 0
#: Pieces in a group, about.
GROUP = 60_000
#: Sequences of a group are numbered within a range of this size.
RANGE = 1 << 32


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; sequences are numbered from 0."""
    sequence = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    sequences = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        # change of the sum, halved, for each gap from n on: that gap has one less, the rest one more
        gain = count[: capacity + 1 - n] - count[n:] + 1
        gain[0] = -count[n]  # closed: no rest (and half a square less, which settles ties)
        gain[count[n:] == 0] = capacity * len(lengths)
        gap = n + int(gain.argmin())
        fresh = count[capacity - n] + 1 if n < capacity else 0
        if not count[gap] or gain[gap - n] >= fresh:
            gap, number = capacity, sequences
            sequences += 1
        else:
            number = open_by_gap[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = number, capacity - gap
        rest = gap - n
        if rest:
            open_by_gap[rest].append(number)
            count[rest] += 1
    _dissolve(lengths, sequence, offset, open_by_gap, capacity)
    return np.unique(sequence, return_inverse=True)[1], offset


def _dissolve(
    lengths: np.ndarray, sequence: np.ndarray, offset: np.ndarray, open_by_gap: list[list[int]], capacity: int
) -> None:
    """Empty the shortest open sequences into the gaps of the others, as far as all their pieces fit.

    The sum of squares keeps gaps of all sizes open for pieces to come; when
    none come any more, these gaps take the pieces of a few sequences.
    """
    gaps = sorted((gap, number) for gap, numbers in enumerate(open_by_gap) for number in numbers)
    order = np.argsort(sequence, kind="stable")
    edges = np.searchsorted(sequence[order], [[number, number + 1] for _, number in gaps])
    own = {number: order[a:b].tolist() for (_, number), (a, b) in zip(gaps, edges.tolist(), strict=True)}
    for number in [number for _, number in reversed(gaps)]:
        moved, left = [], [x for x in gaps if x[1] != number]
        for i in sorted(own[number], key=lambda i: -lengths[i]):
            at = bisect.bisect_left(left, (int(lengths[i]), -1))
            if at == len(left):
                break
            gap, other = left.pop(at)
            moved.append((i, other, capacity - gap))
            if gap > lengths[i]:
                bisect.insort(left, (gap - int(lengths[i]), other))
        if len(moved) < len(own[number]):
            continue
        for i, other, start in moved:
            sequence[i], offset[i] = other, start
            own[other].append(i)
        own[number] = []
        gaps = left


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    documents: DataFrame,
    vocabulary: str,
    *,
    kind: str = "word",
    capacity: int = CAPACITY,
    ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The pieces of all documents: number, place in the document, length, CRC-32
    of the ids and, if asked for, the ids."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary, kind)
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            numbers = batch.column(0).to_pylist()
            for number, code in zip(numbers, encoder.encode(batch.column(1)), strict=True):
                code = np.append(code, END_ID).astype("<u4")
                for k, start in enumerate(range(0, len(code), capacity)):
                    own = code[start : start + capacity]
                    for column, v in zip(columns, (number, k, start, len(own), zlib.crc32(own.tobytes())), strict=False):
                        column.append(v)
                    if ids:
                        columns[5].append(own.astype(np.int64))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            arrays = [pa.array(c, t) for c, t in zip(columns[: 5 + ids], kinds, strict=False)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, PIECES + (", ids array<long>" if ids else ""))


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    Only the columns of ``PIECES`` travel; ids stay where they are and are
    joined by ``sequences``.
    """
    rows = common.stage(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    groups = max(1, -(-rows.count() // group))
    # the number of a group comes from the place of the rows, so that copies are dealt out too
    salted = rows.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "length", "ids_crc32")])
        sequence, offset = place(table["length"].to_numpy(), capacity)
        sequence += key[0].as_py() * RANGE
        out = table.drop_columns(["_group"])
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return salted.groupBy("_group").applyInArrow(fill, f"{PIECES}, sequence_id long, offset long")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id`` and ``ids``, and the ``doc_ids`` of its pieces in order.

    ``pieces`` has ids; a sequence is one group of at most its capacity.
    """
    keys = ["doc_id", "piece", "ids_crc32"]
    at = placed.select(*keys, "sequence_id", "offset")
    # equal copies of a document: the k-th of one table belongs to the k-th of the other
    nth = F.expr("row_number() over (partition by doc_id, piece, ids_crc32 order by length)")
    left, right = pieces.withColumn("_n", nth), at.withColumn("length", F.lit(0)).withColumn("_n", nth).drop("length")
    same = [left[k].eqNullSafe(right[k]) for k in (*keys, "_n")]
    joined = left.join(right, same).select(left["doc_id"], left["ids"], right["sequence_id"], right["offset"])
    return (
        joined.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("all"))
        .select("sequence_id", F.flatten("all.ids").alias("ids"), F.col("all.doc_id").alias("doc_ids"))
    )
