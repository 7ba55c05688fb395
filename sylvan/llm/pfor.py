"""Token ids in binary files of patched frame-of-reference blocks.

A file (little-endian) holds whole documents in the order of their ids:

    magic ``SYPF``, version u32, block size u32, documents u64, ids u64, blocks u64
    documents: id i64 each, then 1 if the id is null u8 each, then number of ids u64 each
    block index: byte place of each block u64, from the end of the index
    blocks: smallest value u32, values u16, exceptions u16, width u8,
        the low ``width`` bits of (value - smallest), packed, high bit first,
        exceptions: place u16 each, then (value - smallest) u32 each

The width of a block is the percentile ``PERCENTILE`` of the bit lengths of its
values; those that need more bits are exceptions. A block of ids can be read
alone by the index. Files are written by Spark's own writer with its commit
protocol (a raw binary row is a file; the writer adds one line end, which
readers ignore), so a lost executor leaves no half file, and any store that
Spark can write will do. Part numbers give the order of the files.

Null texts are empty; a document always has the end id, so no document is
without ids. A null id sorts first. Repeated documents stay, in the order of
their texts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC, VERSION = b"SYPF", 1
HEADER = "<4sIIQQQ"
BLOCK_HEADER = "<IHHB"
BLOCK = 512
PERCENTILE = 0.9
#: A file is closed at the document that reaches this number of ids.
FILE_IDS = 1 << 21
END_ID = 0
#: Blocks that are packed or unpacked at once.
AT_ONCE = 512


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(rows: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, row by row, as bytes."""
    bits = np.unpackbits(rows.astype(">u4").view(np.uint8).reshape(len(rows), -1, 4), axis=2)
    return np.packbits(bits[:, :, 32 - width :].reshape(len(rows), -1), axis=1)


def unpack(rows: np.ndarray, width: int, count: int) -> np.ndarray:
    """``count`` values of each row of packed bytes."""
    bits = np.unpackbits(rows, axis=1)[:, : count * width].reshape(len(rows), count, width)
    full = np.zeros((len(rows), count, 32), np.uint8)
    full[:, :, 32 - width :] = bits
    return np.packbits(full, axis=2).view(">u4").reshape(len(rows), count).astype(np.uint32)


def encode_blocks(ids: np.ndarray, size: int = BLOCK, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of a run of ids."""
    out: list[bytes] = []
    full = len(ids) // size
    parts = [ids[i * size : min(i + AT_ONCE, full) * size].reshape(-1, size) for i in range(0, full, AT_ONCE)]
    if len(ids) % size:
        parts.append(ids[full * size :].reshape(1, -1))
    for part in parts:
        count = part.shape[1]
        low = part.min(axis=1)
        deltas = (part - low[:, None]).astype(np.uint32)
        bits = bit_lengths(deltas)
        widths = np.sort(bits, axis=1)[:, min(count - 1, int(np.ceil(percentile * count)) - 1)]
        blocks: list[bytes] = [b""] * len(part)
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            packed = pack(deltas[rows], width) if width else np.zeros((len(rows), 0), np.uint8)
            for row, data in zip(rows.tolist(), packed, strict=True):
                at = np.flatnonzero(bits[row] > width)
                blocks[row] = b"".join(
                    (
                        struct.pack(BLOCK_HEADER, int(low[row]), count, len(at), width),
                        data.tobytes(),
                        at.astype("<u2").tobytes(),
                        deltas[row, at].astype("<u4").tobytes(),
                    )
                )
        out += blocks
    return out


def decode_block(data: memoryview) -> np.ndarray:
    return decode_blocks([data])


def decode_blocks(blocks: list[memoryview]) -> np.ndarray:
    """The ids of consecutive blocks."""
    heads = np.array([struct.unpack_from(BLOCK_HEADER, b) for b in blocks], np.int64).reshape(-1, 4)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for count, width in {(h[1], h[3]) for h in heads.tolist()}:
        group = np.flatnonzero((heads[:, 1] == count) & (heads[:, 3] == width))
        n = (count * width + 7) // 8
        a = struct.calcsize(BLOCK_HEADER)
        for some in np.array_split(group, max(1, len(group) // AT_ONCE)):
            if width:
                raw = b"".join(blocks[i][a : a + n] for i in some)
                values = unpack(np.frombuffer(raw, np.uint8).reshape(len(some), n), width, count)
            else:
                values = np.zeros((len(some), count), np.uint32)
            for row, i in zip(values, some.tolist(), strict=True):
                k = int(heads[i, 2])
                at = np.frombuffer(blocks[i], "<u2", k, a + n)
                row[at] = np.frombuffer(blocks[i], "<u4", k, a + n + 2 * k)
                out[i] = row + np.uint32(heads[i, 0])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_file(doc_ids: list[int | None], ids: list[np.ndarray], size: int = BLOCK) -> bytes:
    """The bytes of a file of documents."""
    blocks = encode_blocks(np.concatenate(ids), size)
    places = np.concatenate([[0], np.cumsum([len(b) for b in blocks])[:-1]])
    return b"".join(
        (
            struct.pack(HEADER, MAGIC, VERSION, size, len(doc_ids), sum(map(len, ids)), len(blocks)),
            np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
            np.array([i is None for i in doc_ids], np.uint8).tobytes(),
            np.array([len(x) for x in ids], "<u8").tobytes(),
            places.astype("<u8").tobytes(),
            *blocks,
        )
    )


class Reader:
    """A file in memory: its documents, any block, any run of ids."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.size, n, self.n_ids, n_blocks = struct.unpack_from(HEADER, data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of token blocks")
        at = struct.calcsize(HEADER)
        ids = np.frombuffer(data, "<i8", n, at)
        null = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.counts = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
        self.places = np.frombuffer(data, "<u8", n_blocks, at + 17 * n).astype(np.int64)
        self.body = memoryview(data)[at + 17 * n + 8 * n_blocks :]

    def run(self, start: int, stop: int) -> np.ndarray:
        """The ids ``start`` to ``stop - 1``, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.size, (stop - 1) // self.size
        edges = [*self.places[first : last + 2].tolist(), len(self.body)]
        blocks = [self.body[edges[i] : edges[i + 1]] for i in range(last - first + 1)]
        return decode_blocks(blocks)[start - first * self.size : stop - first * self.size]

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document, some blocks at a time."""
        edges = np.concatenate([[0], np.cumsum(self.counts)])
        held, begin, end = np.zeros(0, np.uint32), 0, 0
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b > end:
                begin, end = a, min(self.n_ids, max(b, a + self.size * AT_ONCE))
                held = self.run(begin, end)
            yield held[a - begin : b - begin]


def write(
    documents: DataFrame,
    path: str,
    vocabulary: str,
    *,
    kind: str = "byte",
    doc_id: str = "doc_id",
    text: str = "text",
    file_ids: int = FILE_IDS,
) -> None:
    """Encode all texts and write their ids, each followed by the end id, in order of the ids.

    Texts are dealt to the tasks in ranges of ``doc_id``, so a task encodes and
    writes its range alone, one file after another. No task or driver holds
    more than one file and one batch of texts.
    """

    def files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary, kind)
        own: list = []
        ids: list[np.ndarray] = []
        total = 0
        end = np.array([END_ID], np.int64)
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for number, code in zip(numbers, encoder.encode(batch.column(1)), strict=True):
                own.append(number)
                ids.append(np.concatenate([code, end]).astype(np.uint32))
                total += len(ids[-1])
                if total >= file_ids:
                    yield pa.RecordBatch.from_arrays([pa.array([write_file(own, ids)])], ["data"])
                    own, ids, total = [], [], 0
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([write_file(own, ids)])], ["data"])

    (
        documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(files, "data binary")
        .select(F.col("data").cast("string"))
        .write.option("maxRecordsPerFile", 1)
        .option("lineSep", "\n")
        .text(path)
    )


def read(spark: SparkSession, path: str, *, ids: bool = True) -> DataFrame:
    """The documents of all files: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``."""
    schema = "part long, number long, doc_id long, local long, n_tokens long, ids_crc32 long"
    schema += ", ids array<long>" if ids else ""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = Reader(data)
                for lo in range(0, max(len(reader.counts), 1), 10_000):
                    if lo == 0:
                        stream = reader.documents()
                        starts = np.cumsum(reader.counts) - reader.counts
                    n = min(10_000, len(reader.counts) - lo)
                    codes = [next(stream) for _ in range(n)]
                    columns = [
                        pa.array([part] * n, pa.int64()),
                        pa.array([number] * n, pa.int64()),
                        pa.array(reader.doc_ids[lo : lo + n], pa.int64()),
                        pa.array(starts[lo : lo + n]),
                        pa.array(reader.counts[lo : lo + n]),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in codes], pa.int64()),
                    ]
                    names = ["part", "number", "doc_id", "local", "n_tokens", "ids_crc32"]
                    if ids:
                        columns.append(pa.array([x.astype(np.int64) for x in codes], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    name = F.col("path")
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load(path)
        .select(
            F.regexp_extract(name, r"part-(\d+)-", 1).cast("long").alias("part"),
            F.regexp_extract(name, r"-c(\d+)\.txt$", 1).cast("long").alias("number"),
            "content",
        )
    )
    rows = common.stage(files.mapInArrow(decode, schema), "token-rows")
    # places of the files: sums by part first, so that the window over all parts stays short
    files = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(
        F.sum("n").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    ahead = F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    places = files.withColumn("before", before).drop("n").join(parts.select("part", ahead.alias("ahead")), "part")
    out = rows.join(places, ["part", "number"]).withColumn("start", F.col("local") + F.col("before") + F.col("ahead"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else []))
