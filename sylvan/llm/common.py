"""Helpers of the operators: shared folder, hashed words of whole texts, bounded chunks."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that numpy works on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Word bytes of two kinds of words.
LETTERS_DIGITS = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
NOT_SPACE = bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)

#: A byte that no UTF-8 text holds.
GAP = 255

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


# --- folders ---------------------------------------------------------------
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names for
    checkpoints, or else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sylvan-llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it from there.

    What follows neither computes it again nor loses it with an executor. The
    owner of the folder removes its files after the job.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker of an executor."""
    name = "_sylvan_llm_store"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def trim() -> None:
    """Give memory that is free back to the machine: allocators keep it for long,
    and the worker of one stage lives on beside those of the next."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


# --- Arrow -----------------------------------------------------------------
def texts_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and n + 1 offsets; null is empty.

    Called once for each batch; what the last one left free is given back.
    """
    trim()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` texts of at most ``limit`` bytes together, or of one longer text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, hi
        lo = hi


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def take_columns(batch: pa.RecordBatch, names: list[str], **more: pa.Array) -> pa.RecordBatch:
    """Some columns of a batch with new ones behind them."""
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*arrays, *more.values()], [*names, *more])


def inner(df: DataFrame) -> DataFrame:
    """The table under names that clash with no column an operator adds."""
    return df.toDF(*(f"_c{i}" for i in range(len(df.columns))))


def outer(df: DataFrame, names: list[str], but: tuple[str, ...] = ()) -> list:
    """The columns of ``inner`` under their own names, without those in ``but``."""
    return [df[f"_c{i}"].alias(n) for i, n in enumerate(names) if n not in but]


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


# --- packed numbers --------------------------------------------------------
def squeeze(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def expand(data: bytes | pa.Buffer, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel().astype(np.uint64)


# --- words -----------------------------------------------------------------
def folding(word_bytes: bytes) -> np.ndarray:
    """A table that lower-cases A-Z and turns every byte outside words into ``GAP``."""
    table = np.full(256, GAP, np.uint8)
    for b in word_bytes:
        table[b] = b
    for b in range(ord("A"), ord("Z") + 1):
        table[b] = b + 32
    return table


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of the multiplier and of its inverse, made once for the longest text."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES)

            def powers(base: int) -> np.ndarray:
                out = np.full(size, base, np.uint64)
                out[0] = 1
                return np.multiply.accumulate(out)

            self.up, self.down = powers(MULTIPLIER), powers(INVERSE)
        return self.up[:n], self.down[:n]


class Words:
    """The words of a chunk of texts.

    ``start`` and ``end`` are byte places in ``folded``; ``first`` has for each
    text the number of its first word, and the number of all words at the end.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> None:
        self.folded = folded = table[raw]
        self.offsets = offsets
        n = len(folded)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = folded != GAP
        begins = inside[1:-1] & ~inside[:-2]
        finish = inside[1:-1] & ~inside[2:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        begins[edges] |= inside[1:-1][edges]
        finish[edges - 1] |= inside[1:-1][edges - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, powers: Powers) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = powers.upto(len(self.folded) + 1)
        sums = np.zeros(len(self.folded) + 1, np.uint64)
        np.cumsum((self.folded + np.uint64(1)) * up[: len(self.folded)], out=sums[1:])
        return mix64((sums[self.end] - sums[self.start]) * down[self.start])

    def texts(self, lo: int, hi: int) -> list[bytes]:
        """The words with numbers ``lo`` to ``hi - 1``."""
        return [self.folded[a:b].tobytes() for a, b in zip(self.start[lo:hi], self.end[lo:hi], strict=True)]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for every ``size`` consecutive words, regardless of texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(size):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        out += hashes[j : j + n] * np.uint64(factor)
    return mix64(out)


def whole(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which windows lie within one text."""
    ok = np.ones(max(n - size + 1, 0), bool)
    for back in range(1, size):
        at = first[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok
