"""Substring dedup by hashing normalised lines, sentences and paragraphs.

A text is cut into units at line ends, after ``. ! ?`` and before capitals, so
a passage has the same units wherever it stands, in a line of its own or amid
another. Units are normalised: A-Z in lower case, only letters, digits and
bytes above ASCII count. A window is the shortest run of whole units of one
text, from each unit forward and from each unit backward, with at least
``min_words`` words (a word longer than 24 bytes counts as several, for scripts
without spaces). Beside the windows, every whole line of fewer words and every
whole paragraph (lines up to a blank one) of at least ``min_line`` words is a
passage of its own; longer lines are covered by their windows. Digests of all of
them are grouped over all documents. The occurrence with the smallest document
id, then the first place, stays; the units of every other occurrence are
removed. A line of which all words go takes its marks along (``## ``, ``- ``).
What is left are repeats of fewer than ``min_words`` words amid a line and of
fewer than ``min_line`` words on a line of their own: closing brackets, ``return
1``, one-word answers. ``min_words=1`` removes every repeated unit.

Digests travel packed, all 64 bits of each, cut into ranges; a task has all
digests of a range and answers with those that a document has to give up.
There is no limit on how often a digest may occur.

Null and empty texts have no units. Rows with equal id and text are one
document: each keeps what that document keeps. Null ids rank first. A text of
which everything is repeated becomes empty; its row stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 20
#: Words from which a line or paragraph counts on its own: as many as make a
#: window of the decontamination. Shorter ones repeat by chance in a large corpus.
MIN_LINE = 10
#: Digests in a range, about, and digests that a task sends at once.
RANGE_DIGESTS = 1_000_000
BATCH_DIGESTS = 400_000
#: Bytes of text per digest, about; only the number of ranges comes from it.
BYTES_PER_DIGEST = 20
DIGEST_BYTES = 8
LONG_WORD = 24


def _marks() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in ".!?\n\r"]] = True
    return table


def _capital(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a capital of Latin, Greek or Cyrillic letters stands at some places."""
    first = raw[at]
    second = raw[np.minimum(at + 1, len(raw) - 1)]
    latin = (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    greek = (first == 0xCE) & (second >= 0x91) & (second <= 0xA9)
    cyrillic = (first == 0xD0) & (second >= 0x90) & (second <= 0xAF)
    return ((first >= 65) & (first <= 90)) | latin | greek | cyrillic


def _line_edges(raw: np.ndarray, words: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """Which words begin a line, and which a paragraph."""
    n = len(words.start)
    line, paragraph = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        ends = []
        for mark in b"\n\r":
            seen = np.concatenate([[0], np.cumsum(raw == mark)])
            ends.append(seen[words.start[1:]] - seen[words.end[:-1]])
        breaks = np.maximum(*ends)  # both marks together are one line end
        line[1:], paragraph[1:] = breaks > 0, breaks > 1
        first = words.first[words.first < n]
        line[first] = paragraph[first] = True
    return line, paragraph


class Windows:
    """The windows, short lines and paragraphs of a chunk of texts, by text and
    place: first word, word behind the last, digest."""

    def __init__(
        self, raw: np.ndarray, offsets: np.ndarray, table, powers: common.Powers, min_words: int, min_line: int = MIN_LINE
    ) -> None:
        self.words = words = common.Words(raw, offsets, table)
        n = len(words.start)
        hashes = words.hashes(powers)
        marks = np.concatenate([[0], np.cumsum(_marks()[raw])])
        edge = np.zeros(n, bool)
        if n:
            edge[1:] = marks[words.start[1:]] > marks[words.end[:-1]]
            edge |= _capital(raw, words.start)
            edge[words.first[words.first < n]] = True
        unit = np.append(np.flatnonzero(edge), n)
        weight = 1 + (words.end - words.start) // LONG_WORD
        upto = np.concatenate([[0], np.cumsum(weight)])
        total = upto[unit]
        up, down = powers.upto(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((hashes | np.uint64(1)) * up[:n], out=sums[1:])
        doc = np.searchsorted(words.first, unit[:-1], "right") - 1
        last = np.searchsorted(unit, words.first[1:])  # unit behind the last of each text
        begin = np.arange(len(unit) - 1)
        end = np.searchsorted(total, total[:-1] + min_words)
        ok = end <= last[doc] if n else np.zeros(0, bool)
        back_end = begin + 1
        back = np.searchsorted(total, total[back_end] - min_words, "right") - 1
        first = np.searchsorted(unit, words.first[:-1])
        back_ok = (back >= first[doc]) if n else np.zeros(0, bool)
        back_ok &= end[np.maximum(back, 0)] != back_end if n else back_ok
        line, paragraph = (np.append(np.flatnonzero(x), n) for x in _line_edges(raw, words))
        size = np.diff(upto[line])
        short = (size >= min_line) & (size < min_words)
        whole = np.diff(upto[paragraph]) >= min_line
        a = np.concatenate([unit[begin[ok]], unit[back[back_ok]], line[:-1][short], paragraph[:-1][whole]])
        b = np.concatenate([unit[end[ok]], unit[back_end[back_ok]], line[1:][short], paragraph[1:][whole]])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)  # a window, a line and a paragraph may be the same words
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.a, self.b = a[new], b[new]
        self.doc = np.searchsorted(words.first, self.a, "right") - 1
        length = (self.b - self.a).astype(np.uint64)
        self.digest = common.mix64((sums[self.b] - sums[self.a]) * down[self.a] + length * np.uint64(0x9E3779B9))


SENT = "range int, batch long, counts binary, digests binary, ids binary"


def _send(batches: Iterable[pa.RecordBatch], ranges: int, min_words: int, min_line: int = MIN_LINE) -> Iterator[pa.RecordBatch]:
    """For each batch of documents a row for each range of digests."""
    from pyspark import TaskContext

    table, powers = common.folding(common.LETTERS_DIGITS), common.Powers()
    batch_no = TaskContext.get().partitionId() << 20
    held: list[tuple] = []

    def rows() -> pa.RecordBatch:
        nonlocal batch_no, held
        ids = np.concatenate([h[2] for h in held])
        n_docs = ids.shape[0]
        shift = np.cumsum([0, *(len(h[2]) for h in held)])
        digests = np.concatenate([h[0] for h in held])
        doc = np.concatenate([h[1] + s for h, s in zip(held, shift, strict=False)])
        of = ((digests >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        order = np.argsort(of.astype(np.int32), kind="stable")  # by text and place within a range
        edges = np.searchsorted(of[order], np.arange(ranges + 1))
        out = []
        for r in range(ranges):
            some = order[edges[r] : edges[r + 1]]
            if len(some):
                counts = np.bincount(doc[some], minlength=n_docs).astype("<u4")
                has = counts > 0
                packed = common.squeeze(digests[some], DIGEST_BYTES)
                out.append((r, batch_no, counts[has].tobytes(), packed, ids[has].astype("<i8").tobytes()))
        batch_no, held = batch_no + 1, []
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["range", "batch", "counts", "digests", "ids"])

    total = 0
    for batch in batches:
        raw, offsets = common.texts_buffer(batch.column(1))
        ids = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2)], axis=1)
        for lo, hi in common.chunks(offsets):
            own = offsets[lo : hi + 1] - offsets[lo]
            found = Windows(raw[offsets[lo] : offsets[hi]], own, table, powers, min_words, min_line)
            held.append((found.digest, found.doc, ids[lo:hi]))
            total += len(found.digest) + hi - lo
            if total >= BATCH_DIGESTS:
                yield rows()
                total = 0
    if held:
        yield rows()


FOUND = "bucket int, docs binary, counts binary, digests binary, own binary"
GIVEN = "id long, hash long, digests binary, own binary"


def _repeats(table: pa.Table, buckets: int = 1) -> pa.Table:
    """For each document the digests of one range that it has to give up, and
    whether it keeps the first place of one itself (``own``); packed, a row for
    each bucket of documents."""
    digests = [common.expand(x.as_py(), DIGEST_BYTES) for x in table["digests"]]
    ids = np.concatenate([np.frombuffer(x.as_py(), "<i8").reshape(-1, 2) for x in table["ids"]])
    counts = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table["counts"]])
    digests = np.concatenate(digests)
    # rank of documents by id, then by text; equal rows have one rank
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]).any(axis=1)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.cumsum(new) - 1
    rank_of = np.repeat(rank, counts)
    order = np.lexsort((rank_of, digests))
    d, r = digests[order], rank_of[order]
    first = np.ones(len(d), bool)
    first[1:] = d[1:] != d[:-1]
    group = np.cumsum(first) - 1
    size = np.bincount(group)
    owner = r[np.flatnonzero(first)][group]
    own = r == owner
    # one entry for each document and digest; of its own ones only those that stand twice
    lead = first.copy()
    lead[1:] |= r[1:] != r[:-1]
    keep = lead & (~own | (np.diff(np.append(np.flatnonzero(lead), len(d)))[np.cumsum(lead) - 1] > 1))
    keep &= size[group] > 1
    d, r, own = d[keep], r[keep], own[keep]
    order = np.argsort(r, kind="stable")
    d, r, own = d[order], r[order], own[order]
    ranks, sizes = np.unique(r, return_counts=True)
    some = np.zeros(int(rank.max(initial=-1)) + 1, np.int64)
    some[rank] = np.arange(len(rank))
    docs = ids[some[ranks]].astype("<i8").reshape(-1, 2)
    both = docs.view(np.uint64)
    bucket = (common.mix64(both[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ both[:, 1]) % np.uint64(buckets)).astype(np.int64)
    of = np.repeat(bucket, sizes)
    order, entries = np.argsort(bucket, kind="stable"), np.argsort(of, kind="stable")
    bucket, of, docs, sizes, d, own = bucket[order], of[entries], docs[order], sizes[order], d[entries], own[entries]
    rows = []
    for b in np.unique(bucket).tolist():
        x, y = np.searchsorted(bucket, [b, b + 1])
        v, w = np.searchsorted(of, [b, b + 1])
        packed = (docs[x:y], sizes[x:y].astype("<u4"), d[v:w].astype("<u8"), own[v:w].astype(np.uint8))
        rows.append((b, *(p.tobytes() for p in packed)))
    kinds = (pa.int32(), *[pa.binary()] * 4)
    columns = [pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)]
    return pa.table(columns, names=["bucket", "docs", "counts", "digests", "own"])


def _gathered(table: pa.Table) -> pa.Table:
    """What the ranges found for the documents of a bucket: one row for each document."""
    docs, counts, digests, own = (
        np.frombuffer(b"".join(table[name].to_pylist()), kind)
        for name, kind in (("docs", "<i8"), ("counts", "<u4"), ("digests", "<u8"), ("own", np.uint8))
    )
    keys, of = np.unique(docs.reshape(-1, 2), axis=0, return_inverse=True)
    entry = np.repeat(of.ravel(), counts)
    order = np.argsort(entry, kind="stable")
    edges = np.searchsorted(entry[order], np.arange(len(keys) + 1)).tolist()
    cut = list(zip(edges, edges[1:], strict=False))
    digests, own = digests[order], own[order]
    return pa.table(
        [
            pa.array(keys[:, 0]),
            pa.array(keys[:, 1]),
            pa.array([digests[a:b].tobytes() for a, b in cut], pa.binary()),
            pa.array([own[a:b].tobytes() for a, b in cut], pa.binary()),
        ],
        names=["id", "hash", "digests", "own"],
    )


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without some ranges; a line that becomes empty goes with its end."""
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
        whole_line = (a == 0 or raw[a - 1] == 10) and (b >= len(raw) or raw[b] == 10)
        if whole_line:
            at = min(b + 1, len(raw))
    out.append(raw[at:])
    return b"".join(out)


def _line_start(raw: bytes, after: int, begin: int) -> int | None:
    """Start of the line of a word, if only marks stand between them; ``after`` is the end of the word before."""
    found = max(raw.rfind(b"\n", after, begin), raw.rfind(b"\r", after, begin))
    return found + 1 if found >= 0 else (0 if after == 0 else None)


def _line_end(raw: bytes, end: int, stop: int) -> int | None:
    """End of the line of a word, if only marks stand between them; ``stop`` is the start of the next word."""
    ends = [at for at in (raw.find(b"\n", end, stop), raw.find(b"\r", end, stop)) if at >= 0]
    return min(ends) if ends else (len(raw) if stop == len(raw) else None)


REMOVED = "removed array<struct<first_byte:long,last_byte:long>>"


def _remove(batches: Iterable[pa.RecordBatch], text: int, n: int, min_words: int, min_line: int) -> Iterator[pa.RecordBatch]:
    table, powers = common.folding(common.LETTERS_DIGITS), common.Powers()
    names = [f"_c{i}" for i in range(n)]
    kind = pa.list_(pa.struct([("first_byte", pa.int64()), ("last_byte", pa.int64())]))
    for batch in batches:
        raw, offsets = common.texts_buffer(batch.column(text))
        given, own = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
        texts = batch.column(text).to_pylist()
        spans: list[list] = [[] for _ in texts]
        for row, blobs in enumerate(given):
            if not blobs:
                continue
            a = offsets[row]
            body = raw[a : offsets[row + 1]]
            found = Windows(body, np.array([0, len(body)]), table, powers, min_words, min_line)
            digest = found.digest
            lost = np.frombuffer(blobs, "<u8")
            mine = np.frombuffer(own[row], np.uint8).astype(bool)
            # of its own repeats a document keeps the words of the first
            _, first, of = np.unique(digest, return_index=True, return_inverse=True)
            kept = np.isin(digest, lost[mine])
            begin = np.where(kept, np.maximum(found.a, found.b[first][of]), found.a)
            gone = (kept | np.isin(digest, lost[~mine])) & (begin < found.b)
            if not gone.any():
                continue
            cover = np.zeros(len(found.words.start) + 1, np.int64)
            np.add.at(cover, begin[gone], 1)
            np.add.at(cover, found.b[gone], -1)
            hit = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
            change = np.flatnonzero(hit[1:] != hit[:-1])
            whole = body.tobytes()
            for x, y in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
                begin, end = int(found.words.start[x]), int(found.words.end[y - 1])
                stop = int(found.words.start[y]) if y < len(found.words.start) else len(whole)
                head = _line_start(whole, int(found.words.end[x - 1]) if x else 0, begin)
                tail = _line_end(whole, end, stop)
                if head is not None and tail is not None:  # nothing but marks is left of its lines
                    spans[row].append((head, tail))
                    continue
                while end < stop and whole[end] not in b" \t\r\n":  # marks behind the last word
                    end += 1
                spans[row].append((begin, end))
            texts[row] = _cut(whole, spans[row]).decode()
        columns = [pa.array(texts, c.type) if i == text else c for i, c in enumerate(batch.columns[:n])]
        removed = pa.array([[{"first_byte": x, "last_byte": y} for x, y in s] for s in spans], kind)
        yield pa.RecordBatch.from_arrays([*columns, removed], [*names, "removed"])


def _deduplicated(documents: DataFrame, doc_id: str, text: str, min_words: int, min_line: int) -> DataFrame:
    df = common.inner(documents)
    number, body = (f"_c{documents.columns.index(c)}" for c in (doc_id, text))
    rank = F.coalesce(F.col(number).cast("long"), F.lit(-(1 << 63)))
    rows = df.select(rank.alias("id"), F.col(body).alias("text"), F.xxhash64(body).alias("hash"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(size // (BYTES_PER_DIGEST * RANGE_DIGESTS)) + 1
    sent = rows.mapInArrow(lambda it: _send(it, ranges, min_words, min_line), SENT)
    found = sent.groupBy("range").applyInArrow(lambda t: _repeats(t, ranges), FOUND)
    # a bucket of documents is about as large as a range
    given = found.groupBy("bucket").applyInArrow(_gathered, GIVEN)
    joined = df.withColumns({"_id": rank, "_hash": F.xxhash64(body)}).join(
        given, (F.col("_id") == given["id"]) & (F.col("_hash") == given["hash"]), "left"
    )
    n, at = len(documents.columns), documents.columns.index(text)
    return joined.select(*df.columns, "digests", "own").mapInArrow(
        lambda it: _remove(it, at, n, min_words, min_line), f"{common.ddl(df)}, {REMOVED}"
    )


def deduplicate(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    min_line: int = MIN_LINE,
) -> DataFrame:
    """All documents with repeated passages cut from the text, and ``removed``:
    the byte ranges of the original text that went (the end is behind the last
    byte). ``removed`` replaces a column of that name."""
    df = _deduplicated(documents, doc_id, text, min_words, min_line)
    return df.select(*common.outer(df, documents.columns, ("removed",)), "removed")


def clean(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    min_line: int = MIN_LINE,
) -> DataFrame:
    """The documents with their own columns, repeated passages cut, without
    those of whose words nothing is left because all of it was repeated."""
    df = _deduplicated(documents, doc_id, text, min_words, min_line)
    left = F.regexp_like(f"_c{documents.columns.index(text)}", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"))
    df = df.filter((F.size("removed") == 0) | left)
    return df.select(*common.outer(df, documents.columns))
