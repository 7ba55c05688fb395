"""License scans: exact phrases, and short notices with a bounded number of edits.

A text is lower-cased (A-Z) and cut into words (letters a-z, digits, all bytes
above ASCII); the words are joined by single spaces. A notice that may have
``k`` edits is split into ``k + 1`` pieces. By the pigeonhole principle one of
them stands unedited in every match, so exact search for the pieces finds all
candidate places. The ``regex`` library verifies each with its bounded-error
matching and reports span and edits.

Null and empty texts have no words and no labels. Repeated documents are each
scanned alone. A match begins and ends with a word.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Exact phrases and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Label, notice, edits allowed, and words that must stand unedited in the match.
NOTICES = (
    ("mit", "under the mit license", 3, "mit"),
    ("mit", "permission is hereby granted free of charge", 5, ""),
    ("apache-2", "apache license version 2", 3, "2"),
    ("cc-by-nc", "licensed under cc by nc", 3, "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial", 5, ""),
    ("gpl-2", "gnu general public license version 2", 4, "2"),
    ("gpl-3", "gnu general public license version 3", 4, "3"),
    ("lgpl", "gnu lesser general public license", 4, "lesser"),
    ("bsd", "redistribution and use in source and binary forms", 5, ""),
    ("mpl-2", "mozilla public license version 2", 4, "2"),
    ("proprietary", "all rights reserved", 2, ""),
)
SPACE, LINE = 0x20, 0x0A

SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label string, first_word long, last_word long, "
    "first_byte long, last_byte long, edits int>>"
)
SPAN = ("label", "first_word", "last_word", "first_byte", "last_byte", "edits")
OUT = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        (
            "spans",
            pa.list_(
                pa.struct(
                    [
                        ("label", pa.string()),
                        ("first_word", pa.int64()),
                        ("last_word", pa.int64()),
                        ("first_byte", pa.int64()),
                        ("last_byte", pa.int64()),
                        ("edits", pa.int32()),
                    ]
                )
            ),
        ),
    ]
)


def pieces(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """``edits + 1`` parts of about the same length, with their places."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def places(text: bytes, wanted: bytes) -> Iterator[int]:
    """All places of a string, overlapping ones too."""
    at = text.find(wanted)
    while at >= 0:
        yield at
        at = text.find(wanted, at + 1)


class Normal:
    """A chunk of texts as single-spaced words, one text a line."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> None:
        n = len(offsets) - 1
        spaced = table[np.insert(raw, offsets[1:], SPACE)]
        ends = offsets[1:] + np.arange(n)
        gap = spaced == common.GAP
        spaced[gap] = SPACE
        spaced[ends] = LINE
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        keep[ends] = True
        self.origin = np.flatnonzero(keep)
        values = spaced[keep]
        self.text = values.tobytes()
        word = (values != SPACE) & (values != LINE)
        before = np.concatenate([[False], word[:-1]])
        self.word_start = np.flatnonzero(word & ~before)
        self.line = np.concatenate([[0], np.flatnonzero(values == LINE) + 1])
        self.first = np.searchsorted(self.word_start, self.line)
        self.offsets = offsets

    def is_edge(self, at: int) -> bool:
        return at < 0 or at >= len(self.text) or self.text[at] in (SPACE, LINE)

    def doc(self, at: int) -> int:
        return int(np.searchsorted(self.line, at, "right")) - 1

    def word(self, at: int, doc: int) -> int:
        """Number of the word that holds a place, from the start of its text."""
        return int(np.searchsorted(self.word_start, at, "right") - 1 - self.first[doc])

    def byte(self, at: int, doc: int) -> int:
        return int(self.origin[at] - doc - self.offsets[doc])


def _exact(normal: Normal, phrase: bytes) -> Iterator[tuple[int, int]]:
    for at in places(normal.text, phrase):
        if normal.is_edge(at - 1) and normal.is_edge(at + len(phrase)):
            yield at, at + len(phrase)


def _fuzzy(normal: Normal, notice: bytes, edits: int, keys: list[bytes], pattern) -> Iterator[tuple[int, int, int]]:
    """Verified matches: begin, end, edits."""
    seen = set()
    found = []
    for offset, piece in pieces(notice, edits):
        for at in places(normal.text, piece):
            lo = max(at - offset - edits, 0)
            hi = min(at - offset + len(notice) + edits, len(normal.text))
            while hi < len(normal.text) and not normal.is_edge(hi):
                hi += 1
            found.append((lo, hi))
    for lo, hi in merge(found):
        for match in pattern.finditer(normal.text, lo, hi, overlapped=True):
            a, b = match.span()
            inside = match.group()
            if (a, b) in seen or b"\n" in inside or not all(k in inside.split(b" ") for k in keys):
                continue
            seen.add((a, b))
            yield a, b, sum(match.fuzzy_counts)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _disjoint(spans: list[tuple]) -> list[tuple]:
    """Of matches of one label that overlap, the one with the fewest edits, then the first.

    Kept matches of a label do not overlap, so in order of place only the ones
    beside a new match can meet it.
    """
    kept: list[tuple] = []
    begins: dict[str, list[int]] = {}
    ends: dict[str, list[int]] = {}
    for x in sorted(spans, key=lambda s: (s[5], s[1], -s[2])):
        begin, end = begins.setdefault(x[0], []), ends.setdefault(x[0], [])
        at = bisect_left(begin, x[1])
        if (at and end[at - 1] >= x[1]) or (at < len(begin) and begin[at] <= x[2]):
            continue
        begin.insert(at, x[1])
        end.insert(at, x[2])
        kept.append(x)
    return sorted(kept, key=lambda s: (s[1], s[0]))


def _scan(batches: Iterable[pa.RecordBatch], text: str, base: tuple, notices: tuple) -> Iterator[pa.RecordBatch]:
    import regex

    table = common.folding(common.LETTERS_DIGITS)
    fuzzy = [
        (
            label,
            notice.encode(),
            edits,
            keys.encode().split(),
            regex.compile(rb"(?e)(?<![^ \n])(?:%s){e<=%d}(?![^ \n])" % (notice.encode(), edits)),
        )
        for label, notice, edits, keys in notices
    ]
    length = {label: max(len(n) for x, n, *_ in notices if x == label) for label, *_ in notices}
    for batch in batches:
        raw, offsets = common.texts_buffer(batch.column(batch.schema.get_field_index(text)))
        rows: list[tuple] = []
        for lo, hi in common.chunks(offsets):
            normal = Normal(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table)
            exact: dict[int, list] = {}
            near: dict[int, list] = {}
            for label, phrase in base:
                for a, _ in _exact(normal, phrase.encode()):
                    doc = normal.doc(a)
                    exact.setdefault(doc, []).append((normal.word(a, doc), label))
            for label, notice, edits, keys, pattern in fuzzy:
                for a, b, e in _fuzzy(normal, notice, edits, keys, pattern):
                    doc = normal.doc(a)
                    near.setdefault(doc, []).append(
                        (
                            label,
                            normal.word(a, doc),
                            normal.word(b - 1, doc),
                            normal.byte(a, doc),
                            normal.byte(b - 1, doc) + 1,
                            e,
                        )
                    )
            counts = np.diff(normal.first)
            for doc in range(hi - lo):
                here, spans = exact.get(doc, []), _disjoint(near.get(doc, []))
                own = {label for _, label in here}
                score = 1.0 if own else max((1 - s[5] / length[s[0]] for s in spans), default=0.0)
                rows.append(
                    (
                        int(counts[doc]),
                        len(here),
                        min(here)[0] if here else None,
                        max(here)[0] if here else None,
                        ",".join(sorted(own)),
                        ",".join(sorted(own | {s[0] for s in spans})),
                        score,
                        [dict(zip(SPAN, s, strict=True)) for s in spans],
                    )
                )
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(OUT)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(list(v), f.type) for v, f in zip(columns, OUT, strict=True))],
            [*batch.schema.names, *OUT.names],
        )


def scan(
    documents: DataFrame,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    base: tuple = BASE,
    notices: tuple = NOTICES,
) -> DataFrame:
    """The columns ``keep`` (all) with the licenses of each text.

    New columns, which replace those of the same name: ``n_words``; ``n_base``,
    ``first_word``, ``last_word`` and ``base_labels`` of the exact phrases
    (places from 0, null where there is none); ``labels`` with those of the
    notices too; ``score``, 1 for an exact phrase, else the best share of
    unedited characters, 0 without a match; ``spans``, the verified notices by
    word and by byte of the original text (the end is behind the last byte).
    """
    keep = keep or documents.columns
    df = common.inner(documents.select(*dict.fromkeys([*keep, text])))
    at = f"_c{list(dict.fromkeys([*keep, text])).index(text)}"
    out = df.mapInArrow(lambda it: _scan(it, at, base, notices), f"{common.ddl(df)}, {SCHEMA}")
    return out.select(*common.outer(out, keep, tuple(OUT.names)), *OUT.names)
