"""Token ids of whole texts with the ``tokenizers`` library, each different word encoded once.

Both vocabularies below cut a text at white space before they merge, so the
ids of a text are those of its words in order. A worker keeps the ids of words
that it has met, by a 64-bit hash of the word; the library encodes the rest,
many at a time. A text with white space other than single spaces and line ends
between words, or with ``<|`` (special tokens), is encoded by the library as a
whole, so ids always equal those of ``encode``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import common

#: Words that a worker remembers (about 40 bytes each); it starts anew beyond that.
MAX_WORDS = 2_000_000
#: Bytes of text encoded at once; some arrays have 8 bytes for each.
CHUNK = 1 << 19
#: Words in one text for the library, and texts in one call.
TOGETHER, TEXTS = 200, 100
SENTINEL = "\x02"
TAIL = ".,;:!?"
#: White space within a word, special tokens, and the sentinel.
UNUSUAL = re.compile(rf"\s|<\||{SENTINEL}")
SPACE, LINE = 0x20, 0x0A


class Encoder:
    """Base of the two kinds."""

    lower = False

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tails = np.array([self._ids(c)[0] for c in TAIL])
        self.powers = common.Powers()
        self.table = np.arange(256, dtype=np.uint8)
        if self.lower:
            self.table[65:91] += 32
        self.table[[SPACE, LINE]] = common.GAP
        self._reset()

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.odd = np.zeros(0, bool)
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _library(self, texts: list[str]) -> np.ndarray:
        """The ids of several texts, one after another."""
        out = [np.zeros(0, np.int64)]
        for lo in range(0, len(texts), TEXTS):
            some = self.library.encode_batch_fast(texts[lo : lo + TEXTS], add_special_tokens=False)
            out += [np.array(x.ids, np.int64) for x in some]
        return np.concatenate(out)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, their numbers and whether it is odd, for each word. A word that
        ends in a single mark after a letter is the word and the mark."""
        odd = np.zeros(len(words), bool)
        if UNUSUAL.search("\0".join(w[self.lead(w) :] for w in words)):
            odd = np.array([bool(UNUSUAL.search(w[self.lead(w) :])) for w in words])
        mark = np.array([TAIL.find(w[-1]) if w[-2:-1].isalpha() else -1 for w in words])
        bare = [w[:-1] if m >= 0 else w for w, m in zip(words, mark.tolist(), strict=True)]
        number = {w: i for i, w in enumerate(dict.fromkeys(w for w, o in zip(bare, odd.tolist(), strict=True) if not o))}
        ids, lengths = self._encode_words(list(number)) if number else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        index = np.array([number.get(w, -1) for w in bare], np.int64)
        lengths = np.append(lengths, 0)
        starts = np.cumsum(lengths) - lengths
        flat, ends = _gather(ids, starts[index], lengths[index])
        marked = (mark >= 0) & ~odd
        return np.insert(flat, ends[marked], self.tails[mark[marked]]), lengths[index] + marked, odd

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null is empty."""
        raw, offsets = common.texts_buffer(texts)
        for lo, hi in common.chunks(offsets, CHUNK):
            yield from self._chunk(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])

    def _chunk(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        words = common.Words(raw, offsets, self.table)
        slow, keys, lead = self.gaps(raw, words, words.hashes(self.powers))
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        unique, where = ordered[new], order[new]
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(new) - 1
        if len(self.keys) + len(unique) > MAX_WORDS:
            self._reset()
        at = np.searchsorted(self.keys, unique)
        missing = np.ones(len(unique), bool)
        within = at < len(self.keys)
        missing[within] = self.keys[at[within]] != unique[within]
        if missing.any():
            some = where[missing]
            a, b = words.start[some].tolist(), words.end[some].tolist()
            folded = words.folded.tobytes()
            ids, lengths, odd = self._learn(
                [x + folded[i:j].decode() for x, i, j in zip(lead(some), a, b, strict=True)]
            )
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(ids)] = ids
            place = at[missing]
            self.keys = np.insert(self.keys, place, unique[missing])
            self.start = np.insert(self.start, place, self.used + np.cumsum(lengths) - lengths)
            self.length = np.insert(self.length, place, lengths)
            self.odd = np.insert(self.odd, place, odd)
            self.used += len(ids)
            at = np.searchsorted(self.keys, unique)
        index = at[number]
        ids, ends = _gather(self.ids, self.start[index], self.length[index].astype(np.int64))
        edges = np.concatenate([[0], ends])[words.first].tolist()
        strange = np.concatenate([[0], np.cumsum(self.odd[index])])[words.first]
        slow = (slow | (np.diff(strange) > 0)).tolist()
        for k in range(len(offsets) - 1):
            if slow[k]:
                yield np.array(self._ids(raw[offsets[k] : offsets[k + 1]].tobytes().decode()), np.int32)
            else:
                yield ids[min(edges[k] + self.extra, edges[k + 1]) : edges[k + 1]]


def _gather(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids one after another, and where each ends."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(starts - ends + lengths, lengths) + np.arange(total)], ends


def _joined(each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for ids in each for i in ids], np.int64), np.array([len(ids) for ids in each], np.int64)


class ByteLevel(Encoder):
    """Byte-level merges: a word takes the space before it along.

    A word behind a line end, and the first of a text, is encoded behind a line
    end; the id of the one before the text is dropped. A text whose words stand
    behind anything else than one space or line end goes to the library whole.
    """

    extra = 1

    def __init__(self, path: str) -> None:
        super().__init__(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)  # the alphabet has a character for each byte

    @staticmethod
    def lead(word: str) -> int:
        return 1

    @staticmethod
    def gaps(raw: np.ndarray, words: common.Words, hashes: np.ndarray):
        """Texts with unusual gaps, keys of words with what stands before them, and that itself."""
        n_docs, n = len(words.offsets) - 1, len(words.start)
        first = np.zeros(n + 1, bool)
        first[words.first] = True
        first = first[:n]
        before = np.concatenate([[0], words.end[:-1]]) if n else np.zeros(0, np.int64)
        line = first | (raw[np.maximum(words.start - 1, 0)] == LINE)
        unusual = np.concatenate([[0], np.cumsum(~first & (words.start - before != 1))])
        slow = np.diff(unusual[words.first]) > 0
        has = words.counts() > 0
        slow |= ~has & (np.diff(words.offsets) > 0)  # white space only
        with_words = np.flatnonzero(has)
        begin, end = words.start[words.first[:-1][has]], words.end[words.first[1:][has] - 1]
        slow[with_words] |= (begin != words.offsets[:-1][has]) | (end != words.offsets[1:][has])
        assert len(slow) == n_docs
        keys = np.where(line, common.mix64(hashes + np.uint64(1)), hashes)
        return slow, keys, lambda some: ["\n" if x else " " for x in line[some].tolist()]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._library(["".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)])
        ends = np.cumsum([len(w.encode()) for w in words])
        done = np.cumsum(self.bytes[ids])
        cut = np.searchsorted(done, ends)
        if len(done) and done[-1] == ends[-1] and (done[cut] == ends).all():
            return ids, np.diff(cut, prepend=-1)
        return _joined([self._ids(w) for w in words])  # a merge across words, which the pattern does not allow for


class WordLevel(Encoder):
    """Merges with word ends; white space is dropped and case ignored."""

    extra = 0
    lower = True

    @staticmethod
    def lead(word: str) -> int:
        return 0

    @staticmethod
    def gaps(raw: np.ndarray, words: common.Words, hashes: np.ndarray):
        return np.zeros(len(words.offsets) - 1, bool), hashes, lambda some: [""] * len(some)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        mark = self._ids(SENTINEL)
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        ids = self._library([f" {SENTINEL} ".join([*g, ""]) for g in groups])
        cut = np.flatnonzero(ids == mark[0])
        if len(mark) == 1 and len(cut) == len(words):
            return np.delete(ids, cut), np.diff(cut, prepend=-1) - 1
        return _joined([self._ids(w) for w in words])


KINDS = {"byte": ByteLevel, "word": WordLevel}


def encoder(path: str, kind: str) -> Encoder:
    """The encoder of a vocabulary file, one for each worker."""
    store = common.worker_store()
    if (path, kind) not in store:
        store[path, kind] = KINDS[kind](path)
    return store[path, kind]
