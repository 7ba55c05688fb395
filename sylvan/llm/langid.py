"""Language ID with error-correcting output codes.

Each language has a codeword of +1 and -1. For every bit a linear classifier
on hashed letter n-grams of the whole text predicts +1 or -1. Decoding adds up
the losses of the bits against each codeword, weighted by how reliable the bit
was on held-out training rows, and takes the codeword with the smallest sum.
The score is the share of that language in a softmax of the negative sums;
``ambiguous`` marks texts whose second language is nearly as good.

The bit classifiers are ridge regressions, so their leave-one-out predictions,
which give the weights of the bits and the steepness of the softmax, have a
closed form. They are fitted on at most ``MAX_TRAINING`` labelled rows, the
same number for each language as far as there are so many, chosen by a hash.

A text that is null or has no letter is ``und`` with score 0, as is every text
if no labelled row has letters. With one learned language every text with a
letter gets it. Repeated documents get equal answers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bound on the rows that the bit classifiers are fitted on.
MAX_TRAINING = 2400
BUCKETS = 1 << 12
SIZES = (2, 3, 4)
RIDGE = 0.05
#: Second language at least this share of the first: ambiguous.
AMBIGUOUS = 0.5
UNDETERMINED = "und"
#: Texts are counted in chunks of this many bytes and rows.
CHUNK, ROWS = 1 << 18, 256
#: Rows of a matrix worked on at once.
BLOCK = 200


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 for each of ``n`` languages.

    Up to five languages: all ways to split them in two. More: the best of some
    random codes by the distance of the closest two rows.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        bits = np.arange(1, 1 << (n - 1))
        rest = (bits[None, :] >> np.arange(n - 1)[:, None]) & 1
        return np.vstack([np.zeros((1, len(bits))), rest]) * 2.0 - 1
    rng = np.random.default_rng(7)
    width = 10 * int(np.ceil(np.log2(n)))
    best, far = None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        split = np.abs(code.sum(axis=0)) < n
        apart = (width - code @ code.T) / 2
        near = apart[~np.eye(n, dtype=bool)].min()
        if split.all() and near > far:
            best, far = code, near
    return best if best is not None else rng.choice([-1.0, 1.0], (n, width))


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows of unit length: square roots of hashed n-gram counts, chunk by chunk.

    Texts are lower-cased; ASCII that is no letter becomes a space. N-grams are
    of bytes, over whole texts.
    """
    table = np.arange(256, dtype=np.uint64)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    raw, offsets = common.texts_buffer(pc.utf8_lower(pc.fill_null(column, "")))
    for lo, hi in common.chunks(offsets, CHUNK, ROWS):
        n = hi - lo
        own = table[raw[offsets[lo] : offsets[hi]]]
        sizes = np.diff(offsets[lo : hi + 1])
        counts = np.zeros(n * BUCKETS)
        doc = np.repeat(np.arange(n) * BUCKETS, sizes)
        gram = own.copy()
        for k in range(1, max(SIZES)):
            if len(own) <= k:
                break
            gram = (gram[:-1] << np.uint64(8)) | own[k:]
            if k + 1 in SIZES:
                same = doc[: len(gram)] == doc[k:]
                hashed = (gram * np.uint64(common.MULTIPLIER)) >> np.uint64(64 - 12)
                at = (doc[: len(gram)] + hashed.astype(np.int64))[same]
                counts += np.bincount(at, minlength=n * BUCKETS)
        x = np.sqrt(counts.reshape(n, BUCKETS))
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        yield (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def _losses(margins: np.ndarray, code: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted squared hinge loss of each row against each codeword."""
    out = np.zeros((len(margins), len(code)))
    for i, word in enumerate(code):
        out[:, i] = (np.maximum(0, 1 - margins * word) ** 2) @ weights
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def invert(a: np.ndarray) -> None:
    """Replace a positive definite matrix by its inverse, some rows at a time and without copies of it."""
    for lo in range(0, len(a), BLOCK):
        own = slice(lo, min(lo + BLOCK, len(a)))
        pivot = np.linalg.inv(a[own, own])
        column = a[:, own].copy()
        column[own] = 0
        rows = pivot @ a[own]
        rows[:, own] = pivot
        a[:, own] = 0
        for at in range(0, len(a), BLOCK):
            a[at : at + BLOCK] -= column[at : at + BLOCK] @ rows
        a[own] = rows


def fit_codes(x: np.ndarray, y: np.ndarray, languages: list[str]) -> dict:
    """Bit classifiers, weights of the bits and steepness, from unit rows ``x``
    and language numbers ``y``."""
    code = codewords(len(languages))
    target = code[y]
    inverse = np.empty((len(x), len(x)))
    for lo in range(0, len(x), BLOCK):
        inverse[lo : lo + BLOCK] = x[lo : lo + BLOCK] @ x.T
    inverse += 1.0
    inverse[np.diag_indices_from(inverse)] += RIDGE
    invert(inverse)
    dual = inverse @ target
    held_out = target - dual / np.diag(inverse)[:, None]
    right = ((held_out * target) > 0).mean(axis=0)
    weights = np.clip(right - 0.5, 0.01, 0.5)
    weights /= weights.sum()
    losses = _losses(held_out, code, weights)
    rows = np.arange(len(y))
    steps = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
    wrong = [-np.log(np.maximum(_softmax(-s * losses)[rows, y], 1e-12)).mean() for s in steps]
    return {
        "languages": languages,
        "code": code,
        "weights": weights,
        "steepness": steps[int(np.argmin(wrong))],
        "linear": (x.T @ dual).astype(np.float32),
        "constant": dual.sum(axis=0),
    }


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", limit: int = MAX_TRAINING) -> dict | None:
    """A model from labelled rows; None if no row has both a label and a letter."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & (F.col("lang") != UNDETERMINED) & F.col("text").rlike(r"\p{L}")
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(limit // len(counts), 1)
    # texts are hashed, so copies stand or fall together and the order of rows is of no account
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.3 * each / n))))
    sample = rows.filter(draw < share[F.col("lang")])
    frame = sample.mapInArrow(_sample_rows, "lang string, x binary")
    got: dict[str, list[bytes]] = {}
    for row in frame.orderBy("lang", F.xxhash64("x")).toLocalIterator():
        if len(got.setdefault(row["lang"], [])) < each:
            got[row["lang"]].append(bytes(row["x"]))
    languages = sorted(got)
    y = np.repeat(np.arange(len(languages)), [len(got[k]) for k in languages])
    x = np.empty((len(y), BUCKETS), np.float32)
    row = 0
    for k in languages:
        for v in got.pop(k):
            x[row] = np.frombuffer(v, np.float16)
            row += 1
    model = fit_codes(x, y, languages)
    del x
    common.trim()
    return model


def _sample_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [row.astype(np.float16).tobytes() for x in features(batch.column(1)) for row in x]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["lang", "x"])


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, second language (the same if there is one only), and shares of all."""
    margins = x @ model["linear"] + model["constant"]
    shares = _softmax(-model["steepness"] * _losses(margins, model["code"], model["weights"]))
    order = np.argsort(-shares, axis=1, kind="stable")
    return order[:, 0], order[:, min(1, shares.shape[1] - 1)], shares


NEW = ("lang_pred", "score", "second", "ambiguous")


def predict(documents: DataFrame, model: dict | None, *, text: str = "text") -> DataFrame:
    """The documents with ``lang_pred``, ``score``, ``second`` and ``ambiguous``,
    which replace columns of the same name."""
    df = common.inner(documents)
    at = f"_c{documents.columns.index(text)}"
    df = df.withColumn("_letter", F.coalesce(F.col(at).rlike(r"\p{L}"), F.lit(False)))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            letter = batch.column(batch.schema.get_field_index("_letter")).to_pylist()
            n = batch.num_rows
            best, score, second, unclear = [UNDETERMINED] * n, [0.0] * n, [None] * n, [True] * n
            row = 0
            for x in features(batch.column(batch.schema.get_field_index(at))) if model else ():
                first, other, shares = decode(model, x)
                for k in range(len(x)):
                    if letter[row]:
                        p = float(shares[k, first[k]])
                        best[row], score[row] = model["languages"][first[k]], p
                        if other[k] != first[k]:
                            second[row] = model["languages"][other[k]]
                        unclear[row] = bool(other[k] != first[k] and shares[k, other[k]] >= AMBIGUOUS * p)
                    row += 1
            more = (pa.array(best), pa.array(score), pa.array(second, pa.string()), pa.array(unclear))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *NEW])

    schema = f"{common.ddl(df)}, lang_pred string, score double, second string, ambiguous boolean"
    out = df.mapInArrow(run, schema)
    return out.select(*common.outer(out, documents.columns, NEW), *NEW)
