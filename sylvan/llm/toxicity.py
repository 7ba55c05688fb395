"""Toxicity by a classifier chain.

Categories are predicted one after another by linear (logistic) models on the
different words of the whole text. Every model but the first has the
probabilities of the earlier categories among its inputs. While the chain is
trained these are out-of-fold predictions, so a later model sees earlier ones
as wrong as they are on new texts.

Words of a language with few marked rows get small weights that way. So beside
the model stand lists of the words that are more frequent in marked texts than
chance allows, each with the logarithm of how much; a text's evidence is the sum
over its listed words by its number of words, whatever its language. A last
small logistic model weighs the word model, the evidence and the earlier
categories, on out-of-fold values of all of them. A category is marked where
its probability reaches the threshold that was best on out-of-fold predictions
(F0.5: a clean text marked costs more than a toxic one missed).

The models are fitted on at most ``MAX_TRAINING`` labelled rows, chosen by a
hash of the text, so copies stand or fall together and are in one fold. Words
are known by a 64-bit hash; those of fewer than ``LEAST`` training rows are left
out. Null and empty texts have no words and get the probability of that. A null
label leaves a row out of its category. A category without both kinds of labels
has probability 0 and no marks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bound on the rows that the models are fitted on.
MAX_TRAINING = 9000
FOLDS = 3
LEAST = 5
EPOCHS, BATCH, RATE, PENALTY = 12, 128, 0.3, 2e-5
#: Standard errors from chance of the words of each list; words added to the length of a text.
LEVELS, LENGTH = (1.5, 2.0, 2.5, 3.0), 50


def word_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For chunks of texts the different words by text (hashes and text numbers), and the number of texts."""
    table, powers = common.folding(common.LETTERS_DIGITS), common.Powers()
    raw, offsets = common.texts_buffer(column)
    for lo, hi in common.chunks(offsets):
        words = common.Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table)
        yield words.hashes(powers), np.repeat(np.arange(hi - lo), words.counts()), hi - lo


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sum_by_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)


class Linear:
    """Weights of words, of earlier probabilities, and a constant."""

    def __init__(self, n_words: int, n_earlier: int) -> None:
        self.words, self.earlier, self.constant = np.zeros(n_words), np.zeros(n_earlier), 0.0

    def score(self, word: np.ndarray, row: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        total = _sum_by_row(self.words[word], row, len(earlier))
        return _sigmoid(total + earlier @ self.earlier + self.constant)


def train(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, n_words: int) -> Linear:
    """Logistic regression by steps that shrink for each weight as it is used (Adagrad)."""
    model, rng = Linear(n_words, earlier.shape[1]), np.random.default_rng(2)
    model.constant = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    seen, seen_earlier, seen_constant = np.full(n_words, 1e-2), np.full(earlier.shape[1], 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            word = np.concatenate([rows[i] for i in some])
            row = np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
            error = (model.score(word, row, earlier[some]) - y[some]) / len(some)
            slope = np.bincount(word, weights=error[row], minlength=n_words) + PENALTY * model.words
            seen += slope * slope
            model.words -= RATE * slope / np.sqrt(seen)
            slope = earlier[some].T @ error
            seen_earlier += slope * slope
            model.earlier -= RATE * slope / np.sqrt(seen_earlier)
            slope = float(error.sum())
            seen_constant += slope * slope
            model.constant -= RATE * slope / seen_constant**0.5
    return model


def word_lists(rows: list[np.ndarray], y: np.ndarray, n_words: int) -> list[np.ndarray]:
    """For each level the log ratios of the words that are as far above chance in marked rows; 0 for others."""
    word = np.concatenate(rows)
    marked = np.repeat(y > 0.5, [len(r) for r in rows])
    with_mark = np.bincount(word[marked], minlength=n_words) + 0.5
    without = np.bincount(word[~marked], minlength=n_words) + 0.5
    ratio = np.log(with_mark / (np.sum(y > 0.5) + 1)) - np.log(without / (np.sum(y <= 0.5) + 1))
    apart = ratio / np.sqrt(1 / with_mark + 1 / without)
    return [np.where(apart > level, ratio, 0.0) for level in LEVELS]


class Category:
    """The word model, the word lists and the weights of what they say."""

    def __init__(self, rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, n_words: int) -> None:
        self.model, self.lists = train(rows, earlier, y, n_words), word_lists(rows, y, n_words)
        self.weights, self.constant = np.zeros(1 + len(LEVELS) + earlier.shape[1]), 0.0

    def inputs(self, word: np.ndarray, row: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        n = len(earlier)
        p = self.model.score(word, row, earlier)
        length = np.bincount(row, minlength=n) + LENGTH
        evidence = [_sum_by_row(x[word], row, n) / length for x in self.lists]
        return np.column_stack([np.log(p / (1 - p)), *evidence, earlier])

    def weigh(self, inputs: np.ndarray) -> np.ndarray:
        return _sigmoid(inputs @ self.weights + self.constant)

    def score(self, word: np.ndarray, row: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return self.weigh(self.inputs(word, row, earlier))


def weights_of(inputs: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on a few inputs by Newton's steps, with a small penalty."""
    mean, spread = inputs.mean(axis=0), inputs.std(axis=0)
    spread[spread < 1e-9] = 1.0
    x = np.column_stack([(inputs - mean) / spread, np.ones(len(y))])
    penalty = np.full(x.shape[1], 1.0)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _sigmoid(x @ w)
        slope = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), slope)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum())


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on marks have the best F0.5, half way to the next lower one."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order])
    worth = 1.25 * right / (np.arange(1, len(p) + 1) + 0.25 * y.sum())
    last = np.append(p[order][1:] != p[order][:-1], True)
    at = int(np.argmax(np.where(last, worth, -1)))
    lower = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + lower) / 2)


def fit(
    labelled: DataFrame, categories: list[str], *, text: str = "text", limit: int = MAX_TRAINING
) -> dict:
    """A chain from rows with a text and a column of 0 and 1 for each category, in that order."""
    labels = [F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(categories)]
    rows = labelled.select(F.col(text).alias("text"), *labels)
    rows = rows.filter(reduce(lambda a, b: a | b, (F.col(f"y{i}").isNotNull() for i in range(len(labels)))))
    n = max(rows.count(), 1)
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.withColumn("hash", F.xxhash64("text")).filter(draw < min(1.0, 0.95 * limit / n))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words, row, count in word_sets(batch.column(0)):
                edges = np.searchsorted(row, np.arange(count + 1))
                out += [np.unique(words[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *batch.columns[1:]], ["words", *batch.schema.names[1:]])

    shape = "words binary, " + ", ".join(f"y{i} double" for i in range(len(labels))) + ", hash long"
    got = sample.mapInArrow(hashed, shape).orderBy("hash", "words").limit(limit).toArrow()
    sets = [np.frombuffer(w.as_py(), np.uint64) for w in got["words"]]
    fold = np.array(got["hash"].to_numpy() % FOLDS, np.int64) if len(sets) else np.zeros(0, np.int64)
    known, frequency = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
    known = known[frequency >= LEAST]
    ids = []
    for words in sets:
        at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
        ids.append(at[known[at] == words] if len(known) else np.zeros(0, np.int64))
    labels_of = [got[f"y{i}"].to_numpy(zero_copy_only=False) if len(sets) else np.zeros(0) for i in range(len(labels))]
    steps, _ = fit_chain(ids, fold, dict(zip(categories, labels_of, strict=True)), len(known))
    return {"words": known, "steps": steps}


def fit_chain(ids: list[np.ndarray], fold: np.ndarray, labels: dict[str, np.ndarray], n_words: int) -> tuple[list, np.ndarray]:
    """The steps of a chain (category, model, threshold) and the out-of-fold
    probabilities, from the known words and the labels (NaN for none) of rows."""
    earlier = np.zeros((len(ids), 0))
    steps = []
    for category, y in labels.items():
        has = np.flatnonzero(~np.isnan(y))
        held_out, model, threshold = np.zeros(len(ids)), None, None
        if len(np.unique(y[has])) > 1:

            def learn(some, y=y, earlier=earlier):
                return Category([ids[j] for j in some], earlier[some], y[some], n_words)

            model = learn(has)
            inputs = np.zeros((len(ids), len(model.weights)))
            known = np.zeros(len(ids), bool)
            for k in range(FOLDS):
                rest, own = has[fold[has] != k], np.flatnonzero(fold == k)
                if len(own) and len(np.unique(y[rest])) > 1:
                    word = np.concatenate([ids[j] for j in own])
                    row = np.repeat(np.arange(len(own)), [len(ids[j]) for j in own])
                    inputs[own], known[own] = learn(rest).inputs(word, row, earlier[own]), True
            some = has[known[has]]
            if len(np.unique(y[some])) > 1:
                for k in range(FOLDS):
                    rest, own = some[fold[some] != k], np.flatnonzero(known & (fold == k))
                    if len(own) and len(np.unique(y[rest])) > 1:
                        model.weights, model.constant = weights_of(inputs[rest], y[rest])
                        held_out[own] = model.weigh(inputs[own])
                model.weights, model.constant = weights_of(inputs[some], y[some])
            else:  # too few rows to hold any out
                model.weights[0] = 1.0
            threshold = best_threshold(held_out[has], y[has])
        steps.append((category, model, threshold))
        earlier = np.hstack([earlier, held_out[:, None]])
    return steps, earlier


def predict(documents: DataFrame, chain: dict, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) with ``p_<category>`` and the mark ``<category>``
    of each; these replace columns of the same name."""
    keep = keep or documents.columns
    columns = list(dict.fromkeys([*keep, text]))
    df = common.inner(documents.select(*columns))
    at = columns.index(text)
    names = [x for category, *_ in chain["steps"] for x in (f"p_{category}", category)]
    shared = documents.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, steps = shared.value["words"], shared.value["steps"]
        for batch in batches:
            parts = [np.zeros((0, len(steps)))]
            for words, row, n in word_sets(batch.column(at)):
                place = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
                hit = known[place] == words if len(known) else np.zeros(len(words), bool)
                pairs = np.unique(row[hit] * (len(known) + 1) + place[hit])
                row, word = pairs // (len(known) + 1), pairs % (len(known) + 1)
                p = np.zeros((n, 0))
                for _, model, _ in steps:
                    now = np.zeros(n) if model is None else model.score(word, row, p)
                    p = np.hstack([p, now[:, None]])
                parts.append(p)
            p = np.vstack(parts)
            out = []
            for i, (_, model, threshold) in enumerate(steps):
                mark = p[:, i] >= threshold if model is not None else np.zeros(len(p), bool)
                out += [pa.array(p[:, i]), pa.array(mark)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, *(f"_p{i}" for i in range(len(out)))])

    more = ", ".join(f"_p{i} {'boolean' if i % 2 else 'double'}" for i in range(len(names)))
    out = df.mapInArrow(run, f"{common.ddl(df)}, {more}")
    own = [out[f"_c{i}"].alias(c) for i, c in enumerate(columns) if c in keep and c not in names]
    return out.select(*own, *(out[f"_p{i}"].alias(c) for i, c in enumerate(names)))
