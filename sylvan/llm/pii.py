"""Personal data: labelers vote on places, their reliabilities are estimated, a classifier decides.

Patterns give candidates: strict forms of an e-mail address, an IP address, a
card number and a telephone number, and looser forms of these (``name (at)
host``, numbers without a plus sign) and of national numbers. Five labelers
vote yes, no or nothing on each: its format and check digits, a gazetteer
(domains, address blocks, issuers, country codes), words near it, what it
touches, and its shape. Expectation-maximisation over the counted vote patterns
estimates for each kind how reliable each labeler is, and so how likely each
pattern is personal data; a logistic model of votes, kind and length is trained
on that. Strict candidates whose checks hold are always spans; others are where
the model says so and no strict span overlaps.

All of it is DataFrame functions. What the driver gets is one row per vote
pattern, of which there are a few thousand at most.

Null texts are empty. Positions are code points, the end exclusive. Repeated
rows each give a row; other columns are kept by ``keep``. Empty tables give no
rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# --- fixed values: kinds in the order of results, and their strict forms ------
KINDS = ["email", "ip", "card", "phone", "id"]
LOCAL, HOST = "A-Za-z0-9._%+-", "[A-Za-z0-9-]++"
#: Equal to the documented patterns, but written so that no place is read twice.
STRICT = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@{HOST}(?:\.{HOST})++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",  # shorter ones fail anyway
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT, _DOT = r" ?[\[(] ?(?i:at|@) ?[\])] ?", r"(?: ?[\[(] ?(?i:dot|\.) ?[\])] ?|\.)"
LOOSE = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]++{_AT}{HOST}(?:{_DOT}{HOST})++",
    "phone": r"(?<![0-9+.()-])(?<![0-9] )(?:00[0-9]{1,3}[ .-])?(?:\([0-9]{2,5}\)|[0-9]{2,5})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this has no such candidate.
NEEDS = {("email", True): "@", ("phone", True): "+"}
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

# --- fixed values: what the gazetteer and the context know ----------------------
DOMAINS = "com org net edu gov info biz io me app dev eu de fr es it nl uk us ca au ch at pl se no".split()
RESERVED = r"^0*(?:0|127|255|22[4-9]|23[0-9])\."
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6)"
CALLING_CODES = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 61 62 63 64 65 66 7 81 82 84 86 90 91".split()
CUES = {
    "email": "mail contact write address reach correo kontakt courriel",
    "ip": "ip server host address client login adresse",
    "card": "card visa credit debit payment karte carte tarjeta",
    "phone": "phone call tel mobile cell fax number telefon appel llame",
    "id": "ssn social insurance identity passport tax",
}
OTHER_CUES = "version isbn order item page part serial invoice model build"
BEFORE, AFTER = 40, 20
LABELERS = ["format", "gazetteer", "context", "edges", "shape"]
YES, NO, NOTHING = "1", "0", "-"
ROUNDS = 60
#: Beyond any position.
FAR = 1 << 40
SPAN = "struct<start:bigint,kind:int,end:bigint,base:boolean,votes:string,size:int>"


# --- running values ----------------------------------------------------------------
def with_running(rows: DataFrame, columns: list[tuple[str, str, Callable[[Column, Column], Column]]]) -> DataFrame:
    """Add arrays of all values before each value taken together (0 for none).

    For each (values, new column, how two are taken together). Done in two steps
    of about a square root of the values, so that long arrays stay affordable.
    What a lambda reads for every element is a column with two uses, which the
    optimizer does not put into the lambda.
    """

    def total(x: Column, add: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: add(a, b))

    def step(values: str) -> Column:
        return F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))

    def block(values: str, i: Column) -> Column:
        return F.floor(i / step(values)).cast("int")

    def blocks(values: str, add: Callable[[Column, Column], Column]) -> Column:
        numbers = F.sequence(F.lit(0), block(values, F.size(values) - 1))
        return F.transform(numbers, lambda b: total(F.slice(values, b * step(values) + 1, step(values)), add))

    def before(sums: str, add: Callable[[Column, Column], Column]) -> Column:
        numbers = F.sequence(F.lit(0), F.size(sums) - 1)
        return F.transform(numbers, lambda b: total(F.slice(sums, F.lit(1), b), add))

    def each(values: str, sums: str, add: Callable[[Column, Column], Column]) -> Column:
        return F.transform(
            values,
            lambda x, i: add(
                F.get(sums, block(values, i)),
                total(F.slice(values, block(values, i) * step(values) + 1, i % step(values)), add),
            ),
        )

    empty = F.array().cast("array<bigint>")
    own = rows.columns
    some = [(f"_b{k}", f"_a{k}", *c) for k, c in enumerate(columns)]
    rows = rows.select("*", *(F.when(F.size(v) > 0, blocks(v, add)).otherwise(empty).alias(b) for b, _, v, _, add in some))
    rows = rows.select(*own, *(F.when(F.size(b) > 0, before(b, add)).otherwise(empty).alias(a) for b, a, _, _, add in some))
    done = [F.when(F.size(a) > 0, each(v, a, add)).otherwise(empty).alias(new) for _, a, v, new, add in some]
    return rows.select(*own, *done)


# --- labelers --------------------------------------------------------------------
def _vote(yes: Column, no: Column | None = None) -> Column:
    no = ~yes if no is None else no
    return F.when(yes, YES).when(no, NO).otherwise(NOTHING)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    last = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substr(digits, last - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    places = F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0)))
    return F.aggregate(places, F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    """The check that a strict match must pass."""
    if kind == "ip":
        return x.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    n = F.length(_digits(x))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(x))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _words(words: str) -> str:
    return r"(?i)\b(?:" + "|".join(words.split()) + r")s?\b"


def votes(kind: str, strict: bool, x: Column, before: Column, after: Column) -> Column:
    """One character for each labeler, in order."""
    by_gazetteer = {
        "email": lambda: _vote(F.lower(F.regexp_extract(x, "([A-Za-z0-9-]+)[^A-Za-z0-9]*$", 1)).isin(DOMAINS)),
        "ip": lambda: _vote(~x.rlike(RESERVED)),
        "card": lambda: _vote(_digits(x).rlike(ISSUERS)),
        "phone": lambda: _vote(_digits(x).rlike("^(?:" + "|".join(CALLING_CODES) + ")")) if strict else F.lit(NOTHING),
        "id": lambda: _vote(~x.rlike("^(?:000|666|9)|-00-|-0000$")),
    }
    shapes = {
        "email": "^[A-Za-z0-9]",
        "ip": r"^[1-9][0-9]{0,2}\.",
        "card": "^(?:[0-9]{12,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$",
        "phone": r"^[^()]*(?:\([0-9]+\)[^()]*)?$",
    }
    near = F.concat(before, F.lit(" \n "), after)
    glued = before.rlike("[A-Za-z0-9_\"'=/]$") | after.rlike("^[A-Za-z0-9_\"'=/]")
    if kind == "ip":
        glued = glued | before.rlike(r"[0-9]\.$") | after.rlike(r"^\.[0-9]")
    return F.concat(
        _vote(valid(kind, x)) if strict else F.lit(NOTHING),
        by_gazetteer[kind](),
        _vote(near.rlike(_words(CUES[kind])), near.rlike(_words(OTHER_CUES))),
        _vote(~glued),
        _vote(x.rlike(shapes[kind])) if strict else F.lit(NOTHING),  # loose forms have their shape by the pattern
    )


# --- candidates --------------------------------------------------------------------
def candidates(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``found``: all candidates of each text with their votes."""
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = documents.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    forms = [(k, True, p) for k, p in STRICT.items()] + [(k, False, p) for k, p in LOOSE.items()]
    t = F.col("_t")
    has_digit = t.rlike("[0-9]")
    none = F.array().cast("array<string>")
    carried, parts = [f"_k{i}" for i in range(len(keep))], []
    for n, (kind, strict, pattern) in enumerate(forms):
        needs = NEEDS.get((kind, strict))
        may = F.contains(t, F.lit(needs)) if needs else t.rlike(r"[\[(]") if kind == "email" else has_digit
        parts.append(F.when(may, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"_p{n}"))
    rows = rows.select(*carried, "_t", *parts)
    gaps = [
        F.when(F.size(f"_p{n}") > 0, F.split(t, pattern, -1)).otherwise(none).alias(f"_g{n}")
        for n, (_, _, pattern) in enumerate(forms)
    ]
    numbers = range(len(forms))
    rows = rows.select(*carried, *(f"_p{n}" for n in numbers), *gaps)
    # what is before a match: the gap, and the match and gap before that
    def lengths_of(n: int) -> Column:
        return F.transform(f"_p{n}", lambda x, i: (F.length(x) + F.length(F.get(f"_g{n}", i))).cast("long"))

    lengths = [lengths_of(n).alias(f"_l{n}") for n in numbers]
    rows = rows.select(*carried, *(f"_p{n}" for n in numbers), *(f"_g{n}" for n in numbers), *lengths)
    rows = with_running(rows, [(f"_l{n}", f"_s{n}", lambda a, b: a + b) for n in numbers])

    def spans(n: int) -> Column:
        kind, strict, _ = forms[n]

        def span(x: Column, i: Column) -> Column:
            gap = F.get(f"_g{n}", i)
            start = F.get(f"_s{n}", i) + F.length(gap)
            said = votes(kind, strict, x, F.right(gap, F.lit(BEFORE)), F.left(F.get(f"_g{n}", i + 1), F.lit(AFTER)))
            size = F.least(F.floor(F.length(x) / 8), F.lit(3)).cast("int")
            return F.struct(
                start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(x)).alias("end"),
                F.lit(strict).alias("base"), said.alias("votes"), size.alias("size"),
            )

        return F.transform(f"_p{n}", span)

    found = F.concat(*(spans(n).cast(f"array<{SPAN}>") for n in numbers))
    checked = F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
            (s["base"] & (F.substring(s["votes"], 1, 1) == YES)).alias("base"), s["votes"].alias("votes"), s["size"].alias("size"),
        ),
    )
    own = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    return rows.select(*own, checked.alias("found"))


# --- reliabilities -------------------------------------------------------------------
def reliabilities(patterns: dict[str, float]) -> tuple[dict[str, float], np.ndarray]:
    """Probability of each vote pattern of a kind, by expectation-maximisation, and
    how often each labeler says each vote of either class.

    A labeler starts out a little better than chance; the format check, where it
    speaks, decides the start. Counts are smoothed, so few rows say little.
    """
    says = {YES: 0, NO: 1, NOTHING: 2}
    keys = sorted(patterns)
    votes_of = np.array([[says[v] for v in k] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    lead = (votes_of == 0).sum(axis=1) - (votes_of == 1).sum(axis=1)
    q = 1 / (1 + np.exp(-0.8 * (lead - 0.5)))
    q = np.where(votes_of[:, 0] == 0, 0.95, np.where(votes_of[:, 0] == 1, 0.05, q))
    prior = np.array([[3.0, 1.0, 2.0], [1.0, 3.0, 2.0]])
    table = np.zeros((2, len(LABELERS), 3))
    for _ in range(ROUNDS):
        share = (n @ q + 1) / (n.sum() + 2)
        for c, belongs in enumerate((q, 1 - q)):
            for j in range(len(LABELERS)):
                counts = np.bincount(votes_of[:, j], n * belongs, 3) + prior[c]
                table[c, j] = counts / counts.sum()
        logs = [np.log(table[c][np.arange(len(LABELERS)), votes_of]).sum(axis=1) for c in (0, 1)]
        q = 1 / (1 + np.exp(np.clip(logs[1] + math.log(1 - share) - logs[0] - math.log(share), -60, 60)))
    return dict(zip(keys, q.tolist(), strict=True)), table


def features(kind: int, said: str, size: int) -> list[float]:
    """What the classifier sees: a constant, votes, kind and length."""
    out = [1.0]
    for v in said:
        out += [float(v == YES), float(v == NO)]
    return out + [float(kind == k) for k in range(len(KINDS))] + [float(size == s) for s in range(1, 4)]


def train(rows: list[tuple[int, str, int, float]]) -> dict:
    """The classifier from (kind, votes, size, count) rows, and what was estimated on the way."""
    by_kind: dict[int, dict[str, float]] = {}
    for kind, said, _, n in rows:
        by_kind.setdefault(kind, {})
        by_kind[kind][said] = by_kind[kind].get(said, 0.0) + n
    estimated = {k: reliabilities(p) for k, p in by_kind.items()}
    x = np.array([features(k, s, z) for k, s, z, _ in rows]).reshape(len(rows), -1)
    y = np.array([estimated[k][0][s] for k, s, _, _ in rows])
    n = np.array([c for *_, c in rows], float)
    width = len(features(0, NOTHING * len(LABELERS), 0))
    w = np.zeros(width)
    w[0] = -1.0
    if len(rows):
        penalty = np.full(width, 0.5)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n * (p - y)) + penalty * w
            curve = (x * (n * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            w -= step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
    return {"weights": w.tolist(), "reliabilities": {KINDS[k]: t for k, (_, t) in estimated.items()}}


def fit(found: DataFrame) -> dict:
    """Reliabilities and classifier from the candidates of all rows; the driver sees counts of vote patterns."""
    one = found.select(F.explode("found").alias("s"))
    counted = one.groupBy("s.kind", "s.votes", "s.size").count().orderBy("kind", "votes", "size").collect()
    return train([(r["kind"], r["votes"], r["size"], float(r["count"])) for r in counted])


def probability(span: Column, model: dict) -> Column:
    w = model["weights"]
    terms = [F.lit(w[0])]
    for j in range(len(LABELERS)):
        vote = F.substring(span["votes"], j + 1, 1)
        terms.append(F.when(vote == YES, w[1 + 2 * j]).when(vote == NO, w[2 + 2 * j]).otherwise(0.0))
    at = 1 + 2 * len(LABELERS)
    terms.append(F.get(F.array(*(F.lit(v) for v in w[at : at + len(KINDS)])), span["kind"]))
    terms.append(F.get(F.array(F.lit(0.0), *(F.lit(v) for v in w[at + len(KINDS) :])), span["size"]))
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms)))


def decide(found: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """Replace ``found`` by ``spans``: kind, start, end, strict or not, and probability, by start and kind.

    A loose span must overlap no strict one, and none that starts before it (or
    there, of an earlier kind).
    """
    scored = F.transform("found", lambda s: s.withField("p", probability(s, model)))
    rows = found.withColumn("_scored", scored)
    good = F.filter("_scored", lambda s: s["base"] | (s["p"] >= least))
    rows = rows.withColumn("_good", F.sort_array(good)).drop("found", "_scored")
    nowhere = F.lit(0).cast("long")
    rows = rows.select(
        "*",
        F.transform("_good", lambda s: F.when(s["base"], s["end"]).otherwise(nowhere)).alias("_strict"),
        F.transform("_good", lambda s: F.when(s["base"], nowhere).otherwise(s["end"])).alias("_loose"),
        # counted down from the end of all numbers, so that the next start is a largest value
        F.reverse(F.transform("_good", lambda s: F.when(s["base"], FAR - s["start"]).otherwise(nowhere))).alias("_next"),
    )
    marks = [("_strict", "_strict_end", F.greatest), ("_loose", "_loose_end", F.greatest), ("_next", "_next_start", F.greatest)]
    rows = with_running(rows, marks).withColumn("_next_start", F.reverse("_next_start"))
    free = F.filter(
        "_good",
        lambda s, i: s["base"]
        | (
            (F.get("_strict_end", i) <= s["start"])
            & (F.get("_loose_end", i) <= s["start"])
            & (FAR - F.get("_next_start", i) >= s["end"])
        ),
    )
    own = [c for c in found.columns if c != "found"]
    return rows.select(*own, free.alias("spans"))


def find(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``spans`` of every text; the model is fitted on all rows.

    Candidates are looked for once and written; the texts are not.
    """
    found = common.stage(candidates(documents, keep, text), "pii-candidates")
    return decide(found, fit(found))


def written(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def report(found: DataFrame) -> DataFrame:
    """Replace ``spans`` by counts of strict spans, their digest, and all spans as text."""
    base = found.withColumn("_base", F.filter("spans", lambda s: s["base"]))

    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    counts = [count(k).alias(f"n_{k}") for k in STRICT]
    others = [c for c in found.columns if c != "spans"]
    digest = F.sha2(written(F.col("_base")).cast("binary"), 256)
    return base.select(*others, *counts, digest.alias("base_sha256"), written(F.col("spans")).alias("spans"))
