"""Spelling variants, ranked search and personal data against plain brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylvan.llm import lexical, pii, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- spelling ------------------------------------------------------------------
def plain_counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                n[w] += 1
    return n


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows, least):
    n = {w: k for w, k in plain_counts(rows).items() if k >= least}
    by_word = {w: sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: v[0] if v and n[v[0]] >= 5 * n[w] else None for w, v in by_word.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(by_word[w]), n[form[w]] if form[w] else -1) for w in n)


def misspelt(seed, n):
    rng = random.Random(seed)
    base = ["mountain", "fountain", "river bank", "größeres", "gründlich", "MOUNTAIN", "Ñandúes", "aaaaaa", "aaaaaaa", "x" * 90]
    out = []
    for _ in range(n):
        w = rng.choice(base)
        for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abéß") + w[k:], w[:k] + rng.choice("abéÿ") + w[k + 1 :]])
        out.append(w)
    return " ".join(out)


@pytest.mark.parametrize("depth", [None, 1, 3, 8])
def test_variants_equal_brute_force(documents, depth):
    rows = [(i, misspelt(i, 300)) for i in range(12)] + [(50, None), (51, ""), (52, "12 !"), (3, misspelt(3, 300)), (None, misspelt(9, 50))]
    df = documents(rows, "word")
    out = spelling.group_variants(df, min_count=2, depth=depth)
    got = sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] if r["form"] else -1) for r in out.collect())
    want = plain_variants(rows, 2)
    assert got == want and sum(r[1] != "" for r in want) > 20 and any(r[1] not in ("", r[2]) for r in want)


def test_shards_are_cut_where_they_are_small_enough(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(2000)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    assert spelling.depth_of(df, len(words)) == 1 < spelling.depth_of(df, 40) <= spelling.GROUPS
    found = {tuple(sorted((r["word"], r["near"]))) for r in spelling.near_words(df, depth=spelling.depth_of(df, 40)).collect()}
    cuts = {}
    for w in words:
        for i in range(len(w)):
            cuts.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    assert found == {(a, b) for same in cuts.values() for a in same for b in same if a < b} and len(found) > 30


def test_hashes_of_words():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    start = np.arange(0, 4000, 37)
    end = start + rng.integers(0, 300, len(start))
    before = np.array([zlib.crc32(str(i).encode()) for i in range(len(start))], np.uint32)
    want = [zlib.crc32(f"{i}".encode() + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(start, end, strict=True))]
    assert spelling.hash_words(data, start, end, before).tolist() == want


def test_one_edit_on_short_and_very_long_words():
    pairs = [("abcdef", "abcdef"), ("abcdef", "abcdeg"), ("abcdef", "abcde"), ("abcdef", "bcdef"), ("abcdef", "acbdef")]
    pairs += [("a" * 3000, "a" * 2999), ("a" * 3000 + "b", "b" + "a" * 3000), ("é" * 9, "é" * 4 + "x" + "é" * 4), ("abcdef", "ab")]
    a, b = (spelling.WordList(pa.array([p[k] for p in pairs])) for k in (0, 1))
    i = np.arange(len(pairs))
    assert spelling.one_edit(a, i, b, i).tolist() == [near(x, y) for x, y in pairs]


def test_no_words(documents):
    assert spelling.group_variants(documents([(1, None), (2, "")])).count() == 0
    assert spelling.group_variants(documents([]).limit(0)).count() == 0


# --- ranked search ---------------------------------------------------------------
def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_search(rows, items, best=20):
    docs = [(i, Counter(terms_of(t))) for i, t in rows]
    lengths = [sum(c.values()) for _, c in docs]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for (i, c), n in zip(docs, lengths, strict=True):
            m = 75 + 25 * n * n_docs // n_terms if n_terms else 0
            s = 0
            for t, q in Counter(terms_of(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += q * w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(str(item), k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=str)


def found(df):
    return sorted(((str(r["item_id"]), r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize(("shard", "block"), [(1 << 24, 128), (2000, 4)])
def test_search_equals_brute_force(documents, spark, prose, monkeypatch, shard, block):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical, "BLOCK", block)
    rows = [(i, prose(i % 70, 5 + i % 90)) for i in range(160)] + [(900, None), (901, ""), (902, "zebra Ärger zebra"), (7, prose(7, 12)), (None, prose(1, 30))]
    items = [("a", prose(3, 30)), ("b", "zebra the THE Ärger"), ("c", "unknownword"), ("d", None), ("e", prose(200, 400)), (None, "moon"), ("b", "zebra the THE Ärger")]
    df = documents(rows, "rank").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, score int")
    want = plain_search(rows, items[:-1])
    assert found(lexical.search(df, asked)) == want and len(want) > 70
    monkeypatch.setattr(lexical, "ITEM_BYTES", 500)
    assert found(lexical.search(df, asked)) == want
    assert found(lexical.search(df, asked, best=3)) == plain_search(rows, items[:-1], 3)


def test_search_without_documents_or_items(documents, spark):
    asked = spark.createDataFrame([(1, "moon")], "item_id int, text string")
    assert lexical.search(documents([(1, None)]), asked).count() == 0
    assert lexical.search(documents([]), asked).count() == 0
    empty = lexical.search(documents([(1, "moon")]), asked.limit(0))
    assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0


def test_search_skips_blocks(monkeypatch):
    """A common term in every document, a rare one in one block: the others are not scored."""
    monkeypatch.setattr(lexical, "BLOCK", 8)
    texts = pa.array([("common " * (1 + i % 3)) + ("rare rare rare" if 400 <= i < 404 else "x") for i in range(1000)])
    terms, items = lexical.read_items(pa.array(["common rare"]))
    builder = lexical.Builder(terms, lexical.common.Powers())
    builder.add(pa.array(range(1000), pa.int64()), *lexical.common.texts_buffer(texts))
    batch = builder.finish()
    row = {n: batch.column(c)[0] for c, n in enumerate(batch.schema.names)}
    shard = lexical.Shard(row, np.array([lexical.weight(1000, 1000 if t == np.argmax(np.diff(np.frombuffer(row["first"].as_py(), np.int64))) else 4) for t in range(2)]), 1000, 3000)
    seen, score = [], shard._score
    shard._score = lambda lo, hi, *more: (seen.append((lo, hi)), score(lo, hi, *more))
    ranking = lexical.Ranking(3)
    shard.rank(items[0], ranking)
    assert set(ranking.id.tolist()) <= {400, 401, 402, 403} and seen == [(400, 408)]


# --- personal data ------------------------------------------------------------------
PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 12 <= len(d) <= 19 and plain_luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), k, m.end()))
    return [f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(out)]


ODD = [
    "a@b.c_d@e.f-g.h. x@y", "é me.you+1@mail.example.com, (+1 (171) 555-2028) 4111 1111 1111 1111", "1.2.3.4.5.6.7.8 999.1.1.1 01.02.003.255",
    "4111-1111-1111-1111 4111111111111112 " + "4" * 40, "+1 23 +12345678 +1234567890123456 +4 (((((((", None, "", "@@@ a@ @b.c ...1.2.3.",
    "5 5 5 5 5 5 5 5 5 5 5 5 5-5", "𝒳 a@b.co 𝒳 +49 30 1234567", "a.@b.c.d..e@f.g", "12.34.56.78@9.10", "x" * 5000 + "@y.z",
]


def random_text(seed):
    rng = random.Random(seed)
    return "".join(rng.choice(["1", "4", "25", "0", ".", "-", " ", "+", "(", ")", "@", "a", "Z", "_", "é", "4111111111111111", "\n"]) for _ in range(200))


def test_strict_spans_equal_brute_force(documents):
    rows = list(enumerate(ODD + [random_text(i) for i in range(60)]))
    out = pii.report(pii.find(documents(rows, "spans"), keep=["doc_id"])).collect()
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["doc_id"])] == [i for i, _ in rows]
    texts = dict(rows)
    for r in out:
        want = plain_spans(texts[r["doc_id"]])
        counts = Counter(s.split(":")[0] for s in want)
        assert [r[f"n_{k}"] for k, _ in PATTERNS] == [counts[k] for k, _ in PATTERNS], texts[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_very_long_texts_take_time_in_proportion(documents):
    """Long runs that never become a match, and very many matches in one text."""
    runs = ["a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "+1 " * 100_000, "a@" * 150_000]
    many = " ".join(f"u{i}@mail.example.com 10.0.{i % 256}.1" for i in range(15_000))
    rows = list(enumerate([*runs, many]))
    out = {r["doc_id"]: r for r in pii.report(pii.find(documents(rows), keep=["doc_id"])).collect()}
    assert out[6]["n_email"] == out[6]["n_ip"] == 15_000
    assert out[6]["base_sha256"] == hashlib.sha256(",".join(plain_spans(many)).encode()).hexdigest()
    assert sum(out[i]["n_email"] for i in range(6)) == 0


def test_loose_forms_are_added_by_the_labelers(documents, prose):
    rows = [(i, prose(i, 30) + f" mail u{i}@mail.example.com or call +1 (171) 555-20{i:02d} now 4111 1111 1111 1111 " + prose(i + 500, 20)) for i in range(60)]
    rows += [(100 + i, prose(i, 20) + f" order item 41111111111111{i:02d} version {i}.{i}.{i + 300}.1 " + prose(i, 9)) for i in range(20, 60)]
    added = [
        (201, "please call 555-867-5309 for more", "555-867-5309"), (202, "write a mail to jane.doe (at) example (dot) org today", "jane.doe (at) example (dot) org"),
        (203, "her ssn 219-09-9999 was noted", "219-09-9999"), (204, "serial part item x219-09-9999x", None), (205, "nothing to see", None),
    ]
    rows += [(i, t) for i, t, _ in added]
    spans = {r["doc_id"]: r["spans"] for r in pii.find(documents(rows), keep=["doc_id"]).collect()}
    for i, text, want in added:
        assert [text[s["start"] : s["end"]] for s in spans[i]] == ([want] if want else []), (i, spans[i])
    for i, text in rows[60:100]:  # numbers whose check fails stay out
        assert ["%s:%d:%d" % (pii.KINDS[s["kind"]], s["start"], s["end"]) for s in spans[i]] == plain_spans(text)


def test_reliabilities_of_known_labelers():
    """Votes drawn from labelers of known accuracy: the estimates come near, the pattern with most yes is likeliest."""
    rng = np.random.default_rng(3)
    accuracy = [0.95, 0.9, 0.8, 0.7, 0.6]
    truth = rng.random(20_000) < 0.4
    said = np.where(rng.random((20_000, 5)) < accuracy, truth[:, None], ~truth[:, None])
    patterns = Counter("".join(pii.YES if v else pii.NO for v in row) for row in said)
    q, table = pii.reliabilities(dict(patterns))
    assert np.abs(table[0, :, 0] - accuracy).max() < 0.05 and np.abs(table[1, :, 1] - accuracy).max() < 0.05
    assert q["11111"] > 0.99 and q["00000"] < 0.01
    share = sum(q[k] * n for k, n in patterns.items()) / 20_000
    assert abs(share - truth.mean()) < 0.03


def test_no_python_on_the_path_of_personal_data(documents):
    plan = pii.report(pii.find(documents([(1, "a@b.de")]), keep=["doc_id"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_running_values_of_long_arrays(spark):
    values = [random.Random(n).choices(range(50), k=n) for n in (0, 1, 2, 5, 99, 1000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<bigint>")
    out = pii.with_running(df, [("v", "total", lambda a, b: a + b), ("v", "top", F.greatest)])
    for r in out.select("i", "v", "total", "top").collect():
        v = values[r["i"]]
        assert r["total"] == [sum(v[:k]) for k in range(len(v))] and r["top"] == [max(v[:k], default=0) for k in range(len(v))]
