"""Language ID, toxicity, quality, neighbours, token files, packing."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sylvan.llm import ann, common, langid, packing, pfor, quality, tokens, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
LIBRARY = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}
SYLLABLES = {"aa": "ba ka ta na ma".split(), "bb": "rin sol fex qui".split(), "cc": "ouille eau ché ré".split()}


def speech(lang, seed, n=30):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


# --- language ID -------------------------------------------------------------
def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 9, 20):
        code = langid.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert code.shape[0] == n and min(apart) >= max(1, code.shape[1] // 5), n


def test_languages_and_odd_texts(spark):
    rows = [(i, speech(lang, i), lang) for lang in SYLLABLES for i in range(40)]
    rows += [(900, speech("aa", 1), None), (901, None, "aa"), (902, "", "bb"), (903, "12 34 !", "cc")]
    model = langid.fit(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert model["languages"] == ["aa", "bb", "cc"]
    tests = [(i, speech(lang, 1000 + i, n), lang) for lang in SYLLABLES for i, n in enumerate((1, 3, 30, 20_000))]
    tests += [(50, None, langid.UNDETERMINED), (51, "", langid.UNDETERMINED), (52, "\n12 % _", langid.UNDETERMINED)]
    df = spark.createDataFrame(tests, "id long, text string, score string")
    out = langid.predict(df, model)
    assert out.columns == ["id", "text", "lang_pred", "score", "second", "ambiguous"]
    got = {r["text"]: r for r in out.collect()}
    for _, text, lang in tests:
        r = got[text]
        assert r["lang_pred"] == lang and 0 <= r["score"] <= 1
        if lang == langid.UNDETERMINED:
            assert r["score"] == 0 and r["second"] is None
    half = speech("aa", 5, 100) + " " + speech("bb", 5, 100)
    mixed = langid.predict(spark.createDataFrame([(half,)], "text string"), model).first()
    assert mixed["score"] < got[tests[2][1]]["score"]


def test_few_or_no_labels(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert langid.fit(empty) is None
    rows = spark.createDataFrame([("abc", "zz"), ("1", "zz"), (None, "zz")], "text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(rows, None).collect()} == {langid.UNDETERMINED}
    assert sorted(r["lang_pred"] for r in langid.predict(rows, langid.fit(rows)).collect()) == ["und", "und", "zz"]
    assert langid.predict(empty, langid.fit(rows)).count() == 0


# --- toxicity ----------------------------------------------------------------
def test_chain_marks_a_language_of_few_marked_rows(spark):
    """One loud word in a frequent language; in a rare one some of many forms, in longer and shorter texts."""
    forms = [f"achlich{a}{b}" for a in ("e", "er", "keit", "ung", "st") for b in ("", "n", "s", "t", "ein")]

    def row(lang, seed, toxic):
        rng = random.Random(f"{lang}{seed}{toxic}")
        words = [f"{lang}{rng.choice('abcdefgh')}{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.choice((80, 300, 900)))]
        words += [] if not toxic else ["scumword"] * 3 if lang == "aa" else rng.sample(forms, max(3, len(words) // 60))
        rng.shuffle(words)
        return " ".join(words)

    rows = [(row(lang, i, t), t) for lang, n in (("aa", 700), ("bb", 200)) for i in range(n) for t in [int(i % 9 == 0)]]
    chain = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"), ["toxic"])
    fresh = [(lang, t, row(lang, 5000 + i, t)) for lang in ("aa", "bb") for t in (0, 1) for i in range(60)]
    out = toxicity.predict(spark.createDataFrame(fresh, "lang string, own int, text string"), chain, keep=["lang", "own"])
    marked = {(r["lang"], r["own"]): r["n"] for r in out.groupBy("lang", "own").agg(F.sum(F.col("toxic").cast("int")).alias("n")).collect()}
    assert marked["aa", 1] >= 57 and marked["bb", 1] >= 54, marked
    assert marked["aa", 0] + marked["bb", 0] <= 2, marked


def test_chain_marks_planted_words(spark, prose):
    rng = random.Random(6)
    rows = []
    for i in range(500):
        toxic, rough = rng.random() < 0.2, rng.random() < 0.3
        words = prose(i, 60).split() + ["scumword"] * (2 * toxic) + ["grr"] * (rough or toxic)
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(rough or toxic), int(toxic)))
    rows += [(600, None, 0, 0), (601, "", None, 0), (602, prose(3, 9), None, None)]
    df = spark.createDataFrame(rows, "id long, text string, rough int, toxic int")
    chain = toxicity.fit(df, ["rough", "toxic"])
    fresh = [(1, prose(7001, 80) + " scumword grr", True), (2, prose(7002, 80), False), (3, None, False), (4, "", False), (5, prose(7003, 50_000), False)]
    out = toxicity.predict(spark.createDataFrame(fresh, "id long, text string, toxic boolean"), chain)
    assert out.columns == ["id", "text", "p_rough", "rough", "p_toxic", "toxic"]
    got = {r["id"]: r for r in out.collect()}
    assert {i: got[i]["toxic"] for i, *_ in fresh} == {i: t for i, _, t in fresh}
    assert toxicity.predict(out.limit(0), chain, keep=["id"]).count() == 0


def test_chain_without_labels(spark):
    chain = toxicity.fit(spark.createDataFrame([], "text string, a int, b int"), ["a", "b"])
    one = spark.createDataFrame([("x", 1, None), ("y", 1, None)], "text string, a int, b int")
    for c in (chain, toxicity.fit(one, ["a", "b"])):
        assert {(r["p_a"], r["a"], r["b"]) for r in toxicity.predict(one, c).collect()} == {(0.0, False, False)}


def test_later_models_use_earlier_predictions(spark):
    """The second category is the first one; its words alone say nothing of it."""
    rng = random.Random(1)
    rows = [(f"{'sig ' if a else ''}w{rng.randrange(50)} w{rng.randrange(50)}", a, a) for a in (rng.randint(0, 1) for _ in range(400))]
    chain = toxicity.fit(spark.createDataFrame(rows, "text string, a int, b int"), ["a", "b"])
    first, second = chain["steps"][0][1], chain["steps"][1][1]
    own = 1 + len(toxicity.LEVELS)
    assert len(first.weights) == own and len(second.weights) == own + 1
    assert second.weights[own] > 0
    word, row = np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = (second.score(word, row, np.array([[p]]))[0] for p in (0.05, 0.95))
    assert high > 5 * low  # equal if earlier probabilities were not used


# --- quality -----------------------------------------------------------------
def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(1)
    x, y, w = rng.random(40), rng.random(40), rng.integers(1, 5, 40).astype(float)
    fit = quality.isotonic(x, y, w)
    ordered = fit[np.argsort(x)]
    assert (np.diff(ordered) >= -1e-12).all()
    # min-max formula of isotonic regression
    o = np.argsort(x)
    yo, wo = y[o], w[o]
    mean = lambda a, b: (yo[a : b + 1] * wo[a : b + 1]).sum() / wo[a : b + 1].sum()
    best = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(ordered, best)


def test_quality_of_odd_texts_and_of_junk(spark, prose):
    rng = random.Random(2)
    good = [(i, prose(i, rng.randint(20, 90)), 1) for i in range(200)]
    junk = [(300 + i, rng.choice([prose(i, 30).upper() + "!!", "buy " * 50, " | ".join(prose(i, 30).split())]), 0) for i in range(100)]
    rows = [*good, *junk, (500, None, 0), (501, "", 0), (502, "x" * 300_000, None)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    stats = quality.with_statistics(df, "id", "text")
    assert stats.count() == len(rows) and all(np.isfinite(r["stats"]).all() for r in stats.collect())
    joined = stats.join(df.withColumnRenamed("id", "doc_id").select("doc_id", "label"), "doc_id").filter("label is not null")
    out = {r["doc_id"]: r for r in quality.score(stats, quality.fit(joined)).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    right = sum(out[i]["predicted"] == y for i, _, y in [*good, *junk])
    assert right >= 0.97 * 300
    assert quality.fit(joined.limit(0)) is None
    assert {r["score"] for r in quality.score(stats, None).collect()} == {0.5}
    assert quality.score(stats.limit(0), quality.fit(joined)).count() == 0


# --- neighbours --------------------------------------------------------------
def exact(rows, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        best = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in best]
    return out


def searched(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.search(df, lambda c: c % 100 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    return got


def test_exact_search_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(0, 2, 6).astype(float).tolist()) for i in range(1, 400)]
    rows = [(i, v if any(v) else [1.0] * 6) for i, v in rows] + [(400, [1.0] * 6)]
    bad = [(500, None), (600, [0.0] * 6), (700, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (800, [float("nan")] * 6), (900, [float("inf")] * 6), (1000, [1.0])]
    got = searched(spark, rows + bad, exact=True)
    assert {q: [x[:2] for x in r] for q, r in got.items()} == exact(rows)
    assert all([x[2] for x in r] == list(range(1, 11)) for r in got.values())
    few = searched(spark, rows[98:103])
    assert {q: [x[:2] for x in r] for q, r in few.items()} == exact(rows[98:103])
    assert searched(spark, []) == {} and searched(spark, [(1, [1.0])]) == {} and searched(spark, [(100, [1.0])]) == {}


@pytest.mark.parametrize("n", [100, 500, 2000])
def test_small_tables_go_through_the_parts(spark, n, monkeypatch):
    made = []
    fit = ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a: made.append(fit(*a)) or made[-1])
    rng = np.random.default_rng(n)
    centres = 3 * rng.normal(size=(8, 16))
    x = (centres[rng.integers(0, 8, n)] + 0.5 * rng.normal(size=(n, 16))).astype(np.float32)
    rows = list(enumerate(x.tolist()))
    got, want = searched(spark, rows), exact(rows)
    assert len(made) == 1 and 2 <= made[0]["parts"] <= 8
    assert n < 500 or made[0]["probes"] <= made[0]["parts"] // 2
    assert all(len(r) == 10 for r in got.values()) and got.keys() == want.keys()
    assert sum(len({i for i, *_ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 9 * len(want)


def test_repeated_rows_count_once(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(50, 350)]
    plain = searched(spark, rows, exact=True)
    twice = rows + [r for r in rows if r[0] % 100 == 0 or r[0] % 3 == 0] * 3
    assert searched(spark, twice, exact=True) == plain
    routed = searched(spark, twice)
    assert all(len({i for i, *_ in r}) == 10 == len(r) for r in routed.values())
    # other vectors of an id: the smallest distance of the two ids counts
    far = [(i, [100.0 + i] * 8) for i, _ in rows if i % 100]
    assert searched(spark, rows + far, exact=True) == plain


def test_recall_of_learned_partitions(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 6000)] + 0.4 * rng.normal(size=(6000, 16))).astype(np.float32)
    x[2000:3500] = x[77]  # a vector of which there are many copies
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got, want = searched(spark, rows), exact(rows)
    assert got.keys() == want.keys()
    hit = sum(len({i for i, *_ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 10 * len(want)
    assert all(abs(s - dict(want[q]).get(i, s)) == 0 for q in want for i, s, _ in got[q])


def test_graph_parts_are_balanced_and_few_edges_are_cut():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8, 12))[rng.integers(0, 8, 1024)] * 3 + rng.normal(size=(1024, 12)) * 0.5
    near = ann.neighbours(x, 10)
    label = ann.bisect(near, 8)
    assert np.bincount(label).max() - np.bincount(label).min() <= 3
    assert (label[:, None] == label[near]).mean() > 0.6


# --- token ids ---------------------------------------------------------------
ODD = [
    "", "\n", "\n\n", "a\n", "a\n\nb", "a\n\n\nb", " a", "a  b", "a \n b", "a\tb", "x<|endoftext|>y", "don't, we'll. 'S it's!!",
    "ΣΑΣ ΟΔΟΣ", "İstanbul É éa", "a b", "\x1cb a", "a \x02 b", "Straße! ÑANDÚ.", "..", "1. 2.", "日本語 テキスト。", "👍🏽 ok.", "A. B, c; D:",
]


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_ids_equal_the_library(kind, prose):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path(LIBRARY[kind])
    library, own = Tokenizer.from_file(path), tokens.KINDS[kind](path)
    texts = [*ODD, *(prose(i, 50).replace(". ", ".\n", 2) for i in range(20)), prose(1, 200_000), None]
    rng = random.Random(9)
    texts += ["".join(rng.choices("ab AB.,'\n\t é́ß1　", k=rng.randint(1, 12))) for _ in range(600)]
    got = [x.tolist() for x in own.encode(pa.array(texts, pa.string()))]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.sampled_from([1, 7, 128, 512]), st.floats(0.1, 1.0))
def test_blocks_round_trip(values, size, percentile):
    ids = np.array(values, np.uint32)
    blocks = pfor.encode_blocks(ids, size, percentile)
    assert len(blocks) == -(-len(ids) // size)
    assert np.array_equal(pfor.decode_blocks([memoryview(b) for b in blocks]), ids)


def test_outliers_do_not_widen_a_block():
    ids = np.full(512, 1000, np.uint32) + np.arange(512, dtype=np.uint32) % 8
    ids[::100] = 2**31
    assert len(pfor.encode_blocks(ids)[0]) < 512 * 4 / 8 + 100


def test_files_and_single_runs():
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (1, 700, 3000, 1)]
    reader = pfor.Reader(pfor.write_file([5, None, 7, 7], ids) + b"\n")
    flat = np.concatenate(ids)
    assert reader.doc_ids == [5, None, 7, 7] and all(np.array_equal(a, b) for a, b in zip(reader.documents(), ids, strict=True))
    for a, b in ((0, 1), (511, 513), (0, len(flat)), (1024, 1024), (3000, 3702)):
        assert np.array_equal(reader.run(a, b), flat[a:b])
    with pytest.raises(ValueError):
        pfor.Reader(b"x" * 100)


def encoded(rows, kind):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(LIBRARY[kind]))
    return [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in rows]


ROWS = [(9, "b c"), (3, None), (4, ""), (None, "no id"), (7, "x y z " * 30_000), (5, "same"), (5, "same"), (-2, "first. " * 50)]


def test_token_files_of_a_table(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in ROWS], "doc_id long, text string, start int")
    path = common.new_path(spark, "test-tokens")
    pfor.write(df.repartition(3), path, public_tokenizers.path(LIBRARY["byte"]), file_ids=1000)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for (i, _), ids in zip(order, encoded(order, "byte"), strict=True):
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    got = sorted(map(tuple, pfor.read(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    empty = common.new_path(spark, "test-empty")
    pfor.write(df.limit(0), empty, public_tokenizers.path(LIBRARY["byte"]))
    assert pfor.read(spark, empty, ids=False).count() == 0


# --- packing -----------------------------------------------------------------
@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=300))
def test_places_are_gapless(lengths):
    n = np.array(lengths, np.int64)
    sequence, offset = packing.place(n, 50)
    for s in set(sequence.tolist()):
        own = sorted((o, n[i]) for i, o in enumerate(offset.tolist()) if sequence[i] == s)
        ends = np.cumsum([x for _, x in own])
        assert [o for o, _ in own] == [0, *ends[:-1]] and ends[-1] <= 50


def test_few_sequences():
    n = np.random.default_rng(4).integers(1, 2048, 20_000)
    sequence, _ = packing.place(n)
    assert sequence.max() + 1 <= 1.025 * n.sum() / 2048 + 1


def test_packed_table_and_sequences(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in ROWS], "doc_id long, text string, piece int")
    pieces = packing.pieces(df, public_tokenizers.path(LIBRARY["word"]), ids=True)
    placed = packing.pack(pieces)
    want = []
    for (i, _), ids in zip(ROWS, encoded(ROWS, "word"), strict=True):
        want += [(i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    rows = placed.collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces, placed).collect()}
    assert sum(len(r["ids"]) for r in whole.values()) == sum(w[3] for w in want)
    for r in rows:
        ids = np.array(whole[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]], "<u4")
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]
    assert packing.pack(pieces.limit(0)).count() == 0
    assert placed.select(F.countDistinct("sequence_id")).first()[0] <= -(-sum(w[3] for w in want) // 2048) + 1
