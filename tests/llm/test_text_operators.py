"""Decontamination, licenses, near duplicates, passages: against brute force."""

import hashlib
import random
import time
from types import SimpleNamespace

import models
import numpy as np
import pyarrow as pa
import pytest

from sylvan.llm import common, decontaminate, licenses, line_dedup, ngram_join

LONG = 60_000


def hit_words(spans):
    return {w for i in range(0, len(spans), 4) for w in range(spans[i], spans[i + 1])}


# --- decontamination ---------------------------------------------------------
@pytest.fixture
def leaks(spark, prose, documents):
    items = [(i, prose(100 + i, 30)) for i in range(6)] + [(7, "Only four words here"), (8, None), (None, prose(1, 20)), (9, ""), (0, "second text of item zero with words")]
    w = items[2][1].split()
    texts = [
        prose(1, 50), f"{prose(2, 30)}\n{items[0][1]}\n{prose(3, 30)}", " ".join(w[3:13]), " ".join(w[3:12]),
        "x ONLY, four\twords...here y", None, "", "é ü " + items[1][1].upper() + " ß", items[3][1] + " " + items[4][1],
        prose(5, LONG) + " " + items[5][1], "second text of item zero with words", "...", items[2][1],
    ]
    rows = list(enumerate(texts)) + [(12, items[2][1]), (None, items[2][1])]
    return rows, items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [decontaminate.MAX_WINDOWS, 25])
def test_marks_equal_brute_force(leaks, documents, limit):
    rows, items, benchmark = leaks
    got = decontaminate.mark(documents(rows, "items"), benchmark, max_windows=limit).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "n_words", "spans", "items"}
    expected = models.decontaminated([t for _, t in rows], items)
    key = lambda x: tuple(str(v) for v in x)
    found = sorted(((r["doc_id"], r["n_words"], hit_words(r["spans"]), set(r["items"])) for r in got), key=key)
    assert found == sorted(((i, *e) for (i, _), e in zip(rows, expected, strict=True)), key=key)


def test_report_and_removal(leaks, documents):
    rows, items, benchmark = leaks
    df = documents(rows, "spans")
    report = {r["doc_id"]: r for r in decontaminate.report(decontaminate.mark(df, benchmark)).collect()}
    for (i, _), (n, hit, of) in zip(rows, models.decontaminated([t for _, t in rows], items), strict=True):
        ids = ",".join(sorted(map(str, of)))
        r = report[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, len(hit), len(of), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
    clean = decontaminate.remove_documents(df, benchmark)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, r in report.items() if not r["contaminated"]}
    cut = decontaminate.remove_spans(df, benchmark)
    assert cut.columns == df.columns and cut.count() == len(rows)
    again = decontaminate.report(decontaminate.mark(cut, benchmark)).collect()
    assert sum(r["n_words"] for r in again) == sum(r["n_words"] - r["n_hit"] for r in decontaminate.report(decontaminate.mark(df, benchmark)).collect())


def test_empty_tables(leaks, documents, spark):
    rows, _, benchmark = leaks
    assert decontaminate.mark(documents([]), benchmark).count() == 0
    none = decontaminate.mark(documents(rows), benchmark.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["items"] for r in none)


# --- licenses ----------------------------------------------------------------
def test_base_phrases_equal_brute_force(documents, prose):
    rng = random.Random(4)
    parts = ["under the MIT license", "Apache License, Version 2", "CC-BY-NC", "under the mit licence", "cc by nc cc by nc", "mit license", ".", "é", "\n"]
    rows = [(i, " ".join(rng.choice([prose(i + k, 3), rng.choice(parts)]) for k in range(6))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, prose(9, LONG) + " cc by nc"), (62, "cc by nc"), (None, "Under THE mit-license")]
    got = licenses.scan(documents(rows, "labels")).collect()
    assert "labels" in got[0].asDict() and len(got) == len(rows)
    by_text = {r["text"]: r for r in got}
    for _, text in rows:
        w, places, labels = models.words(text), [], set()
        for label, phrase in licenses.BASE:
            p = phrase.split()
            at = [a for a in range(len(w) - len(p) + 1) if w[a : a + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = by_text[text]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1


def test_notices_with_edits(documents):
    texts = {
        "Relased undre the MIT licence.": "mit", "Permision is hereby granted, free of charg": "mit", "gnu genral public license verson 3": "gpl-3",
        "apache licence version 1": "", "All right reserved": "proprietary", "under the bsd license": "", "licensed under cc by nd": "",
    }
    got = {r["text"]: r for r in licenses.scan(documents(list(enumerate(texts)))).collect()}
    assert {t: r["labels"] for t, r in got.items()} == texts
    for t, r in got.items():
        for s in r["spans"]:
            piece = t.encode()[s["first_byte"] : s["last_byte"]].decode()
            assert models.words(piece) == models.words(t)[s["first_word"] : s["last_word"] + 1] and s["edits"] > 0


# --- n-gram join -------------------------------------------------------------
def near_copies(prose):
    rng = random.Random(8)
    rows = [(i, prose(i, rng.randint(1, 80))) for i in range(30)]
    for k in range(60):
        w = rng.choice(rows[:8])[1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(40)}"
        rows.append((100 - k, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one two"), (204, "One  TWO"), (205, "one\x00two"), (206, "one two three four five")]
    rows += [(300, prose(77, LONG)), (301, prose(77, LONG) + " end"), (0, rows[0][1]), (0, "another text with the same id as the first")]
    return rows


def test_components_equal_brute_force(spark, prose):
    rows = near_copies(prose)
    expected = sorted(models.components(rows))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    for parts in (1, 7):
        got = ngram_join.join_classes(df.repartition(parts)).collect()
        assert sorted(map(tuple, got)) == expected
    assert ngram_join.join_classes(df.limit(0)).count() == 0


def test_a_large_group_and_hot_members(spark, prose):
    """Copies and near copies of one text, many with a common passage: frequent members are indexed in pairs."""
    rng, base, common = random.Random(3), prose(5, 120).split(), prose(6, 60)
    rows = [(i, " ".join(base)) for i in range(150)]
    for i in range(150, 330):
        w = base.copy()
        for _ in range(rng.randint(1, 7)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    rows += [(i, f"{prose(i, rng.randint(0, 40))} {common} {prose(i + 1, rng.randint(0, 10))}") for i in range(330, 480)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.join_classes(df).collect())) == sorted(models.components(rows))


def test_linked_sets_share_an_entry():
    """The index as such, on random sets with skewed frequencies."""
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(120):
        base = rng.choice(400, rng.integers(1, 60), replace=False) if not sets or rng.random() < 0.3 else sets[rng.integers(len(sets))]
        keep = base[rng.random(len(base)) < 0.93]
        sets.append(np.unique(np.concatenate([keep, rng.choice(100_000, rng.integers(0, 4))])))
    sets = [s for s in sets if len(s)]
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    often = dict(zip(values.tolist(), counts.tolist(), strict=True))
    entries = []
    for rare in (2, 4, 100):
        entries = []
        for s in sets:
            shared = sorted((x for x in s.tolist() if often[x] > 1), key=lambda x: (int(often[x]).bit_length(), x))
            n_rare = sum(1 for x in shared if often[x] < rare)
            # classes are powers of two, as in the operator
            n_rare = sum(1 for x in shared if int(often[x]).bit_length() <= int(rare).bit_length() - 1)
            got, place = ngram_join.signatures(len(s), len(s) - len(shared), n_rare, np.array(shared, np.uint64), 75)
            entries.append(dict(zip(got.tolist(), place.tolist(), strict=True)))
        for i, x in enumerate(sets):
            for j in range(i):
                y = sets[j]
                k = len(np.intersect1d(x, y))
                if 100 * k >= 75 * (len(x) + len(y) - k) and not np.array_equal(x, y):
                    both = entries[i].keys() & entries[j].keys()
                    assert any(175 * min(len(x) - entries[i][e], len(y) - entries[j][e]) >= 75 * (len(x) + len(y)) for e in both)


def test_keep_first(spark, prose):
    rows = near_copies(prose)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string")
    kept = ngram_join.keep_first(df)
    assert kept.columns == df.columns
    got = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert kept.count() == len(got)
    least = models.components(rows)
    assert {i for i, _ in got} == {c for *_, c in least}
    assert (0, rows[0][1]) in got and (0, rows[-1][1]) in got


# --- passages ----------------------------------------------------------------
def test_passages_equal_brute_force(documents, prose):
    rng = random.Random(12)
    common = [prose(900 + i, 60) for i in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(i * 10 + k, rng.randint(1, 40)) for k in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(4), rng.choice(common))
        rows.append((i, rng.choice([" ", "\n", " end \n\n"]).join(parts)))
    rows += [(60, rows[3][1]), (61, None), (62, ""), (63, "Ha ha. " * 60), (64, common[0]), (65, prose(1, LONG) + " " + common[1]), (66, "日本語" * 60), (67, "日本語" * 60)]
    df = documents(rows, "removed")
    out = line_dedup.deduplicate(df)
    assert out.columns == ["doc_id", "text", "removed"]
    got = {r["doc_id"]: r for r in out.repartition(5).collect()}
    kept = models.passages(rows)
    for (i, text), expected in zip(rows[:66], kept, strict=False):
        assert models.words(got[i]["text"]) == expected, i
        raw = (text or "").encode()
        spans = [(s["first_byte"], s["last_byte"]) for s in got[i]["removed"]]
        left = b" ".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(b for b, _ in spans), len(raw)], strict=True))
        assert models.words(left.decode()) == expected
    assert got[66]["text"] and got[67]["text"] == "" and got[61]["text"] is None
    assert got[60]["text"] == "" and got[64]["text"] in ("", common[0])
    cleaned = line_dedup.clean(df)
    assert cleaned.columns == df.columns and {61, 62} <= {r["doc_id"] for r in cleaned.collect()}
    assert 60 not in {r["doc_id"] for r in cleaned.collect()}
    assert line_dedup.deduplicate(df.limit(0)).count() == 0


def test_equal_rows_keep_what_the_document_keeps(documents, prose):
    text = prose(1, 50)
    rows = [(1, text), (1, text), (2, text), (None, text)]
    got = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.deduplicate(documents(rows)).collect())
    assert got == [("1", ""), ("1", ""), ("2", ""), ("None", text)]


def test_every_unit_goes_with_one_word_windows(documents):
    rows = [(1, "Alpha beta.\nGamma."), (2, "Gamma.\nAlpha beta.\nDelta."), (3, "delta")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(documents(rows), min_words=1).collect()}
    assert got == {1: rows[0][1], 2: "Delta.", 3: ""}


def test_short_lines_and_paragraphs_go_as_wholes(documents, prose):
    line = "The sun and moon, over stone. River under light."
    rows = [(i, f"{prose(300 + i, 30)}\n{line}\n{prose(400 + i, 30)}") for i in range(40)]
    rows += [(50, prose(350, 30) + " " + line + " " + prose(351, 30))]  # amid a line it is too short
    rows += [(60, "Les.\r\nOne more line of doc sixty"), (61, "sixty one starts\nles!\nles"), (62, "LES")]
    rows += [(70, "blue tree wind\nroad field house\n\nseventy ends so"), (71, "seventyone\n\nblue tree\nwind road field house")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(documents(rows), min_line=1).repartition(3).collect()}
    assert got[0] == rows[0][1] and got[50] == rows[40][1] and got[60] == rows[41][1] and got[70] == rows[44][1]
    assert all(got[i] == rows[i][1].replace(line + "\n", "") for i in range(1, 40))
    assert got[61] == "sixty one starts\n" and got[62] == "" and got[71].rstrip() == "seventyone"


def test_lines_from_ten_words_on_go_with_their_marks(documents, prose):
    line = "The sun and moon, over stone. River under light and wind"
    code = "def f(x):\n    return 1\n\n## Example\n\nYes.\n"
    rows = [(1, f"## {line} ##\n{prose(1, 30)}"), (2, f"{prose(2, 30)}\n- {line}!\n{prose(3, 30)}")]
    rows += [(3, f"* {line} ..."), (4, f"{prose(4, 30)}\n> {line}"), (5, code), (6, code.replace("f(x)", "g(y)"))]
    rows += [(7, f"{line}\r\n{prose(5, 30)}"), (8, f"{prose(6, 30)} {line} {prose(7, 30)}")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(documents(rows)).collect()}
    assert got[1] == rows[0][1] and got[5] == code and got[6] == rows[5][1] and got[8] == rows[7][1]
    assert got[2] == f"{prose(2, 30)}\n{prose(3, 30)}" and got[3] == "" and got[4] == f"{prose(4, 30)}\n"
    assert got[7] == f"\r\n{prose(5, 30)}"


def test_lines_and_paragraphs_as_the_model_has_them(documents, prose):
    rng = random.Random(9)
    lines = [prose(900 + i, rng.randint(1, 24)) for i in range(14)]
    rows = [(i, "".join(rng.choice(lines) + rng.choice(["\n", "\n", "\n\n"]) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    for least in (1, 3, 10):
        got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(documents(rows), min_line=least).collect()}
        kept = models.passages(rows, min_line=least)
        assert all(models.words(got[i]) == expected for (i, _), expected in zip(rows, kept, strict=True)), least


def test_many_ranges_and_buckets_give_the_same(documents, prose, monkeypatch):
    shared = [prose(700 + i, 40) for i in range(5)]
    rows = [(i, f"{prose(750 + i, 30)}\n{shared[i % 5]}\n{shared[i % 3]}") for i in range(30)]
    monkeypatch.setattr(line_dedup, "RANGE_DIGESTS", 30)
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(documents(rows)).collect()}
    kept = models.passages(rows)
    assert all(models.words(got[i]) == expected for (i, _), expected in zip(rows, kept, strict=True))


def test_digests_that_differ_in_high_bits_only_are_no_repeats(documents, prose, monkeypatch):
    """All digests are equal in their low 40 and first 8 bits, and in one range."""
    rows = [(i, prose(600 + i, 24)) for i in range(12)]
    made = line_dedup.Windows.__init__

    def alike(self, *args):
        made(self, *args)
        self.digest = ((self.digest & np.uint64(0xFFFF)) << np.uint64(40)) | np.uint64(7)

    monkeypatch.setattr(line_dedup.Windows, "__init__", alike)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    table, powers = common.folding(common.LETTERS_DIGITS), common.Powers()
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "text": [t for _, t in rows], "hash": [i for i, _ in rows]})
    digests = [line_dedup.Windows(*common.texts_buffer(pa.array([t])), table, powers, 20).digest for _, t in rows]
    assert len(set(np.concatenate(digests))) == sum(len(set(d)) for d in digests)
    sent = pa.Table.from_batches(list(line_dedup._send(iter([batch]), 1, 20)))
    assert line_dedup._repeats(sent).num_rows == 0


def test_matches_that_do_not_overlap_are_found_in_one_sweep():
    def plain(spans):
        kept = []
        for x in sorted(spans, key=lambda s: (s[5], s[1], -s[2])):
            if all(x[0] != y[0] or x[2] < y[1] or x[1] > y[2] for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda s: (s[1], s[0]))

    rng = random.Random(3)
    for _ in range(50):
        spans = []
        for _ in range(rng.randint(0, 60)):
            a = rng.randint(0, 80)
            spans.append((rng.choice("ab"), a, a + rng.randint(0, 9), 0, 0, rng.randint(0, 3)))
        assert licenses._disjoint(spans) == plain(spans)
    many = [("a", i * 3, i * 3 + 4, 0, 0, i % 3) for i in range(100_000)]
    began = time.monotonic()
    assert licenses._disjoint(many) and time.monotonic() - began < 20
