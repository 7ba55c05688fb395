"""The registered queries over given tables, and the pipeline."""

import os

import models
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sylvan.llm import langid, queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables not here")


def test_all_operators_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF_DIR)
    rel = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted(rel.select(*columns).fetchall(), key=repr) and got


def test_language_and_quality_on_held_out_rows(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = queries.op1_language_id(spark, SF_DIR).filter("held_out").join(documents, "doc_id")
    right, n = found.agg(F.count_if(F.expr("lang = lang_pred")), F.count("*")).first()
    assert n > 20 and right >= 0.95 * n
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scored = queries.op8_quality(spark, SF_DIR)
    assert scored.count() == documents.count()
    known = scored.filter("held_out").join(labels, "doc_id")
    assert known.agg(F.count_if(F.expr("predicted = quality")) / F.count("*")).first()[0] >= 0.85


def test_pipeline_stages(spark, prose):
    """Each stage on a small table, by what it must drop and keep."""
    benchmark = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").collect()]
    passage = prose(500, 60)
    rows = [(i, prose(i, 80), "en") for i in range(20)]
    rows += [(30, "12 34", "en"), (31, None, None), (32, rows[3][1], "en"), (33, rows[4][1] + " tail", "en"), (34, "zwölf " + benchmark[0], "en")]
    rows += [(40, prose(41, 40) + "\n" + passage, "en"), (41, prose(42, 40) + " " + passage + " " + prose(43, 40), "en")]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    ids = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF_DIR).cache()
        assert out.columns == docs.columns
        ids.append({r["doc_id"] for r in out.collect()})
    everything = {i for i, *_ in rows}
    assert ids[0] == everything - {30, 31}
    least = {c for *_, c in models.components([(i, t) for i, t, _ in rows if i in ids[0]])}
    assert ids[1] == least == ids[0] - {32, 33}
    assert ids[2] == ids[1] and ids[3] == ids[2] - {34}
    texts = {r["doc_id"]: r for r in out.collect()}
    assert passage in texts[40]["text"] and passage[30:] not in texts[41]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())
    kept = models.passages([(i, t) for i, t, _ in rows if i in ids[1]])
    for (i, *_), words in zip([r for r in rows if r[0] in ids[1]], kept, strict=True):
        assert i == 34 or models.words(texts[i]["text"]) == words
    packed = corpus_pipeline.STAGES[-1][1](spark, out, SF_DIR)
    assert {r["doc_id"] for r in packed.collect()} == ids[3]
    assert langid.UNDETERMINED == "und"


def test_pipeline_on_empty_and_given_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF_DIR)
        assert out.count() == 0
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.count() > 0 and rows.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
