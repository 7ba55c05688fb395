"""A training corpus from raw documents, in five stages.

1. ``language_id`` drops documents whose language cannot be told.
2. ``near_duplicates`` keeps one document (the smallest id) of each group that
   5-word sets with a similarity of 0.75 or more link.
3. ``line_dedup`` cuts passages that an earlier document has.
4. ``decontaminate`` drops documents that hold ten consecutive words of a
   benchmark item.
5. ``packing`` cuts and packs what is left into sequences of 2048 token ids.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of
``documents``; the last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm import common, decontaminate, langid, line_dedup, ngram_join, packing, queries

#: A language with a smaller share than this is no better than a guess.
MIN_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.filter(queries.remainder(5) != 0))
    mine = docs.toDF(*(f"own_{c}" for c in docs.columns))
    found = langid.predict(mine, model, text="own_text")
    known = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE)
    return found.filter(known).select(*(F.col(f"own_{c}").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.clean(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, queries.vocabulary("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("line_dedup", dedup_lines),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: Tokenizer, learned language model and components are not SQL's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
