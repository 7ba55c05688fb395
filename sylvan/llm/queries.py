"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, common, decontaminate, langid, lexical, licenses, line_dedup, ngram_join, packing, pfor, pii, quality, spelling, toxicity
from .oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(modulus: int):
    """crc32 of the id as text, modulo a number."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(documents.filter(remainder(5) != 0))
    out = langid.predict(documents.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score", "second", "ambiguous")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without passages that an earlier one has, and what went."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.deduplicate(documents)
    bytes_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["last_byte"] - x["first_byte"])
    return out.select(
        "doc_id",
        "text",
        "removed",
        F.size("removed").alias("n_removed"),
        bytes_removed.alias("bytes_removed"),
        (F.size("removed") > 0).alias("repeats"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low quality and toxicity of every document, a chain of two categories."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit(documents.select("doc_id", "text").join(labels, "doc_id"), ["low_quality", "toxic"])
    return toxicity.predict(documents, chain, keep=["doc_id"]).withColumn("score", F.col("p_toxic"))


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector, among all."""
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.mark(documents, table(spark, sf_dir, "benchmark")))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word sets overlap by three quarters."""
    return ngram_join.join_classes(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from two thirds of the labelled ones."""
    rows = quality.with_statistics(table(spark, sf_dir, "documents"), "doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter("quality is not null")
    labels = labels.groupBy("doc_id").agg(F.avg("quality").alias("label"))
    labelled = rows.join(labels, "doc_id").filter(remainder(3) != 1)
    out = quality.score(rows, quality.fit(labelled))
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as block files and read back."""
    path = common.new_path(spark, "token-blocks")
    pfor.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return pfor.read(spark, path, ids=False)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, cut into pieces and packed into sequences of 2048 ids."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.report(pii.find(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents that score highest for each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_learned_partitions": op4_learned_partitions,
    "op5_licenses": op5_licenses,
    "op6_decontaminate": op6_decontaminate,
    "op7_ngram_join": op7_ngram_join,
    "op8_quality": op8_quality,
    "op9_token_blocks": op9_token_blocks,
    "op10_packing": op10_packing,
    "op11_spelling": op11_spelling,
    "op12_pii": op12_pii,
    "op13_lexical_search": op13_lexical_search,
}
