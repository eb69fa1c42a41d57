"""Corpus cleaning in five stages: language ID, line dedup, near-dedup, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslattice.llm import bpe, decontam, forest, langid, lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose n-grams fit no language better than this is rejected, as is one without letters. Measured with profiles
#: of four languages: clean texts score 0.41 or more (0.45 but for one in 10,000); texts in other languages of the same
#: letters 0.25 to 0.31, in other letters, of random letters or of hexadecimal digits under 0.17.
LEAST_SCORE = 0.33


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language. Profiles come from the labels of all of docs."""
    profiles = langid.fit(docs.select("text", "lang"))
    named = langid.predict(docs.select(*COLUMNS), profiles)
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; documents of which nothing is left go."""
    out = lines.line_dedup(docs.select(*COLUMNS), longest=lines.MIN_RUN)
    return out.where((F.col("n_removed") == 0) | (F.length("text") > 0)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of the smallest id.

    Of rows of one id and text, the one of the least other columns stays; rows of one id and other texts all stay or go
    with their id. Rows without an id are documents of their own and stay."""
    kept = forest.near_dedup(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    named = docs.select(*COLUMNS).where("doc_id is not null")
    some = named.join(kept.hint("merge"), named["doc_id"] == kept["_id"], "left_semi")
    one = some.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("x")).select("doc_id", "text", "x.*")
    return one.unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    clean = decontam.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return bpe.encode(docs, digests=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("bpe_encode", encode)]

#: Language profiles, MinHash candidates and BPE are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
