"""The corpus pipeline: language, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a
DataFrame; all but the last return the columns of documents.  Nulls, blank texts,
repeated rows and empty tables are as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, langid, minhash, mixing
from brindle.llm.queries import tokenizer_file
from brindle.storage import shipped, stored

#: Share of the predicted language from which a document stays.
SURE = 0.3
#: Tokens of the mixture over tokens that come to it.
BUDGET = 0.6


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is unsure; a null lang becomes the predicted one."""
    columns = docs.columns
    model = langid.fit(docs.filter(~langid.held_out()).select("text", "lang", F.col("doc_id").alias("key")))
    judged = langid.predict(docs, model, columns)
    kept = judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one of the least doc_id."""
    return minhash.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics have their target weights."""
    return mixing.mix(docs, budget=BUDGET).filter("sampled").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids' digest and count of each document."""
    return bpe.encode_documents(docs, tokenizer_file())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]
#: Language scores, chosen paths and BPE are not expressible in SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents, each on what the one before it wrote."""
    shipped(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
