"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.storage import scratch_path


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as byte planes with a chunk index, and read back."""
    from brindle.llm import bitplane

    path = scratch_path(spark, "ids")
    bitplane.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_file(), end_id=2)
    return bitplane.read_ids(spark, path)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated sampling probability and fate of every document."""
    from brindle.llm import mixing

    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 9).alias("probability"), F.round("weight", 6).alias("weight"), "sampled")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids of every text by the segment tree, and their decoding."""
    from brindle.llm import bpe

    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says control strings, formatted and read back."""
    from brindle.llm import template

    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    # apart, so that a conversation of the table that has this number stays one of its own
    return template.read_back(template.format_conversations(turns)).unionByName(template.read_back(template.format_conversations(own)))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by vector bin packing."""
    from brindle.llm import sharding

    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    from brindle.llm import langid

    return langid.identify(table(spark, sf_dir, "documents"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near vectors of equal label among all embeddings."""
    from brindle.llm import embeddings

    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page by wrapper induction."""
    from brindle.llm import pages

    return pages.extract_pages(table(spark, sf_dir, "pages"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by the chosen-path join."""
    from brindle.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text by consistent weighted sampling."""
    from brindle.llm import fingerprint

    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bitplane, op2_mixing, op3_bpe, op4_chat, op5_embeddings, op6_pages, op7_minhash, op8_fingerprint, op9_sharding, op10_langid)}


def oracle_sql() -> dict[str, str]:
    from brindle.llm import embeddings, mixing

    return {"op2_mixing": mixing.sql(), "op5_embeddings": embeddings.sql()}
