"""One registered query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import store
from sparkloom.llm import bitpack, chat, langid, mixing, packing, quality, search, secret_scan, sharding, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return store.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose internal repetition stays within the limits, with their figures."""
    return quality.repetition_filter(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in near-equal token windows."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a near duplicate of smaller id, and the one that stands for them."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, whole, in contiguous shards whose largest has as few bytes as can be."""
    return sharding.shard(_table(spark, sf_dir, "conversations"), "conv_id", F.octet_length("text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a mixture in which large sources weigh less than their share."""
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one text that parses back into its turns."""
    return chat.chat_texts(_table(spark, sf_dir, "conversations"))


def op7_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in the fewest bits."""
    return bitpack.packed_ids(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every random string that looks like a key."""
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark passage, by BM25, exactly."""
    return search.top_k(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, and whether it is sure enough."""
    return langid.languages(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_repetition, op2_packing, op3_simhash, op4_sharding, op5_mixing, op6_chat, op7_bitpack, op8_secrets, op9_top_k, op10_language)
}

ORACLE_SQL: dict[str, str] = {"op4_sharding": sharding.ORACLE_SQL, "op6_chat": chat.ORACLE_SQL, "op9_top_k": search.ORACLE_SQL}
