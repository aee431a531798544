"""The corpus pipeline: five stages, each written and read again by the next.

Defined results, of the stages and of :func:`run`: rows with a null or empty text pass the first three
stages and are in no mixture; rows with a null id pass near dedup, have a key and are packed
like others. Rows that repeat an id stay or go together in near dedup and are documents of their own
elsewhere; repeated rows are each judged, mixed and packed. Ties: of near duplicates the smallest id
stays; at a source's cut the order is that of key, id and tokens, and rows that share the id there come
together; equal sizes are packed in the order of ids. A null source is the source ``""``. A very long
text is judged whole, redacted whole, mixed whole, and packed in as many windows as it fills. Extra columns, whatever
their names, pass through all stages but the last, which returns windows. An empty table gives
empty results at every stage. Ids are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom import store
from sparkloom.llm import mixing, packing, quality, secret_scan, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat themselves too much go; null and empty texts stay."""
    return quality.drop_repetitive(store.spread(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id stays; rows without id or words stay."""
    return simhash.drop_near_duplicates(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark and ``n_chars`` follows; every document stays, null texts too."""
    return secret_scan.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget has them; those without tokens are in no mixture."""
    return mixing.mix_documents(docs)


def packing_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in near-equal token windows, a row for each piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing", mixing_sources),
    ("packing", packing_windows),
]

#: Suffix arrays, fingerprints and token ids are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, store.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        store.drop(before)
    return docs
