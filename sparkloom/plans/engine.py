"""The whole engine from settings: pages to chunks, vectors and indexes in a folder, and searches in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import embedders, hybrid, lexical, pages, vectors
from sparkloom.sources import records, sinks
from sparkloom.sources.config import Config

Vectors = vectors.ExactIndex | vectors.CellIndex


class Engine:
    """Chunks with a vector and a lexical index, and articles with vectors if there are any, below one folder."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, embedder: vectors.Embedder | None = None):
        self.spark, self.path, self.config = spark, path, config or Config()
        own = self.config.embedding
        self.embedder = embedders.checked(embedder or embedders.named(own.model, own.dim), own.dim)
        self.chunks = spark.read.parquet(f"{path}/chunks")
        self.lexical = lexical.LexicalIndex(spark, f"{path}/lexical")
        self.vectors: Vectors = (
            vectors.ExactIndex.load(spark, f"{path}/index", own.dim) if self.config.index.backend == "bruteforce" else vectors.CellIndex.load(spark, f"{path}/index")
        )

    @classmethod
    def build(cls, spark: SparkSession, pages_: DataFrame, path: str, config: Config | None = None, embedder: vectors.Embedder | None = None) -> Engine:
        """Everything anew from raw pages ``(url, html)``."""
        config = config or Config()
        cut = config.chunking
        sinks.save_table(pages.page_chunks(pages_, size=cut.window_size, overlap=cut.window_overlap, depth=cut.context_depth), f"{path}/chunks", "serve")
        chunks = spark.read.parquet(f"{path}/chunks")
        own = config.embedding
        embedder = embedders.checked(embedder or embedders.named(own.model, own.dim), own.dim)
        leaves = chunks.where("is_leaf").withColumn("_t", F.coalesce("embed_text", "text"))
        sinks.save_table(vectors.embed(leaves, embedder, "chunk_id", "_t"), f"{path}/embeddings")
        held = spark.read.parquet(f"{path}/embeddings")
        cells = {} if config.index.backend == "bruteforce" else {"cells": config.index.cells}
        vectors.build_index(held, own.dim, config.index.backend, **cells).save(f"{path}/index")
        lexical.LexicalIndex.build(lexical.fields(chunks), f"{path}/lexical")
        return cls(spark, path, config, embedder)

    def search(self, queries: DataFrame, k: int = 10, query_id: str = "query_id", query_text: str = "text") -> DataFrame:
        """The k results of every query."""
        index = self.vectors if isinstance(self.vectors, vectors.ExactIndex) else _Probing(self.vectors, self.config.index.nprobe)
        return hybrid.search(self.chunks, index, queries, self.embedder, k, query_id, query_text, self.config.embedding.model, self.lexical)

    def add_articles(self, lines: DataFrame, line_col: str = "value", order_col: str | None = None) -> None:
        """Articles from JSON lines, for the panel; they replace those that are there."""
        sinks.save_table(records.wiki_records(lines, line_col, order_col), f"{self.path}/wiki", "serve")
        wiki = self.spark.read.parquet(f"{self.path}/wiki").withColumn("_t", records.wiki_text())
        sinks.save_table(vectors.embed(wiki, self.embedder, "wiki_key", "_t"), f"{self.path}/wiki_vectors")

    def panels(self, queries: DataFrame, query_id: str = "query_id", query_text: str = "text") -> DataFrame:
        """The article shown beside each query's results, where there is one."""
        model = self.config.embedding.model
        asked = queries.select(F.col(query_id).alias("query_id"), embedders.query_text(model, query_text).alias("text"))
        wiki, held = self.spark.read.parquet(f"{self.path}/wiki"), self.spark.read.parquet(f"{self.path}/wiki_vectors")
        return hybrid.panel(wiki, held, vectors.embed(asked, self.embedder, "query_id", "text"))


class _Probing:
    """A cell index with a fixed number of probes."""

    def __init__(self, index: vectors.CellIndex, nprobe: int):
        self.index, self.nprobe = index, nprobe

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return self.index.search(queries, k, self.nprobe)
