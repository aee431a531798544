"""Where results go: keyed tables as Parquet, clicks, labels and reports as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import serp

#: How tables are written: as they are looked up by key (with Bloom filters), or as they are filled in bulk.
PROFILES = {"serve": {"parquet.bloom.filter.enabled": "true"}, "bulk": {"parquet.bloom.filter.enabled": "false"}}


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def checked_folder(spark: SparkSession, path: str) -> str:
    """The path of a table's folder; an error where there is a plain file."""
    files, target = _file_system(spark, path)
    if files.exists(target) and files.getFileStatus(target).isFile():
        raise ValueError(f"{path} is a file, not a folder of tables")
    return path


def save_table(df: DataFrame, path: str, profile: str = "bulk", mode: str = "overwrite") -> None:
    """A table as Parquet under one of the :data:`PROFILES`."""
    df.write.options(**PROFILES[profile]).mode(mode).parquet(checked_folder(df.sparkSession, path))


def append_vectors(df: DataFrame, path: str, id_col: str = "chunk_id") -> None:
    """Vectors added to those that are there; ids that have one already are left out."""
    files, target = _file_system(df.sparkSession, checked_folder(df.sparkSession, path))
    if files.exists(target):
        df = df.join(df.sparkSession.read.parquet(path).select(id_col), id_col, "left_anti")
    df.write.mode("append").parquet(path)


def clear_table(spark: SparkSession, path: str) -> int:
    """A table emptied; how many rows it had. Its schema stays."""
    df = spark.read.parquet(path)
    rows = df.count()
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)
    return rows


def append_clicks(clicks: DataFrame, path: str) -> None:
    """Clicks as JSON lines, keyed by ``click_id``."""
    clicks.select("click_id", "query", "position", "target_url", "timestamp_ms").write.mode("append").json(path)


def log_clicks(tokens: DataFrame, key: str, now_ms: int, path: str, token_col: str = "token") -> None:
    """The clicks behind a batch of tokens, appended; forged and stale ones are left out."""
    read = serp.read_tokens(key, now_ms)
    rows = tokens.select(read(token_col).alias("c")).select("c.*").where("timestamp_ms is not null")
    append_clicks(rows.withColumn("click_id", serp.click_id(F.col("query"), F.col("position"), F.col("target_url"), F.lit(now_ms))), path)


def append_labels(rows: DataFrame, path: str) -> None:
    """Labelled statements as JSON lines; labels are 0 (stands alone) to 3 (leans on the third before)."""
    good = rows.where(F.col("label").between(0, 3))
    good.select("current_sentence", "prev_1", "prev_2", "prev_3", F.col("label").cast("int").alias("label")).write.mode("append").json(path)


def save_report(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Figures of a run as JSON lines in one file."""
    spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").json(path)
