"""Tables written to the shared folder, to cut lineage where executors may be lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The tables of each application that are still there.
_kept: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where the setting is missing a local session gets a temporary folder of its own; a
    cluster session is refused, since a folder of one machine cannot serve the others.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sparkloom-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder, with the writer's ``options``, and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _kept.setdefault(spark.sparkContext.applicationId, set()).add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files behind a table that :func:`written` returned."""
    path = getattr(df, "_sparkloom_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application wrote here, once no result that reads them is wanted."""
    for path in list(_kept.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _kept.get(spark.sparkContext.applicationId, set()).discard(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A table of one small file is one task, whatever is then done to its rows. Tables that
    already have a partition for each core come back as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
