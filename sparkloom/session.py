"""Session construction shared by the tests, the bench and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, app: str = "sparkloom", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under.

    On a cluster, build the session with ``spark-submit`` instead; no operator sets
    anything on the session that it is given.
    """
    base = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
