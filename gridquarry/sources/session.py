"""A local session with the settings that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g", **conf: str) -> SparkSession:
    """A session on local[cores]; on a cluster, build the session from the cluster's own settings instead."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridquarry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
