"""Session settings for local runs and tests; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", app: str = "tessera", checkpoints: str | None = None) -> SparkSession:
    """A UTC session on ``local[cpus]`` with adaptive execution and few shuffle partitions."""
    builder = SparkSession.builder.config("spark.checkpoint.dir", checkpoints) if checkpoints else SparkSession.builder
    return (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("TESSERA_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer parts than there are cores; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
