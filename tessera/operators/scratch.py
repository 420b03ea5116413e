"""Tables that cut the lineage of iterated jobs, in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_base() -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, gone when the driver ends; where that is unset (tests), a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_base()
    name = f"{base.rstrip('/')}/rounds-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written and read again."""
    place = folder(df.sparkSession)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def bucketed(df: DataFrame, *keys: str, dealt: bool = False) -> DataFrame:
    """The rows of ``df``, written and read again in buckets of ``keys``: what groups or joins by these needs no shuffle.
    Rows that are ``dealt`` by them already are not dealt again.

    The table's name is given up at once, its files stay as those of :func:`written`.
    """
    spark = df.sparkSession
    place, parts = folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "rounds_" + place.rsplit("-", 1)[1]
    (df if dealt else df.repartition(parts, *keys)).write.bucketBy(parts, *keys).option("path", place).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes the folders of written tables that nothing reads any more."""
    for df in tables:
        for place in {f.rsplit("/rounds-", 1)[0] + "/rounds-" + f.rsplit("/rounds-", 1)[1].split("/")[0] for f in df.inputFiles() if "/rounds-" in f}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
