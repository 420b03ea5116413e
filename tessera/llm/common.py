"""What the operators of this subpackage share: tables, scratch folders, text helpers, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_base() -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; it goes when the driver ends.

    Only where that setting is absent (tests on one machine) a local folder is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_base()
    folder = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


#: Rows of a batch that tables on their way to disk send to Python: texts may be long, and batches stand in memory twice.
BATCH = 2000


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = BATCH) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is run inside; the session's setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """The same rows read back from a Parquet table in a scratch folder: lineage ends there."""
    folder = scratch(df.sparkSession)
    with short_batches(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def removed(*tables: DataFrame) -> None:
    """Deletes the scratch folders of written tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tessera-" in folder:
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def named(name: str) -> Column:
    """The column of this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def struct_of(names: list[str]) -> Column:
    """The columns of these names, whatever signs they hold, as one."""
    return F.struct(*[named(c) for c in names])


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` has it; letter case doesn't tell names apart."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def wider(schema: StructType, **fields: str) -> StructType:
    """``schema`` with further fields of these types."""
    return StructType([*schema.fields, *(StructField(k, StructType.fromDDL(f"x {v}")[0].dataType) for k, v in fields.items())])


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from the md5 of the seed and the columns, the same on every engine."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, giving freed memory back to the system when its task ends: workers stay for later tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def mapped(df: DataFrame, run: Callable[[Iterator], Iterator], schema: StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any name: they travel under plain ones."""
    names, plain = df.columns, [f"c{i}" for i in range(max(len(df.columns), len(schema)))]

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(plain[: batch.num_columns])

    src = df.select(*[named(c).alias(p) for c, p in zip(names, plain)])
    out = src.mapInArrow(tidied(inner), StructType([StructField(p, f.dataType) for p, f in zip(plain, schema)]))
    return out.select(*[F.col(p).alias(f.name) for p, f in zip(plain, schema)])


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b: long) with the smallest node that it reaches.

    Alternating large-star and small-star steps, each an aggregate and a join, until the edges stay the
    same. Every round is written to the shared folder. A hub's edges are never gathered in one row, and
    the number of rounds grows with the logarithm of the longest path, not with its length.
    Nulls and loops (a = b) are dropped; an empty input gives an empty result.
    """
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = written(stars)
    state = _state(stars)
    for _ in range(rounds if state[0] else 0):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        stars, before = written(small), state
        state = _state(stars)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = stars.select("v").distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them."""
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("d")
    return tuple(edges.agg(F.count("*").alias("n"), digest).first())
