"""Exact dedup with a heavy-hitter split.

Texts are told apart by their SHA-256. Misra-Gries summaries, one a task, find the digests that may be frequent; a second
look at all digests counts those exactly and verifies them. The verified ones, with their winners, are few at any
size of the input (fewer than ``most``, as each covers more than 1 / most of all rows) and are broadcast: their rows are
settled, or removed, where they stand. All other digests, none of which is frequent, are shuffled in the ordinary way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import named, struct_of, table, tidied, written

#: Digests that can be frequent at most: a frequent one has more than 1 / MOST of all rows.
MOST = 8192


def digest_of(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256))


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> pa.Table:
    """(digest, n): at most ``counters`` digests of the first column with counts that are too low by at most
    rows / (counters + 1), and never too high. Batches are counted whole and merged; whenever more counters stand,
    the largest count that doesn't fit is taken off all, so that those which fall to 0 go."""
    held = pa.table({"digest": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    for batch in batches:
        new = pa.table({"digest": batch.column(0), "n": np.ones(batch.num_rows, dtype=np.int64)})
        sums = pa.concat_tables([held, new]).group_by("digest").aggregate([("n", "sum")])
        held = pa.table({"digest": sums["digest"], "n": sums["n_sum"]})
        if held.num_rows > counters:
            n = held["n"].to_numpy()
            cut = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])
            held = held.filter(pc.greater(held["n"], cut))
            held = held.set_column(1, "n", pc.subtract(held["n"], cut))
    return held


def candidates(digests: DataFrame, rows: int, most: int = MOST) -> DataFrame:
    """(digest): all digests with more than rows / most of the ``rows`` rows, and perhaps others, under 2 most in all.

    Each task's summary misses at most 1 / (2 most + 1) of its rows, so all of them together miss at most that share
    of all; a digest whose summed counts reach the difference may be frequent, and only so many can.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from misra_gries(batches, 2 * most).to_batches()

    sums = digests.select("digest").mapInArrow(tidied(run), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") > rows / most - rows / (2 * most + 1) - 1e-9).select("digest")


def winners(digests: DataFrame, most: int = MOST) -> DataFrame:
    """(digest, size, best) of every digest with more than 1 / most of the rows of ``digests`` (digest, rank), counted
    exactly; best is the largest rank. Fewer than ``most`` rows, written."""
    rows = digests.count()
    maybe = F.broadcast(written(candidates(digests, rows, most)))
    exact = digests.join(maybe, "digest").groupBy("digest").agg(F.count("*").alias("size"), F.max("rank").alias("best"))
    return written(exact.where(F.col("size") > rows / most))


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept), one row per row of ``docs``.

    Rows of equal texts, null as empty, are a group; that of the largest id stays (null ids come last; of rows that
    repeat an id and a text one stays). Other columns are left out; an empty table gives an empty one.
    """
    src = docs.select(digest_of(named(text)).alias("digest"), named(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"))
    src = written(src.select("digest", F.struct("doc_id", "row").alias("rank")))
    frequent = winners(src, most)
    settled = src.join(F.broadcast(frequent), "digest")
    rest = src.join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
    sums = rest.groupBy("digest").agg(F.count("*").alias("size"), F.max("rank").alias("best"))
    both = settled.unionByName(rest.join(sums.hint("shuffle_hash"), "digest"))
    return both.select(
        F.col("rank.doc_id").alias("doc_id"),
        "digest",
        F.col("best.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("rank.row") == F.col("best.row")).alias("kept"),
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """The rows that stay, all columns as given, whatever their names; of equal ids and texts the row whose hash is largest.

    Rows of frequent texts that are not of the winning id go where they are read; what is left is dealt by digest once, and
    each task has dropped all but one row of a digest before it sends any.
    """
    rank = F.struct(named(doc_id).alias("doc_id"), F.xxhash64(F.to_json(struct_of(docs.columns))).alias("row"))
    inner = docs.select(digest_of(named(text)).alias("digest"), rank.alias("rank"), struct_of(docs.columns).alias("given"))
    frequent = F.broadcast(winners(written(inner.select("digest", "rank")), most).select("digest", "best"))
    left = inner.join(frequent, "digest", "left").where("best is null or rank = best")
    first = F.row_number().over(Window.partitionBy("digest").orderBy(F.col("rank").desc()))
    kept = left.withColumn("turn", first).where("turn = 1")
    return kept.select(*[F.col("given").getField(c).alias(c) for c in docs.columns])


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document, and which row of it stays."""
    groups = duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
 sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
