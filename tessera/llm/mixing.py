"""Mixing sources to target weights with DataFrame functions only.

Sizes are summed per source, every source gets a target and so a repetition rate, and each document is
emitted floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import struct_of, table, unit_hash, word_count, written


def source_targets(
    sized: DataFrame, source: str = "source", weights: tuple = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0
) -> DataFrame:
    """(source, source_size, target, rate) for rows with ``source`` and ``size``.

    Sources in code-point order, null last, take ``weights`` in turn and divide ``share`` of all sizes. A target
    stops at ``ceiling`` times the source's size; the excess goes to the others by weight until none is above.
    That fixed point is target = min(level * weight, cap) for one level: with sources ordered by cap / weight, the
    level is the largest of (goal - caps before) / (weights from here on). The windows hold one row per source.
    A source of size 0 has target 0 and rate 0; an empty table gives no rows.
    """
    n = len(weights)
    turn = (F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1) % n
    weight = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        weight = F.when(turn == i, float(w)).otherwise(weight)
    per = sized.groupBy(source).agg(F.sum("size").cast("long").alias("source_size")).select("*", weight.alias("weight"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    everyone = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col(source).asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    goal = F.sum("source_size").over(everyone) * F.lit(float(share))
    per = per.withColumn("level", (goal - before) / onward)
    per = per.withColumn("target", F.least(F.max("level").over(everyone) * F.col("weight"), F.col("cap")))
    rate = F.when(F.col("source_size") > 0, F.try_divide(F.col("target"), F.col("source_size"))).otherwise(0.0)
    return per.select(source, "source_size", "target", rate.alias("rate"))


def with_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", **targets
) -> DataFrame:
    """``docs`` with _size, _source_size, _target and _copies; columns of these names (and _source, _rate) are replaced.

    The per-source table is written first and joined without a hint: Spark knows its size, broadcasts it where that
    allows, so that no text is shuffled, and otherwise joins by key, splitting a hot source. Equal ids draw alike; a null id draws as the word null;
    null text has size 0, repeated rows are documents of their own. Extra columns stay as they are, an empty table gives
    an empty one.
    """
    docs = docs.drop("_size", "_source_size", "_target", "_copies", "_source", "_rate")
    sized = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    per = source_targets(sized, **targets).select(
        F.col("source").alias("_source"),
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
        F.col("rate").alias("_rate"),
    )
    per = written(per)
    whole = F.floor("_rate")
    extra = (unit_hash(seed, F.col(doc_id)) < F.col("_rate") - whole).cast("long")
    joined = docs.withColumn("_size", word_count(F.col(text))).join(per, F.col(source).eqNullSafe(F.col("_source")))
    return joined.withColumn("_copies", whole + extra).drop("_source", "_rate")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed rows themselves: every document as often as it is taken, all columns as given, whatever their names."""
    rest = [c for c in docs.columns if c != text]
    inner = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"), struct_of(rest).alias("rest"))
    copies = with_copies(inner, **options).where("_copies > 0")
    copies = copies.select("text", "rest", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("copy"))
    return copies.select(*[F.col("text").alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return with_copies(docs).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
        F.col("_copies").alias("copies"),
    )


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap FROM per
), levels AS (
  SELECT *, ((SUM(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
    - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / SUM(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted
), targets AS (
  SELECT source, source_size, LEAST(MAX(level) OVER () * weight, cap) AS target FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets
), drawn AS (
  SELECT doc_id, size, source_size, target,
    (FLOOR(rate) + CASE WHEN ('0x' || substr(md5('mix|' || COALESCE(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - FLOOR(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM drawn
"""
