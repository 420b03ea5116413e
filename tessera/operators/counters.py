"""Counter algebra: tables of (key, value) that are summed, scaled, combined, filtered and listed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str, weight: Column | str | None = None) -> DataFrame:
    """(keys, value): number of rows or sum of a weight for each key."""
    value = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(*keys).agg(value.alias("value"))


def add_all(*counters: DataFrame) -> DataFrame:
    """Sum of counters (key, value)."""
    return reduce(DataFrame.unionByName, counters).groupBy("key").agg(F.sum("value").alias("value"))


def normalize(counter: DataFrame) -> DataFrame:
    """Values as shares of their total, which is one aggregate row joined back, not a window over all rows."""
    total = counter.agg(F.sum("value").alias("_total"))
    return counter.join(F.broadcast(total)).withColumn("value", F.try_divide("value", "_total")).drop("_total")


def scale(counter: DataFrame, by: float) -> DataFrame:
    return counter.withColumn("value", F.col("value") * F.lit(by))


def divide(counter: DataFrame, by: float) -> DataFrame:
    return counter.withColumn("value", F.try_divide(F.col("value"), F.lit(by)))


def divide_all_by(counter: DataFrame, other: DataFrame) -> DataFrame:
    """Values divided by the other counter's; keys that it lacks, or has as zero, give null."""
    return counter.join(other.withColumnRenamed("value", "_by"), "key", "left").select("key", F.try_divide("value", "_by").alias("value"))


def scale_all_by(counter: DataFrame, other: DataFrame) -> DataFrame:
    """Values times the other counter's; keys that it lacks give zero."""
    joined = counter.join(other.withColumnRenamed("value", "_by"), "key", "left")
    return joined.select("key", (F.col("value") * F.coalesce("_by", F.lit(0))).alias("value"))


def or_counters(*counters: DataFrame) -> DataFrame:
    """For each key the number of counters in which it is not zero."""
    rows = reduce(DataFrame.unionByName, [c.where("value <> 0").select("key") for c in counters])
    return rows.groupBy("key").agg(F.count("*").alias("value"))


def and_counters(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of both values for keys that are non-zero in both."""
    joined = a.where("value <> 0").join(b.where("value <> 0").withColumnRenamed("value", "_other"), "key")
    return joined.select("key", (F.col("value") + F.col("_other")).alias("value"))


def at_least(counter: DataFrame, threshold: float) -> DataFrame:
    return counter.where(F.col("value") >= threshold)


def histogram(counter: DataFrame) -> DataFrame:
    """(value, keys): how many keys have each value."""
    return counter.groupBy("value").agg(F.count("*").alias("keys"))


def sum_of_products(counter: DataFrame) -> DataFrame:
    """One row: sum of key times value, for numeric keys."""
    return counter.agg(F.sum(F.col("key") * F.col("value")).alias("total"))


def nested_counter(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, inner, value)."""
    return count_by(df, outer, inner)


def multi_counter(df: DataFrame, key: str, field: str, value: str, fields: list) -> DataFrame:
    """One column for each of the given fields, side by side; missing ones are zero."""
    return df.groupBy(key).pivot(field, fields).agg(F.sum(value)).na.fill(0, [str(f) for f in fields])


def top_with_percent(counter: DataFrame, threshold: float) -> DataFrame:
    """Keys of at least the threshold with value and percentage of the whole, largest first."""
    total = counter.agg(F.sum("value").alias("_total"))
    out = counter.join(F.broadcast(total)).withColumn("percent", F.try_divide(100 * F.col("value"), F.col("_total"))).drop("_total")
    return out.where(F.col("value") >= threshold).orderBy(F.col("value").desc(), "key")


def write_once(df: DataFrame, policy: str = "error") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) of rows (key, value, seq) where a key is set more than once.

    ``ignore`` keeps the first by seq, ``replace`` the last; ``error`` rejects all later rows; ``different`` rejects
    only later rows whose value differs from the first.
    """
    order = Window.partitionBy("key").orderBy("seq")
    if policy == "replace":
        last = df.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc())))
        return last.where("_n = 1").drop("_n"), df.where("false")
    ranked = df.withColumns({"_n": F.row_number().over(order), "_first": F.first("value").over(order)})
    kept = ranked.where("_n = 1").drop("_n", "_first")
    if policy == "ignore":
        return kept, df.where("false")
    later = ranked.where("_n > 1")
    if policy == "different":
        later = later.where(~F.col("value").eqNullSafe(F.col("_first")))
    elif policy != "error":
        raise ValueError(policy)
    return kept, later.drop("_n", "_first")
