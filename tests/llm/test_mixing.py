import math
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.llm.common import word_count


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        room = goal - sum(capped.values())
        share = {s: room * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_targets_reshare_until_none_is_above(spark):
    sizes = {"a": 10, "b": 500, "c": 30, None: 90, "é": 0, "z": 1000, "Z": 4}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    for s, t in brute_targets(sizes).items():
        assert math.isclose(got[s], t, abs_tol=1e-9)


def test_mix_repeats_whole_rows(spark, odd, none):
    out = mixing.with_copies(odd)
    by = defaultdict(float)
    for r in out.collect():
        rate = r["_target"] / r["_source_size"] if r["_source_size"] else 0
        assert r["_copies"] in (math.floor(rate), math.floor(rate) + 1) and r["_copies"] <= 2
        by[r["source"]] += r["_size"] * r["_copies"]
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    total = mixed.agg(F.sum(word_count(F.col("text")))).first()[0]
    assert total == sum(by.values())
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(odd.repartition(5)).collect()))
    assert mixing.mix(none).count() == 0
    named = odd.withColumns({c: F.lit(c) for c in ("_size", "_rate", "_source", "_copies", "_copy", "rest", "a.b")})
    again = mixing.mix(named)
    assert again.columns == named.columns and sorted(map(str, again.select(*odd.columns).collect())) == sorted(map(str, mixed.collect()))


def test_many_documents_come_near_their_target(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    rows = mixing.with_copies(df).groupBy("source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("taken"), F.first("_target").alias("target")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.03 for r in rows)


def test_plan_has_no_python(spark, odd):
    plan = mixing.mix(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
