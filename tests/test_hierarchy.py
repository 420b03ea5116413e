import math
import random
from collections import Counter

import pytest

from tessera.operators import hierarchy


def walk(steps, a):
    """Distances and numbers of shortest paths from a."""
    hops, paths, front = {a: 0}, Counter({a: 1}), [a]
    while front:
        ahead = []
        for x in front:
            for y in steps.get(x, ()):
                if y not in hops:
                    hops[y] = hops[x] + 1
                    ahead.append(y)
                if hops[y] == hops[x] + 1:
                    paths[y] += paths[x]
        front = ahead
    return hops, paths


@pytest.fixture(scope="module")
def graph():
    rng = random.Random(3)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(70)} | {(100 + i, 101 + i) for i in range(30)} | {(130, 100)}
    steps = {}
    for a, b in edges:
        if a != b:
            steps.setdefault(a, set()).add(b)
    return edges, steps


@pytest.mark.parametrize("most", [None, 1, 5])
def test_closure_by_doubling(spark, graph, most):
    edges, steps = graph
    got = hierarchy.closure(spark.createDataFrame(sorted(edges), "a int, b int"), most, counts=True).collect()
    want = {}
    for a in steps:
        hops, paths = walk(steps, a)
        want |= {(a, b): (h, paths[b]) for b, h in hops.items() if h and (most is None or h <= most)}
    assert {(r["a"], r["b"]): (r["hops"], r["paths"]) for r in got} == want and len(got) == len(want)
    assert hierarchy.closure(spark.createDataFrame([], "a int, b int"), most).count() == 0


def test_arrivals_are_the_nodes_that_lead_there(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("d", "f"), ("e", "g"), ("f", "g")]
    df = spark.createDataFrame(edges, "a string, b string")
    paths = {(r["a"], r["b"]): r["paths"] for r in hierarchy.closure(df, counts=True).collect()}
    led = {(r["a"], r["b"]): r["paths"] for r in hierarchy.closure(df, counts=True, arrivals=True).collect()}
    assert paths["a", "g"] == 4 and led["a", "g"] == 2 and led["a", "d"] == 2 and led["a", "b"] == 1


def test_pairs_meet_in_the_middle(spark, graph):
    edges, _ = graph
    both = {}
    for a, b in edges:
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
    df = spark.createDataFrame([(a, b, "x") for a, b in sorted(edges)], "sup int, sub int, relation string")
    pairs = [(1, 2), (3, 3), (5, 30), (100, 115), (100, 108), (7, 120), (999, 1)]
    got = {(r["a"], r["b"]): r["hops"] for r in hierarchy.pair_distances(df, spark.createDataFrame(pairs, "a int, b int"), most=9).collect()}
    for a, b in pairs:
        hops = walk(both, a)[0].get(b)
        assert got[a, b] == (hops if hops is not None and hops <= 9 else None)


@pytest.mark.parametrize("block", [3, 256])
def test_pmi_in_blocks(spark, block):
    rng = random.Random(5)
    rows = [(g, f"n{min(int(rng.expovariate(0.2)), 19):02d}") for g in range(12) for _ in range(rng.choice([1, 4, 60]))] + [(99, f"m{i}") for i in range(30)]
    names, groups = Counter(n for _, n in rows), {}
    for g, n in rows:
        groups.setdefault(g, []).append(n)
    pairs = sum(len(x) * (len(x) - 1) // 2 for x in groups.values())
    want = Counter()
    for x in groups.values():
        x = sorted(n for n in x if names[n] >= 4)
        want.update((x[i], x[j]) for i in range(len(x)) for j in range(i + 1, len(x)))
    got = {(r["a"], r["b"]): (r["n"], r["pmi"]) for r in hierarchy.pmi(spark.createDataFrame(rows, "group int, name string"), block=block).collect()}
    assert {k: v[0] for k, v in got.items()} == dict(want)
    for (a, b), (n, value) in got.items():
        assert value == pytest.approx(math.log(n) - math.log(pairs) - math.log(names[a]) - math.log(names[b]) + 2 * math.log(len(rows)))


def test_a_large_group_stands_in_many_rows(spark):
    df = spark.range(4000).select(hierarchy.F.lit(1).alias("group"), (hierarchy.F.col("id") % 1000).alias("name"))
    got = hierarchy.pmi(df)
    assert got.count() == 1000 * 1001 // 2 and got.agg({"n": "sum"}).first()[0] == 4000 * 3999 // 2


def test_a_round_never_shuffles_what_is_known(spark, monkeypatch):
    plans = []
    kept = hierarchy.bucketed
    monkeypatch.setattr(hierarchy, "bucketed", lambda df, *keys, **more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, *keys, **more))
    steps = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(0, 7), (3, 0)], "a int, b int")
    got = hierarchy.closure(steps)
    assert got.count() == got.select("a", "b").distinct().count() and got.where("a = 0 and b = 20").first()["hops"] == 14
    assert len(plans) > 3 and all("Bucketed: true" in p for p in plans[1:])
    assert all(p.count("hashpartitioning(a#") == 1 for p in plans[1:])
