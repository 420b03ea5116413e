import math
import os

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import negatives


def brute(rows, every=10, positives=5, limit=3, least=50, most=95):
    """Rows (vec_id, vector, label) in any order; a row is known by its place."""
    fine = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    fine = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in fine]
    fine = [r for r in fine if all(abs(x) < 2**63 for x in r[1])]
    out = []
    for n, (i, v, k) in enumerate(fine):
        if i % every:
            continue
        found = [(-max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -(2**63)), j, q) for m, (j, w, q) in enumerate(fine) if m != n and len(w) == len(v)]
        found.sort(key=lambda r: r[:2])
        for p, pid, _ in [r for r in found if r[2] == k][:positives]:
            inside = [r for r in found if r[2] != k and p <= 0 and least * -p <= 100 * -r[0] <= most * -p][:limit]
            out += [(i, pid, rank + 1, j, -p, -s) for rank, (s, j, _) in enumerate(inside)]
    return sorted(out)


def made(seed, n=300, width=16, labels=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, width)) + 0.3
    x = base[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, width))
    return [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, rng.integers(0, labels, n)))]


@pytest.mark.parametrize("width", [1, 3, 16, 70])
@pytest.mark.parametrize("block", [(40, 7), (8192, 2048)])
def test_matches_brute_force(spark, width, block):
    rows = made(width, width=width)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, row int, rank int").repartition(3)
    got = negatives.hard_negatives(df, negatives.F.col("vec_id") % 10 == 0, per_row=block[0], per_anchor=block[1])
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_odd_rows_ties_and_repeats(spark):
    rows = made(7, n=120)
    same = rows[0][1]
    rows += [(1000 + i, same, i % 2) for i in range(60)] + [(20, same, 0), (20, same, 0), (1000, [x / 2 for x in same], 3)]
    rows += [(None, same, 0), (2000, None, 0), (2010, same, None), (2020, [float("nan")] * 16, 0), (2030, [None, *same[1:]], 0), (2040, [float("inf"), *same[1:]], 1)]
    rows += [(2050, [], 0), (2060, [], 0), (2070, [], 1), (2080, [0.0] * 16, 2), (2090, [0.0] * 16, 2), (2100, [1.0, 2.0], 1), (2110, [1.0, 2.5], 1), (2120, [1.0, 1.5], 0)]
    rows += [(3000 + 10 * i, [1e14 + 1e11 * i, 3.0, 1.5], i % 2) for i in range(6)] + [(4000 + i, [1e300, 1.0], 1) for i in range(2)] + [(5000 + i, [-(2.0**30) - i], i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = negatives.hard_negatives(df, negatives.F.col("vec_id") % 10 == 0, per_row=50, per_anchor=9)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert negatives.hard_negatives(df.limit(0), negatives.F.lit(True)).count() == 0


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(2)
    for width in (1, 5, 16, 64, 100, 333):
        x = np.floor(256 * rng.normal(size=(40, width)) + 40)
        found = negatives.levels(*negatives.summaries(x), width)
        reach = []
        for c, d in found:
            assert (np.abs(x @ x.T - c @ c.T) <= d @ d.T + 1e-6).all()
            reach.append((d @ d.T).mean())
        assert reach == sorted(reach, reverse=True) and len(negatives.segments(width)) - 1 == 4 ** (len(found) - 1)


def test_pairs_are_dropped_before_scoring():
    rng = np.random.default_rng(3)
    base = np.repeat(rng.normal(scale=4, size=(30, 16)), 4, axis=1)
    x = np.floor(64 * (base[np.arange(600) % 30] + 0.05 * rng.normal(size=(600, 64))))
    mean, dev = negatives.summaries(x)
    found = pa.table({"row": np.arange(600), "vec_id": np.arange(600), "whole": list(x.astype(np.int64)), "mean": list(mean), "dev": list(dev)})
    block = negatives.Block(found, 64)
    at = np.arange(50)
    i, j = negatives.survivors(block, block, at[:, None] != np.arange(600)[None, :], at, negatives.best(5))
    assert len(i) < 0.2 * 50 * 600
    exact = block.x[:50] @ block.x.T
    exact[at, at] = -np.inf
    wanted = {(a, b) for a in range(50) for b in np.argsort(-exact[a], kind="stable")[:5].tolist()}
    assert wanted <= set(zip(i.tolist(), j.tolist()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are absent")
def test_query_and_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    got = negatives.op13_hard_negatives(spark, folder)
    duckdb.execute(f"create or replace view embeddings as select * from '{folder}/embeddings.parquet'")
    found = duckdb.execute(negatives.OP13_SQL)
    assert [d[0] for d in found.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall()) != []
