import numpy as np
import pytest

from tessera.llm import neighbours


@pytest.mark.parametrize("block", [5, 1024])
def test_links_match_brute_force(spark, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:30] + rng.normal(scale=0.18, size=(30, 16)), base[:1] + rng.normal(scale=0.05, size=(40, 16))])
    labels = [int(i) for i in rng.integers(0, 2, len(x))]
    rows = [(i, v.tolist(), k, 1, 2) for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(1000 + i, v, 0, 1, 2) for i, v in enumerate(odd)] + [(2000, x[0].tolist(), None, 1, 2), rows[0], (None, x[0].tolist(), labels[0], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, row int, cells int").repartition(3)
    got = neighbours.near_duplicates(df, block=block, per_cell=20).collect()
    assert len(got) == len(rows)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = (unit @ unit.T >= 0.93) & np.equal.outer(labels, labels)
    root = list(range(len(x)))
    for _ in range(len(x)):
        root = [min(root[j] for j in np.flatnonzero(link[i])) for i in range(len(x))]
    by = {r["vec_id"]: r for r in got if r["vec_id"] != 0}
    for i in range(1, len(x)):
        assert by[i]["n_links"] == link[i].sum() - 1 + link[i, 0]
        assert by[i]["component_id"] == root[i] and by[i]["kept"] == (root[i] == i)
    assert all(by[k]["n_links"] == 0 and by[k]["kept"] for k in [*range(1000, 1007), 2000])
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_lengths_that_share_a_batch_lose_nothing(spark):
    rng = np.random.default_rng(5)
    long, short = rng.normal(size=16), rng.normal(size=2)
    rows = [(i, long.tolist(), "a") for i in range(5)] + [(100 + i, (short * (i + 1)).tolist(), "a") for i in range(30)]
    rows += [(200 + i, rng.normal(size=3).tolist(), "b") for i in range(3)] + [(300, [long.tolist()[0]], "a"), (301, [-1.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").coalesce(1)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.near_duplicates(df).collect()}
    assert all(got[i] == (4, 0) for i in range(5)) and all(got[100 + i] == (29, 100) for i in range(30))
    assert got[300][1] == 300 or long[0] < 0


def test_cells_of_several_centres_and_ties(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 8))
    x = np.concatenate([base + 0.12 * rng.normal(size=base.shape) for _ in range(25)] + [np.repeat(base[:1], 20, axis=0), base[:1] * 3])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in neighbours.near_duplicates(df, per_cell=15, block=40).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()
