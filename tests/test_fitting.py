import numpy as np
import pytest

from tessera.operators import fitting, scratch, training

SCHEMA = "inst int, cand int, idx long, value double, gold boolean, cost double"


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(4)
    x, gold = rng.normal(size=(25, 3)), rng.integers(0, 3, 25)
    return x, gold, [(i, c, 3 * c + j, float(x[i, j]), bool(c == gold[i]), 0.0) for i in range(25) for c in range(3) for j in range(3)]


def gradient(w, x, gold, l2):
    p = np.exp(x @ w.reshape(3, 3).T)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(gold)), gold] -= 1
    return (p.T @ x).ravel() + 2 * l2 * w


def test_direction_from_products_equals_that_from_vectors():
    rng = np.random.default_rng(1)
    vectors = {fitting.GRAD: rng.normal(size=9)} | {(k, t): rng.normal(size=9) for t in (3, 4, 7) for k in "sy"}
    for t in (3, 4, 7):
        vectors["y", t] = vectors["s", t] + 0.1 * vectors["y", t]
    products = {(a, b): float(vectors[a] @ vectors[b]) for a in vectors for b in vectors if a <= b}
    got = sum(f * vectors[b] for b, f in fitting.factors([3, 4, 7], products).items())
    h = np.eye(9) * (vectors["s", 7] @ vectors["y", 7]) / (vectors["y", 7] @ vectors["y", 7])
    for t in (3, 4, 7):
        s, y = vectors["s", t], vectors["y", t]
        v = np.eye(9) - np.outer(y, s) / (y @ s)
        h = v.T @ h @ v + np.outer(s, s) / (y @ s)
    assert got == pytest.approx(-h @ vectors[fitting.GRAD])
    assert fitting.factors([], products) == {fitting.GRAD: -1.0}


@pytest.mark.parametrize("memory", [1, 6])
def test_the_gradient_at_the_result_is_null(spark, drawn, memory):
    x, gold, rows = drawn
    ev = spark.createDataFrame(rows, SCHEMA)
    w = fitting.fit(ev, l2=0.2, tolerance=1e-5, memory=memory)
    w = np.array([r["weight"] for r in w.orderBy("idx").collect()])
    assert np.linalg.norm(gradient(w, x, gold, 0.2)) <= 2e-5 * max(1, np.linalg.norm(w))


def test_start_checkpoint_and_no_events(spark, drawn, tmp_path):
    _, _, rows = drawn
    ev = spark.createDataFrame(rows, SCHEMA)
    half = fitting.fit(ev, l2=0.2, most=4, checkpoint=str(tmp_path), every=2)
    kept = {r["idx"]: r["weight"] for r in spark.read.parquet(f"{tmp_path}/weights_00004").collect()}
    assert kept == {r["idx"]: r["weight"] for r in half.collect()} and len(kept) == 9
    start = spark.createDataFrame([*kept.items(), (99, 0.5)], "idx long, weight double")
    done = {r["idx"]: r["weight"] for r in fitting.fit(ev, l2=0.2, start=start).collect()}
    assert set(done) == {*range(9), 99} and abs(done[99]) < 0.01
    assert [tuple(r) for r in fitting.fit(ev.limit(0), start=start.where("idx = 99"), l2=0.0).collect()] == [(99, 0.5)]
    assert fitting.fit(ev.limit(0)).count() == 0


def test_minibatches_take_each_instance_once_a_pass(spark, drawn):
    x, gold, rows = drawn
    ev = spark.createDataFrame(rows, SCHEMA)
    deal = lambda turn, parts: fitting.F.pmod(fitting.F.col("inst") + turn, fitting.F.lit(parts))
    got = fitting.minibatch_sgd(ev, passes=2, batch=10, rate=0.3, l2=0.01, deal=deal)
    w = np.zeros(9)
    for turn in range(2):
        for part in range(3):
            some = (np.arange(25) + turn) % 3 == part
            w = w * (1 - 2 * 0.3 * 0.01) - 0.3 / 10 * gradient(w, x[some], gold[some], 0.0)
    assert [r["weight"] for r in got.orderBy("idx").collect()] == pytest.approx(w.tolist())


def test_bucketed_events_are_not_shuffled_and_scores_not_broadcast(spark, drawn):
    _, _, rows = drawn
    ev = spark.createDataFrame(rows, SCHEMA)
    weights = scratch.written(spark.createDataFrame([(k, k / 9) for k in range(9)], "idx long, weight double"))
    sums = training.softmax_sums(scratch.bucketed(ev, "inst", "cand"), weights)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 2 and plan.count("BroadcastHashJoin") == 1 and "ShuffledHashJoin" in plan
    loss, grad = training.softmax_loss_grad(ev, weights)
    assert sums.agg({"loss": "sum"}).first()[0] == pytest.approx(loss.first()["loss"])
    assert {r["idx"]: r["grad"] for r in sums.collect()} == pytest.approx({r["idx"]: r["grad"] for r in grad.collect()})


def test_latent_events_are_dealt_once_and_joined_with_weights_only(spark):
    ev = spark.createDataFrame([(i, c, u, 2 * c + u, 1.0 + i, c == 0) for i in range(4) for c in range(2) for u in range(2)], "inst int, cand int, unit int, idx long, value double, gold boolean")
    weights = spark.createDataFrame([(k, k / 4) for k in range(3)], "idx long, weight double")
    loss, grad = training.latent_loss_grad(ev, weights)
    plan = grad._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("hashpartitioning(inst") == 1 and "REPARTITION_BY_NUM" in plan
    w = np.array([0, 0.25, 0.5, 0])
    e = [np.exp((1.0 + i) * w) for i in range(4)]
    assert loss.first()["loss"] == pytest.approx(sum(np.log(x.sum()) - np.log(x[:2].sum()) for x in e))
    want = sum((1.0 + i) * (x / x.sum() - np.r_[x[:2] / x[:2].sum(), 0, 0]) for i, x in enumerate(e))
    assert [r["grad"] for r in grad.orderBy("idx").collect()] == pytest.approx(want.tolist())
