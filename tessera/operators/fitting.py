"""Fitting log-linear models: quasi-Newton steps without vectors on the driver, and minibatch steps from a dealt table.

Weights, gradients and histories stay tables by idx. What the driver sees of them are sums of products: a step's
direction is a combination of the last changes of weights and gradients and the gradient itself, and its factors follow
from the products of these 2 m + 1 columns alone. So the number of features is bounded by the cluster only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import scratch
from tessera.operators.scratch import bucketed, written
from tessera.operators.training import softmax_loss_grad, softmax_sums

#: The basis of a direction: changes of weights, of gradients, the gradient.
Name = tuple[str, int]
GRAD: Name = ("g", 0)
#: The share of a loss within which two sums of it count as equal.
STILL = 1e-10


def factors(turns: list[int], products: dict[tuple[Name, Name], float]) -> dict[Name, float]:
    """The quasi-Newton direction as factors of its basis, from products of the basis alone (two-loop recursion).

    ``turns`` number the kept pairs, oldest first; without any the direction is the negated gradient.
    """
    of = {GRAD: -1.0} | {(k, t): 0.0 for t in turns for k in "sy"}
    dot = lambda a: sum(f * products[min(a, b), max(a, b)] for b, f in of.items() if f)
    pair = {t: products[("s", t), ("y", t)] for t in turns}
    alpha = {}
    for t in reversed(turns):
        alpha[t] = dot(("s", t)) / pair[t]
        of["y", t] -= alpha[t]
    if turns:
        last = turns[-1]
        scale = pair[last] / products[("y", last), ("y", last)]
        of = {b: f * scale for b, f in of.items()}
    for t in turns:
        of["s", t] += alpha[t] - dot(("y", t)) / pair[t]
    return of


def _columns(turns: list[int]) -> dict[Name, Column]:
    """Where a state's table holds each column of the basis."""
    both = {(k, t): F.get(k, F.lit(i)) for i, t in enumerate(turns) for k in "sy"}
    return both | {GRAD: F.col("grad")}


def _tried(data: DataFrame, moved: DataFrame, loss_grad: Callable, l2: float) -> DataFrame:
    """``moved`` (idx, weight, ...) with grad_new and loss, written in one job; losses add up to that of all events."""
    found = loss_grad(data, moved.select("idx", "weight"))
    if isinstance(found, tuple):  # a loss of its own stands in the row with a null idx
        loss, grad = found
        found = grad.select("idx", "grad", F.lit(0.0).alias("loss")).unionByName(loss.select(F.lit(None).cast("long").alias("idx"), F.lit(0.0).alias("grad"), "loss"))
    pulled = F.coalesce("_g", F.lit(0.0)) + 2 * l2 * F.coalesce("weight", F.lit(0.0))
    return written(moved.join(found.withColumnRenamed("grad", "_g"), "idx", "full_outer").withColumn("grad_new", pulled).drop("_g"))


def fit(
    events: DataFrame,
    loss_grad: Callable = softmax_sums,
    l2: float = 0.1,
    most: int = 200,
    memory: int = 6,
    tolerance: float = 1e-4,
    checkpoint: str | None = None,
    every: int = 10,
    start: DataFrame | None = None,
) -> DataFrame:
    """(idx, weight) of all features of ``events`` that minimise the loss plus l2 |w|^2: limited-memory quasi-Newton steps
    with a backtracking line search.

    Events are written once, in buckets of candidates. Each try of a step is two jobs: one evaluates loss and gradient at
    the moved weights and writes them with the state, one sums the new products. ``loss_grad`` gives one row (loss) and
    (idx, grad), or (idx, grad, loss) in one table, so that events are read once. Stops at |g| <= tolerance max(1, |w|),
    after ``most`` steps, or if no step helps; the last weights stand. ``checkpoint`` is a folder for the weights every few
    steps; ``start`` (idx, weight) continues from such a table, its features stay though no event has them. Events with
    a null idx count nothing; without events the start is given back.
    """
    data = bucketed(events.where("idx is not null"), "inst", "cand")
    known = data.select("idx").distinct()
    begin = start.select("idx", F.col("weight").alias("_w")) if start is not None else known.limit(0).select("idx", F.lit(0.0).alias("_w"))
    none = F.array().cast("array<double>")
    state = known.join(begin, "idx", "full_outer").select("idx", F.coalesce("_w", F.lit(0.0)).alias("weight"), none.alias("s"), none.alias("y"))
    tried = _tried(data, written(state), loss_grad, l2)
    state = tried.where("idx is not null").select("idx", "weight", F.col("grad_new").alias("grad"), "s", "y")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sums = tried.agg(
        total(F.col("loss")).alias("loss"),
        total(F.when(F.col("idx").isNotNull(), F.col("weight") ** 2)).alias("ww"),
        total(F.when(F.col("idx").isNotNull(), F.col("grad_new") ** 2)).alias("gg"),
    ).first()
    value, size = sums["loss"] + l2 * sums["ww"], sums["ww"]
    products: dict[tuple[Name, Name], float] = {(GRAD, GRAD): sums["gg"]}
    turns: list[int] = []
    for turn in range(1, most + 1):
        if math.sqrt(products[GRAD, GRAD]) <= tolerance * max(1.0, math.sqrt(size)):
            break
        of, columns = factors(turns, products), _columns(turns)
        slope = sum(f * products[min(GRAD, b), max(GRAD, b)] for b, f in of.items())
        direction = sum((F.lit(f) * columns[b] for b, f in of.items()), F.lit(0.0))
        step = 1.0 if turns else min(1.0, 1.0 / math.sqrt(products[GRAD, GRAD]))
        for _ in range(20):
            moved = state.select("idx", (F.col("weight") + step * direction).alias("weight"), (step * direction).alias("_s"), "grad", "s", "y")
            found = _tried(data, moved, loss_grad, l2)
            change = {("s", turn): F.col("_s"), ("y", turn): F.col("grad_new") - F.col("grad"), GRAD: F.col("grad_new")}
            both = {b: c for b, c in columns.items() if b != GRAD} | change
            pairs = sorted({(min(a, b), max(a, b)) for a in change for b in both})
            sums = found.agg(
                total(F.col("loss")).alias("loss"),
                total(F.when(F.col("idx").isNotNull(), F.col("weight") ** 2)).alias("ww"),
                *[total(F.when(F.col("idx").isNotNull(), both[a] * both[b])).alias(f"p{n}") for n, (a, b) in enumerate(pairs)],
            ).first()
            new = {pair: sums[f"p{n}"] for n, pair in enumerate(pairs)}
            moved_to, then = sums["loss"] + l2 * sums["ww"], new[min(GRAD, ("s", turn)), max(GRAD, ("s", turn))] / step
            # Near the optimum the gain is less than a sum's last digits: where the loss stands still, the slope tells.
            if moved_to <= value + 1e-4 * step * slope or (moved_to <= value + STILL * abs(value) and abs(then) <= -0.8 * slope):
                break
            scratch.dropped(found)
            step /= 2
        else:
            break
        products = {pair: x for pair, x in products.items() if GRAD not in pair} | new
        value, size, before = moved_to, sums["ww"], tried
        curved = products[("s", turn), ("y", turn)] > 1e-12
        turns = [*turns, turn] if curved else turns
        kept = lambda old, c: F.slice(F.concat(F.col(old), F.array(c)), -min(memory, len(turns)), memory) if curved else F.col(old)
        turns = turns[-memory:]
        tried = found
        state = found.where("idx is not null").select(
            "idx", "weight", F.col("grad_new").alias("grad"), kept("s", change["s", turn]).alias("s"), kept("y", change["y", turn]).alias("y")
        )
        scratch.dropped(before)
        if checkpoint and turn % every == 0:
            state.select("idx", "weight").write.mode("overwrite").parquet(f"{checkpoint}/weights_{turn:05d}")
    return state.select("idx", "weight")


def minibatch_sgd(
    events: DataFrame,
    passes: int = 5,
    batch: int = 100,
    rate: float = 0.1,
    seed: int = 7,
    l2: float = 0.0,
    loss_grad: Callable = softmax_loss_grad,
    checkpoint: str | None = None,
    deal: Callable[[int, int], Column] | None = None,
) -> DataFrame:
    """(idx, weight) after stochastic steps: in every pass instances are dealt without replacement into batches.

    A pass writes the events once, partitioned by batch; each step then reads its own partition only, so a pass reads the
    events twice in all, however many steps it has. The deal is a seeded hash, or ``deal(turn, parts)``, a column from 0 to
    parts - 1. A step takes rate / batch times the gradient off and 2 rate l2 of the weights.
    """
    spark = events.sparkSession
    data = written(events.where("idx is not null").repartition("inst"))
    parts = max(1, -(-data.select("inst").distinct().count() // batch))
    deal = deal or (lambda turn, n: F.pmod(F.xxhash64("inst", F.lit(seed + turn)), F.lit(n)))
    weights = written(data.select("idx").distinct().select("idx", F.lit(0.0).alias("weight")))
    for turn in range(passes):
        place = scratch.folder(spark)
        data.withColumn("part", deal(turn, parts).cast("int")).repartition("part").write.partitionBy("part").parquet(place)
        for part in range(parts):
            _, grad = loss_grad(spark.read.schema(data.schema).parquet(f"{place}/part={part}"), weights) if _there(spark, f"{place}/part={part}") else (None, None)
            if grad is None:
                continue
            moved = weights.join(grad, "idx", "left").select("idx", (F.col("weight") * (1 - 2 * rate * l2) - rate / batch * F.coalesce("grad", F.lit(0.0))).alias("weight"))
            before, weights = weights, written(moved)
            scratch.dropped(before)
        if checkpoint:
            weights.write.mode("overwrite").parquet(f"{checkpoint}/weights_{turn:05d}")
    return weights


def _there(spark, folder: str) -> bool:
    """Whether a batch got any instance."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
