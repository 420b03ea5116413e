"""Queries that fit models: by SQL where the optimum has a closed form, else by the gradient at the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fitting, training
from tessera.plans.fixtures import read


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each labelled vector with ten classes: one feature for a class and the sign of the first component."""
    vectors = read(spark, sf, "embeddings").where("label is not null").select("vec_id", "label", (F.element_at("embedding", 1) > 0).cast("long").alias("cell"))
    events = vectors.select(F.col("vec_id").alias("inst"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("cand"), "label", "cell")
    return events.select("inst", "cand", (F.col("cand") * 2 + F.col("cell")).alias("idx"), F.lit(1.0).alias("value"), (F.col("cand") == F.col("label")).alias("gold"), F.lit(0.0).alias("cost"))


CELLS_SQL = """WITH v AS (SELECT vec_id, label, (embedding[1] > 0)::INTEGER AS cell FROM embeddings WHERE label IS NOT NULL), x AS (SELECT c.c AS cand, s.s AS cell FROM range(10) c(c), range(2) s(s))"""


def q_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Weights fitted to the vectors' labels by the sign of their first component. Without a penalty the best ones are
    the logarithms of counts, less their mean within a cell."""
    weights = fitting.fit(_cells(spark, sf), l2=0.0, tolerance=1e-6)
    return weights.select((F.col("idx")).alias("idx"), (F.round("weight", 3) + 0.0).alias("weight"))


FIT_SQL = CELLS_SQL + """, n AS (SELECT cand, x.cell, ln(COUNT(vec_id)) AS l FROM x LEFT JOIN v ON label = cand AND v.cell = x.cell GROUP BY ALL)
SELECT (cand * 2 + cell)::BIGINT AS idx, round(l - AVG(l) OVER (PARTITION BY cell), 3) + 0.0 AS weight FROM n"""


def q_fit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A penalised model of the labels by all components: for each class its vectors, and whether the gradient of loss and
    penalty, computed anew at the result, is null for all its weights."""
    vectors = read(spark, sf, "embeddings").where("label is not null").select("vec_id", "label", F.posexplode("embedding").alias("j", "x"))
    events = vectors.select(F.col("vec_id").alias("inst"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("cand"), "label", "j", F.col("x").cast("double").alias("value"))
    events = events.select("inst", "cand", (F.col("cand") * 1000 + F.col("j")).cast("long").alias("idx"), "value", (F.col("cand") == F.col("label")).alias("gold"))
    weights = fitting.fit(events, l2=1.0, tolerance=1e-4)
    _, grad = training.softmax_loss_grad(events, weights)
    pulled = grad.join(weights, "idx").select(F.floor(F.col("idx") / 1000).cast("int").alias("label"), F.abs(F.col("grad") + 2 * F.col("weight")).alias("g"))
    null = pulled.groupBy("label").agg((F.max("g") < 1e-2).alias("optimal"), F.count("*").alias("weights"))
    rows = read(spark, sf, "embeddings").where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    return rows.join(null, "label").select("label", "n", "weights", "optimal")


FIT_VECTORS_SQL = "SELECT label, COUNT(*) AS n, MAX(len(embedding))::BIGINT AS weights, true AS optimal FROM embeddings WHERE label IS NOT NULL GROUP BY label"


def q_minibatch(spark: SparkSession, sf: str) -> DataFrame:
    """Weights after two steps of half the vectors each."""
    events = _cells(spark, sf)
    n = events.select("inst").distinct().count()
    half = lambda _, parts: F.pmod(F.col("inst"), F.lit(2))
    weights = fitting.minibatch_sgd(events, passes=1, batch=-(-n // 2), rate=2.0, l2=0.01, deal=half)
    return weights.select("idx", (F.round("weight", 6) + 0.0).alias("weight"))


MINIBATCH_SQL = CELLS_SQL + """, b AS (SELECT (COUNT(*) + 1) // 2 AS b FROM v),
g1 AS (SELECT cand, x.cell, SUM(0.1 - (label = cand)::INTEGER) AS g FROM x JOIN v ON v.cell = x.cell AND vec_id % 2 = 0 GROUP BY ALL),
w1 AS (SELECT cand, x.cell, -2.0 / b * COALESCE(g, 0) AS w FROM x LEFT JOIN g1 USING (cand, cell), b), z AS (SELECT cell, SUM(exp(w)) AS z FROM w1 GROUP BY cell),
g2 AS (SELECT cand, w1.cell, SUM(exp(w) / z - (label = cand)::INTEGER) AS g FROM w1 JOIN z USING (cell) JOIN v ON v.cell = w1.cell AND vec_id % 2 = 1 GROUP BY ALL)
SELECT (cand * 2 + cell)::BIGINT AS idx, round(w * (1 - 2 * 2.0 * 0.01) - 2.0 / b * COALESCE(g, 0), 6) + 0.0 AS weight FROM w1 LEFT JOIN g2 USING (cand, cell), b"""


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    first = [F.element_at("embedding", k + 1).cast("double").alias(f"x{k}") for k in range(4)]
    return read(spark, sf, "embeddings").where("label is not null").select("vec_id", F.col("label").cast("double").alias("label"), *first)


NAMES = [f"x{k}" for k in range(4)]


def q_multinomial(spark: SparkSession, sf: str) -> DataFrame:
    """A multinomial regression of the labels on four components, its penalty chosen by cross-validation: each class's
    vectors, and whether the mean loss's gradient and the penalty's, on components scaled to deviation one, cancel out."""
    rows = _rows(spark, sf)
    best = training.multinomial_cv(rows, NAMES, "label", grid=(1.0, 0.1), folds=3).bestModel.stages[-1]
    penalty, coefficients, intercepts = best.getOrDefault("regParam"), best.coefficientMatrix.toArray().tolist(), best.interceptVector.toArray().tolist()
    classes = [float(k) for k in range(len(intercepts))]
    score = [F.exp(F.lit(b) + sum((F.lit(w) * F.col(n) for w, n in zip(ws, NAMES, strict=True)), F.lit(0.0))) for ws, b in zip(coefficients, intercepts, strict=True)]
    scored = rows.withColumn("e", F.array(*score)).withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    share = [F.get("e", F.lit(int(k))) / F.col("z") - (F.col("label") == k).cast("double") for k in classes]
    # In the scaled space a component x of deviation d is x / d, its weight d w.
    scale = rows.agg(*[F.stddev_samp(n).alias(f"d{n}") for n in NAMES])
    sums = scored.crossJoin(F.broadcast(scale)).agg(
        F.array(*[F.greatest(F.abs(F.avg(s)), *[F.abs(F.avg(s * F.col(n) / F.col(f"d{n}")) + penalty * w * F.first(f"d{n}")) for w, n in zip(ws, NAMES, strict=True)]) for s, ws in zip(share, coefficients, strict=True)]).alias("g")
    )
    null = sums.select(F.posexplode("g").alias("label", "g")).select(F.col("label"), (F.col("g") < 1e-3).alias("optimal"))
    return rows.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n")).join(null, "label")


MULTINOMIAL_SQL = "SELECT label, COUNT(*) AS n, true AS optimal FROM embeddings WHERE label IS NOT NULL GROUP BY label"


def q_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """A binary regression and a forest on the vectors' first components: rows of either, and whether each guesses better
    than the commonest class, the forest alike when grown again from its seed."""
    rows = _rows(spark, sf)
    binary = rows.withColumn("label", (F.col("label") < 5).cast("double"))
    train, dev = binary.where("vec_id % 3 > 0"), binary.where("vec_id % 3 = 0")
    accuracy = training.binary_logistic(train, dev, dev, NAMES)
    share = rows.groupBy("label").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("common"), F.sum("n").alias("n"))
    trees = [training.random_forest(rows, NAMES, "label", trees=20, seed=3).transform(rows).select("vec_id", "label", "prediction") for _ in range(2)]
    again = trees[0].join(trees[1].select("vec_id", F.col("prediction").alias("again")), "vec_id")
    forest = again.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("hit"), F.bool_and(F.col("prediction") == F.col("again")).alias("stable"))
    halves = binary.agg(F.greatest(F.avg("label"), 1 - F.avg("label")).alias("half"))
    out = share.crossJoin(forest).crossJoin(halves)  # one row each
    return out.select("n", F.round("common", 6).alias("common"), (F.col("hit") > F.col("common")).alias("forest_better"), "stable", (F.lit(accuracy["train"]) >= F.col("half") - 0.02).alias("regression_holds"))


BASELINES_SQL = """WITH c AS (SELECT label, COUNT(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label)
SELECT SUM(n)::BIGINT AS n, round(MAX(n) / SUM(n), 6) AS common, true AS forest_better, true AS stable, true AS regression_holds FROM c"""

FUNCTIONS = (q_fit, q_fit_vectors, q_minibatch, q_multinomial, q_baselines)
QUERIES = {f.__name__: f for f in FUNCTIONS}
ORACLES = {"q_fit": FIT_SQL, "q_fit_vectors": FIT_VECTORS_SQL, "q_minibatch": MINIBATCH_SQL, "q_multinomial": MULTINOMIAL_SQL, "q_baselines": BASELINES_SQL}
