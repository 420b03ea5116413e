"""Evaluation: precision and recall over key sets, partial credit by hierarchy, bags, randomisation tests."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.hierarchy import DECAY

#: The frame that an entity of a class may stand for; name classes that may evoke frames although they are entities.
EXCEPTED = ("Weapon", "WEA")
EVOKING_ENTITIES = ("WEA", "Weapon", "Date", "Month", "Day", "Year", "Time")


def prf(matched: Column, found: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; null where a denominator is zero."""
    p, r = F.try_divide(matched, found), F.try_divide(matched, gold)
    return p, r, F.try_divide(2 * p * r, p + r)


def key_scores(gold: DataFrame, pred: DataFrame, keys: list[str], metric: str, by: str = "sid") -> DataFrame:
    """(sid, metric, numer, pden, rden) of two tables of distinct keys with ``points``: sums over both, pred and gold."""
    g = gold.groupBy(by, *keys).agg(F.max("points").alias("_g"))
    p = pred.groupBy(by, *keys).agg(F.max("points").alias("_p"))
    both = g.join(p, [by, *keys], "full_outer")
    hit = F.col("_g").isNotNull() & F.col("_p").isNotNull()
    zero = F.lit(0.0)
    return both.groupBy(by).agg(
        F.lit(metric).alias("metric"),
        F.sum(F.when(hit, F.col("_g")).otherwise(zero)).alias("numer"),
        F.sum(F.coalesce("_p", zero)).alias("pden"),
        F.sum(F.coalesce("_g", zero)).alias("rden"),
    )


def score_sentences(gold: DataFrame, pred: DataFrame, core: DataFrame) -> DataFrame:
    """(sid, metric, numer, pden, rden) for the span, frame and argument metrics.

    Rows are (sid, t_start, t_stop, frame, role, a_start, a_stop) with null role and span for the frame itself.
    ``core`` is (frame, role, points): 1 for core, less otherwise; the core metrics give 0 to the rest.
    """
    t, a = ["t_start", "t_stop"], ["a_start", "a_stop"]
    one = lambda df: df.withColumn("points", F.lit(1.0))
    frames = [d.where("role is null") for d in (gold, pred)]
    args = [d.where("role is not null") for d in (gold, pred)]
    common = frames[0].select("sid", *t).distinct().join(frames[1].select("sid", *t).distinct(), ["sid", *t])
    exact = frames[0].select("sid", *t, "frame").join(frames[1].select("sid", *t, "frame"), ["sid", *t, "frame"]).distinct()
    only = lambda d, keys: d.join(common if keys is None else exact, ["sid", *t] if keys is None else ["sid", *t, "frame"], "left_semi")
    weighted = [d.join(core, ["frame", "role"], "left").na.fill({"points": 0.5}) for d in args]
    cores = [d.withColumn("points", F.when(F.col("points") >= 1, 1.0).otherwise(0.0)) for d in weighted]
    pairs = lambda ds, f=lambda d: d: [f(d) for d in ds]
    plan = [
        ("targets by span", t, pairs(frames, one)),
        ("frames with correct targets", [*t, "frame"], pairs(frames, one)),
        ("argument spans with correct targets", [*t, *a], pairs(args, one)),
        ("argument spans with correct targets and frames", [*t, "frame", *a], pairs(args, one)),
        ("arguments, labeled", [*t, "frame", *a, "role"], weighted),
        ("core arguments, labeled", [*t, "frame", *a, "role"], cores),
        ("frames (correct targets only)", [*t, "frame"], pairs(frames, lambda d: one(only(d, None)))),
        ("argument spans (correct targets only)", [*t, *a], pairs(args, lambda d: one(only(d, None)))),
        ("argument spans (correct targets and frames only)", [*t, "frame", *a], pairs(args, lambda d: one(only(d, True)))),
        ("arguments, labeled (correct targets and frames only)", [*t, "frame", *a, "role"], pairs(weighted, lambda d: only(d, True))),
        ("core arguments, labeled (correct targets and frames only)", [*t, "frame", *a, "role"], pairs(cores, lambda d: only(d, True))),
    ]
    rows = [key_scores(g, p, keys, name) for name, keys, (g, p) in plan]
    text = lambda d, w: d.select("sid", F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*t, "frame", *a, "role"]]).alias("k"), w.alias("points"))
    total = [text(f, F.lit(1.0)).unionByName(text(w, F.col("points"))) for f, w in zip(frames, weighted, strict=True)]
    rows.append(key_scores(*total, ["k"], "total frames and labeled arguments"))
    tokens = [d.select("sid", F.explode(F.sequence("t_start", F.col("t_stop") - 1)).alias("token")) for d in frames]
    rows.append(key_scores(*pairs(tokens, one), ["token"], "targets by token"))
    return reduce(DataFrame.unionByName, rows)


def accuracy(n: Column, found: Column, gold: Column, only_found: Column, only_gold: Column, numer: Column) -> Column:
    """True decisions among n: all matched if the sets are complete, else n less what only one side has."""
    return F.when((found == n) & (gold == n), numer).otherwise(n - only_found - only_gold)


def corpus_scores(rows: DataFrame) -> DataFrame:
    """(metric, numer, pden, rden, precision, recall, f1) summed over sentences; 0 denominators give NaN."""
    sums = rows.groupBy("metric").agg(*[F.sum(c).alias(c) for c in ("numer", "pden", "rden")])
    p, r, f = (F.coalesce(c, F.lit(float("nan"))) for c in prf(F.col("numer"), F.col("pden"), F.col("rden")))
    return sums.select("*", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def error_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(kind, what, n): missed and extra targets (sid, start, stop, text, postag) by text_POS and by POS."""
    key = ["sid", "start", "stop"]
    missed, extra = gold.join(pred, key, "left_anti"), pred.join(gold, key, "left_anti")
    rows = missed.withColumn("kind", F.lit("missed")).unionByName(extra.withColumn("kind", F.lit("extra")))
    whats = rows.select("kind", F.explode(F.array(F.concat_ws("_", "text", "postag"), F.col("postag"))).alias("what"))
    return whats.groupBy("kind", "what").agg(F.count("*").alias("n"))


def non_target_spans(wsl: DataFrame, ner: DataFrame, gold: DataFrame) -> DataFrame:
    """(sid, start, stop): word status labels and entities that evoke nothing, less those that are gold targets."""
    dull = ner.where(~F.col("name").isin(list(EVOKING_ENTITIES))).select("sid", "start", "stop")
    return wsl.select("sid", "start", "stop").join(gold, ["sid", "start", "stop"], "left_anti").unionByName(dull).distinct()


def span_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(sid, matches, found, gold) of two tables of spans."""
    key = ["sid", "start", "stop"]
    both = gold.select(*key, F.lit(1).alias("_g")).distinct().join(pred.select(*key, F.lit(1).alias("_p")).distinct(), key, "full_outer")
    return both.groupBy("sid").agg(
        F.count_if(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("matches"), F.count("_p").alias("found"), F.count("_g").alias("gold")
    )


def closest_pairs(gold: DataFrame, pred: DataFrame, hops: DataFrame, keys: list[str], frame: str = "label", near: Column | None = None) -> DataFrame:
    """(keys, gold_<frame>, pred_<frame>, hops): labels on one boundary paired exact first, then nearest, each used once.

    Candidates within a boundary are ordered by (distance, names) and taken greedily inside one row. Where ``near`` (a
    condition on the keys) does not hold, only equal labels are candidates.
    """
    g = gold.select(*keys, F.col(frame).alias("g"))
    p = pred.select(*keys, F.col(frame).alias("p"))
    both = g.join(p, keys).join(hops.select(F.col("a").alias("g"), F.col("b").alias("p"), "hops"), ["g", "p"], "left")
    both = both.withColumn("hops", F.when(F.col("g") == F.col("p"), 0).otherwise(F.col("hops"))).where("hops is not null")
    both = both if near is None else both.where(near | (F.col("hops") == 0))
    by = both.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("hops", "g", "p"))).alias("c"))
    none = F.array().cast("array<struct<hops:int,g:string,p:string>>")
    used = lambda acc, c: F.exists(acc, lambda x: (x["g"] == c["g"]) | (x["p"] == c["p"]))
    chosen = F.aggregate("c", none, lambda acc, c: F.when(used(acc, c), acc).otherwise(F.concat(acc, F.array(c))).cast("array<struct<hops:int,g:string,p:string>>"))
    return by.select(*keys, F.explode(chosen).alias("x")).select(*keys, F.col("x.g").alias(f"gold_{frame}"), F.col("x.p").alias(f"pred_{frame}"), "x.hops")


def hierarchical_score(gold: DataFrame, pred: DataFrame, hops: DataFrame, exact: bool = False) -> DataFrame:
    """(sid, match, gold, pred, precision, recall, f1) of frames alone (sid, t_start, t_stop, label, points): a predicted
    label earns its points x 0.8 ^ hops; sentences without gold, or missing from the prediction, are left out."""
    paths = hops.withColumn("paths", F.lit(1).cast("long"))
    typed = lambda df: df.withColumn("kind", F.lit("FR"))
    return semantic_score(typed(gold), typed(pred), None, None, paths, None, exact=exact)


def semantic_score(
    gold: DataFrame,
    pred: DataFrame,
    gold_roles: DataFrame | None,
    pred_roles: DataFrame | None,
    frame_paths: DataFrame,
    role_paths: DataFrame | None,
    exact: bool = False,
    entities: bool = True,
    excepted: tuple[str, str] = EXCEPTED,
) -> DataFrame:
    """(sid, match, gold, pred, precision, recall, f1) with partial credit for near labels.

    ``gold`` and ``pred`` are (sid, t_start, t_stop, kind, label, points) of kind FR (frames), NE (entities) or SU; roles are
    (sid, t_start, t_stop, label: the frame, a_start, a_stop, role, points). Frames on one boundary are paired, exact
    first, then nearest; a pair earns the predicted points x 0.8 ^ hops. Other kinds match exactly or not. A frame of the
    first ``excepted`` name whose boundary has no predicted frame, but an entity of the second, earns the entity's points.
    Roles of paired frames are paired by span, nearest ``frame;role`` first, and earn by :func:`role_credit`.
    ``frame_paths`` and ``role_paths`` are (a, b, hops, paths), nodes of the latter ``frame;role``. Without ``gold_roles`` frames
    alone are scored; ``entities`` false leaves entities out, ``exact`` allows no distance. Sentences whose gold has no
    points, or which the prediction lacks, are left out.
    """
    t = ["sid", "t_start", "t_stop"]
    if not entities:
        gold, pred = gold.where("kind <> 'NE'"), pred.where("kind <> 'NE'")
    worth = gold.select("sid", "points")
    worth = worth if gold_roles is None else worth.unionByName(gold_roles.select("sid", "points"))
    sids = worth.groupBy("sid").agg(F.sum("points").alias("p")).where("p > 0").select("sid").join(pred.select("sid").distinct(), "sid")
    g, p = gold.join(sids, "sid", "left_semi"), pred.join(sids, "sid", "left_semi")
    paths = frame_paths.where("hops = 0") if exact else frame_paths
    pairs = closest_pairs(g, p, paths, [*t, "kind"], near=F.col("kind") == "FR")
    own = p.select(*t, "kind", F.col("label").alias("pred_label"), "points")
    earned = pairs.join(own, [*t, "kind", "pred_label"]).select("sid", (F.col("points") * F.pow(F.lit(DECAY), F.col("hops"))).alias("match"))
    lone = g.where((F.col("kind") == "FR") & (F.col("label") == excepted[0])).select(*t).join(p.where("kind = 'FR'").select(*t), t, "left_anti")
    named = p.where((F.col("kind") == "NE") & (F.col("label") == excepted[1]))
    earned = earned.unionByName(lone.join(named.select(*t, F.col("points").alias("match")), t).select("sid", "match"))
    found = [df.select("sid", "points") for df in (g, p)]
    if gold_roles is not None:
        gr, pr = gold_roles.join(sids, "sid", "left_semi"), pred_roles.join(sids, "sid", "left_semi")
        found = [df.unionByName(roles.select("sid", "points")) for df, roles in zip(found, (gr, pr), strict=True)]
        framed = pairs.where("kind = 'FR'").select(*t, "gold_label", "pred_label")
        span = [*t, "gold_label", "pred_label", "a_start", "a_stop"]
        keyed = lambda df, side: framed.join(df.withColumnRenamed("label", side), [*t, side]).withColumn("node", F.concat_ws(";", side, "role"))
        left, right = keyed(gr, "gold_label"), keyed(pr, "pred_label")
        near = closest_pairs(left, right, role_paths.where("hops = 0") if exact else role_paths, span, frame="node").drop("hops")
        named = lambda df, side: df.select(*span, F.col("node").alias(f"{side}_node"), F.col("role").alias(f"{side}_role"), *(["points"] if side == "pred" else []))
        near = near.join(named(left, "gold"), [*span, "gold_node"]).join(named(right, "pred"), [*span, "pred_node"])
        near = near.select("sid", F.col("gold_label").alias("frame"), F.col("pred_label").alias("other_frame"), F.col("gold_role").alias("role"), F.col("pred_role").alias("other_role"), "points")
        earned = earned.unionByName(role_credit(near, frame_paths, role_paths).select("sid", F.col("earned").alias("match")))
    sums = lambda df, name, c: df.groupBy("sid").agg(F.sum(c).alias(name))
    rows = sums(found[0], "gold", "points").join(sums(found[1], "pred", "points"), "sid").join(sums(earned, "match", "match"), "sid", "left").na.fill({"match": 0.0})
    precision, recall, f1 = prf(F.col("match"), F.col("pred"), F.col("gold"))
    return rows.select("sid", "match", "gold", "pred", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def role_credit(pairs: DataFrame, frame_paths: DataFrame, role_paths: DataFrame) -> DataFrame:
    """Paired roles (frame, other_frame, role, other_role, points) with ``earned``: exact 1, else 0.8 ^ hops times
    min(1, role paths / frame paths), and nothing if the distances of role and frame differ."""
    f = frame_paths.select(F.col("a").alias("frame"), F.col("b").alias("other_frame"), F.col("hops").alias("f_hops"), F.col("paths").alias("f_paths"))
    r = role_paths.select(F.col("a").alias("role_key"), F.col("b").alias("other_key"), F.col("hops").alias("r_hops"), F.col("paths").alias("r_paths"))
    keyed = pairs.withColumns({"role_key": F.concat_ws(";", "frame", "role"), "other_key": F.concat_ws(";", "other_frame", "other_role")})
    rows = keyed.join(f, ["frame", "other_frame"], "left").join(r, ["role_key", "other_key"], "left")
    share = F.least(F.lit(1.0), F.col("r_paths") / F.col("f_paths"))
    credit = F.when(F.col("role_key") == F.col("other_key"), 1.0).when(F.col("r_hops") == F.col("f_hops"), F.pow(F.lit(DECAY), F.col("r_hops")) * share).otherwise(0.0)
    return rows.withColumn("earned", F.col("points") * F.coalesce(credit, F.lit(0.0))).drop("role_key", "other_key", "f_hops", "f_paths", "r_hops", "r_paths")


def hashed_coins(keys: np.ndarray, reps: int) -> np.ndarray:
    """A fair coin for each key (unsigned, 64 bits) and replicate; 64 coins come from one mixed number."""
    x = keys[:, None] + np.arange(1, -(-reps // 64) + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8), axis=1)[:, :reps]


def paired_randomization(a: DataFrame, b: DataFrame, reps: int = 10_000, seed: int = 7, measure: str = "f", two_sided: bool = False, coin=None) -> DataFrame:
    """One row (observed, reps, at_least, p_value): how often swapping each sentence's counts between two systems with a
    fair coin gives a difference as large as observed; p = (n + 1) / (reps + 1), in favour of the first system.

    Rows are (sid, matches, found, gold). A swap moves the difference of a sentence's counts from one system to the other, so
    a replicate is known by three sums of differences. A task multiplies its rows' coins with their differences, block by
    block, and gives one row a replicate; only those are shuffled. ``coin(sids, reps)``, from numpy arrays to a table of
    booleans, may replace the seeded hash; it takes whole numbers as sid. Without sentences there are no replicates.
    """
    names = ["matches", "found", "gold"]
    key = F.col("sid").cast("long") if coin else F.xxhash64("sid", F.lit(seed))
    both = a.select("sid", *[F.col(c).alias(f"a_{c}") for c in names]).join(b.select("sid", *[F.col(c).alias(f"b_{c}") for c in names]), "sid")
    both = both.select(key.alias("key"), *[F.coalesce(F.col(f"{x}_{c}"), F.lit(0)).cast("double").alias(f"{x}_{c}") for x in "ab" for c in names])
    totals = both.agg(*[F.sum(f"{x}_{c}").alias(f"{x}_{c}") for x in "ab" for c in names])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_ = np.zeros((reps, 3)), False
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1) if batch.num_rows else np.zeros((0, 6))
            change, keys, any_ = rows[:, 3:] - rows[:, :3], batch.column(0).to_numpy(), any_ or batch.num_rows > 0
            for at in range(0, len(keys), 256):
                part = slice(at, at + 256)
                heads = coin(keys[part][:, None], np.arange(1, reps + 1)[None, :]) if coin else hashed_coins(keys[part].view(np.uint64), reps)
                sums += heads.T.astype(np.float64) @ change[part]
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, reps + 1)), *(pa.array(sums[:, i].copy()) for i in range(3))], ["rep", *names])

    done = both.mapInArrow(moved, "rep long, matches double, found double, gold double").groupBy("rep").agg(*[F.sum(c).alias(c) for c in names])
    at = {"p": 0, "r": 1, "f": 2}[measure]
    value = lambda sums: F.coalesce(prf(*sums)[at], F.lit(0.0))
    swapped = [value([F.col(f"{x}_{c}") + sign * F.col(c) for c in names]) for x, sign in (("a", 1), ("b", -1))]
    plain = [value([F.col(f"{x}_{c}") for c in names]) for x in "ab"]
    rest = done.crossJoin(F.broadcast(totals))  # one row
    rest = rest.select(F.round(swapped[0] - swapped[1], 12).alias("d"), F.round(plain[0] - plain[1], 12).alias("observed"))
    hit = F.abs("d") >= F.abs("observed") if two_sided else F.col("d") >= F.col("observed")
    out = rest.agg(F.first("observed").alias("observed"), F.count("*").alias("reps"), F.count_if(hit).alias("at_least"))
    return out.withColumn("p_value", (F.col("at_least") + 1) / (F.col("reps") + 1))


def bagged_prf(gold: DataFrame, pred: DataFrame, least: float | None = None) -> DataFrame:
    """(key, matched, found, gold, precision, recall, f1) of bags (group, key[, confidence]): multiset matches in a group,
    by key and (null key) over all; empty denominators give null."""
    p = pred if least is None else pred.where(F.col("confidence") >= least)
    g = gold.groupBy("group", "key").agg(F.count("*").alias("g"))
    p = p.groupBy("group", "key").agg(F.count("*").alias("p"))
    both = g.join(p, ["group", "key"], "full_outer").na.fill(0, ["g", "p"])
    sums = [F.sum(F.least("g", "p")).alias("matched"), F.sum("p").alias("found"), F.sum("g").alias("gold")]
    rows = both.groupBy("key").agg(*sums)
    rows = rows.unionByName(rows.agg(F.lit(None).cast(rows.schema["key"].dataType).alias("key"), *[F.sum(c).alias(c) for c in ("matched", "found", "gold")]))
    precision, recall, f1 = prf(F.col("matched"), F.col("found"), F.col("gold"))
    return rows.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def bag_errors(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(key, missed, extra) over all groups."""
    g = gold.groupBy("group", "key").agg(F.count("*").alias("g"))
    p = pred.groupBy("group", "key").agg(F.count("*").alias("p"))
    both = g.join(p, ["group", "key"], "full_outer").na.fill(0, ["g", "p"])
    over = lambda a, b: F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0)))
    return both.groupBy("key").agg(over("g", "p").alias("missed"), over("p", "g").alias("extra"))


def parse_scorer_log(lines: DataFrame) -> DataFrame:
    """(matched, found, gold, precision, recall, f1) from lines (value) with ``Total: m / f / g``; numbers are summed."""
    number = r"([0-9]+(?:\.[0-9]+)?)"
    pattern = rf"Total:\s*{number}\s*/\s*{number}\s*/\s*{number}"
    rows = lines.where(F.col("value").rlike(pattern)).select(*[F.regexp_extract("value", pattern, i + 1).try_cast("double").alias(n) for i, n in enumerate(("matched", "found", "gold"))])
    sums = rows.agg(*[F.sum(n).alias(n) for n in ("matched", "found", "gold")])
    precision, recall, f1 = prf(F.col("matched"), F.col("found"), F.col("gold"))
    return sums.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))
