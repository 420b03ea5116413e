"""Frame hierarchies: closures, hop distances, path counts, costs, co-occurrence, roll-ups.

Edges are (sup, sub, relation). Closures double their reach each round, so a chain of n nodes takes log n rounds; each round
is written to the shared folder of the session, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.scratch import bucketed, written

MAX_HOPS, DECAY = 9, 0.8


def parents(edges: DataFrame, relation: str | None = None) -> DataFrame:
    """(node, parent)."""
    kept = edges if relation is None else edges.where(F.col("relation") == relation)
    return kept.select(F.col("sub").alias("node"), F.col("sup").alias("parent")).distinct()


def children(edges: DataFrame, relation: str | None = None) -> DataFrame:
    """(node, child)."""
    kept = edges if relation is None else edges.where(F.col("relation") == relation)
    return kept.select(F.col("sup").alias("node"), F.col("sub").alias("child")).distinct()


def ancestors(edges: DataFrame, relation: str | None = "Inheritance") -> DataFrame:
    """(node, ancestor, hops) with the fewest hops, however deep; circles end as no pair is entered twice."""
    steps = parents(edges, relation).select(F.col("node").alias("a"), F.col("parent").alias("b"))
    return closure(steps).select(F.col("a").alias("node"), F.col("b").alias("ancestor"), "hops")


def descendants(edges: DataFrame, relation: str | None = "Inheritance") -> DataFrame:
    """(node, descendant, hops): the same from above."""
    return ancestors(edges, relation).select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "hops")


def closure(steps: DataFrame, most: int | None = None, counts: bool = False, arrivals: bool = False) -> DataFrame:
    """(a, b, hops[, paths]) of all pairs a <> b that steps (a, b) lead between, or that ``most`` of them do.

    After round k all pairs within 2^k hops are known. A shortest path of up to twice that passes one node exactly 2^k from its
    start: pairs at just that distance meet all known ones, which gives the new pairs, their hops and, as sums of
    products, their numbers of shortest paths (``paths``). It ends when no pair has the full distance. With ``arrivals`` a
    node's number is that of the nodes one hop nearer to the start that lead to it.

    Known pairs lie in buckets of their first node. So a round shuffles the pairs of full distance, which are few, and what
    they lead to, each once; it never moves what is known.
    """
    steps = written(steps.where("a <> b").distinct())
    known = newest = bucketed(steps.select("a", "b", F.lit(1).alias("hops"), F.lit(1).cast("long").alias("paths")), "a")
    reach, parts = 1, int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while most is None or reach < most:
        far = newest.where(F.col("hops") == reach).select("a", F.col("b").alias("mid"), F.col("paths").alias("p"))
        if far.isEmpty():
            break
        near = known.select(F.col("a").alias("mid"), "b", F.col("hops").alias("h"), "paths")
        ahead = far.join(near.hint("merge"), "mid").where(F.col("a") != F.col("b"))
        ahead = ahead.select("a", "b", (F.col("h") + reach).alias("hops"), (F.col("p") * F.col("paths")).alias("paths"))
        ahead = ahead if most is None else ahead.where(F.col("hops") <= most)
        # Known pairs are nearer than all these, so the least hops of a pair tell whether it is new.
        every = known.unionByName(ahead.repartition(parts, "a"))
        if counts:
            least = every.groupBy("a", "b", "hops").agg(F.sum("paths").alias("paths"))
            least = least.groupBy("a", "b").agg(F.min(F.struct("hops", "paths")).alias("m")).select("a", "b", "m.hops", "m.paths")
        else:  # hops alone are summed up without sorting
            least = every.groupBy("a", "b").agg(F.min("hops").alias("hops")).withColumn("paths", F.lit(1).cast("long"))
        newest = bucketed(least.where(F.col("hops") > reach), "a", dealt=True)
        known, reach = known.unionByName(newest), 2 * reach
    if counts and arrivals:
        before = known.select("a", F.col("b").alias("mid"), F.col("hops").alias("h")).join(steps.select(F.col("a").alias("mid"), "b"), "mid")
        led = before.join(known.select("a", "b", "hops"), ["a", "b"]).where("h + 1 = hops").groupBy("a", "b").agg(F.count("*").alias("led"))
        known = known.join(led, ["a", "b"], "left").select("a", "b", "hops", F.coalesce("led", F.lit(1)).cast("long").alias("paths"))
    return known if counts else known.drop("paths")


def balls(steps: DataFrame, centres: DataFrame, radius: int) -> DataFrame:
    """(centre, node, hops) of all nodes within ``radius`` steps (a, b) of the given centres (node), themselves included."""
    seen = frontier = written(centres.select(F.col("node").alias("centre"), "node", F.lit(0).alias("hops")).distinct())
    for hop in range(1, radius + 1):
        ahead = frontier.select("centre", F.col("node").alias("a")).join(steps, "a").select("centre", F.col("b").alias("node"), F.lit(hop).alias("hops")).distinct()
        frontier = written(ahead.join(seen.select("centre", "node"), ["centre", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def pair_distances(edges: DataFrame, pairs: DataFrame, most: int = MAX_HOPS, without: tuple[str, ...] = ("See_also",)) -> DataFrame:
    """(a, b, hops) for the given pairs, null beyond ``most`` hops; edges count both ways.

    Only the pairs' own nodes are walked from, each half of the way, and balls meet in the middle: nothing of the size of
    all pairs is made.
    """
    steps = written(undirected(edges, without))
    wanted = pairs.select("a", "b").distinct()
    left = balls(steps, wanted.select(F.col("a").alias("node")), -(-most // 2)).select(F.col("centre").alias("a"), "node", F.col("hops").alias("h1"))
    right = balls(steps, wanted.select(F.col("b").alias("node")), most // 2).select(F.col("centre").alias("b"), "node", F.col("hops").alias("h2"))
    met = wanted.join(left, "a").join(right, ["b", "node"]).groupBy("a", "b").agg(F.min(F.col("h1") + F.col("h2")).alias("hops"))
    return wanted.join(met, ["a", "b"], "left")


def undirected(edges: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """Steps (a, b) both ways."""
    kept = edges.where(~F.col("relation").isin(list(without))) if without else edges
    one = kept.select(F.col("sup").alias("a"), F.col("sub").alias("b"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def distances(edges: DataFrame, directed: bool = False, most: int = MAX_HOPS, without: tuple[str, ...] = ("See_also",)) -> DataFrame:
    """(a, b, hops) for all pairs within ``most`` hops, in both directions unless ``directed`` (from sup to sub)."""
    steps = edges.select(F.col("sup").alias("a"), F.col("sub").alias("b")) if directed else undirected(edges, without)
    return closure(steps, most)


def hop_cost(hops: Column, decay: float = DECAY) -> Column:
    """1 - 0.8 ^ hops; unreachable (null) costs 1."""
    return F.coalesce(1 - F.pow(F.lit(decay), hops), F.lit(1.0))


def path_counts(edges: DataFrame, most: int = MAX_HOPS, without: tuple[str, ...] = ("See_also",), arrivals: bool = False) -> DataFrame:
    """(a, b, hops, paths): number of shortest paths."""
    return closure(undirected(edges, without), most, counts=True, arrivals=arrivals)


def shortest_path(edges: DataFrame, pairs: DataFrame, most: int = MAX_HOPS, without: tuple[str, ...] = ("See_also",)) -> DataFrame:
    """(a, b, path): nodes of one shortest path, of several the first by name; pairs out of reach are left out."""
    steps = written(undirected(edges, without))
    wanted = pairs.select(F.col("a").alias("start"), F.col("b").alias("goal")).distinct()
    frontier = wanted.select("start").distinct().select("start", F.col("start").alias("at"), F.array("start").alias("path"))
    seen = frontier = written(frontier)
    for _ in range(most):
        ahead = frontier.join(steps.select(F.col("a").alias("at"), F.col("b").alias("next")), "at")
        ahead = ahead.select("start", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
        ahead = ahead.groupBy("start", "at").agg(F.min("path").alias("path"))
        frontier = written(ahead.join(seen.select("start", "at"), ["start", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    found = wanted.join(seen.withColumnRenamed("at", "goal"), ["start", "goal"])
    return found.select(F.col("start").alias("a"), F.col("goal").alias("b"), "path")


def add_ancestors(targets: DataFrame, roles: DataFrame, frame_closure: DataFrame, role_closure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets (sid, target, frame) with their frames' ancestors; roles (sid, target, frame, role) with (role, frame)
    pairs above them, equal names left out."""
    up = targets.join(frame_closure.withColumnRenamed("node", "frame"), "frame", "left")
    up = up.groupBy("sid", "target", "frame").agg(F.array_sort(F.collect_set("ancestor")).alias("ancestors"))
    over = roles.join(role_closure, ["frame", "role"], "left")
    pair = F.when(F.col("super_role") != F.col("role"), F.struct("super_role", "super_frame"))
    over = over.groupBy("sid", "target", "frame", "role").agg(F.array_sort(F.collect_set(pair)).alias("ancestors"))
    return up, over


def pmi(members: DataFrame, least: int = 4, block: int = 256) -> DataFrame:
    """(a, b, n, pmi) for unordered pairs of names (group, name) that stand in one group, both seen ``least`` times.

    log(pair) - log(pairs) - log(a) - log(b) + 2 log(all). Names are cut by count, then counted within groups, so that a name's
    repeats are one number. A group's names are dealt into blocks of about ``block``; each pair of blocks is a row of its own,
    so a group of any size is spread over many tasks and no row holds more than two blocks.
    """
    frequent = members.groupBy("name").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    whole = members.groupBy("group").agg(F.count("*").alias("k")).agg(F.sum("k").alias("all"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("pairs"))
    held = written(members.join(frequent, "name").groupBy("group", "name").agg(F.count("*").alias("m"), F.first("c").alias("c")))
    sizes = held.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = held.join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    lists = dealt.groupBy("group", "own", "blocks").agg(F.collect_list(F.struct("name", "m", "c")).alias("x"))
    dealt = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = dealt.groupBy("group", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(
        F.first(F.when(F.col("own") <= F.col("other"), F.col("x")), ignorenulls=True).alias("x"), F.first(F.when(F.col("own") >= F.col("other"), F.col("x")), ignorenulls=True).alias("y")
    )
    pair = lambda p, q, n: F.struct(
        F.least(p["name"], q["name"]).alias("a"), F.greatest(p["name"], q["name"]).alias("b"), n.alias("n"),
        F.when(p["name"] <= q["name"], p["c"]).otherwise(q["c"]).alias("ca"), F.when(p["name"] <= q["name"], q["c"]).otherwise(p["c"]).alias("cb"),
    )
    inner = F.col("lo") == F.col("hi")
    left = both.select("y", inner.alias("inner"), F.explode("x").alias("p")).withColumn("q", F.explode(F.when(F.col("inner"), F.filter("y", lambda q: q["name"] >= F.col("p.name"))).otherwise(F.col("y"))))
    p, q = F.col("p"), F.col("q")
    times = F.when(p["name"] == q["name"], p["m"] * (p["m"] - 1) / 2).otherwise(p["m"] * q["m"]).cast("long")
    sums = left.select(pair(p, q, times).alias("s")).select("s.*").where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("ca").alias("ca"), F.first("cb").alias("cb"))
    sums = sums.crossJoin(F.broadcast(whole))  # one row
    value = F.log("n") - F.log("pairs") - F.log("ca") - F.log("cb") + 2 * F.log("all")
    return sums.select("a", "b", "n", value.alias("pmi"))


def counts_with_ancestors(counts: DataFrame, closed: DataFrame) -> DataFrame:
    """Counts (node, n) rolled up: each node's own and those of all below it."""
    above = counts.join(closed, "node").select(F.col("ancestor").alias("node"), "n")
    return counts.select("node", "n").unionByName(above).groupBy("node").agg(F.sum("n").alias("n"))


def core_status(items: DataFrame, roles: DataFrame, other: float = 0.5) -> DataFrame:
    """Items (frame, role, ...) with ``points``: 1 for a core role, else ``other``."""
    core = roles.where(F.lower("core_type").startswith("core")).select("frame", "role", F.lit(1.0).alias("points")).distinct()
    return items.join(core, ["frame", "role"], "left").na.fill({"points": other})


def frame_cost(pairs: DataFrame, costs: DataFrame, default: float = 1.0) -> DataFrame:
    """Pairs (gold, pred, ...) with ``cost`` by lookup."""
    return pairs.join(costs, ["gold", "pred"], "left").na.fill({"cost": default})
