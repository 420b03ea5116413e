"""Queries over dependency trees, candidate spans and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import arguments, hierarchy, trees
from tessera.plans.fixtures import ITEM_TOKENS_SQL, item_tokens, read


def tokens_of(spark: SparkSession, sf: str) -> DataFrame:
    return item_tokens(read(spark, sf, "benchmark"))


def q_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return trees.ancestors(tokens_of(spark, sf))


UP_SQL = f"""
WITH RECURSIVE tok AS MATERIALIZED ({ITEM_TOKENS_SQL}), up AS (
 SELECT sid, id, head AS ancestor, 1 AS hops FROM tok WHERE head > 0
 UNION ALL SELECT up.sid, up.id, tok.head, hops + 1 FROM up JOIN tok ON tok.sid = up.sid AND tok.id = up.ancestor WHERE tok.head > 0),
cons AS (SELECT sid, id, MIN(o) AS first, MAX(o) AS last FROM (SELECT sid, id, id AS o FROM tok UNION ALL SELECT sid, ancestor, id FROM up) c GROUP BY ALL)
"""


def q_constituents(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of subtrees with depth and sizes by side."""
    tokens = tokens_of(spark, sf)
    return trees.constituents(tokens).join(trees.depth(tokens), ["sid", "id"]).join(trees.sides(tokens), ["sid", "id"])


CONSTITUENTS_SQL = (
    UP_SQL
    + """, d AS (SELECT tok.sid, tok.id, 1 + COUNT(ancestor) AS depth FROM tok LEFT JOIN up ON up.sid = tok.sid AND up.id = tok.id GROUP BY ALL),
k AS (SELECT sid, head AS id, COUNT_IF(id < head)::BIGINT AS lc, COUNT_IF(id > head)::BIGINT AS rc FROM tok GROUP BY ALL),
e AS (SELECT sid, ancestor AS id, COUNT_IF(id < ancestor)::BIGINT AS ld, COUNT_IF(id > ancestor)::BIGINT AS rd FROM up GROUP BY ALL)
SELECT cons.sid, cons.id, first, last, depth, COALESCE(lc, 0) AS left_children, COALESCE(rc, 0) AS right_children, COALESCE(ld, 0) AS left_descendants, COALESCE(rd, 0) AS right_descendants
FROM cons JOIN d USING (sid, id) LEFT JOIN k USING (sid, id) LEFT JOIN e USING (sid, id)"""
)


def q_lca(spark: SparkSession, sf: str) -> DataFrame:
    """Lowest common ancestor of each token and the one three places on."""
    tokens = tokens_of(spark, sf)
    last = tokens.groupBy("sid").agg(F.max("id").alias("n"))
    pairs = tokens.join(last, "sid").where("id + 3 <= n").select("sid", F.col("id").alias("a"), (F.col("id") + 3).alias("b"))
    return trees.path(tokens, pairs).select("sid", "a", "b", "lca", "path")


LCA_SQL = (
    UP_SQL
    + """, s AS (SELECT sid, id, ancestor, hops FROM up UNION ALL SELECT sid, id, id, 0 FROM tok),
p AS (SELECT a.sid, a.id AS a, b.id AS b FROM tok a JOIN tok b ON a.sid = b.sid AND b.id = a.id + 3),
l AS (SELECT p.sid, a, b, COALESCE(arg_min(x.ancestor, x.hops), 0) AS lca, COALESCE(MIN(x.hops), 99) AS ha, COALESCE(MIN(y.hops), 99) AS hb FROM p
  LEFT JOIN (s x JOIN s y ON x.sid = y.sid AND x.ancestor = y.ancestor) ON x.sid = p.sid AND x.id = a AND y.id = b GROUP BY ALL),
la AS (SELECT l.sid, a, b, string_agg('^' || deprel, '' ORDER BY s.hops) AS t FROM l JOIN s ON s.sid = l.sid AND s.id = a AND s.hops > 0 AND s.hops < ha JOIN tok ON tok.sid = s.sid AND tok.id = s.ancestor GROUP BY ALL),
lb AS (SELECT l.sid, a, b, string_agg('!' || deprel, '' ORDER BY s.hops DESC) AS t FROM l JOIN s ON s.sid = l.sid AND s.id = b AND s.hops < hb JOIN tok ON tok.sid = s.sid AND tok.id = s.ancestor GROUP BY ALL)
SELECT l.sid, l.a, l.b, lca::INTEGER AS lca, '=' || ta.deprel || COALESCE(la.t, '') || CASE WHEN lca = l.a THEN '' ELSE '^' || COALESCE(tl.deprel, 'ROOT') END || COALESCE(lb.t, '') AS path
FROM l JOIN tok ta ON ta.sid = l.sid AND ta.id = l.a LEFT JOIN tok tl ON tl.sid = l.sid AND tl.id = lca LEFT JOIN la ON la.sid = l.sid AND la.a = l.a AND la.b = l.b LEFT JOIN lb ON lb.sid = l.sid AND lb.a = l.a AND lb.b = l.b"""
)


def q_voice(spark: SparkSession, sf: str) -> DataFrame:
    return trees.voice(tokens_of(spark, sf))


VOICE_SQL = (
    UP_SQL
    + """, v AS (SELECT tok.sid, tok.id, tok.postag, lower(tok.form) AS form, hops,
  CASE WHEN a.postag LIKE 'NN%' OR lower(a.form) IN ('be','am','is','are','was','were','been','being') THEN 'PAS' WHEN lower(a.form) IN ('have','has','had','having') THEN 'ACT'
   WHEN a.postag IN ('VBZ','VBD','VBP','MD') THEN 'PAS' END AS verdict
  FROM tok LEFT JOIN up ON up.sid = tok.sid AND up.id = tok.id LEFT JOIN tok a ON a.sid = tok.sid AND a.id = up.ancestor WHERE tok.postag LIKE 'V%')
SELECT sid, id, CASE WHEN form = 'been' OR postag <> 'VBN' THEN 'ACT' ELSE COALESCE(arg_min(verdict, hops) FILTER (verdict IS NOT NULL), 'PAS') END AS voice FROM v GROUP BY sid, id, form, postag"""
)


def mirrored(spark: SparkSession, sf: str) -> DataFrame:
    """Items' tokens with every second sentence mirrored, so that dependents stand on both sides."""
    tokens = tokens_of(spark, sf)
    last = tokens.groupBy("sid").agg(F.max("id").alias("n"))
    odd = F.col("sid") % 2 == 1
    moved = tokens.join(last, "sid")
    new_id = F.when(odd, F.col("n") + 1 - F.col("id")).otherwise(F.col("id"))
    new_head = F.when(odd & (F.col("head") > 0), F.col("n") + 1 - F.col("head")).otherwise(F.col("head"))
    return moved.withColumns({"id": new_id.cast("int"), "head": new_head.cast("int")}).drop("n")


MIRROR_SQL = f"""
WITH RECURSIVE tok0 AS ({ITEM_TOKENS_SQL}), l AS (SELECT sid, MAX(id) AS n FROM tok0 GROUP BY sid),
tok AS MATERIALIZED (SELECT sid, CASE WHEN sid % 2 = 1 THEN n + 1 - id ELSE id END AS id, CASE WHEN sid % 2 = 1 AND head > 0 THEN n + 1 - head ELSE head END AS head, form, postag, deprel FROM tok0 JOIN l USING (sid)),
up AS (SELECT sid, id, head AS ancestor FROM tok WHERE head > 0 UNION ALL SELECT up.sid, up.id, tok.head FROM up JOIN tok ON tok.sid = up.sid AND tok.id = up.ancestor WHERE tok.head > 0),
cons AS (SELECT sid, id, MIN(o) AS first, MAX(o) AS last FROM (SELECT sid, id, id AS o FROM tok UNION ALL SELECT sid, ancestor, id FROM up) c GROUP BY ALL)
"""


def q_candidate_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate spans of every item; dependents are on one side of each head, so no half constituents arise."""
    return arguments.candidate_spans(mirrored(spark, sf))


SPANS_SQL = MIRROR_SQL + """SELECT DISTINCT sid, (a - 1)::INTEGER AS start, (b - 1)::INTEGER AS stop FROM
 (SELECT sid, first AS a, last AS b FROM cons UNION ALL SELECT sid, id, id FROM tok UNION ALL SELECT sid, 0, 0 FROM tok) u"""


def q_signature_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans whose tag signature constituents have, counted by sentence."""
    tokens = tokens_of(spark, sf)
    gold = trees.constituents(tokens).select("sid", (F.col("first") - 1).cast("int").alias("start"), (F.col("last") - 1).cast("int").alias("stop"))
    kept = arguments.pos_boundary_filter(tokens, gold, tokens, 3)
    return kept.groupBy("sid").agg(F.count("*").alias("spans"), F.sum(F.col("stop") - F.col("start") + 1).alias("tokens"))


SIGNATURE_SQL = (
    UP_SQL
    + """, tg AS (SELECT sid, list(postag ORDER BY id) AS t FROM tok GROUP BY sid),
p AS (SELECT sid, t, a AS start, b AS stop FROM tg, unnest(range(0, len(t))) AS x(a), unnest(range(a, len(t))) AS y(b)),
g AS (SELECT cons.sid, t, first - 1 AS start, last - 1 AS stop FROM cons JOIN tg USING (sid)),
sp AS (SELECT sid, start, stop, t[start + 1] || '_' || CASE WHEN start + 1 <= stop THEN t[start + 2] ELSE '-' END || '_' || t[stop + 1] AS s FROM p),
sg AS (SELECT t[start + 1] || '_' || CASE WHEN start + 1 <= stop THEN t[start + 2] ELSE '-' END || '_' || t[stop + 1] AS s FROM g),
known AS (SELECT s FROM sg GROUP BY s HAVING COUNT(*) >= 3)
SELECT sid, COUNT(*) AS spans, SUM(stop - start + 1)::BIGINT AS tokens FROM sp WHERE s IN (SELECT s FROM known) GROUP BY sid"""
)


def place_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Regions over nations over market segments, and segments beside each other, as a small hierarchy."""
    regions, nations = read(spark, sf, "region"), read(spark, sf, "nation")
    up = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("sup"), F.col("n_name").alias("sub"))
    root = regions.select(F.lit("WORLD").alias("sup"), F.col("r_name").alias("sub"))
    sold = read(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("sup"), F.col("c_mktsegment").alias("sub")).distinct()
    return root.unionByName(up).unionByName(sold).withColumn("relation", F.lit("Inheritance"))


EDGES_SQL = """
WITH RECURSIVE e AS MATERIALIZED (SELECT 'WORLD' AS sup, r_name AS sub FROM region UNION SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION SELECT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def q_hierarchy_closure(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.ancestors(place_edges(spark, sf))


CLOSURE_SQL = EDGES_SQL + """, up AS (SELECT sub AS node, sup AS ancestor, 1 AS hops FROM e UNION SELECT node, sup, hops + 1 FROM up JOIN e ON sub = ancestor)
SELECT node, ancestor, MIN(hops)::INTEGER AS hops FROM up GROUP BY ALL"""


def q_hop_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Undirected hop distances, shortest paths and costs between all places."""
    paths = hierarchy.path_counts(place_edges(spark, sf), without=())
    return paths.withColumn("cost", F.round(hierarchy.hop_cost(F.col("hops")), 6))


HOPS_SQL = EDGES_SQL + """, st AS MATERIALIZED (SELECT sup AS a, sub AS b FROM e UNION SELECT sub, sup FROM e),
l1 AS (SELECT a, b, 1 AS hops, 1::HUGEINT AS paths FROM st),
l2 AS MATERIALIZED (SELECT l.a, s.b, 2 AS hops, SUM(paths) AS paths FROM l1 l JOIN st s ON l.b = s.a WHERE l.a <> s.b AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.a = l.a AND x.b = s.b) GROUP BY ALL),
s2 AS MATERIALIZED (SELECT * FROM l1 UNION ALL SELECT * FROM l2),
l3 AS MATERIALIZED (SELECT l.a, s.b, 3 AS hops, SUM(paths) AS paths FROM l2 l JOIN st s ON l.b = s.a WHERE l.a <> s.b AND NOT EXISTS (SELECT 1 FROM s2 x WHERE x.a = l.a AND x.b = s.b) GROUP BY ALL),
s3 AS MATERIALIZED (SELECT * FROM s2 UNION ALL SELECT * FROM l3),
l4 AS MATERIALIZED (SELECT l.a, s.b, 4 AS hops, SUM(paths) AS paths FROM l3 l JOIN st s ON l.b = s.a WHERE l.a <> s.b AND NOT EXISTS (SELECT 1 FROM s3 x WHERE x.a = l.a AND x.b = s.b) GROUP BY ALL),
s4 AS MATERIALIZED (SELECT * FROM s3 UNION ALL SELECT * FROM l4),
l5 AS MATERIALIZED (SELECT l.a, s.b, 5 AS hops, SUM(paths) AS paths FROM l4 l JOIN st s ON l.b = s.a WHERE l.a <> s.b AND NOT EXISTS (SELECT 1 FROM s4 x WHERE x.a = l.a AND x.b = s.b) GROUP BY ALL)
SELECT a, b, hops::INTEGER AS hops, paths::BIGINT AS paths, round(1 - pow(0.8::DOUBLE, hops), 6) AS cost FROM (SELECT * FROM s4 UNION ALL SELECT * FROM l5) u"""


def q_shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    """One shortest path from the root to every market segment."""
    edges = place_edges(spark, sf)
    goals = read(spark, sf, "customer").select(F.lit("WORLD").alias("a"), F.col("c_mktsegment").alias("b")).distinct()
    return hierarchy.shortest_path(edges, goals, without=()).select("a", "b", F.array_join("path", ">").alias("path"))


SHORTEST_SQL = EDGES_SQL + """SELECT 'WORLD' AS a, e3.sub AS b, MIN('WORLD>' || e2.sup || '>' || e3.sup || '>' || e3.sub) AS path
 FROM e e2 JOIN e e3 ON e2.sub = e3.sup WHERE e2.sup <> 'WORLD' GROUP BY ALL"""


def q_pmi(spark: SparkSession, sf: str) -> DataFrame:
    """Mutual information of part brands in one order."""
    items = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    members = items.select(F.col("l_orderkey").alias("group"), F.col("p_brand").alias("name"))
    return hierarchy.pmi(members).withColumn("pmi", F.round("pmi", 6))


PMI_SQL = """
WITH m AS (SELECT l_orderkey AS g, p_brand AS name FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT name, COUNT(*) AS c FROM m GROUP BY name HAVING COUNT(*) >= 4),
n AS (SELECT g, ROW_NUMBER() OVER (PARTITION BY g ORDER BY name) AS i, name FROM m JOIN c USING (name)),
p AS (SELECT x.name AS a, y.name AS b, COUNT(*) AS n FROM n x JOIN n y ON x.g = y.g AND x.i < y.i GROUP BY ALL),
t AS (SELECT COUNT(*) AS n FROM m), q AS (SELECT SUM(k * (k - 1) / 2) AS n FROM (SELECT COUNT(*) AS k FROM m GROUP BY g) z)
SELECT a, b, p.n, round(ln(p.n) - ln(q.n) - ln(ca.c) - ln(cb.c) + 2 * ln(t.n), 6) AS pmi FROM p, t, q, c ca, c cb WHERE ca.name = a AND cb.name = b"""


def q_ancestor_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by place, rolled up to nations, regions and the root."""
    edges = place_edges(spark, sf).join(read(spark, sf, "nation").select(F.col("n_name").alias("sub")).unionByName(read(spark, sf, "region").select("r_name").toDF("sub")), "sub", "left_semi")
    counts = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("node")).agg(F.count("*").alias("n"))
    return hierarchy.counts_with_ancestors(counts, hierarchy.ancestors(edges).drop("hops"))


ROLLUP_SQL = """SELECT n_name AS node, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
UNION ALL SELECT r_name, COUNT(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
UNION ALL SELECT 'WORLD', COUNT(*) FROM customer"""


def q_chain_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in chains of five hundred, each over the next: how many stand over and under each, and how far."""
    top = F.col("c_custkey") % 500
    edges = read(spark, sf, "customer").where(top > 0).select((F.col("c_custkey") - 1).alias("sup"), F.col("c_custkey").alias("sub"), F.lit("Inheritance").alias("relation"))
    closed = hierarchy.ancestors(edges)  # read from above too: one closure serves both
    up = closed.groupBy("node").agg(F.count("*").alias("over"), F.max("hops").alias("highest"))
    down = closed.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("under"))
    kids = hierarchy.children(edges).groupBy("node").agg(F.min("child").alias("child"))
    return up.join(down, "node", "full_outer").join(kids, "node", "left")


CHAIN_SQL = """WITH c AS (SELECT c_custkey AS k, MAX(c_custkey) OVER (PARTITION BY c_custkey // 500) AS last, MIN(c_custkey) OVER (PARTITION BY c_custkey // 500) AS lo FROM customer),
d AS (SELECT k, k - CASE WHEN lo % 500 > 0 THEN lo - 1 ELSE lo END AS over, last - k AS under FROM c UNION ALL SELECT DISTINCT lo - 1, 0, last - lo + 1 FROM c WHERE lo % 500 > 0)
SELECT k AS node, NULLIF(over, 0) AS over, NULLIF(over, 0)::INTEGER AS highest, NULLIF(under, 0) AS under, CASE WHEN under > 0 THEN k + 1 END AS child FROM d WHERE over + under > 0"""


def q_pair_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Hops between the regions of the world and the segments their customers buy for."""
    edges = place_edges(spark, sf)
    pairs = read(spark, sf, "region").select(F.col("r_name").alias("a")).crossJoin(F.broadcast(read(spark, sf, "customer").select(F.col("c_mktsegment").alias("b")).distinct().limit(100)))
    return hierarchy.pair_distances(edges, pairs, without=())


PAIRS_SQL = EDGES_SQL + """, st AS (SELECT sup AS a, sub AS b FROM e UNION SELECT sub, sup FROM e), w AS (SELECT r_name AS a, 0 AS h, r_name AS at FROM region UNION SELECT w.a, h + 1, st.b FROM w JOIN st ON st.a = w.at WHERE h < 6)
SELECT r_name AS a, s.s AS b, MIN(h)::INTEGER AS hops FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer) s LEFT JOIN w ON w.a = r_name AND w.at = s.s GROUP BY ALL"""

QUERIES = {f.__name__: f for f in (q_ancestors, q_constituents, q_lca, q_voice, q_candidate_spans, q_signature_spans, q_hierarchy_closure, q_hop_cost, q_shortest_path, q_pmi, q_ancestor_counts, q_chain_closure, q_pair_distances)}
ORACLES = {
    "q_ancestors": UP_SQL + "SELECT sid, id, ancestor::INTEGER AS ancestor, hops::INTEGER AS hops FROM up",
    "q_constituents": CONSTITUENTS_SQL,
    "q_lca": LCA_SQL,
    "q_voice": VOICE_SQL,
    "q_candidate_spans": SPANS_SQL,
    "q_signature_spans": SIGNATURE_SQL,
    "q_hierarchy_closure": CLOSURE_SQL,
    "q_hop_cost": HOPS_SQL,
    "q_shortest_path": SHORTEST_SQL,
    "q_pmi": PMI_SQL,
    "q_ancestor_counts": ROLLUP_SQL,
    "q_chain_closure": CHAIN_SQL,
    "q_pair_distances": PAIRS_SQL,
}
