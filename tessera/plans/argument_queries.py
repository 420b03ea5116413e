"""Queries over the features of arguments: every token of the items as a target, every candidate span of its sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import arguments, training
from tessera.plans.fixtures import LABELS, TAGS, read
from tessera.plans.parse_queries import HALVES_SQL, LEVELS, sentence_tokens


def _rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, tokens, targets): two roles of each token's frame with all spans."""
    items = read(spark, sf, "benchmark").select(F.col("item_id").alias("sid"), F.split(F.trim("text"), r"[ \n]+").alias("tokens"))
    tokens = sentence_tokens(items).withColumn("lemma", F.lower("form"))
    goal = tokens.select("sid", (F.col("sid") * 10000 + F.col("id")).alias("inst"), F.array("id").alias("idxs"), F.col("id").alias("head_id"))
    instances = goal.select("inst", "sid", F.concat(F.lit("F"), F.col("sid") % 3).alias("frame"))
    roles = spark.createDataFrame([(f"F{k}", r) for k in range(3) for r in ("Agent", "Theme")], "frame string, role string")
    return arguments.argument_rows(instances, roles, arguments.candidate_spans(tokens)), tokens, goal


def q_argument_features(spark: SparkSession, sf: str) -> DataFrame:
    """How often each argument feature fires over roles and spans of the items' tokens."""
    rows, tokens, goal = _rows(spark, sf)
    return arguments.argument_features(rows, tokens, goal).groupBy("feature").agg(F.count("*").alias("n"))


def q_argument_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Spans scored with weights by their features' names, then the best assignment of each token."""
    rows, tokens, goal = _rows(spark, sf)
    features = arguments.argument_features(rows, tokens, goal)
    alphabet = training.distinct_alphabet(features)
    weight = ((F.length("feature") * 7 + F.ascii("feature")) % 41 - 20) / 64
    params = alphabet.select("idx", weight.cast("double").alias("weight")).unionByName(spark.createDataFrame([(0, 0.25)], "idx long, weight double"))
    best = arguments.best_assignments(arguments.score_spans(rows, arguments.index_features(features, alphabet), params))
    return best.select("inst", F.round("score", 6).alias("score"), F.size("roles").alias("roles"))


def _q(n: str) -> str:
    """The quantised number as SQL."""
    a = f"abs({n})"
    return f"(CASE WHEN {n} < 0 THEN '-' ELSE '' END || CASE WHEN {a} < 5 THEN {a}::BIGINT::VARCHAR WHEN {a} < 10 THEN '5-9' WHEN {a} < 20 THEN '10-19' WHEN {n} < 0 THEN '20' ELSE '20+' END)"


def _edge(name: str, at: str) -> str:
    closed = f"NOT regexp_matches(p[{at}], '^(N|V|A|R|CD)')"
    return f"[CASE WHEN {closed} THEN ['F', 'w[{name}]pos[{name}]_' || w[{at}] || ' ' || p[{at}]] END, ['F', 'dep[{name}]_' || d[{at}]]]"


FEATURES_SQL = (
    f"""WITH RECURSIVE sent AS (SELECT item_id AS sid, string_split_regex(trim(text), '[ \\n]+') AS tokens FROM benchmark), w0 AS (SELECT sid, id, tokens[id] AS form, len(tokens) AS n FROM sent, unnest(range(1, len(tokens) + 1)) AS r(id)),
w1 AS (SELECT sid, id::INTEGER AS id, form, n, {TAGS.replace('regexp_like', 'regexp_matches')} AS postag, {LABELS} AS deprel, id & (-id) AS bit FROM w0),
tok AS MATERIALIZED (SELECT *, lower(form) AS lemma, COALESCE(list_filter(list_transform(range(0, {LEVELS}), lambda j: CASE WHEN (1::BIGINT << j) > bit THEN ((id::BIGINT >> (j + 1)) << (j + 1)) + (1::BIGINT << j) ELSE n + 1 END), lambda p: p <= n)[1], 0)::INTEGER AS head,
  id - bit + 1 AS first, least(id + bit - 1, n) AS last FROM w1),
up AS (SELECT sid, id, id AS anc, 0 AS hops FROM tok UNION ALL SELECT up.sid, up.id, tok.head, hops + 1 FROM up JOIN tok ON tok.sid = up.sid AND tok.id = up.anc WHERE tok.head > 0)"""
    + HALVES_SQL
    + f""", ch AS (SELECT sid, id, list(anc ORDER BY hops) AS chain FROM up GROUP BY ALL), kd AS (SELECT sid, head AS id, list(id ORDER BY id) AS kids FROM tok GROUP BY ALL),
vd AS (SELECT t.sid, t.id, t.postag, lower(t.form) AS f, hops, CASE WHEN a.postag LIKE 'NN%' OR lower(a.form) IN ('be','am','is','are','was','were','been','being') THEN 'PAS' WHEN lower(a.form) IN ('have','has','had','having') THEN 'ACT' WHEN a.postag IN ('VBZ','VBD','VBP','MD') THEN 'PAS' END AS verdict
  FROM tok t LEFT JOIN up ON up.sid = t.sid AND up.id = t.id AND hops > 0 LEFT JOIN tok a ON a.sid = t.sid AND a.id = up.anc WHERE t.postag LIKE 'V%'),
vc AS (SELECT sid, id, CASE WHEN f = 'been' OR postag <> 'VBN' THEN 'ACT' ELSE COALESCE(arg_min(verdict, hops) FILTER (verdict IS NOT NULL), 'PAS') END AS voice FROM vd GROUP BY sid, id, f, postag),
ls AS MATERIALIZED (SELECT t.sid, list(form ORDER BY t.id) AS w, list(lemma ORDER BY t.id) AS l, list(postag ORDER BY t.id) AS p, list(deprel ORDER BY t.id) AS d, list(head ORDER BY t.id) AS h, list(voice ORDER BY t.id) AS v, list(COALESCE(kids, []) ORDER BY t.id) AS k, list(chain ORDER BY t.id) AS c
  FROM tok t LEFT JOIN vc ON vc.sid = t.sid AND vc.id = t.id LEFT JOIN kd ON kd.sid = t.sid AND kd.id = t.id JOIN ch ON ch.sid = t.sid AND ch.id = t.id GROUP BY t.sid),
sp AS (SELECT DISTINCT sid, lo, hi FROM (SELECT sid, first AS lo, last AS hi FROM tok UNION ALL SELECT sid, id, id FROM tok UNION ALL SELECT sid, first, last FROM half UNION ALL SELECT sid, 0, 0 FROM tok) u),
x0 AS (SELECT t.sid, t.id AS t, lo, hi, lo = 0 AS nul, ls.* EXCLUDE (sid), CASE WHEN lo = 0 THEN [] ELSE range(lo, hi + 1) END AS ins FROM tok t JOIN sp ON sp.sid = t.sid JOIN ls ON ls.sid = t.sid),
x1 AS (SELECT *, list_filter(ins, lambda i: h[i] < lo OR h[i] > hi) AS tops FROM x0),
x2 AS (SELECT *, COALESCE(list_filter(tops, lambda i: p[i] LIKE 'V%')[1], tops[-1]) AS f FROM x1),
x3 AS (SELECT *, k[f] AS fk, c[t] AS ut, c[f] AS uh, CASE WHEN hi < t THEN hi - t ELSE lo - t END AS gap, (lo + hi) // 2 - t AS mid, t >= lo AND t <= hi AS over, hi - lo + 1 AS size FROM x2),
x4 AS (SELECT *, CASE WHEN NOT nul THEN list_concat(list_filter(ut, lambda i: NOT list_contains(uh, i)), list_filter(ut, lambda i: list_contains(uh, i))[1:1], list_reverse(list_filter(uh, lambda i: NOT list_contains(ut, i)))) END AS nodes, CASE WHEN nul THEN 'NULL_' ELSE '' END AS z FROM x3),
x5 AS (SELECT sid, t, lo, hi, list_distinct(list_filter(list_concat(
  [['F', CASE WHEN nul THEN 'NULL' ELSE 'OVERT' END], ['F', z || 'targetLemma_' || l[t]], CASE WHEN v[t] IS NOT NULL THEN ['R', z || 'targetLemma_' || l[t] || '_' || v[t]] END, ['F', z || 'targetPOS_' || p[t]], ['F', z || 'NCHILDREN_' || len(k[t])], ['R', z || 'SUBCATSEQ' || COALESCE(array_to_string(list_transform(k[t], lambda i: d[i]), '_'), '')]],
  list_transform(k[t], lambda i: ['R', z || 'SUBCAT_' || d[i]]),
  CASE WHEN nul THEN [] ELSE list_concat(
   list_transform(ins, lambda i: ['R', 'ltok_' || l[i]]), list_transform(ins, lambda i: ['N', 'POS_' || p[i]]),
   list_transform(list_filter(ins, lambda i: v[i] IS NOT NULL), lambda i: ['R', 'Voice_' || l[i] || '_' || v[i]]),
   list_transform(list_filter(ins, lambda i: v[i] IS NOT NULL), lambda i: ['R', 'Voice_' || l[i] || '_' || v[i] || CASE WHEN i < t THEN '_B4_TARGET' WHEN i > t THEN '_AF_TARGET' ELSE '_IN_TARGET' END]),
   list_transform(range(greatest(lo - 3, 1), lo), lambda i: ['N', 'pPOS_' || p[i]]), list_transform(range(hi + 1, least(hi + 3, len(p)) + 1), lambda i: ['N', 'nPOS_' || p[i]]),
   CASE WHEN over THEN [['F', 'O_W_T']] ELSE [['N', 'dist_' || {_q('gap')}], ['F', CASE WHEN gap < 0 THEN 'LEFTTAR' ELSE 'RIGHTTAR' END], ['N', 'midDist_' || {_q('mid')}]] END,
   CASE WHEN len(nodes) BETWEEN 1 AND 7 THEN [['N', 'depPath_' || array_to_string(list_transform(nodes, lambda i: '=' || CASE WHEN len(nodes) <= 5 THEN d[i] ELSE p[i] END), '')]] ELSE [] END,
   [['N', 'pathLength_' || {_q('len(nodes)')}], ['N', 'headLemma_' || l[f]], ['N', 'headPOS_' || p[f]], ['N', 'headLabel_' || d[f]], ['F', 'len_' || {_q('size')}]],
   CASE WHEN len(fk) > 0 THEN [['N', 'leftLemma_' || l[fk[1]]], ['N', 'leftPOS_' || p[fk[1]]], ['N', 'rightLemma_' || l[fk[-1]]], ['N', 'rightPOS_' || p[fk[-1]]]] ELSE [] END,
   {_edge('0', 'lo')}, CASE WHEN size > 1 THEN {_edge('1', 'lo + 1')} ELSE [] END, CASE WHEN size > 2 THEN {_edge('-1', 'hi')} ELSE [] END) END), lambda e: e IS NOT NULL AND e[2] IS NOT NULL)) AS names FROM x4),
x6 AS (SELECT sid * 10000 + t AS inst, 'F' || sid % 3 AS frame, role, lo, hi, unnest(names) AS e FROM x5, (VALUES ('Agent'), ('Theme')) r(role)),
ft AS (SELECT inst, role, lo, hi, unnest(CASE e[1] WHEN 'F' THEN [e[2] || '_' || frame || '.' || role, e[2] || '_' || role, e[2]] WHEN 'R' THEN [e[2] || '_' || role, e[2]] ELSE [e[2]] END) AS feature FROM x6)
"""
)
DECODE_SQL = FEATURES_SQL + """, sc AS MATERIALIZED (SELECT inst, role, lo, hi, 0.25 + SUM(((length(feature) * 7 + ascii(feature)) % 41 - 20) / 64.0::DOUBLE) AS s FROM ft GROUP BY ALL),
pr AS (SELECT a.inst, a.s + b.s AS s FROM sc a JOIN sc b ON b.inst = a.inst AND a.role = 'Agent' AND b.role = 'Theme' WHERE a.lo = 0 OR b.lo = 0 OR a.hi < b.lo OR b.hi < a.lo)
SELECT inst, round(MAX(s), 6) AS score, 2 AS roles FROM pr GROUP BY inst"""

QUERIES = {f.__name__: f for f in (q_argument_features, q_argument_decode)}
ORACLES = {"q_argument_features": FEATURES_SQL + "SELECT feature, COUNT(*) AS n FROM ft GROUP BY feature", "q_argument_decode": DECODE_SQL}
