"""Queries over sentences and tokens: tokenising, targets, counts, windows, islands, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import canonical_form, coarse_pos, pos_class, tokenize, tokenize_sql
from tessera.operators import counters, prep, targets
from tessera.plans.fixtures import ITEM_TOKENS_SQL, LINES_SQL, item_tokens, lines, read


def q_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document, tokenised."""
    return lines(read(spark, sf, "documents")).select("doc_id", "line", tokenize(F.col("text")).alias("tokens"))


def word_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(read(spark, sf, "documents"))
    return rows.select("doc_id", "line", F.split(F.lower(F.trim("text")), " +").alias("words"))


def item_grams(spark: SparkSession, sf: str) -> DataFrame:
    """Whitelist: all n-grams of the benchmark's items, lower-cased."""
    items = read(spark, sf, "benchmark").select("item_id", F.split(F.lower(F.trim("text")), " +").alias("words"))
    return targets.ngram_table(items, "words").select("gram").distinct()


def found_targets(spark: SparkSession, sf: str) -> DataFrame:
    return targets.match_lexicon(word_lines(spark, sf), item_grams(spark, sf))


def q_ngram_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of documents by length, with their source."""
    counted = found_targets(spark, sf).groupBy("doc_id", "n").agg(F.count("*").alias("targets"))
    return counted.join(read(spark, sf, "documents").select("doc_id", "source"), "doc_id").select("doc_id", "source", "n", "targets")


GREEDY_SQL = f"""
WITH w AS (SELECT doc_id, line, string_split_regex(lower(trim(text)), ' +') AS words FROM ({LINES_SQL}) l),
iw AS (SELECT string_split_regex(lower(trim(text)), ' +') AS words FROM benchmark),
wl AS (SELECT DISTINCT array_to_string(words[i : i + n - 1], ' ') AS gram FROM iw, unnest([1, 2, 3, 4]) AS a(n), unnest(range(1, len(words) + 1)) AS b(i) WHERE i + n - 1 <= len(words)),
g AS (SELECT doc_id, line, (i - 1)::INTEGER AS start, n, array_to_string(words[i : i + n - 1], ' ') AS gram
  FROM w, unnest([1, 2, 3, 4]) AS a(n), unnest(range(1, len(words) + 1)) AS b(i) WHERE i + n - 1 <= len(words)),
hits AS (SELECT * FROM g WHERE gram IN (SELECT gram FROM wl)),
m AS (SELECT doc_id, line, list({{'claimed': range(start, start + n), 'chosen': [{{'start': start, 'n': n, 'gram': gram}}]}} ORDER BY n DESC, start) AS ms FROM hits GROUP BY ALL),
t AS (SELECT doc_id, line, list_reduce(ms, lambda acc, x: CASE WHEN list_contains(acc.claimed, x.chosen[1].start) THEN acc
   ELSE {{'claimed': list_concat(acc.claimed, x.claimed), 'chosen': list_concat(acc.chosen, x.chosen)}} END).chosen AS ts FROM m),
found AS (SELECT doc_id, line, x.start AS start, x.n AS n, x.gram AS gram FROM (SELECT doc_id, line, unnest(ts) AS x FROM t) u)
"""


def q_target_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each n-gram is a target."""
    return targets.target_counts(found_targets(spark, sf))


def q_target_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Items' words that count as targets by their share of occurrences; every second item's words count as targets."""
    tokens = item_tokens(read(spark, sf, "benchmark"))
    gram = F.concat_ws("_", "lemma", "postag")
    gold = targets.target_counts(tokens.where("sid % 2 = 0").select(gram.alias("gram")))
    grams = tokens.select(gram.alias("gram"), F.col("postag").alias("tag")).distinct().withColumn("n", F.lit(1))
    return targets.ratio_targets(grams, gold, targets.unigram_counts(tokens))


RATIO_SQL = f"""
WITH tok AS ({ITEM_TOKENS_SQL}), t AS (SELECT sid, lemma || '_' || postag AS gram, postag AS tag FROM tok),
tc AS (SELECT gram, COUNT(*) AS target_count FROM t WHERE sid % 2 = 0 GROUP BY gram),
uc AS (SELECT gram, regexp_extract(gram, '_([^_]*)$', 1) AS tag, COUNT(*) AS count FROM t WHERE tag NOT LIKE 'NNP%' GROUP BY ALL),
bt AS (SELECT tag, SUM(COALESCE(target_count, 0)) / SUM(count) AS r FROM uc LEFT JOIN tc USING (gram) GROUP BY tag),
rows_ AS (SELECT DISTINCT gram, tag FROM t)
SELECT gram, tag, 1 AS n, COALESCE(target_count, 0) AS target_count, COALESCE(count, 0) AS count
FROM rows_ LEFT JOIN tc USING (gram) LEFT JOIN (SELECT gram, count FROM uc) u USING (gram) LEFT JOIN bt USING (tag)
WHERE CASE WHEN COALESCE(target_count, 0) >= 5 OR COALESCE(count, 0) >= 10
  THEN COALESCE(target_count, 0) / COALESCE(count, 1) >= 0.5 AND tag NOT LIKE 'NNP%' ELSE COALESCE(r, 0) >= 0.5 END
"""


def q_filtered_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Single words of items that the target rules keep."""
    return targets.keep_target(item_tokens(read(spark, sf, "benchmark"))).select("sid", "id", "lemma", "keep")


FILTER_SQL = f"""
WITH tok AS ({ITEM_TOKENS_SQL}), o AS (SELECT DISTINCT sid, head AS id FROM tok WHERE upper(deprel) IN ('OBJ', 'DOBJ')),
n AS (SELECT *, lag(lower(form)) OVER w AS f_1, lead(lower(form)) OVER w AS f1, lag(lemma) OVER w AS l_1, lag(postag) OVER w AS p_1,
  lead(postag) OVER w AS p1, lead(postag, 2) OVER w AS p2 FROM tok WINDOW w AS (PARTITION BY sid ORDER BY id))
SELECT n.sid, n.id, lemma, CASE WHEN lower(form) IN ('a','an','as','for','i','in particular','it','of course','so','the','with','above','against','at','below','beside','by','in','on','over','under','after','before','into','through','to') THEN false
 WHEN substr(postag, 1, 2) IN ('PR','CC','IN','TO') THEN false
 WHEN lower(form) = 'course' AND f_1 = 'of' THEN false WHEN lower(form) = 'particular' AND f_1 = 'in' THEN false
 WHEN lower(form) = 'of' THEN COALESCE(l_1 IN ('%','all','face','few','half','majority','many','member','minority','more','most','much','none','one','only','part','proportion','quarter','share','some','third'), false)
   OR COALESCE(f1 IN ('all','group','their','them','us'), false) OR COALESCE(p_1 LIKE 'JJ%' OR p_1 LIKE 'CD%', false) OR COALESCE(p1 LIKE 'CD%', false) OR COALESCE(p1 LIKE 'DT%' AND p2 LIKE 'CD%', false)
 WHEN lemma = 'will' THEN postag <> 'MD' WHEN lemma = 'have' THEN o.id IS NOT NULL ELSE lemma <> 'be' END AS keep
FROM n LEFT JOIN o ON n.sid = o.sid AND n.id = o.id
"""


def q_token_classes(spark: SparkSession, sf: str) -> DataFrame:
    """How many tokens of items have each coarse tag and class."""
    tokens = item_tokens(read(spark, sf, "benchmark"))
    tag = F.col("postag")
    classes = pos_class(tag)
    rows = tokens.select(
        canonical_form(F.col("form")).alias("canonical"), coarse_pos(tag).alias("first"), coarse_pos(tag, "class").alias("class"),
        coarse_pos(tag, "wordnet").alias("wordnet"), *[c.alias(k) for k, c in classes.items()],
    )
    flags = [F.count_if(k).alias(k) for k in classes]
    return rows.groupBy("first", "class", "wordnet").agg(F.count("*").alias("n"), F.count_distinct("canonical").alias("forms"), *flags)


CLASSES_SQL = f"""
WITH tok AS ({ITEM_TOKENS_SQL}), c AS (SELECT lower(regexp_replace(form, '[0-9]', '@', 'g')) AS canonical, substr(postag, 1, 1) AS first,
  CASE WHEN substr(postag, 1, 2) IN ('PR', 'RB') THEN substr(postag, 1, 2) WHEN substr(postag, 1, 1) IN ('J', 'N', 'V', 'W') THEN substr(postag, 1, 1) ELSE postag END AS class,
  CASE WHEN substr(postag, 1, 1) = 'N' THEN 'n' WHEN substr(postag, 1, 1) = 'V' THEN 'v' WHEN substr(postag, 1, 1) = 'J' THEN 'a' WHEN postag LIKE 'RB%' THEN 'adv' WHEN postag IN ('IN', 'TO') THEN 'prep' END AS wordnet,
  (substr(postag, 1, 1) IN ('N', 'V', 'J') OR postag LIKE 'RB%') AS content, postag = 'CD' AS number, NOT regexp_matches(postag, '[A-Za-z]') AS punctuation,
  (postag LIKE 'PRP%' OR postag LIKE 'WP%') AS pronoun, postag IN ('DT', 'PDT', 'WDT') AS determiner FROM tok)
SELECT first, class, wordnet, COUNT(*) AS n, COUNT(DISTINCT canonical) AS forms, COUNT_IF(content)::BIGINT AS content, COUNT_IF(number)::BIGINT AS number, COUNT_IF(punctuation)::BIGINT AS punctuation,
  COUNT_IF(pronoun)::BIGINT AS pronoun, COUNT_IF(determiner)::BIGINT AS determiner, COUNT_IF(NOT content AND NOT number AND NOT punctuation)::BIGINT AS closed FROM c GROUP BY ALL
"""


def q_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of consecutive hours with events of each user."""
    hours = read(spark, sf, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("hour"))
    return prep.merge_adjacent(hours, ["user_id"], "hour")


ISLANDS_SQL = """
WITH h AS (SELECT DISTINCT user_id, floor(epoch(ts::TIMESTAMP) / 3600)::BIGINT AS hour FROM events),
m AS (SELECT *, hour - ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY hour) AS island FROM h)
SELECT user_id, MIN(hour) AS start, MAX(hour) AS stop FROM m GROUP BY user_id, island
"""


def q_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counter algebra over line items: quantities by part, shared keys, shares, histogram, top list."""
    items = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), "l_returnflag", F.col("l_quantity").cast("long").alias("q"))
    all_ = counters.count_by(items, "key", weight="q")
    returned = counters.count_by(items.where("l_returnflag = 'R'"), "key", weight="q")
    accepted = counters.count_by(items.where("l_returnflag = 'A'"), "key", weight="q")
    share = counters.divide_all_by(returned, all_).select("key", F.lit("share").alias("what"), F.round("value", 6).alias("value"))
    scaled = counters.scale_all_by(returned, accepted).select("key", F.lit("product").alias("what"), F.col("value").cast("double"))
    both = counters.and_counters(returned, accepted).select("key", F.lit("both").alias("what"), F.col("value").cast("double"))
    either = counters.or_counters(returned, accepted).select("key", F.lit("either").alias("what"), F.col("value").cast("double"))
    total = counters.add_all(returned, accepted).select("key", F.lit("sum").alias("what"), F.col("value").cast("double"))
    hist = counters.histogram(all_).select(F.col("value").alias("key"), F.lit("histogram").alias("what"), F.col("keys").cast("double").alias("value"))
    top = counters.top_with_percent(all_, 1000).select("key", F.lit("percent").alias("what"), F.round("percent", 6).alias("value"))
    sops = counters.sum_of_products(all_).select(F.lit(0).cast("long").alias("key"), F.lit("dot").alias("what"), F.col("total").cast("double").alias("value"))
    out = share
    for part in (scaled, both, either, total, hist, top, sops):
        out = out.unionByName(part)
    return out


COUNTERS_SQL = """
WITH i AS (SELECT l_partkey AS key, l_returnflag AS f, l_quantity::BIGINT AS q FROM lineitem),
a AS (SELECT key, SUM(q) AS v FROM i GROUP BY key), r AS (SELECT key, SUM(q) AS v FROM i WHERE f = 'R' GROUP BY key), c AS (SELECT key, SUM(q) AS v FROM i WHERE f = 'A' GROUP BY key)
SELECT key, 'share' AS what, round(r.v / a.v, 6)::DOUBLE AS value FROM r JOIN a USING (key)
UNION ALL SELECT key, 'product', (r.v * COALESCE(c.v, 0))::DOUBLE FROM r LEFT JOIN c USING (key)
UNION ALL SELECT key, 'both', (r.v + c.v)::DOUBLE FROM r JOIN c USING (key) WHERE r.v <> 0 AND c.v <> 0
UNION ALL SELECT key, 'either', COUNT(*)::DOUBLE FROM (SELECT key FROM r WHERE v <> 0 UNION ALL SELECT key FROM c WHERE v <> 0) u GROUP BY key
UNION ALL SELECT key, 'sum', SUM(v)::DOUBLE FROM (SELECT * FROM r UNION ALL SELECT * FROM c) u GROUP BY key
UNION ALL SELECT v::BIGINT, 'histogram', COUNT(*)::DOUBLE FROM a GROUP BY v
UNION ALL SELECT key, 'percent', round(100 * v / (SELECT SUM(v) FROM a), 6)::DOUBLE FROM a WHERE v >= 1000
UNION ALL SELECT 0, 'dot', SUM(key * v)::DOUBLE FROM a
"""


def q_write_once(spark: SparkSession, sf: str) -> DataFrame:
    """The first order of each customer by date, with how many later ones differ in priority."""
    orders = read(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.struct("o_orderdate", "o_orderkey").alias("seq"))
    kept, rejected = counters.write_once(orders, "different")
    late = rejected.groupBy("key").agg(F.count("*").alias("rejected"))
    return kept.join(late, "key", "left").select("key", "value", F.coalesce("rejected", F.lit(0)).alias("rejected"))


ONCE_SQL = """
WITH x AS (SELECT o_custkey AS key, o_orderpriority AS value, ROW_NUMBER() OVER w AS n, FIRST(o_orderpriority) OVER w AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT key, MAX(f) AS value, COUNT_IF(n > 1 AND value IS DISTINCT FROM f)::BIGINT AS rejected FROM x GROUP BY key
"""


def q_counter_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each user side by side by type."""
    events = counters.nested_counter(read(spark, sf, "events"), "user_id", "event_type")
    kinds = sorted(r[0] for r in events.select("event_type").distinct().collect())
    return counters.multi_counter(events, "user_id", "event_type", "value", kinds).select("user_id", F.to_json(F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*[F.col(k) for k in kinds]))).alias("counts"))


QUERIES = {f.__name__: f for f in (q_tokenize, q_ngram_targets, q_target_counts, q_target_ratio, q_filtered_targets, q_token_classes, q_islands, q_counters, q_write_once, q_counter_pivot)}
ORACLES = {
    "q_tokenize": f"SELECT doc_id, line, {tokenize_sql('text')} AS tokens FROM ({LINES_SQL}) l",
    "q_ngram_targets": GREEDY_SQL + "SELECT doc_id, source, n, COUNT(*) AS targets FROM found JOIN documents USING (doc_id) GROUP BY ALL",
    "q_target_counts": GREEDY_SQL + "SELECT gram, COUNT(*) AS target_count FROM found GROUP BY gram",
    "q_target_ratio": RATIO_SQL,
    "q_filtered_targets": FILTER_SQL,
    "q_token_classes": CLASSES_SQL,
    "q_islands": ISLANDS_SQL,
    "q_counters": COUNTERS_SQL,
    "q_write_once": ONCE_SQL,
    "q_counter_pivot": """WITH k AS (SELECT DISTINCT event_type AS k FROM events), u AS (SELECT DISTINCT user_id FROM events), c AS (SELECT user_id, event_type AS k, COUNT(*) AS n FROM events GROUP BY ALL)
SELECT user_id, '{' || string_agg('"' || k || '":' || COALESCE(n, 0), ',' ORDER BY k) || '}' AS counts FROM u CROSS JOIN k LEFT JOIN c USING (user_id, k) GROUP BY user_id""",
}
