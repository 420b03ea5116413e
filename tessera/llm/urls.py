"""URL filters: host rules first, else an empirical-Bayes host reputation.

Labelled page outcomes are counted by host, registered domain and suffix. Each level shrinks to the one above by
a beta-binomial prior whose strength comes from the data (moments), and a host passes if the lower bound of its
posterior good rate reaches a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. A rule is ``host/path``; it fits the host and its subdomains."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


#: Suffixes of two labels under which names are registered: one of these kinds below a country's two letters.
SUFFIX_RULE = "^(ac|co|com|edu|go|gob|gov|gouv|mil|ne|net|or|org|sch)\\.[a-z]{2}$"
IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"


def domain_and_suffix(host: Column, suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, its port left out: the suffix is the last label, or the last two where the
    rule says so or they are one of ``suffixes`` (as ``github.io``); the domain has one label more. An address in numbers
    (or in brackets) is its own domain and suffix."""
    name = F.regexp_replace(host, r":\d*$", "")
    whole = name.rlike(IPV4) | name.startswith("[")
    two = F.substring_index(name, ".", -2)
    longer = two.rlike(SUFFIX_RULE) | two.isin(*suffixes) if suffixes else two.rlike(SUFFIX_RULE)
    suffix = F.when(whole, name).when(longer, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(whole, name).when(longer, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return domain, suffix


def _strength(level: DataFrame) -> float:
    """Prior strength (alpha + beta) by the moments of beta-binomial counts n, k around their parents' mean m."""
    noise = F.col("n") * F.col("m") * (1 - F.col("m"))
    row = level.agg(
        F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), 2.0) - noise).alias("over"), F.sum(noise * (F.col("n") - 1)).alias("room")
    ).first()
    rho = (row["over"] or 0.0) / row["room"] if row["room"] else 0.5
    rho = min(max(rho, 0.001), 0.9)
    return float(round(1 / rho - 1, 4))


def host_reputation(outcomes: DataFrame, z: float = 1.645, known: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """From (host, good: 0 or 1) rows: tables by host, domain and suffix of the posterior, and the prior's numbers.

    Rows with null good are no outcomes. Without any outcome the good rate is one half everywhere. Only
    four scalars go through the driver; the tables stay distributed.
    """
    hosts = outcomes.where("good is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("k"))
    domain, suffix = domain_and_suffix(F.col("host"), known)
    # Written once: outcomes are not read again for each level and each moment.
    hosts = written(hosts.withColumns({"domain": domain, "suffix": suffix}))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = ((total["k"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)
    top = _strength(suffixes.withColumn("m", F.lit(base)))
    suffixes = suffixes.select("suffix", ((F.lit(top * base) + F.col("k")) / (F.lit(top) + F.col("n"))).alias("suffix_mean"))
    domains = written(domains.join(suffixes, "suffix"))
    mid = _strength(domains.withColumn("m", F.col("suffix_mean")))
    domains = domains.select("domain", ((F.lit(mid) * F.col("suffix_mean") + F.col("k")) / (F.lit(mid) + F.col("n"))).alias("domain_mean"))
    hosts = hosts.join(domains, "domain")
    low = _strength(hosts.withColumn("m", F.col("domain_mean")))
    hosts = hosts.select("host", "n", "k")
    return hosts, domains, suffixes, {"base": base, "suffix": top, "domain": mid, "host": low, "z": z}


def lower_bound(n: Column, k: Column, mean: Column, strength: float, z: float) -> Column:
    """Mean less z standard deviations of the posterior Beta(strength * mean + k, strength * (1 - mean) + n - k)."""
    a = F.lit(strength) * mean + k
    b = F.lit(strength) * (1 - mean) + n - k
    return a / (a + b) - F.lit(z) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))


def filter_urls(pages: DataFrame, outcomes: DataFrame, url: str = "url", rules=RULES, least: float = 0.6, z: float = 1.645, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """``pages`` with host, path, rule, verdict and good_bound (the posterior bound that decides where no rule does).

    ``outcomes`` are (url, good). Hosts, not pages, are joined to the reputation tables; pages then join their
    host's bound by key, where Spark splits a hot host. An unseen host has its domain's mean, an unseen domain its
    suffix's, an unseen suffix the overall mean. ``suffixes`` are further public suffixes of two labels. Columns of these names in ``pages`` are replaced; repeated rows are
    judged alike, an empty table gives an empty one.
    """
    host, path = host_and_path(F.col(url))
    seen = outcomes.select(host_and_path(F.col("url"))[0].alias("host"), F.col("good").cast("long").alias("good"))
    hosts, domains, endings, prior = host_reputation(seen, z, suffixes)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = pages.drop("host", "path", "rule", "verdict", "good_bound").withColumns({"host": host, "path": path})
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    every = judged.select("host").distinct().withColumns({"domain": domain, "suffix": suffix})
    every = every.join(hosts, "host", "left").join(domains, "domain", "left").join(endings, "suffix", "left")
    mean = F.coalesce("domain_mean", "suffix_mean", F.lit(prior["base"]))
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    every = every.select("host", lower_bound(n, k, mean, prior["host"], z).alias("good_bound"))
    judged = judged.join(every, "host", "left")
    judged = judged.withColumns({"rule": rule, "_verdict": verdict})
    chosen = F.coalesce("_verdict", F.when(F.col("good_bound") >= least, "allow").otherwise("block"))
    return judged.withColumn("verdict", chosen).drop("_verdict")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url; outcomes are the quality labels of the same ids."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return filter_urls(pages, pages.join(labels, "page_id").select("url", "good")).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), judged AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT *,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    regexp_replace(host, ':[0-9]*$', '') AS name
  FROM judged
), named AS (
  SELECT *, regexp_matches(name, '^[0-9]{1,3}([.][0-9]{1,3}){3}$') OR starts_with(name, '[') AS whole,
    regexp_matches(list_aggregate(string_split(name, '.')[-2:], 'string_agg', '.'), '{rule}') AS longer FROM ruled
), levels AS (
  SELECT page_id, host, path, rule,
    CASE WHEN whole THEN name WHEN longer THEN list_aggregate(string_split(name, '.')[-3:], 'string_agg', '.')
         ELSE list_aggregate(string_split(name, '.')[-2:], 'string_agg', '.') END AS domain,
    CASE WHEN whole THEN name WHEN longer THEN list_aggregate(string_split(name, '.')[-2:], 'string_agg', '.')
         ELSE string_split(name, '.')[-1] END AS suffix FROM named
), h AS (
  SELECT host, domain, suffix, COUNT(*)::DOUBLE AS n, SUM(quality)::DOUBLE AS k
  FROM levels JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL GROUP BY ALL
), d AS (SELECT domain, suffix, SUM(n) AS n, SUM(k) AS k FROM h GROUP BY ALL
), s AS (SELECT suffix, SUM(n) AS n, SUM(k) AS k FROM d GROUP BY ALL
), g AS (SELECT (SUM(k) + 1.0::DOUBLE) / (SUM(n) + 2.0::DOUBLE) AS base FROM s
), rs AS (SELECT SUM(pow(k - n * base, 2) - n * base * (1 - base)) / SUM(n * base * (1 - base) * (n - 1)) AS rho FROM s, g
), ks AS (SELECT round(1 / LEAST(GREATEST(rho, 0.001::DOUBLE), 0.9::DOUBLE) - 1, 4) AS v FROM rs
), sm AS (SELECT suffix, (v * base + k) / (v + n) AS suffix_mean FROM s, g, ks
), dm0 AS (SELECT d.*, suffix_mean AS m FROM d JOIN sm USING (suffix)
), rd AS (SELECT SUM(pow(k - n * m, 2) - n * m * (1 - m)) / SUM(n * m * (1 - m) * (n - 1)) AS rho FROM dm0
), kd AS (SELECT round(1 / LEAST(GREATEST(rho, 0.001::DOUBLE), 0.9::DOUBLE) - 1, 4) AS v FROM rd
), dm AS (SELECT domain, (v * m + k) / (v + n) AS domain_mean FROM dm0, kd
), hm AS (SELECT h.*, domain_mean AS m FROM h JOIN dm USING (domain)
), rh AS (SELECT SUM(pow(k - n * m, 2) - n * m * (1 - m)) / SUM(n * m * (1 - m) * (n - 1)) AS rho FROM hm
), kh AS (SELECT round(1 / LEAST(GREATEST(rho, 0.001::DOUBLE), 0.9::DOUBLE) - 1, 4) AS v FROM rh
), post AS (
  SELECT page_id, levels.host, path, rule,
    v * COALESCE(domain_mean, suffix_mean, base) + COALESCE(k, 0) AS a,
    v * (1 - COALESCE(domain_mean, suffix_mean, base)) + COALESCE(n, 0) - COALESCE(k, 0) AS b
  FROM levels LEFT JOIN (SELECT host, n, k FROM h) hh ON levels.host = hh.host
    LEFT JOIN dm ON levels.domain = dm.domain LEFT JOIN sm ON levels.suffix = sm.suffix, g, kh
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= 0.6 THEN 'allow' ELSE 'block' END AS verdict
FROM post
""".replace("{rule}", SUFFIX_RULE)
