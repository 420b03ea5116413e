import pytest

from tessera.llm import urls

CASES = [
    ("http://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net", "example.net", "", None, None),
    ("ftp://x.net/?a", "x.net", "/", "net/", "block"),
    ("https://notexample.com/de/", "notexample.com", "/de/", None, None),
    ("https://b.example.com/de/y#z", "b.example.com", "/de/y", "example.com/de/", "block"),
    ("https://x.org/fr", "x.org", "/fr", None, None),
    ("https://x.org/fr/1", "x.org", "/fr/1", "org/fr/", "allow"),
    ("no scheme.net/", "", "", None, None),
    (None, "", "", None, None),
    ("a://b://c", "b:", "//c", None, None),
    ("http://ÀB.net/", "Àb.net", "/", "net/", "block"),
]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, c[0], "x", "y") for i, c in enumerate(CASES)], "page_id long, url string, host string, verdict string")
    outcomes = spark.createDataFrame([("https://x.org/", 1)] * 40 + [("https://bad.org/", 0)] * 40 + [(None, 1), ("http://q.q/", None)], "url string, good int")
    got = {r["page_id"]: r for r in urls.filter_urls(df, outcomes).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert urls.filter_urls(df.limit(0), outcomes.limit(0)).count() == 0


def test_reputation_shrinks_to_domain_and_suffix(spark):
    rows = [("http://good.a.com/", 1)] * 50 + [("http://bad.b.com/", 0)] * 50 + [("http://c.com/", 1)] * 3
    outcomes = spark.createDataFrame(rows, "url string, good int")
    asked = ["http://good.a.com/1", "http://new.a.com/", "http://bad.b.com/", "http://new.b.com/", "http://else.xyz/"]
    df = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    b = {r["page_id"]: r["good_bound"] for r in urls.filter_urls(df, outcomes, rules=()).collect()}
    assert b[0] > b[1] > b[3] and abs(b[3] - b[2]) < 0.1
    assert b[0] > 0.8 and b[2] < 0.2 and b[1] > b[4] > b[3]


@pytest.mark.parametrize("n,k", [(0, 0), (10, 10)])
def test_bound_is_finite(spark, n, k):
    from pyspark.sql import functions as F

    value = spark.range(1).select(urls.lower_bound(F.lit(n), F.lit(k), F.lit(0.5), 4.0, 1.645)).first()[0]
    assert -1 < value < 1


def test_domains_and_suffixes(spark):
    hosts = ["a.co.uk", "x.b.co.uk:80", "co.uk", "10.1.2.3", "10.1.2.3:8080", "[::1]:80", "www.a.com", "a.com:", "localhost", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    from pyspark.sql import functions as F

    domain, suffix = urls.domain_and_suffix(F.col("host"))
    got = [(r[0], r[1]) for r in df.coalesce(1).select(domain, suffix).collect()]
    assert got == [("a.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("10.1.2.3",) * 2, ("10.1.2.3",) * 2, ("[::1]",) * 2, ("a.com", "com"), ("a.com", "com"), ("localhost",) * 2, ("", "")]
