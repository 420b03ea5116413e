from pyspark.sql import functions as F

from tessera.llm import rollups
from tessera.llm.common import scratch, word_count


def table(df):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in df.collect()}


def test_deltas_replays_and_compaction(spark, odd, none):
    rows = odd.select("source", "lang", F.lit("v1").alias("tokenizer"), word_count(F.col("text")).alias("tokens"))
    later = rows.withColumns({"tokenizer": F.lit("v2"), "tokens": F.col("tokens") * 2})
    whole = table(rollups.delta(rows))
    r = rollups.Rollup(spark, scratch(spark))
    assert table(r.totals()) == {}
    assert r.commit("a", rollups.delta(rows)) and not r.commit("a", rollups.delta(rows))
    assert table(r.totals()) == whole
    r.compact()
    assert r.commit("b", rollups.revision(rows.where("lang = 'en'"), later.where("lang = 'en'")))
    got = table(r.totals())
    for (s, k, _), (n, t) in whole.items():
        assert got[s, k, "v2" if k == "en" else "v1"] == ((n, 2 * t) if k == "en" else (n, t))
    r.compact()
    assert not r.commit("a", rollups.delta(rows)) and not r.commit("b", rollups.delta(rows))
    assert table(rollups.Rollup(spark, r.folder).totals()) == got
    gone = rollups.delta(later.where("lang = 'en'"), -1)
    r.commit("c", gone)
    assert all(k[1] != "en" for k in table(r.totals()))
    r.commit("d", rollups.delta(none.select("source", "lang", F.lit("v1").alias("tokenizer"), F.lit(1).alias("tokens"))))
    assert sorted(x["batch"] for x in r.committed().collect()) == ["a", "b", "c", "d"]
    before = table(r.totals())
    for _ in range(2):
        r.compact()
    assert table(r.totals()) == before and r._ids("batch") == [] and len(r._ids("snapshot")) == 2
    assert not r.commit("a", rollups.delta(rows)) and sorted(x["batch"] for x in r.committed().collect()) == ["a", "b", "c", "d"]


def test_tokens_are_those_of_the_tokenizer(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rollups.with_tokens(odd)
    assert [c for c in got.columns if c not in ("tokens", "tokenizer")] == odd.columns
    for r in got.collect():
        assert r["tokens"] == len(tok.encode(r["text"] or "", add_special_tokens=False).ids)
    sums = table(rollups.delta(got))
    assert all(k[2] == "word_bpe_49k" for k in sums) and sum(v[0] for v in sums.values()) == odd.count()
    assert rollups.with_tokens(none).count() == 0


def test_query_equals_its_sql(spark):
    import os

    import duckdb
    import pytest

    from tessera.llm import exact, mixing, urls

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables are absent")
    con = duckdb.connect()
    for name in ("documents", "labels", "pages"):
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    pairs = [(rollups.op9_token_counts, rollups.OP9_SQL), (urls.op10_url_filters, urls.OP10_SQL), (mixing.op3_mixing, mixing.OP3_SQL), (exact.op11_exact_dedup, exact.OP11_SQL)]
    for query, sql in pairs:
        got, found = query(spark, "/root/testdata/sf0.001"), con.execute(sql)
        names = [d[0] for d in found.description]
        order = lambda rows: sorted(repr(r) for r in rows)
        assert order(tuple(r[n] for n in names) for r in got.collect()) == order(found.fetchall()) and sorted(names) == sorted(got.columns)


def test_half_written_batch_does_not_count(spark):
    r = rollups.Rollup(spark, scratch(spark))
    rows = spark.createDataFrame([("s", "en", "v1", 3)], "source string, lang string, tokenizer string, tokens long")
    r.commit("a", rollups.delta(rows))
    r.fs.delete(r._path("batch=a/_SUCCESS"), False)
    assert table(r.totals()) == {} and r.commit("a", rollups.delta(rows)) and table(r.totals()) == {("s", "en", "v1"): (1, 3)}
