import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity


def test_folding():
    assert toxicity.fold("An 1D10T, id\u0456ot and i\u200bdiot!") == " an idiot idiot and idiot "
    assert toxicity.fold("word$$$ end!! 1234") == " word end "
    assert toxicity.fold("") == " " and toxicity.fold("123 ...") == " "


def test_words_beginnings_and_exceptions():
    lex = toxicity.Lexicon({"trash": 2.0}, {"vile": 3.0}, frozenset({"vile", "trash can"}))
    m = lambda t: lex.matched(toxicity.fold(t))
    assert m("trash Tr4sh trashy") == 4.0
    assert m("vile vilest") == 3.0
    assert m("a trash can, trash") == 2.0
    assert toxicity.Lexicon({}, {}).matched(" any text ") == 0.0


def test_learns_and_scores(spark, odd, none):
    clean = [(i, f"good words number {i} of text " * 5, 0) for i in range(200)]
    toxic = [(1000 + i, f"good words number {i} you m0ron of text " * 5, 1) for i in range(60)]
    df = spark.createDataFrame(clean + toxic + [(5000, None, None)], "doc_id long, text string, toxic int")
    lex = toxicity.fit(df)
    assert "moron" in lex.words and "good" not in lex.words
    rows = toxicity.with_score(df.union(df.limit(3)), lex).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] >= 1000 and r["doc_id"] != 5000) for r in rows)
    scored = toxicity.with_score(odd, lex)
    assert sorted(scored.columns) == sorted(odd.columns) and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.with_score(none, lex).count() == 0 and toxicity.fit(df.where("toxic is null")).words == {}


def test_held_out_rows_are_not_learned_from(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    import zlib

    want = {f"w{i}" for i in range(100) if zlib.crc32(str(i).encode()) % 5}
    assert {r["text"] for r in toxicity.training_rows(docs, labels).collect()} == want


def test_a_bound_on_labels_leaves_the_ratio_of_classes(spark):
    text = F.concat(F.lit("plain words of number "), "id", F.when(F.col("id") % 20 < 2, " moron").otherwise(""))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 20 == 0).cast("int").alias("toxic"))
    whole, few = (toxicity.fit(toxicity.training_rows(docs, labels, bound), weight="weight") for bound in (12_000, 1000))
    assert "moron" in whole.words and "moron" in few.words
    for m, n in ((0.0, 5), (1.0, 6)):
        a, b = (float(lex.score([lex.matched(toxicity.fold("moron")) * m], [n])[0]) for lex in (whole, few))
        assert abs(a - b) < 0.12, (m, a, b)


def brute_entries(rows, support=5, ratio=8.0):
    """Words, beginnings and exceptions counted one text at a time."""
    sets = [(set(toxicity.fold(t or "").split()), y) for t, y in rows]
    n1, n0 = sum(y for _, y in sets) + 1.0, sum(1 - y for _, y in sets) + 1.0
    count = {w: [sum(w in s for s, y in sets if y == k) for k in (1, 0)] for s, _ in sets for w in s}
    odds = lambda t, c: math.log(((t + 0.5) / n1) / ((c + 0.5) / n0))
    sure = lambda t, c: t >= support and odds(t, c) >= math.log(ratio)
    words = {w: odds(t, c) for w, (t, c) in count.items() if len(w) > 2 and sure(t, c)}
    stems = {}
    for stem in {w[:n] for w in count for n in range(4, 9) if len(w) > n}:
        of = [v for w, v in count.items() if w.startswith(stem) and len(w) > len(stem)]
        t, c = (sum(v[k] for v in of) for k in (0, 1))
        if sum(v[0] > 0 for v in of) >= 3 and sure(t, c):
            stems[stem] = odds(t, c)
    spared = {w for w, (t, c) in count.items() if c >= support and odds(t, c) <= math.log(2) and any(w.startswith(x) and len(w) > len(x) for x in stems)}
    return words, stems, spared - set(words)


def brute_matched(words, stems, spared, folded):
    """The heaviest entry of every word, those inside an exception left out, without an automaton."""
    total = 0.0
    for w in folded.split():
        found = [words[w]] if w in words else []
        found += [v for x, v in stems.items() if w.startswith(x) and len(w) > len(x)]
        total += 0.0 if w in spared or not found else max(found)
    return total


def test_lexicon_and_matches_equal_brute_force(spark):
    rng = random.Random(8)
    plain = ["word", "good", "vilest", "villa", "village", "villain", "text", "some", "other"]
    rude = ["m0ron", "scumbag", "scummy", "scumlord", "tr4sh", "scum"]
    rows = [(" ".join(rng.choices(plain, k=12)), 0) for _ in range(150)] + [(" ".join(rng.choices(plain, k=6) + rng.choices(rude, k=4)), 1) for _ in range(60)]
    rows += [("scumble " * 3 + rng.choice(plain), 0) for _ in range(8)] + [("", 0), (None, 1)]
    lex = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int").repartition(3))
    words, stems, spared = brute_entries(rows)
    assert lex.words == pytest.approx(words) and lex.stems == pytest.approx(stems) and lex.exceptions == spared and words and stems and spared
    for text, _ in rows:
        folded = toxicity.fold(text or "")
        assert lex.matched(folded) == pytest.approx(brute_matched(words, stems, spared, folded))


def test_held_out_accuracy_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null")
    rows = toxicity.op8_toxicity(spark, folder).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    assert len(rows) > 40 and sum(r["toxic"] == r["predicted"] for r in rows) / len(rows) >= 0.95
    pairs = [(a["score"], b["score"]) for a in rows if a["toxic"] for b in rows if not b["toxic"]]
    assert sum((x > y) + 0.5 * (x == y) for x, y in pairs) / len(pairs) >= 0.97
