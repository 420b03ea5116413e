"""Operators on small inline rows: golden results and invariants."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import arguments, counters, evaluation, fitting, frames, hierarchy, lexicon, prep, targets, training, trees
from tessera.streaming import stream

TOKENS = "sid long, id int, form string, lemma string, postag string, head int, deprel string"


def sentence(spark, *words, sid=1):
    return spark.createDataFrame([(sid, i + 1, *w) for i, w in enumerate(words)], TOKENS)


@pytest.fixture(scope="module")
def money(spark):
    return sentence(spark, ("I", "i", "PRP", 2, "SUB"), ("have", "have", "VBP", 0, "ROOT"), ("money", "money", "NN", 2, "OBJ"), (".", ".", ".", 2, "P"))


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tokenizer_rules(spark):
    cases = {
        'He said, "I can\'t go."': "He said , `` I ca n't go . ''",
        "It's 5% (net)...": "It 's 5 % -LRB- net -RRB- ...",
        "They'll cannot stop -- gonna?": "They 'll can not stop -- gon na ?",
        "the dogs' food": "the dogs ' food",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.tokenize(F.col("t")).alias("o"))
    assert {r["t"]: r["o"] for r in df.collect()} == cases


def test_small_text_functions(spark):
    df = spark.createDataFrame([(n,) for n in (-25, -12, -7, -3, 0, 4, 5, 9, 10, 19, 20)], "n int").select("n", text.quantize(F.col("n")).alias("q"))
    assert [r["q"] for r in df.orderBy("n").collect()] == ["-20", "-10-19", "-5-9", "-3", "0", "4", "5-9", "5-9", "10-19", "10-19", "20+"]
    one = spark.range(1).select(
        text.ngrams(F.split(F.lit("a b c"), " "), 2).alias("g"), text.ngrams(F.split(F.lit("a"), " "), 2).alias("none"), text.canonical_form(F.lit("B2b")).alias("c"),
        text.restore_brackets(F.lit("-LRB-_-LRB- x_NN")).alias("b"), text.split_sentences(F.lit("One. Two two! ''q'' three?\n\nFour")).alias("s"),
    ).first()
    assert one["g"] == ["a b", "b c"] and one["none"] == [] and one["c"] == "b@b" and one["b"] == "(_-LRB- x_NN"
    assert one["s"] == ["One.", "Two two! '' q ''  three?", "Four"] or one["s"][0] == "One." and one["s"][-1] == "Four"


def test_possessive_have_is_a_target(spark, money):
    white = spark.createDataFrame([("have",)], "gram string")
    words = spark.createDataFrame([(1, ["i", "have", "money", "."])], "sid long, words array<string>")
    found = targets.match_lexicon(words, white)
    assert pairs(found, "sid", "start", "n") == [(1, 1, 1)]
    assert pairs(targets.filter_targets(money, found.select("sid", "start", "n")), "start") == [(1,)]
    without = money.withColumn("deprel", F.lit("X"))
    assert targets.filter_targets(without, found.select("sid", "start", "n")).count() == 0


def test_filter_keeps_of_only_in_its_cases(spark):
    t = sentence(spark, ("half", "half", "NN", 0, "R"), ("of", "of", "XX", 1, "M"), ("them", "them", "PRP", 2, "P"), ("will", "will", "MD", 1, "V"), ("is", "be", "VBZ", 1, "V"), ("of", "of", "XX", 1, "M"), ("at", "at", "IN", 1, "M"))
    assert {r["id"]: r["keep"] for r in targets.keep_target(t).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}


def test_greedy_claims_starts_only(spark):
    words = spark.createDataFrame([(1, list("abcd"))], "sid long, words array<string>")
    white = spark.createDataFrame([("a b c",), ("c d",), ("b",), ("d",)], "gram string")
    assert pairs(targets.match_lexicon(words, white), "start", "n", "gram") == [(0, 3, "a b c"), (3, 1, "d")]
    assert pairs(targets.match_lexicon(words, white.where("gram <> 'd'").union(spark.createDataFrame([("d a",)], "gram string"))), "gram") == [("a b c",)]


def test_trees(spark):
    t = sentence(spark, ("The", "the", "DT", 2, "NMOD"), ("dog", "dog", "NN", 3, "SUB"), ("was", "be", "VBD", 0, "ROOT"), ("bitten", "bite", "VBN", 3, "VC"), ("by", "by", "IN", 4, "LGS"), ("me", "i", "PRP", 5, "PMOD"))
    assert pairs(trees.children(t), "id", "children") == [(0, [3]), (2, [1]), (3, [2, 4]), (4, [5]), (5, [6])]
    assert pairs(trees.ancestors(t).where("id = 6"), "ancestor", "hops") == [(3, 3), (4, 2), (5, 1)]
    assert pairs(trees.constituents(t), "id", "first", "last") == [(1, 1, 1), (2, 1, 2), (3, 1, 6), (4, 4, 6), (5, 5, 6), (6, 6, 6)]
    assert pairs(trees.half_constituents(t), "first", "last") == [(1, 3), (3, 6)]
    assert pairs(trees.voice(t), "id", "voice") == [(3, "ACT"), (4, "PAS")]
    p = spark.createDataFrame([(1, 2, 6), (1, 3, 5), (1, 6, 6)], "sid long, a int, b int")
    assert pairs(trees.path(t, p), "a", "b", "lca", "path") == [(2, 6, 3, "=SUB^ROOT!VC!LGS!PMOD"), (3, 5, 3, "=ROOT!VC!LGS"), (6, 6, 6, "=PMOD")]
    g = spark.createDataFrame([(1, "a", [1, 2]), (1, "b", [4, 5]), (1, "c", [6])], "sid long, key string, idxs array<int>")
    assert pairs(trees.heuristic_head(t, g), "key", "head_id") == [("a", 2), ("b", 4), ("c", 6)]
    two = t.withColumn("parse_idx", F.lit(0)).withColumn("head", F.lit(0)).unionByName(t.withColumn("parse_idx", F.lit(1)))
    assert pairs(trees.match_constituent(two, spark.createDataFrame([(1, 4, 6), (1, 2, 4)], "sid long, first int, last int")), "first", "last", "parse_idx") == [(4, 6, 1)]
    assert pairs(trees.topological_rank(t), "rank", "id") == [(1, 3), (2, 2), (3, 4), (4, 1), (5, 5), (6, 6)]
    assert pairs(trees.ancestry_chains(t, 2).where("id = 6"), "chain") == [([5, 4],)]


def test_candidate_spans_hold_null_and_singles(spark):
    t = sentence(spark, *[(f"w{i}", f"w{i}", "NN", i // 2 if i > 1 else 0, "X") for i in range(1, 7)])
    spans = set(pairs(arguments.candidate_spans(t), "start", "stop"))
    assert {(-1, -1), *((i, i) for i in range(6)), (0, 5)} <= spans


def test_beam_equals_brute_force(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for inst in range(25):
        grid = {r: [(-1, -1, rng.random())] + [(a, a + rng.randint(0, 2), rng.random() * 2) for a in rng.sample(range(8), 4)] for r in "abc"}
        rows += [(inst, r, *o) for r, os in grid.items() for o in os]
        apart = lambda x, y: x[0] < 0 or y[0] < 0 or x[1] < y[0] or y[1] < x[0]
        ok = [c for c in itertools.product(*grid.values()) if all(apart(x, y) for x, y in itertools.combinations(c, 2))]
        want[inst] = (max(sum(o[2] for o in c) for c in ok), max(sum(o[2] for o in c) for c in ok if not (c[0][0] >= 0 and c[1][0] >= 0)))
    df = spark.createDataFrame(rows, "inst int, role string, start int, stop int, score double")
    got = {r["inst"]: r["score"] for r in arguments.best_assignments(df, beam=400).collect()}
    rule = spark.createDataFrame([(i, "a", "b", "excludes") for i in range(25)], "inst int, role_a string, role_b string, kind string")
    bound = {r["inst"]: (r["score"], r["is_optimal"]) for r in arguments.constrained_assignment(df, rule, k=400, beam=400).collect()}
    for i, (free, tied) in want.items():
        assert math.isclose(got[i], free) and math.isclose(bound[i][0], tied) and bound[i][1]
    best = arguments.best_assignments(df, k=3, beam=400)
    assert best.count() == 75 and best.where("rank = 1").count() == 25


def test_argument_features_and_scores(spark, money):
    inst = spark.createDataFrame([(1, 1, "Possession")], "inst int, sid long, frame string")
    roles = spark.createDataFrame([("Possession", "Owner"), ("Possession", "Thing")], "frame string, role string")
    gold = spark.createDataFrame([(1, "Owner", 0, 0, 0)], "inst int, role string, start int, stop int, position int")
    rows = arguments.argument_rows(inst, roles, arguments.candidate_spans(money), gold)
    assert rows.where("is_gold").count() == 2
    target = spark.createDataFrame([(1, 1, [2], 2)], "inst int, sid long, idxs array<int>, head_id int")
    features = arguments.argument_features(rows, money, target)
    null = {r[0] for r in features.where("role = 'Owner' and start = -1").select("feature").collect()}
    first = {r[0] for r in features.where("role = 'Owner' and start = 0 and stop = 0").select("feature").collect()}
    assert {"NULL_Possession.Owner", "NULL_Owner", "NULL", "NULL_targetLemma_have", "NULL_NCHILDREN_3", "NULL_SUBCATSEQSUB_OBJ_P"} <= null
    assert {"OVERT", "targetLemma_have_ACT", "ltok_i", "ltok_i_Owner", "POS_PRP", "LEFTTAR", "dist_-1", "depPath_=ROOT=SUB", "pathLength_2", "headLemma_i", "w[0]pos[0]_I PRP", "len_1"} <= first
    alphabet = training.distinct_alphabet(features)
    indexed = arguments.index_features(features, alphabet)
    params = alphabet.where("feature in ('ltok_i_Owner', 'NULL_Thing')").select("idx", F.lit(2.0).alias("weight")).unionByName(spark.createDataFrame([(0, 0.5)], "idx long, weight double"))
    scored = arguments.score_spans(rows, indexed, params)
    best = arguments.best_assignments(scored).first()
    assert best["score"] == pytest.approx(5.0) and {(r["role"], r["start"]) for r in best["roles"]} == {("Owner", 0), ("Thing", -1)} or best["score"] >= 5.0
    assert arguments.feature_cache(indexed, gold).where("role = 'Owner' and gold_position > 0").count() == 1


def test_frames_end_to_end(spark, money):
    goal = spark.createDataFrame([(7, 1, [2], 2)], "key long, sid long, idxs array<int>, head_id int")
    cand = spark.createDataFrame([(7, "B"), (7, "A")], "key long, frame string")
    of = frames.frame_features(cand.select("frame"), spark.createDataFrame([("A", "Top")], "node string, ancestor string"))
    params = spark.createDataFrame([("f:A bias", 1.0), ("f:B bias", 1.0), ("af:Top aP:V", 0.5)], "feature string, weight double")
    out = frames.identify(money, goal, cand, params, of).first()
    assert (out["frame"], out["score"], out["unit"]) == ("A", 1.5, "have.v")
    tie = frames.identify(money, goal, cand, params.where("weight = 1.0"), of).first()
    assert (tie["frame"], tie["score"]) == ("A", 1.0)
    base = {r["feature"] for r in frames.base_features(money, goal).collect()}
    assert {"bias", "aP:V", "aTP:have_V", "d:OBJ_P_SUB", "sC:OBJ", "dH:ROOT"} <= base


def test_hierarchy(spark):
    e = spark.createDataFrame([("Entity", "Artifact", "Inheritance"), ("Artifact", "Text", "Inheritance"), ("Entity", "Place", "Inheritance"), ("Place", "Text", "Inheritance"), ("Text", "Entity", "See_also")], "sup string, sub string, relation string")
    assert pairs(hierarchy.ancestors(e).where("node = 'Text'"), "ancestor", "hops") == [("Artifact", 1), ("Entity", 2), ("Place", 1)]
    c = hierarchy.path_counts(e).where("a = 'Text' and b = 'Entity'").select("hops", "paths", F.round(hierarchy.hop_cost(F.col("hops")), 2)).first()
    assert tuple(c) == (2, 2, 0.36)
    costs = hierarchy.frame_cost(spark.createDataFrame([("Text", "Nowhere")], "gold string, pred string"), spark.createDataFrame([("Text", "Entity", 0.36)], "gold string, pred string, cost double"))
    assert costs.first()["cost"] == 1.0
    circle = spark.createDataFrame([("a", "b", "Inheritance"), ("b", "a", "Inheritance")], "sup string, sub string, relation string")
    assert pairs(hierarchy.ancestors(circle), "node", "ancestor") == [("a", "b"), ("b", "a")]


def test_gradient_is_the_loss_derivative(spark):
    rng = np.random.default_rng(1)
    rows = [(i, c, j, float(rng.normal()), c == i % 3, 0.0 if c == i % 3 else 1.0) for i in range(6) for c in range(3) for j in range(4) if rng.random() < 0.8]
    ev = spark.createDataFrame(rows, "inst int, cand int, idx long, value double, gold boolean, cost double").cache()
    latent = ev.withColumn("unit", F.col("idx") % 2)
    w = rng.normal(size=4)
    for f in (lambda x: training.softmax_loss_grad(ev, x, 0.5), lambda x: training.latent_loss_grad(latent, x)):
        table = lambda v: spark.createDataFrame([(j, float(x)) for j, x in enumerate(v)], "idx long, weight double")
        loss = lambda v: f(table(v))[0].first()["loss"]  # noqa: E731, B023
        grad = {r["idx"]: r["grad"] for r in f(table(w))[1].collect()}
        for j in (0, 3):
            step = np.eye(4)[j] * 1e-5
            assert grad[j] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-5, abs=1e-4)


def test_fit_separates_classes(spark):
    rows = [(i, c, c * 2 + j, x, c == i % 2, 0.0) for i in range(20) for c in range(2) for j, x in enumerate((1.0, 1.0 if i % 2 else -1.0))]
    ev = spark.createDataFrame(rows, "inst int, cand int, idx long, value double, gold boolean, cost double")
    w = {r["idx"]: r["weight"] for r in fitting.fit(ev, l2=0.05, most=15).collect()}
    assert w[3] > 0.3 > w[1] and abs(w[3] + w[1]) < 0.1
    s = {r["idx"]: r["weight"] for r in fitting.minibatch_sgd(ev, passes=1, batch=10).collect()}
    assert s[3] > 0


def test_evaluation(spark):
    schema = "sid int, t_start int, t_stop int, frame string, role string, a_start int, a_stop int"
    gold = spark.createDataFrame([(1, 0, 1, "A", None, None, None), (1, 0, 1, "A", "x", 2, 3), (1, 4, 5, "B", None, None, None)], schema)
    pred = spark.createDataFrame([(1, 0, 1, "A", None, None, None), (1, 0, 1, "A", "x", 2, 3), (1, 4, 5, "C", None, None, None), (1, 6, 7, "D", None, None, None)], schema)
    core = spark.createDataFrame([("A", "x", 1.0)], "frame string, role string, points double")
    got = {r["metric"]: (r["numer"], r["pden"], r["rden"]) for r in evaluation.score_sentences(gold, pred, core).collect()}
    back = {r["metric"]: (r["numer"], r["rden"], r["pden"]) for r in evaluation.score_sentences(pred, gold, core).collect()}
    assert got == back and got["targets by span"] == (2, 3, 2) and got["frames with correct targets"] == (1, 3, 2)
    assert got["frames (correct targets only)"] == (1, 2, 2) and got["core arguments, labeled"] == (1, 1, 1) and got["total frames and labeled arguments"] == (2, 4, 3)
    totals = evaluation.corpus_scores(evaluation.score_sentences(gold, pred, core)).where("metric = 'targets by span'").first()
    assert totals["recall"] == 1 and totals["precision"] == pytest.approx(2 / 3)
    log = evaluation.parse_scorer_log(spark.createDataFrame([("Total: 1 / 2 / 4",), ("noise",), ("x Total: 2.0 / 2 / 2",)], "value string")).first()
    assert (log["matched"], log["found"], log["gold"]) == (3, 4, 6)
    bags = evaluation.bagged_prf(spark.createDataFrame([("g", "a"), ("g", "a"), ("h", "b")], "group string, key string"), spark.createDataFrame([("g", "a"), ("g", "b")], "group string, key string"))
    assert {r["key"]: (r["matched"], r["found"], r["gold"]) for r in bags.collect()} == {"a": (1, 1, 2), "b": (0, 1, 1), None: (1, 2, 3)}


def test_randomization_reruns_agree(spark):
    a = spark.createDataFrame([(i, i % 2, 1, 1) for i in range(40)], "sid int, matches int, found int, gold int")
    b = a.withColumn("matches", F.lit(0))
    one, two = (evaluation.paired_randomization(a, b, 99, seed=5).first() for _ in range(2))
    assert one == two and one["p_value"] < 0.05
    assert evaluation.paired_randomization(a, a, 20).first()["p_value"] == 1.0


def test_lexicon_and_distributions(spark):
    w = spark.createDataFrame([("p", "A", 3.0), ("p", "B", 1.0)], "pred string, frame string, w double")
    lex = spark.createDataFrame([("p", "C"), ("q", "A"), ("q", "B")], "pred string, frame string")
    out = {(r["pred"], r["frame"]): r["p"] for r in lexicon.expand_distribution(w, lex).collect()}
    assert out["q", "A"] == 0.5 and out["p", "C"] == pytest.approx(0.1 / 4.1) and sum(v for (p, _), v in out.items() if p == "p") == pytest.approx(1)
    n = spark.createDataFrame([("u", 1, "x", 0.2), ("u", 1, "x", 0.4), ("u", 2, "x", 0.9), ("u", 1, "y", 0.7)], "unit string, line int, nbr string, sim double")
    assert [(r["nbr"], round(r["sim"], 6)) for r in lexicon.normalize_neighbors(n).collect()] == [("y", 0.7), ("x", 0.6)]
    words = spark.createDataFrame([("quickly",), ("blue",), ("well",), ("even",)], "word string")
    counts = spark.createDataFrame([("well", 1, 9), ("even", 5, 5)], "word string, adj long, adv long")
    assert {r["word"]: r["routes"] for r in lexicon.route_pos(words, counts).collect()} == {"quickly": ["adv"], "blue": ["a", "adv"], "well": ["adv"], "even": ["a", "adv"]}
    senses = spark.createDataFrame([("dog", "1"), ("hound", "1"), ("animal", "2")], "word string, synset string")
    pointers = spark.createDataFrame([("1", "hype", "2")], "synset string, fine string, target string")
    stop = spark.createDataFrame([("the",)], "word string")
    rel = lexicon.collapse_relations(lexicon.related_words(spark.createDataFrame([("dog",), ("the",)], "word string"), senses, pointers, stop))
    found = lexicon.relations_between(spark.createDataFrame([("dog", "hound"), ("dog", "animal"), ("the", "dog"), ("the", "the"), ("dog", "dogs")], "a string, b string"), rel)
    assert {(r["a"], r["b"]): r["relations"] for r in found.collect()} == {("dog", "hound"): ["synonym"], ("dog", "animal"): ["hypernym"], ("the", "dog"): ["no-relation"], ("the", "the"): ["identity"], ("dog", "dogs"): ["derivation"]}
    idx = lexicon.index_strings(spark.createDataFrame([(c,) for c in "hello world"], "c string"), "c")
    assert [r["value"] for r in idx.orderBy("idx").collect()] == sorted(set("hello world")) and idx.agg(F.max("idx")).first()[0] == 7


def test_lemmas(spark):
    t = sentence(spark, ("Geese", None, "NNS", 0, ""), ("boxes", None, "NNS", 0, ""), ("carries", None, "VBZ", 0, ""), ("n't", None, "RB", 0, ""), ("'s", None, "VBZ", 0, ""), ("'s", None, "PRP", 0, ""), ("'s", None, "POS", 0, ""), ("zzzs", None, "NNS", 0, ""), ("null", None, "NN", 0, ""), ("nicer", None, "JJR", 0, "")).drop("lemma")
    exc = spark.createDataFrame([("geese", "n", "goose")], "form string, pos string, base string")
    index = spark.createDataFrame([("box", "n"), ("carry", "v"), ("nice", "a")], "lemma string, pos string")
    got = [r["lemma"] for r in prep.add_lemmas(t, exc, index).orderBy("id").collect()]
    assert got == ["goose", "box", "carry", "not", "be", "us", "'s", "zzzs", "null", "nice"]


def test_prep(spark, money):
    rows, bad = prep.zip_annotations(money.select("sid", "id", "form").unionByName(spark.createDataFrame([(2, 1, "x")], "sid long, id int, form string")), money)
    assert rows.count() == 4 and [r[0] for r in bad.collect()] == [2]
    spans = prep.merge_adjacent(spark.createDataFrame([(1, i) for i in (1, 2, 3, 7, 9, 10, 10)], "sid int, at int"), ["sid"], "at")
    assert pairs(spans, "start", "stop") == [(1, 3), (7, 7), (9, 10)]
    free, totals = prep.uncovered_tokens(money, spark.createDataFrame([(1, 1, 2)], "sid long, start int, stop int"))
    assert pairs(free, "id") == [(3,), (4,)] and tuple(totals.first()) == (4, 2)
    capped = prep.strip_tags_and_cap(spark.createDataFrame([("a_b_NN c_VB",), ("x_Y " * 101,)], "value string"))
    assert [r[0] for r in capped.collect()] == ["a_b c"]
    joined = prep.concatenate(money.withColumns({"doc": F.lit(1), "part": F.lit(0)}).unionByName(money.withColumns({"sid": F.lit(2).cast("long"), "doc": F.lit(1), "part": F.lit(1)})), "doc", "part")
    assert pairs(joined.where("sid = 2"), "id", "head") == [(5, 6), (6, 0), (7, 6), (8, 6)]


def test_counters(spark):
    c = spark.createDataFrame([("a", 3), ("b", 1), ("z", 0)], "key string, value int")
    d = spark.createDataFrame([("a", 2), ("z", 5)], "key string, value int")
    assert pairs(counters.normalize(c), "key", "value") == [("a", 0.75), ("b", 0.25), ("z", 0.0)]
    assert pairs(counters.or_counters(c, d), "key", "value") == [("a", 2), ("b", 1), ("z", 1)]
    assert pairs(counters.and_counters(c, d), "key", "value") == [("a", 5)]
    w = spark.createDataFrame([("k", 1, 0), ("k", 2, 1), ("k", 1, 2), ("j", 9, 0)], "key string, value int, seq int")
    for policy, kept, rejected in (("ignore", 1, 0), ("replace", 1, 0), ("error", 1, 2), ("different", 1, 1)):
        a, b = counters.write_once(w, policy)
        assert a.where("key = 'k'").first()["value"] == kept and b.count() == rejected
    with pytest.raises(ValueError):
        counters.write_once(w, "other")


def test_stream_routes_errors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"sid": 2, "text": "{\\"k\\": 1}"}\n{"sid": 1, "text": "{bad"}\n{"sid": 3}\n')
    source = stream.checked(stream.read_sentences(spark, str(tmp_path / "in")), "text", "k int")
    got = []
    stream.annotate_stream(source, lambda df: df, lambda df, i: got.extend(df.collect()), str(tmp_path / "state")).awaitTermination()
    assert sorted((r["sid"], r["error"]) for r in got) == [(1, "not a JSON record"), (2, None), (3, "no record")]
    batch = spark.createDataFrame([(1, "x")], "sid int, error string")
    assert stream.error_rows(batch).first()[0] == '{"error":"x"}'


def test_results_nest_and_rare_classes_go(spark):
    p = [(1, "F", 0, 1, 0, 0.5, [("r", 2, 3)]), (1, "F", 2, 3, 0, 0.4, []), (1, "F", 0, 1, 1, 0.3, [])]
    pred = spark.createDataFrame(p, "sid long, frame string, target_start int, target_stop int, rank int, score double, roles array<struct<role:string,start:int,stop:int>>")
    sents = spark.createDataFrame([(1, list("abcde")), (2, ["x"])], "sid long, tokens array<string>")
    out = {r["sid"]: r for r in arguments.assemble_results(pred, sents).collect()}
    f = out[1]["frames"]
    assert [(x["target"]["name"], x["target"]["spans"][0]["text"], len(x["annotationSets"])) for x in f] == [("F", "a", 2), ("F", "c", 1)]
    assert f[0]["annotationSets"][0]["frameElements"][0]["spans"][0]["text"] == "c d" and out[2]["frames"] is None
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2, "y string")
    assert training.drop_rare_classes(rows, "y").count() == 3
    grid = spark.createDataFrame([(1, f, 1, 2) for f in range(5)] + [(2, f, 2, 2) for f in range(4)], "a int, fold int, correct int, total int")
    assert training.grid_select(grid, ["a"]).first()["a"] == 1


def test_models_from_ml(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 2) * 2 - 1 + i / 100) for i in range(40)], "label double, x double")
    acc = training.binary_logistic(df, df, df.withColumn("label", F.col("label") * 2 - 1), ["x"])
    assert acc == {"train": 1.0, "dev": 1.0, "test": 1.0}
    assert training.multinomial_cv(df, ["x"], "label", grid=(0.1, 0.01), folds=2).bestModel.transform(df).where("prediction = label").count() == 40
    assert training.random_forest(df, ["x"], "label", trees=5).transform(df).count() == 40


def test_long_chains_and_circles_are_walked_to_the_end(spark):
    rows = [(1, i, i - 1, "x", "NN", "d") for i in range(1, 301)] + [(2, 1, 2, "x", "NN", "d"), (2, 2, 1, "x", "NN", "d"), (2, 3, 0, "x", "NN", "d"), (3, 1, 0, "x", "NN", "d")]
    tokens = spark.createDataFrame(rows, "sid int, id int, head int, form string, postag string, deprel string")
    depth = {(r["sid"], r["id"]): r["depth"] for r in trees.depth(tokens).collect()}
    assert all(depth[1, i] == i for i in range(1, 301)) and depth[2, 3] == depth[3, 1] == 1 and depth[2, 1] > 3
    found = trees.ancestors(tokens).where("sid = 1").groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in found} == {i: i - 1 for i in range(2, 301)}
    spans = {r["id"]: (r["first"], r["last"]) for r in trees.constituents(tokens).where("sid = 1").collect()}
    assert spans[1] == (1, 300) and spans[299] == (299, 300)
    assert trees.ancestors(tokens).where("sid = 2").count() < 10


def test_relations_are_counted_without_their_pairs(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    words = frame([(w,) for w in ("a", "b", "c", "d", "e", "stop", "7", "?!", "none")], "word string")
    senses = frame([("a", "s"), ("b", "s"), ("c", "s"), ("c", "t"), ("d", "t"), ("e", "u"), ("stop", "s"), ("7", "u"), ("a", "s"), ("as", "u"), ("d", "v")], "word string, synset string")
    pointers = frame([("s", "hype", "t"), ("s", "hype", "v"), ("s", "syn2", "s"), ("s", "syn2", "u"), ("u", "deri", "s"), ("u", "iden", "u"), ("u", "own", "u"), ("t", "antm", "s"), ("s", "extd", "u"), ("s", "deri", "u")], "synset string, fine string, target string")
    stop = frame([("stop",)], "word string")
    pairs = lexicon.collapse_relations(lexicon.related_words(words, senses, pointers, stop)).groupBy("word", "relation").count().collect()
    counts = lexicon.relation_counts(words, senses, pointers, stop)
    assert sorted(tuple(r) for r in counts.collect()) == sorted(tuple(r) for r in pairs)
