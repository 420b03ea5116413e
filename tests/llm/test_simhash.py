import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import components, written


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes))


def groups(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_match_the_definition(spark, odd, odd_rows):
    got = {(r["doc_id"], r["text"]): r["fingerprint"] for r in simhash.with_fingerprint(odd).collect()}
    for r in odd_rows:
        assert got[r[0], r[1]] % (1 << 64) == plain(r[1])


def test_covering_masks_cover():
    masks = simhash.covering_masks()
    rng = np.random.default_rng(1)
    assert len(masks) == 15
    for _ in range(2000):
        bits = sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 4), replace=False))
        assert any(bits & m == 0 for m in masks)


@pytest.mark.parametrize("bucket", [2, 512])
def test_components_match_all_pairs(spark, bucket):
    rng = np.random.default_rng(5)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 40)}
    for p in list(prints):
        for _ in range(6):
            q = p
            for i in rng.choice(64, rng.integers(1, 5), replace=False):
                q ^= 1 << int(i)
            prints.add(q)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = written(spark.createDataFrame([(p,) for p in signed], "fingerprint long"))
    found = {r["node"]: r["root"] for r in components(simhash.links(df, bucket=bucket)).collect()}
    edges = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 3]
    want = groups(signed, edges)
    assert {n: found.get(n, n) for n in signed} == want


def test_long_chain_settles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (500, 500)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} or {b" ".join(words)}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_parities_never_tell_similar_sets_apart():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 900, 20_000):
        x = rng.integers(0, 1 << 62, n).astype(np.uint64)
        for cut in (0, n // 20, n // 9):
            y = np.concatenate([x[cut:], rng.integers(0, 1 << 62, cut // 2).astype(np.uint64)])
            both, union = len(x) - cut, len(x) + cut // 2
            differ = int(np.bitwise_count((simhash.parities(x) ^ simhash.parities(y)).view(np.uint64)).sum())
            assert both < 0.8 * union or differ <= simhash.most_apart(len(x), len(y), 0.8)


def test_one_row_of_each_group_stays(spark, odd, none):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert all(jaccard(a["text"], b["text"]) < 0.8 for a, b in combinations(rows, 2))
    for r in odd.collect():
        assert any(jaccard(r["text"], k["text"]) >= 0.75 for k in rows)
    assert {r["doc_id"] for r in rows} >= {0, 3, 4, 5, 9, 10, 11, 12}
    assert simhash.drop_near_duplicates(none).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(4000)]
    text = lambda n: list(rng.choice(vocabulary, n))
    rows, close, far = [], [], []
    for i in range(30):
        base = text(int(rng.integers(60, 400)))
        rows.append((1000 * i, " ".join(base)))
        for k in range(1, 6):
            copy = base.copy()
            for at in rng.choice(len(copy), max(1, len(copy) // 100), replace=False):
                copy[at] = "new"
            rows.append((1000 * i + k, " ".join(copy)))
            close.append(1000 * i + k)
        half = base[: len(base) // 2] + text(len(base) // 2)
        rows.append((1000 * i + 100, " ".join(half)))
        far += [1000 * i, 1000 * i + 100]
    left = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert set(far) <= left and len(left & set(close)) <= 2


def test_texts_of_one_word_set_meet(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words, *rng.choice(words, 5)])) for i in range(600)]
    rows += [(1000 + i, " ".join(rng.permutation(words))) for i in range(40)]
    left = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert left == [0, *range(1000, 1040)]


def test_all_pairs_of_the_similarity_meet(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i, n in enumerate([5, 9, 12, 20, 30, 40, 52, 80, 150, 400, 1000] * 12):
        base = [f"w{x}" for x in rng.integers(0, 3000, n)]
        if i % 3 == 0:
            base[: n // 4] = [f"common{k}" for k in range(n // 4)]
        rows.append((10 * i, " ".join(base)))
        for k in range(1, 6):
            copy = base.copy()
            for at in rng.choice(n, max(1, k * n // 200), replace=False):
                copy[at] = f"n{i}-{k}-{at}"
            copy = base[:-1] + ["last"] if k == 5 else copy
            rows.append((10 * i + k, " ".join(copy)))
    sets = [shingles(t) for _, t in rows]
    edges = [(rows[i][0], rows[j][0]) for i, j in combinations(range(len(rows)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = set(groups([r[0] for r in rows], edges).values())
    left = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert left == want


def test_near_dedup_takes_what_fingerprints_link(spark):
    base = [f"w{k}" for k in range(400)]
    texts = {1: base, 2: base[:399] + ["other"], 3: [f"v{k}" for k in range(400)]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    rows = simhash.with_content(docs).withColumn("row", F.col("doc_id"))
    prints = simhash.with_fingerprint(rows.select("doc_id", "content", "text"), keep_text=False)
    pairs = simhash.print_pairs(prints.select("content", "fingerprint")).collect()
    near = {r["doc_id"]: r["content"] for r in rows.select("doc_id", "content").collect()}
    assert [{r["a"], r["b"]} for r in pairs] == [{near[1], near[2]}]
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == [1, 3]


def test_groups_of_near_copies_do_not_give_all_their_pairs(spark, monkeypatch):
    rng, base = random.Random(3), [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(120):
        words = list(base)
        for at in rng.sample(range(300), 3):
            words[at] = f"x{rng.random()}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, checked = [], simhash._checked
    monkeypatch.setattr(simhash, "_checked", lambda pairs, *rest: seen.append(pairs.count()) or checked(pairs, *rest))
    assert [r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()] == [0]
    assert sum(seen) < 5 * len(texts)
