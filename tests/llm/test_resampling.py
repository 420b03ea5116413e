import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(gram):
    return zlib.crc32(gram.encode()) % 10_000


def brute(docs, goal):
    s, t = (Counter(bucket(g) for x in texts for g in features(x)[1]) for texts in ([d for _, d in docs], goal))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for i, x in docs:
        words, grams = features(x)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in grams)
        rows.append([i, len(words), len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able):
        r.append(k + 1 if k < 5 * len(able) // 100 else None)
    return [tuple(r) if len(r) == 6 else (*r, None) for r in rows]


def order(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    vocab = ["".join(rng.choices("abcdeéghiÉÄ漢1", k=rng.choice([1, 2, 3, 8, 9, 16, 33, 40]))) for _ in range(30)] + ["Foo-Bar", "X" * 300]
    return [rng.choice(["", ".", " "]) + rng.choice([" ", ", ", "\n--"]).join(rng.choices(vocab, k=rng.randrange(0, 60))) for _ in range(90)]


def test_hashes_equal_the_library():
    rng = random.Random(2)
    longs = np.array([rng.getrandbits(64) for _ in range(99)], dtype=np.uint64)
    assert resampling.xxh64_of_longs(longs).tolist() == [xxhash.xxh64_intdigest(int(x).to_bytes(8, "little"), 42) for x in longs]
    raw = bytes(rng.getrandbits(8) for _ in range(5000))
    starts, sizes = np.array([rng.randrange(4000) for _ in range(300)]), np.array([rng.randrange(1, 70) for _ in range(300)])
    got = resampling.xxh64_of_words(np.frombuffer(raw, dtype=np.uint8), starts, sizes).tolist()
    assert got == [xxhash.xxh64_intdigest(raw[a : a + n], 42) for a, n in zip(starts.tolist(), sizes.tolist())]


def test_checksums_of_joined_strings():
    rng = random.Random(3)
    pairs = [(rng.randbytes(rng.randrange(40)), rng.randbytes(rng.choice([0, 1, 5, 300, 70_000]))) for _ in range(60)]
    a, b = (np.array([zlib.crc32(p[k]) for p in pairs], dtype=np.uint32) for k in (0, 1))
    got = resampling.crc_joined(a, b, np.array([len(p[1]) for p in pairs]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in pairs]


def test_equal_hashes_of_different_bytes_take_slots_of_their_own():
    keys, what = np.array([5, 5, 5, 21, 5], dtype=np.uint64), np.array([1, 2, 1, 3, 2])
    slots, firsts = resampling.intern(keys, lambda a, b: what[a] == what[b])
    assert len(firsts) == 3 and slots[0] == slots[2] and slots[1] == slots[4] and len({*slots.tolist()}) == 3


@pytest.mark.parametrize("window", [1, 7, 64, 1000, 1 << 20])
def test_windows_lose_and_repeat_nothing(texts, window):
    rows = [None, "", " ", "ab", "cd", *texts, "z" * 500, None, "a"]
    whole = pa.array(["cut off", *rows]).slice(1)
    n, found = len(rows), Counter()
    words, sums = np.zeros(n), np.zeros(n)
    for g in resampling.windows_of(whole, 3, 10_000, window=window):
        words += np.bincount(g.words, minlength=n)
        sums += np.bincount(g.doc, weights=g.bucket[g.slot], minlength=n)
        for b, k in zip(g.bucket.tolist(), g.count.tolist()):
            found[b] += k
    assert words.tolist() == [len(features(x)[0]) for x in rows]
    assert sums.tolist() == [sum(map(bucket, features(x)[1])) for x in rows]
    assert +found == Counter(bucket(g) for x in rows for g in features(x)[1])


def test_sample_matches_brute_force(spark, texts, odd_rows):
    docs = [(i, x) for i, x in enumerate(texts)] + [(100 + i, "one two three " * 9) for i in range(60)]
    docs += [docs[-1], (7, docs[-1][1]), *[(r[0], r[1]) for r in odd_rows]]
    goal = [texts[0], texts[1], None, "", texts[2] + texts[3]]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in docs], "doc_id long, text string, rank int, weight int").repartition(5)
    target = spark.createDataFrame([(x,) for x in goal], "text string")
    got = resampling.importance_sample(df, target)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert order(tuple(r) for r in got.collect()) == order(brute(docs, goal))
    drawn = resampling.resample(df, target)
    ids = {r[0] for r in brute(docs, goal) if r[5]}
    assert drawn.columns == df.columns and sorted(map(repr, (r["doc_id"] for r in drawn.collect()))) == sorted(repr(i) for i, _ in docs if i in ids)


def test_empty_tables(spark, none):
    goal = spark.createDataFrame([("a b c",)], "text string")
    assert resampling.importance_sample(none, goal).count() == 0
    rows = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert [tuple(r) for r in resampling.importance_sample(rows, goal.limit(0)).collect()] == brute([(1, "a " * 30)], [])


def test_ranks_over_many_ranges_with_ties(spark):
    rows = [(i, i * 7919 % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, score long").repartition(9)
    got = resampling.ranked(df, [df.score.desc(), df.doc_id.asc()], parts=13).collect()
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert {r["doc_id"]: r["rank"] for r in got} == want


def test_query_on_the_drivers_tables(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables are absent")
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    goal = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = resampling.op12_importance_resampling(spark, "/root/testdata/sf0.001").collect()
    assert order(tuple(r) for r in got) == order((r[0], *r[2:]) for r in brute(docs, goal))
