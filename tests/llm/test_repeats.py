import random
from collections import Counter

import pytest

from tessera.llm import repeats


def brute(texts, length=400):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(c for c, h in zip(t, hit, strict=True) if not h)
        spans = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out.append((len(t), sum(hit), spans, kept))
    return out


def check(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(df, **options).collect()}
    want = brute([(t or "").encode() for t in texts], options.get("length", 400))
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("hot", [1, 4096])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed, hot):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choices("abcé \n", k=n))
    shared = [noise(n) for n in (399, 400, 401, 700, 1500)]
    texts = [None, "", noise(399), noise(400), "ab" * 600, "x" * 399, "x" * 400, "x" * 401, noise(5000)]
    for _ in range(25):
        parts = [noise(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            cut = rng.choice([0, 0, 1, 50])
            parts += [s[cut:], noise(rng.choice([0, 1, 200]))]
        texts.append("".join(parts))
    texts += [texts[10], texts[10], texts[12][:-1]]
    check(spark, texts, hot=hot, size=7)


def test_short_windows_overlap_and_touch(spark):
    check(spark, ["abcdefghij" * 3, "zzabcdefghijabcdefghij", "qrs" * 20, "0123456789ABCDEF", "x0123456789ABCDEFy"], length=12, gram=4)


def test_odd_rows_and_text_form(spark, odd, none):
    out = repeats.without_repeats(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes and out.count() == odd.count()
    rows = out.collect()
    assert sum(r["text"] is None for r in rows) == 2
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in rows)
    assert all(r["text"] == "" for r in rows if r["doc_id"] == 5)
    assert repeats.without_repeats(none).count() == 0
