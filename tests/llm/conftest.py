"""Documents with every odd case: nulls, blanks, long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, _key string, fingerprint string, kept int, size int"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdeéghilmnorstu", k=rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    base, passage = words(1, 300), words(2, 120)
    texts = [
        None, "", " \n\t ", "One", "one two", base, base, base.upper(), base + " tail", words(3, 50) + " " + passage + " " + words(4, 80), passage + " " + words(5, 60),
        words(6, 20) + "\n" + passage, words(7, 30_000), "ab " * 400, "Ω≈ç√ 漢字 🙂 " * 30, "x" * 1000, words(8, 200), words(9, 2),
    ]
    sources = ["b", "a", None, "c"]
    rows = [(i, t, "en", sources[i % 4], len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[9], (None, "null id", None, "a", 7), (None, None, None, None, None), (3, "same id, other text", "de", "a", 19)]
    return [(*r, 0.5, 7, "k", "f", 1, 2) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
