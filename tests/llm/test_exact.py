import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import exact


def grouped(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return groups


def key(i):
    return -1 if i is None else i


@pytest.mark.parametrize("most", [4, exact.MOST])
def test_groups_match_brute_force(spark, odd, odd_rows, most):
    want = grouped([(r[0], r[1]) for r in odd_rows])
    got = exact.duplicate_groups(odd, most=most).collect()
    assert len(got) == len(odd_rows)
    for t, ids in want.items():
        digest = hashlib.sha256(t.encode()).digest()
        mine = [r for r in got if bytes(r["digest"]) == digest]
        best = max(ids, key=key)
        assert Counter(r["doc_id"] for r in mine) == Counter(ids)
        assert {(r["keep_id"], r["group_size"]) for r in mine} == {(best, len(ids))}
        assert [r["doc_id"] for r in mine if r["kept"]] == [best]


@pytest.mark.parametrize("most", [4, exact.MOST])
def test_documents_that_stay(spark, odd, odd_rows, most):
    left = exact.drop_duplicates(odd, most=most)
    assert left.columns == odd.columns
    want = sorted((key(max(ids, key=key)), t) for t, ids in grouped([(r[0], r[1]) for r in odd_rows]).items())
    assert sorted((key(r["doc_id"]), r["text"] or "") for r in left.collect()) == want


def test_empty_tables(spark, none):
    assert exact.duplicate_groups(none).count() == 0 and exact.drop_duplicates(none).count() == 0


def test_a_text_of_a_third_of_all_rows_is_found_in_every_deal(spark):
    rows = [(i, "hot" if i % 3 == 0 else "warm" if i % 10 == 1 else f"own {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    digests = df.select(exact.digest_of(df.text).alias("digest"), exact.F.struct("doc_id").alias("rank"))
    found = {bytes(r["digest"]): (r["size"], r["best"]["doc_id"]) for r in exact.winners(digests, most=20).collect()}
    warm = [i for i, t in rows if t == "warm"]
    assert found == {hashlib.sha256(b"hot").digest(): (1000, 2997), hashlib.sha256(b"warm").digest(): (len(warm), max(warm))}
    assert sum(r["kept"] for r in exact.duplicate_groups(df, most=20).collect()) == len({t for _, t in rows})


def test_summaries_keep_their_bound():
    rng = np.random.default_rng(5)
    values = np.minimum(rng.zipf(1.3, size=20_000), 5000)
    batches = [pa.record_batch({"digest": pa.array([str(v).encode() for v in part], pa.binary())}) for part in np.array_split(values, 13)]
    true = Counter(str(v).encode() for v in values)
    for counters in (1, 10, 100):
        held = {k: n for k, n in zip(*exact.misra_gries(iter(batches), counters).to_pydict().values())}
        assert len(held) <= counters
        assert all(true[k] - len(values) / (counters + 1) <= held.get(k, 0) <= true[k] for k in true)
