import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, tokens
from tessera.llm.tokens import Encoder

TEXTS = ["don't we'll 12ab", "a<|endoftext|>b", "İstanbul ΣΑΣ Σ", "e\u0301 cafe\u0301 \u0301x", "a\x1cb\x85c\xa0d\u2003e", "\u200bzero", "a\0b \0", "ÀÉ ß ſ Ĳ", "漢字 かな 🙂", "", None, " \n ", "x" * 500]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("keep", [5, 300_000])
def test_ids_are_the_tokenizers(tokenizer, odd_rows, keep):
    texts = TEXTS + [r[1] for r in odd_rows]
    got = Encoder(keep=keep).ids(texts)
    for t, x in zip(texts, got, strict=True):
        assert np.frombuffer(x, "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_nnls_finds_the_constrained_minimum():
    rng = np.random.default_rng(2)
    a, y = rng.random((12, 30)), rng.random(12)
    x = packing.nnls(a, y)
    gain = a.T @ (y - a @ x)
    assert (x >= 0).all() and gain.max() < 1e-6 and abs(gain[x > 0]).max() < 1e-6


def test_layout_covers_each_token_once_and_fills_windows():
    lengths = np.random.default_rng(4).integers(1, 5000, 4000)
    lines = packing.layout(lengths)
    seen = defaultdict(list)
    for line in lines:
        assert 0 < sum(n for _, _, n in line) <= 2048
        for d, s, n in line:
            seen[d].append((s, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, m in sorted(seen[d]):
            assert s == at
            at += m
        assert at == n
    assert len(lines) * 2048 / lengths.sum() < 1.02
    assert packing.layout(np.array([], dtype=int)) == []


def test_pieces_rebuild_documents(spark, odd, none, tokenizer):
    rows = packing.pack(odd, block=20_000).collect()
    by, lines = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        by[r["doc_id"]].append(r)
        lines[r["sequence_id"]].append(r)
    for r in odd.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        crcs = {zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])]) for p in by[r["doc_id"]] if p["doc_tokens"] == len(ids) // 4}
        assert {zlib.crc32(p["ids"]) for p in by[r["doc_id"]] if p["doc_tokens"] == len(ids) // 4} & crcs
    assert sum(r["length"] for r in rows) == sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    for line in lines.values():
        at = 0
        for p in sorted(line, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    assert packing.pack(none).count() == 0


def test_chunks_are_learned_in_one_go():
    made = tokens.Encoder()
    calls, pieces = [], made.pieces
    made.pieces = lambda text: calls.append(1) or pieces(text)
    texts = ["I'LL don'T  Größe x1.5\t9%% a\0b", "  İı ÀÉ-ﬁ", "", "\r\x85 q", "<|endoftext|> z", " ".join(f"w{i}é" for i in range(500))]
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in made.ids(texts)]
    assert got == [[i for c in t.split(" ") for i in made.exact.encode(c, add_special_tokens=False).ids] for t in texts]
    assert len(calls) == 1
    assert tokens.encoder() is tokens.encoder()
