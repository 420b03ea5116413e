import hashlib
import zlib

import numpy as np
import pytest

from tessera.llm import media


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("shape", [(1, 64), (40, 64), (9, 5, 3), (7, 3, 4)])
def test_every_filter_round_trips(kind, shape):
    x = np.random.default_rng(kind).integers(0, 256, shape).astype(np.uint8)
    assert (media.png_decode(media.png_encode(x, kind)) == x).all()


def test_mixed_filters_and_long_images_round_trip():
    x = np.random.default_rng(9).integers(0, 256, (3000, 64)).astype(np.uint8)
    for most in (3, 5):
        kinds = np.random.default_rng(1).integers(0, most, 3000).astype(np.uint8)
        data = media.png_encode(x, kinds)
        assert data.count(b"IDAT") > 1 and (media.png_decode(data) == x).all()


def slow_samples(data):
    """Filters undone a byte at a time, as the format defines them."""
    at, body, w = 8, b"", 0
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IHDR":
            w = int.from_bytes(data[at + 8 : at + 12])
        body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    raw, out, above = zlib.decompress(body), [], [0] * w
    for y in range(len(raw) // (w + 1)):
        line, kind = list(raw[y * (w + 1) + 1 : (y + 1) * (w + 1)]), raw[y * (w + 1)]
        for x in range(w):
            line[x] = (line[x] + (0, line[x - 1] if x else 0, above[x])[kind]) % 256
        out += line
        above = line
    return bytes(out)


def test_rows_are_filtered_and_read_back(spark):
    texts = ["aaaa" * 100, "abcdefgh" * 40, "".join(chr(65 + (i * i) % 50) for i in range(3000)), "", None, "é" * 333]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in media.png_features(media.to_png(docs)).collect()}
    used = set()
    for i, t in enumerate(texts):
        data, image = (t or "").encode(), bytes(rows[i]["media"])
        data += b"\0" * (-len(data) % 64 or (0 if data else 64))
        assert slow_samples(image) == data
        used |= set(media.chosen_filters(np.frombuffer(data, np.uint8).reshape(-1, 64)).tolist())
    assert used == {0, 1, 2}


def test_the_query_on_a_small_table(spark, odd_rows, tmp_path):
    docs = [(i, r[1]) for i, r in enumerate(odd_rows)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in media.op2_media_columns(spark, str(tmp_path)).collect()}
    by_text = {}
    for i, t in docs:
        data = (t or "").encode()
        whole = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(whole), zlib.crc32(whole[-64:]))
        image = media.png_encode(np.frombuffer(whole, np.uint8).reshape(-1, 64))
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        assert by_text.setdefault(t or "", r["feature"]) == r["feature"]


def test_damage_is_found():
    data = bytearray(media.png_encode(np.zeros((4, 64), np.uint8)))
    for at in (0, 20, 45, len(data) - 5):
        bad = bytes(data[:at]) + bytes([data[at] ^ 1]) + bytes(data[at + 1 :])
        with pytest.raises(ValueError):
            media.png_decode(bad)
    with pytest.raises(ValueError):
        media.png_decode(bytes(data[:-6]))


def test_columns_match_the_definition(odd, none):
    rows = media.png_features(media.to_png(odd.select("doc_id", "text"))).collect()
    texts = sorted((r["text"] or "") for r in odd.collect())
    got = sorted((r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows)
    want = []
    for t in texts:
        data = t.encode()
        data += b"\0" * (-len(data) % 64 or (0 if data else 64))
        want.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])))
    assert got == sorted(want)
    assert all(len(r["feature"]) == 16 for r in rows)
    assert media.to_png(none).count() == 0


def test_hash_is_stable_under_small_change():
    x = np.outer(np.arange(64), np.ones(64)).astype(np.uint8) * 3
    a, b = media.cosine_hash(x), media.cosine_hash(x + 1)
    assert a == b
