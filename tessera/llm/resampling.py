"""Importance resampling towards a target: documents drawn by hashed n-gram likelihood ratios plus Gumbel noise.

Both corpora are counted into hashed n-gram buckets; a bucket's gain is the logarithm of how much likelier it is in the
target; a document's weight is the sum of gains over its n-grams. Adding one Gumbel number a document and taking the
highest sums draws without replacement in proportion to exp(weight).

N-grams are interned per batch in an open-addressed numpy table whose keys are xxhash64: of a word's bytes, and for a
longer n-gram of the eight bytes (slot of the n-gram without its last word, slot of that word). A slot is taken for an
occurrence only if its bytes agree, so two n-grams never share one. Slots hold the n-gram's bucket, computed once, and
its count; occurrences keep slot ids, by which they gather gains. Every window of text is bounded, whole texts are read.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, mapped, named, struct_of, table, wider, written

#: Bytes of text that are interned at once.
WINDOW = 1 << 21

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

#: Byte to byte: A-Z lower-cased, what no word holds as a blank.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def _begun(seed: int, size: int) -> np.uint64:
    return np.uint64((seed + size + int(P5)) % (1 << 64))


def xxh64_of_longs(keys: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each number's eight little-endian bytes."""
    h = _turned(keys * P2, 31) * P1 ^ _begun(seed, 8)
    return _mixed(_turned(h, 27) * P1 + P4)


def xxh64_of_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the bytes data[start : start + size]; ``data`` holds eight bytes more than the words.

    Words of up to 31 bytes are hashed together by size, eight bytes at a time; longer ones one by one.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    longs = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    ints = np.ndarray(len(data) - 3, dtype="<u4", buffer=data, strides=(1,))
    order = np.argsort(np.minimum(sizes, 32).astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(np.minimum(sizes, 32), minlength=33))
    for size in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
        rows = order[ends[size] - np.diff(ends, prepend=0)[size] : ends[size]]
        at = starts[rows]
        if size == 32:
            raw = data.tobytes()
            out[rows] = [xxhash.xxh64_intdigest(raw[a : a + n], seed) for a, n in zip(at.tolist(), sizes[rows].tolist())]
            continue
        h = np.full(len(rows), _begun(seed, size), dtype=np.uint64)
        done = 0
        for done in range(8, size + 1, 8):
            h ^= _turned(longs[at + (done - 8)] * P2, 31) * P1
            h = _turned(h, 27) * P1 + P4
        if size - done >= 4:
            h ^= ints[at + done].astype(np.uint64) * P1
            h = _turned(h, 23) * P2 + P3
            done += 4
        for i in range(done, size):
            h ^= data[at + i].astype(np.uint64) * P5
            h = _turned(h, 11) * P1
        out[rows] = _mixed(h)
    return out


def intern(keys: np.ndarray, same) -> tuple[np.ndarray, np.ndarray]:
    """(slots, firsts): each key's slot from 0, and for each slot one of its keys' places.

    An open-addressed table of at least twice as many cells as keys. In each round all keys without a slot look at
    their cell: an empty one goes to the last key that asks, a taken one is shared where the 64 bits and, by
    ``same(places, owners)``, the bytes agree; the others go on to the next cell.
    """
    cells = 1 << max(4, (2 * len(keys)).bit_length())
    mask = np.uint64(cells - 1)
    owner = np.full(cells, -1, dtype=np.int32)
    at = (keys & mask).astype(np.int64)
    of = np.empty(len(keys), dtype=np.int32)
    left = np.arange(len(keys), dtype=np.int32)
    while len(left):
        cell = at[left]
        free = owner[cell] < 0
        owner[cell[free]] = left[free]
        held = owner[cell]
        ok = keys[held] == keys[left]
        ok[ok] = same(left[ok], held[ok])
        of[left[ok]] = held[ok]
        left = left[~ok]
        at[left] = (at[left] + 1) & (cells - 1)
    firsts = np.flatnonzero(of == np.arange(len(keys), dtype=np.int32))
    number = np.empty(len(keys), dtype=np.int32)
    number[firsts] = np.arange(len(firsts), dtype=np.int32)
    return number[of], firsts


def _same_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    longs = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = sizes[a] == sizes[b]
        rest = np.flatnonzero(ok)
        done = 0
        while len(rest):
            left = np.minimum(sizes[a[rest]] - done, 8).astype(np.uint64)
            differ = (longs[starts[a[rest]] + done] ^ longs[starts[b[rest]] + done]) << (np.uint64(64) - np.uint64(8) * left)
            ok[rest[differ != 0]] = False
            done += 8
            rest = rest[(differ == 0) & (sizes[a[rest]] > done)]
        return ok

    return same


@functools.cache
def _crc_steps() -> list[np.ndarray]:
    """At k the images of the 32 single bits after 2**k zero bytes have passed through CRC-32."""
    table = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    steps = [(bits >> np.uint32(8)) ^ table[bits & np.uint32(255)]]
    for _ in range(31):
        steps.append(_applied(steps[-1], steps[-1]))
    return steps


def _applied(images: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for i in range(32):
        out ^= np.where(x >> np.uint32(i) & np.uint32(1), images[i], np.uint32(0))
    return out


@functools.lru_cache(4096)
def _crc_shift(size: int) -> np.ndarray:
    """[4, 256]: for each byte of a CRC-32 what it becomes once ``size`` bytes follow."""
    x = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for k, images in enumerate(_crc_steps()):
        if size >> k & 1:
            x = _applied(images, x)
    places = np.arange(256)
    out = np.zeros((4, 256), dtype=np.uint32)
    for i in range(32):
        out[i // 8] ^= np.where(places >> (i % 8) & 1, x[i], np.uint32(0)).astype(np.uint32)
    return out


def crc_joined(crcs: np.ndarray, tails: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of strings put together, from those of their parts and the sizes of the second ones."""
    kinds, kind = np.unique(sizes, return_inverse=True)
    if not len(kinds):
        return tails.copy()
    shifts = np.concatenate([_crc_shift(int(k)) for k in kinds]).reshape(-1)
    at = kind * 1024
    out = tails.copy()
    for i in range(4):
        out ^= shifts[at + (256 * i) + (crcs >> np.uint32(8 * i) & np.uint32(255))]
    return out


@dataclass
class Grams:
    """Interned n-grams of one window: bucket and count by slot; for occurrences their slot and document's place."""

    bucket: np.ndarray
    count: np.ndarray
    slot: np.ndarray
    doc: np.ndarray
    words: np.ndarray  # the places of documents, once for each of the window's words


def grams_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, old: int, most: int, buckets: int) -> Grams:
    """All runs of 1 to ``most`` words of a document that end in a word from ``old`` on; words are data[start : start + size]."""
    word, first = intern(xxh64_of_words(data, starts, sizes), _same_bytes(data, starts, sizes))
    raw = data.tobytes()
    spans = list(zip(starts[first].tolist(), (starts[first] + sizes[first]).tolist()))
    crc = np.array([zlib.crc32(raw[a:b]) for a, b in spans], dtype=np.uint32)
    tail = np.array([zlib.crc32(b" " + raw[a:b]) for a, b in spans], dtype=np.uint32)
    wide = sizes[first] + 1
    buckets_of, counts, slots, places, begin = [], [], [], [], 0
    shorter, ends, crcs = word, np.arange(len(word)), crc
    for n in range(1, most + 1):
        if n > 1:
            # Occurrences of n words: those of n - 1 whose next word is of the same document.
            before = np.flatnonzero(ends + 1 < len(docs))
            before = before[docs[ends[before] + 1] == docs[ends[before]]]
            ends = ends[before] + 1
            keys = shorter[before].astype(np.uint64) << np.uint64(32) | word[ends].astype(np.uint64)
            shorter, some = intern(xxh64_of_longs(keys), lambda a, b, k=keys: k[a] == k[b])
            prefix, last = (keys[some] >> np.uint64(32)).astype(np.int64), (keys[some] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            crcs = crc_joined(crcs[prefix], tail[last], wide[last])
        fresh_ones = ends >= old
        buckets_of.append((crcs % np.uint32(buckets)).astype(np.int32))
        counts.append(np.bincount(shorter[fresh_ones], minlength=len(crcs)))
        slots.append(shorter[fresh_ones] + begin)
        places.append(docs[ends[fresh_ones]])
        begin += len(crcs)
    return Grams(np.concatenate(buckets_of), np.concatenate(counts), np.concatenate(slots), np.concatenate(places), docs[old:])


def windows_of(texts: pa.Array, most: int, buckets: int, window: int = WINDOW) -> Iterator[Grams]:
    """The n-grams of an Arrow array of texts, window by window; a long text goes on in the next one without loss."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    body = texts.buffers()[2]
    whole = np.frombuffer(body, dtype=np.uint8) if body else np.zeros(0, dtype=np.uint8)
    # A null's text has no bytes here: it may cover some in the buffer.
    spans = offsets.copy()
    kept = texts.is_valid().to_numpy(zero_copy_only=False)
    carried, carried_docs = b"", np.zeros(0, dtype=np.int64)
    at, stop = int(spans[0]), int(spans[-1])
    while at < stop:
        end = min(at + window, stop)
        if FOLD[whole[end - 1]] != 32:  # on to the end of the word
            bound = int(spans[np.searchsorted(spans, end)])
            blank = np.flatnonzero(FOLD[whole[end:bound]] == 32)
            end = end + int(blank[0]) if len(blank) else bound
        data = np.concatenate([np.frombuffer(carried, dtype=np.uint8), FOLD[whole[at:end]], np.full(16, 32, dtype=np.uint8)])
        shift = len(carried) - at
        inner = spans[(spans > at) & (spans < end)] + shift  # texts begin here: no word goes across
        sign = data != 32
        begins = sign.copy()
        begins[1:] &= ~sign[:-1]
        ends = sign.copy()
        ends[:-1] &= ~sign[1:]
        cuts = inner[inner > 0]
        begins[cuts] = sign[cuts]
        ends[cuts - 1] = sign[cuts - 1]
        starts = np.flatnonzero(begins)
        sizes = np.flatnonzero(ends) + 1 - starts
        fresh_words = starts >= len(carried)
        docs = np.concatenate([carried_docs, np.searchsorted(spans, starts[fresh_words] - shift, side="right") - 1])
        old = len(carried_docs)
        if not kept.all():
            ok = kept[docs]
            starts, sizes, docs = starts[ok], sizes[ok], docs[ok]
        if len(starts) > old:
            yield grams_of(data, starts, sizes, docs, old, most, buckets)
        tail = slice(max(0, len(starts) - most + 1), len(starts))
        carried = b"".join(data[a : a + n].tobytes() + b" " for a, n in zip(starts[tail].tolist(), sizes[tail].tolist()))
        carried_docs = docs[tail]
        at = end


def bucket_counts(texts: DataFrame, text: str = "text", most: int = 3, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall into each bucket; buckets without any have no row.

    Each task sends at most ``buckets`` rows. Null texts hold none, repeated rows count again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for grams in windows_of(batch.column(0), most, buckets):
                sums += np.bincount(grams.bucket, weights=grams.count, minlength=buckets).astype(np.int64)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["bucket", "n"])

    src = texts.select(named(text).alias("text"))
    return mapped(src, run, StructType.fromDDL("bucket int, n long")).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", most: int = 3, buckets: int = 10_000) -> np.ndarray:
    """For each bucket floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), s and t its counts, S and T all.

    The driver gets ``buckets`` rows of either corpus, whatever their size."""
    s, t = ({r["bucket"]: r["n"] for r in bucket_counts(df, text, most, buckets).collect()} for df in (docs, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    ratio = lambda b: (t.get(b, 0) + 1.0) * (all_s + float(buckets)) / ((s.get(b, 0) + 1.0) * (all_t + float(buckets)))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], dtype=np.int64)


def with_weights(docs: DataFrame, gain: np.ndarray, text: str = "text", most: int = 3) -> DataFrame:
    """``docs`` with n_words, n_features and weight (all long), computed in place; columns of these names are replaced.

    Texts that are null or hold no word have 0 of each; repeated rows are weighed alike."""
    docs = docs.drop("n_words", "n_features", "weight")
    names = [*docs.columns, "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, features, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for grams in windows_of(batch.column(batch.schema.get_field_index(text)), most, len(gain)):
                of_slot = gain[grams.bucket]
                words += np.bincount(grams.words, minlength=n)
                features += np.bincount(grams.doc, minlength=n)
                weight += np.rint(np.bincount(grams.doc, weights=of_slot[grams.slot], minlength=n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in (words, features, weight))], names)

    return mapped(docs, run, wider(docs.schema, n_words="long", n_features="long", weight="long"))


def gumbel(seed: str, key: Column) -> Column:
    """floor(-1000 ln(-ln u)) as long, u from the first 32 bits of sha256 of ``seed:key``; a null key is the word null."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """``rows``, written, with rank (long, from 1) in the given total order.

    Rows are dealt by ranges of the whole order, so equal scores don't meet in one task; each range is sorted and
    written with its rows' places; the ranges' sizes (a row each) give the ranks where they begin. No window over all.
    """
    place = fresh("place", rows.columns)
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    put = written(dealt.sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()))
    part, within = F.shiftright(F.col(place), 33), F.col(place).bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["part"], r["n"]) for r in put.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    begins, total = {}, 0
    for p, n in sizes:
        begins[p] = total
        total += n
    if not begins:
        return put.withColumn("rank", F.lit(None).cast("long")).drop(place)
    begin = F.get(F.lit([begins.get(p, 0) for p in range(max(begins) + 1)]).cast("array<long>"), part.cast("int"))
    return put.withColumn("rank", begin + within + 1).drop(place)


def importance_sample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = 5,
    least_words: int = 20,
    most: int = 3,
    buckets: int = 10_000,
    seed: str = "42",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), one row per row of ``docs``.

    Of the N rows with ``least_words`` words or more the floor(percent N / 100) of highest score are drawn, ties to the
    smaller doc_id (a null id first; rows that repeat an id and a score in any order, as their values are equal). The
    others have a null rank. Null texts have no words; other columns are left out, whatever their names; an empty
    table gives an empty one, an empty target makes all gains those of no evidence.
    """
    src = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    goal = target.select(named(target_text).alias("text"))
    scored = with_weights(src, gains(src, goal, most=most, buckets=buckets), most=most).drop("text")
    scored = written(scored.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))))
    eligible = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("weight")]
    drawn = scored.where(eligible).count() * percent // 100
    inside = ranked(scored.where(eligible), order)
    inside = inside.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return inside.unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn documents themselves, all columns as given: the rows of each drawn id."""
    rows = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    drawn = importance_sample(rows, target, **options).where("rank is not null").select(F.col("doc_id").alias("drawn")).distinct()
    kept = docs.select(named(doc_id).alias("doc_id"), struct_of(docs.columns).alias("row")).join(drawn, F.col("doc_id").eqNullSafe(F.col("drawn")), "left_semi")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark's texts."""
    docs, goal = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance_sample(docs, goal).select("doc_id", "n_features", "weight", "score", "rank")
