"""Exact removal of repeated passages: strings of 400 bytes (or of so many words) that start at two places or more.

Every window of that length is owned by the smallest hash of its k-unit strings, so equal windows have equal owners.
Runs of windows with one owner are the shards: a hash of the owner groups them, equal shards collapse to a count, and
owners seen once are done unless a text repeats itself within their run. The other shards of a bucket are merged as
Burrows-Wheeler transforms are, by refining one interleave of all their suffixes: a suffix's row moves from the row of the
suffix that follows it, by its preceding symbol, stably, so that each pass puts one more symbol of the common prefix in
front. Symbols are 16 bytes (or 3 words), so 400 bytes take 25 passes. Where the interleave falls into blocks, the number
of passes is the common prefix; rows alone in a block are done and move no further; blocks left at the end are the
repeated intervals. A shard's own rows need no sorting first, as the same passes order them.

Owners of over ``HOT`` different shards are not merged in one task: their windows are counted by 128 bits of hash instead.
Equal shards, and words, are told by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import spread

from .common import removed, struct_of, table, tidied, written

LENGTH, GRAM = 400, 64
#: Words of a passage that counts as repeated (over 50), and of the strings whose hashes own its windows.
PASSAGE, WORDS = 51, 8
#: Shards of one bucket, and of one owner beyond which windows are counted by key instead.
SHARDS, HOT = 1500, 1024
#: Units of a symbol: bytes, words.
SYMBOL = 16, 3
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@dataclass(frozen=True)
class Unit:
    """What strings are made of: bytes (number 0) or words (number 1), their length, and the length of owning strings."""

    number: int
    length: int
    gram: int

    @property
    def symbol(self) -> int:
        return SYMBOL[self.number]

    @property
    def kind(self) -> type:
        return (np.uint8, np.uint64)[self.number]

    def read(self, data: np.ndarray, sums: np.ndarray | None, hasher: Hasher) -> np.ndarray:
        """The units of a text, given its prefix sums."""
        if self.number == 0:
            return data
        starts, stops = words_of(data)
        return hasher.of(hasher.sums(data) if sums is None else sums, starts, stops)


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and stop in bytes."""
    edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[data], True].astype(np.int8)))
    return edge[::2], edge[1::2]


class Hasher:
    """Hashes of byte ranges from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, base: int = _BASE):
        self.base, self.size = base, 0
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(self.size + 1, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((sums[stop] - sums[start]) * self.down[start])

    def grams(self, sums: np.ndarray, k: int) -> np.ndarray:
        n = len(sums) - k
        return mix((sums[k:] - sums[:n]) * self.down[:n])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    n, w, m = len(h) - width + 1, 1, h
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[:n], m[width - w : width - w + n])


def shards(data: np.ndarray, hasher: Hasher, length: int = LENGTH, gram: int = GRAM, sums: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(first window, last window, owner, content hash, inner) of the runs of windows of one text, given as bytes or as
    words; a run is split where it would be longer than a window can reach.

    ``inner`` tells that the owner comes again inside the run after a window began with it. Two equal windows of one run
    make the text between them periodic, so that an owner then stands at a window's start before the last.
    """
    if len(data) < length:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty, empty
    sums = hasher.sums(data) if sums is None else sums
    width = length - gram + 1
    grams = hasher.grams(sums, gram)
    owner = sliding_min(grams, width)
    cuts = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    first = np.r_[0, cuts]
    hit = grams[: len(owner)] == owner
    hit[np.r_[cuts - 1, len(owner) - 1]] = False
    inner = np.add.reduceat(hit, first, dtype=np.int64) > 0
    runs = np.diff(np.r_[first, len(owner)])
    if runs.max() > width:
        parts = -(-runs // width)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, inner = np.repeat(first, parts) + step * width, np.repeat(inner, parts)
    last = np.r_[first[1:], len(owner)] - 1
    content = hasher.of(sums, first, last + length)
    return first, last, owner[first].view(np.int64), content.view(np.int64), inner.astype(np.int64)


def repeated_starts(pieces: list[np.ndarray], length: int = LENGTH, symbol: int = SYMBOL[0]) -> list[np.ndarray]:
    """For each piece a flag by window start: whether that window starts at another place of these pieces too.

    Exact: blocks of the interleave are told by symbols, never by hashes of strings.
    """
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    data = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.uint8)
    left = np.repeat(ends, sizes) - np.arange(n)
    before = np.repeat(sizes, sizes) - left
    passes, symbol = (length - 1) // symbol, min(symbol, length)
    last = length - passes * symbol
    names = _names(data, left, symbol)
    deepest = names if last == symbol else _names(data, left, last)
    rows = np.flatnonzero(deepest >= 0)
    rows = rows[np.argsort(deepest[rows], kind="stable")]
    block = deepest[rows]
    for _ in range(passes):
        if not len(rows):
            break
        keep = before[rows] >= symbol
        rows, block = rows[keep] - symbol, block[keep]
        name = names[rows]
        keep = name >= 0
        rows, block, name = rows[keep], block[keep], name[keep]
        # Distributed by the preceding symbol; the running number keeps the order of rows with the same one.
        order = np.sort(name << np.int64(32) | np.arange(len(rows))) & np.int64(0xFFFFFFFF)
        rows, block, name = rows[order], block[order], name[order]
        new = np.r_[True, (name[1:] != name[:-1]) | (block[1:] != block[:-1])][: len(rows)]
        shared = ~(new & np.r_[new[1:], True][: len(rows)])
        rows, block = rows[shared], np.cumsum(new)[shared]
    flags = np.zeros(n, dtype=bool)
    flags[rows] = True
    starts = ends - sizes
    return [flags[a : max(a, b - length + 1)] for a, b in zip(starts, ends, strict=True)]


def _names(data: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """Dense names of the strings of ``width`` units at all places, equal for equal strings; -1 where a string stands once
    or runs over the end."""
    n, size = len(data), 1
    if data.dtype == np.uint8 and width >= 8:
        padded, size = np.r_[data, np.zeros(8, dtype=np.uint8)], 8
        key = np.zeros(n, dtype=np.uint64)
        for i in range(8):
            key = key << np.uint64(8) | padded[i : i + n]
    else:
        key = data
    names = np.full(n, -1, dtype=np.int64)
    at = np.flatnonzero(left >= size)
    names[at] = _places(key[at])
    while size < width:
        step = min(size, width - size)
        at = np.flatnonzero((names >= 0) & (left >= size + step))
        ahead = names[at + step]
        at, ahead = at[ahead >= 0], ahead[ahead >= 0]
        key, names = names[at] * np.int64(n + 1) + ahead, np.full(n, -1, dtype=np.int64)
        names[at] = _places(key)
        size += step
    return names


def _places(key: np.ndarray) -> np.ndarray:
    """Dense ranks of keys, -1 for those that occur once."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]][: len(key)]
    rank = np.cumsum(new) - 1
    rank[new & np.r_[new[1:], True][: len(key)]] = -1
    out = np.empty(len(key), dtype=np.int64)
    out[order] = rank
    return out


def _runs(flags: np.ndarray, first: int, length: int) -> Iterator[tuple[int, int]]:
    """Byte ranges [start, stop) covered by flagged windows."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        yield first + a, first + b - 1 + length


def repeated_ranges(keyed: DataFrame, units: list[Unit], hot: int = HOT, size: int = SHARDS) -> DataFrame:
    """(key, ranges): for each row key of (key: long, data: binary) the ranges (unit, start, stop) that repeated strings
    of each unit cover, counted in that unit.

    Keys may repeat if their data are equal; each such row counts as a place of its own.
    """
    of = {u.number: u for u in units}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        names = ["key", "unit", "first", "last", "owner", "content", "inner"]
        kinds = [pa.int64(), pa.int8(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int8()]
        for batch in batches:
            parts = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(value.as_buffer() or b"", dtype=np.uint8)
                sums = hasher.sums(data)
                for unit in units:
                    own = unit.read(data, sums, hasher)
                    first, last, owner, content, inner = shards(own, hasher, unit.length, unit.gram, sums if unit.number == 0 else None)
                    # Owners of words and of bytes never meet.
                    owner = owner ^ np.int64(unit.number * 0x5DEECE66D)
                    n = len(first)
                    parts.append((np.full(n, key, dtype=np.int64), np.full(n, unit.number, dtype=np.int8), first, last, owner, content, inner))
            columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for i in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = made = written(keyed.mapInArrow(tidied(cut), "key long, unit byte, first int, last int, owner long, content long, inner byte"))
    several = (F.count("*") > 1).alias("several")
    seen = rows.groupBy("owner").agg(several, (F.min("content") == F.max("content")).alias("alike"), F.max("inner").alias("again"))
    seen = written(seen.where("several or again > 0").select("owner", (F.col("several") & F.col("alike")).alias("alike")))
    # Written first, so that a hot owner's rows can be split in the join instead of sharing the sum's partitioning.
    rows = written(rows.drop("inner").join(seen, "owner"))
    removed(made, seen)
    length = F.element_at(F.create_map(*[F.lit(x).cast("int") for u in units for x in (u.number, u.length)]), F.col("unit").cast("int"))
    covered = F.struct("unit", F.col("first").alias("start"), (F.col("last") + length).alias("stop")).alias("range")
    whole = rows.where("alike").select("key", covered)
    mixed = rows.where("not alike")
    kinds = mixed.groupBy("owner", "content").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "last", "unit")).alias("one"))
    kinds = written(kinds)
    whole = whole.unionByName(mixed.join(kinds.where("n > 1").select("owner", "content"), ["owner", "content"]).select("key", covered))
    open_ = kinds.groupBy("owner").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single")).where("single > 0")
    wanted = written(kinds.join(open_, "owner").select("owner", "kinds", "n", "one.*"))
    buckets = max(1, -(-wanted.count() // size))
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("owner", "unit", "kinds", "n", "first", "last")).alias("parts"))
    # Lists are hashed, here as ranges below, so that texts need no sorting.
    texts = keyed.join(lists.hint("shuffle_hash"), "key").mapInArrow(tidied(_slices(of)), "owner long, unit byte, kinds long, n long, key long, first int, data binary")
    texts = written(texts)
    usual = texts.where(F.col("kinds") <= hot).withColumn("bucket", F.pmod(F.xxhash64("owner"), F.lit(buckets)).cast("int"))
    edges = usual.select("bucket", "unit", "n", "key", "first", "data").groupBy("bucket", "unit").applyInPandas(_merge(of), "key long, unit byte, start int, stop int")
    edges = edges.select("key", F.struct("unit", "start", "stop").alias("range"))
    windows = texts.where(F.col("kinds") > hot).mapInArrow(tidied(_windows(of)), "a long, b long, n long, key long, unit byte, first int, start int")
    many = windows.groupBy("a", "b", "unit").agg(F.sum("n").alias("n")).where("n > 1").drop("n")
    spans = windows.where("n = 1").join(many, ["a", "b", "unit"])
    # Neighbouring windows of a shard become one range; a shard has no more windows than a window has owning strings.
    place = F.row_number().over(Window.partitionBy("key", "unit", "first").orderBy("start"))
    spans = spans.select("key", "unit", "first", "start", (F.col("start") - place).alias("run"))
    spans = spans.groupBy("key", "unit", "first", "run").agg(F.min("start").alias("start"), F.max("start").alias("end"))
    spans = spans.select("key", F.struct("unit", "start", (F.col("end") + length).alias("stop")).alias("range"))
    found = written(whole.unionByName(edges).unionByName(spans).groupBy("key").agg(F.collect_list("range").alias("ranges")))
    removed(rows, kinds, wanted, texts)
    return found


def _slices(of: dict[int, Unit]):
    """The units of the wanted shards of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["owner", "unit", "kinds", "n", "key", "first", "data"]
        kinds = [pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        hasher = Hasher()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, value, parts in zip(*(batch.column(batch.schema.get_field_index(n)) for n in ("key", "data", "parts")), strict=True):
                key, data, own = key.as_py(), np.frombuffer(value.as_buffer(), dtype=np.uint8), {}
                for p in parts.as_py():
                    unit = of[p["unit"]]
                    if unit not in own:
                        own[unit] = unit.read(data, None, hasher)
                    row = (p["owner"], unit.number, p["kinds"], p["n"], key, p["first"], own[unit][p["first"] : p["last"] + unit.length].tobytes())
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return run


def _merge(of: dict[int, Unit]):
    """Ranges of the single shards of a bucket that some other shard there shares."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = of[int(pdf["unit"].iloc[0])]
        flags = repeated_starts([np.frombuffer(d, dtype=unit.kind) for d in pdf["data"]], unit.length, unit.symbol)
        out = [(k, unit.number, a, b) for k, first, n, f in zip(pdf["key"], pdf["first"], pdf["n"], flags, strict=True) if n == 1 for a, b in _runs(f, first, unit.length)]
        return pd.DataFrame(out, columns=["key", "unit", "start", "stop"])

    return run


def _windows(of: dict[int, Unit]):
    """Two hashes for every window of every shard, for owners with very many different shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = Hasher(), Hasher(0xC2B2AE3D27D4EB4F)
        names = ["a", "b", "n", "key", "unit", "first", "start"]
        for batch in batches:
            for number, n, key, first, data in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4, 5, 6)), strict=True):
                own = np.frombuffer(data, dtype=of[number].kind)
                a, b = (h.grams(h.sums(own), of[number].length).view(np.int64) for h in hashers)
                m = len(a)
                columns = [pa.array(a), pa.array(b), *(pa.array(np.full(m, v), k) for v, k in ((n, pa.int64()), (key, pa.int64()), (number, pa.int8()), (first, pa.int32())))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(first, first + m, dtype=np.int32))], names)

    return run


def joined_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges."""
    out: list[tuple[int, int]] = []
    for r in sorted(ranges):
        if out and r[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r[1]))
        else:
            out.append(r)
    return out


def byte_ranges(data: bytes, ranges: list[dict] | None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Byte ranges of the ranges of bytes and of those of words; the latter reach up to the word that follows."""
    by = [[(r["start"], r["stop"]) for r in ranges or () if r["unit"] == k] for k in (0, 1)]
    if by[1]:
        starts = np.r_[words_of(np.frombuffer(data, dtype=np.uint8))[0], len(data)].tolist()
        by[1] = [(starts[a], starts[b]) for a, b in joined_ranges(by[1])]
    return by[0], by[1]


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    as_text: bool = False,
    words: int = 0,
    cut_words: bool = True,
    **options,
) -> DataFrame:
    """``docs`` without its text but with kept (binary: what is left of the text's UTF-8; with ``as_text`` a string without
    the characters that were cut in two, null where the text was), n_bytes, n_removed, n_spans and n_passage; columns of
    these names are replaced.

    Null text is empty. Texts shorter than ``length`` bytes stay whole. Rows with equal id and text are places of their
    own: both lose what they share. Whole texts count, with no limit on their length or on the size of a group. An empty
    table gives an empty one.

    With ``words``, n_passage counts the bytes in strings of so many words that start elsewhere too, however few bytes
    those have, and unless ``cut_words`` is false they go as well; white space between words does not count there, and a
    word is known by 64 bits of its hash. Without, n_passage is 0.
    """
    units = [Unit(0, length, gram), *([Unit(1, words, min(WORDS, words))] if words else [])]
    rest = [c for c in docs.columns if c not in (text, "kept", "n_bytes", "n_removed", "n_spans", "n_passage")]
    # The other columns travel as one, so that no name can clash.
    docs = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), F.col(text).cast("binary").alias("given"), struct_of(rest).alias("rest"))
    least = min([length, *([2 * words - 1] if words else [])])
    ranges = repeated_ranges(docs.select("key", F.col("given").alias("data")).where(F.length("given") >= least), units, **options)
    joined = docs.join(ranges.hint("shuffle_hash"), "key", "left").select("rest", "given", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], []
            for value, found in zip(batch.column(1), batch.column(2), strict=True):
                given = value.as_py()
                data = given or b""
                by_bytes, by_words = byte_ranges(data, found.as_py())
                runs = joined_ranges([*by_bytes, *(by_words if cut_words else ())])
                stops = [0, *(b for _, b in runs)]
                left = b"".join(data[a:b] for a, b in zip(stops, [*(a for a, _ in runs), len(data)], strict=True)) if runs else data
                counts.append((len(data), len(data) - len(left), len(runs), sum(b - a for a, b in by_words)))
                kept.append(left if not as_text else None if given is None else left.decode("utf-8", "ignore"))
            columns = [batch.column(0), pa.array(kept, pa.string() if as_text else pa.binary())]
            columns += [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, ["rest", "kept", "n_bytes", "n_removed", "n_spans", "n_passage"])

    counted = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans", "n_passage")]
    fields = T.StructType([docs.schema["rest"], T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *counted])
    out = joined.mapInArrow(tidied(run), fields)
    return out.select(*[F.col("rest").getField(c).alias(c) for c in rest], "kept", "n_bytes", "n_removed", "n_spans", "n_passage")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """``docs`` with the kept bytes as text, characters cut in two left out, and ``n_chars`` (if there) its length.

    A document of which nothing is left stays with an empty text, a null text stays null; other columns stay as they are.
    """
    own = [c for c in docs.columns if c != text]
    inner = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), struct_of(own).alias("rest"))
    out = remove_repeats(inner, as_text=True, **options)
    columns = {text: F.col("kept")}
    if n_chars in own:
        columns[n_chars] = F.length("kept").cast(docs.schema[n_chars].dataType)
    return out.select(*[columns[c].alias(c) if c in columns else F.col("rest").getField(c).alias(c) for c in docs.columns])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 400 bytes that start elsewhere too, and the digest of the rest; n_passage
    tells the bytes of its passages of over 50 words that stand elsewhere too, which may be shorter than 400 bytes."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = remove_repeats(docs, words=PASSAGE, cut_words=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage")
