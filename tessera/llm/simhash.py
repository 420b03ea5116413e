"""SimHash near-dedup with covering locality-sensitive hashing.

Each of the 64 bits gets a vector of ``radius + 1`` binary digits. For every non-zero vector v there is one table,
whose mask holds the bits with odd product with v. Up to ``radius`` differing bits span too few dimensions to leave no
v orthogonal to all of them, so every pair within the radius agrees under some mask (Pagh's covering construction).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import spread

from .common import components, mapped, removed, struct_of, table, tidied, wider, written

RADIUS = 3
#: Distinct fingerprints of a bucket that one row holds; larger buckets are cut by further masks.
BUCKET = 512


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of UTF-8 text, A-Z lower-cased; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    stops = ends[shingle - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype=">u8", count=len(stops))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", keep_text: bool = True) -> DataFrame:
    """``docs`` with the fingerprint as a signed long; null text counts as empty. Computed in place."""
    docs = docs.drop(name)
    out = docs if keep_text else docs.drop(text)
    names = [*out.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            prints = [fingerprint((v.as_py() or "").encode()) for v in column]
            signed = pa.array(np.array(prints, dtype=np.uint64).view(np.int64), pa.int64())
            kept = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if keep_text or n != text]
            yield pa.RecordBatch.from_arrays([*kept, signed], names)

    return mapped(docs, run, wider(out.schema, **{name: "long"}))


def covering_masks(radius: int = RADIUS, free: int = (1 << 64) - 1) -> list[int]:
    """Masks over the ``free`` bits such that bits differing in ``radius`` places or fewer are all outside one of them."""
    digits = (1 << (radius + 1)) - 1
    places = [i for i in range(64) if free >> i & 1]
    vector = {p: k % digits + 1 for k, p in enumerate(places)}
    return [sum(1 << p for p in places if (vector[p] & v).bit_count() % 2) for v in range(1, digits + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fingerprint``) that join exactly the sets which pairs within
    the radius join: of each bucket a tree, not its pairs.

    Buckets of one mask and masked value that hold more than ``bucket`` fingerprints are cut again by masks over the
    bits still free, up to three times; by then under eight bits are free and no bucket can be larger.
    """
    level = [((1 << 64) - 1, 0)]
    rows = prints.select("fingerprint", F.lit(0).cast("long").alias("mask"))
    found = None
    for depth in range(3):
        finer = {_signed(mask): [_signed(mask | m) for m in covering_masks(radius, free)] for free, mask in level}
        level = [(((1 << 64) - 1) & ~(m % (1 << 64)), m % (1 << 64)) for ms in finer.values() for m in sorted(set(ms))]
        if depth == 0:
            rows = rows.select("fingerprint", F.explode(F.array(*[F.lit(m) for m in finer[0]])).alias("mask"))
        else:
            step = prints.sparkSession.createDataFrame([(m, k) for m, ms in finer.items() for k in ms], "mask long, finer long")
            rows = rows.join(F.broadcast(step), "mask").select("fingerprint", F.col("finer").alias("mask"))
        rows = rows.withColumn("key", F.col("fingerprint").bitwiseAND(F.col("mask")))
        size = rows.groupBy("mask", "key").agg(F.count("*").alias("size")).where("size > 1")
        rows = written(rows.join(size, ["mask", "key"]))
        most = (1 << 64) if depth == 2 else bucket
        some = rows.where(F.col("size") <= F.lit(most).cast("decimal(20,0)")) if depth < 2 else rows
        some = some.groupBy("mask", "key").agg(F.collect_list("fingerprint").alias("prints"))
        edges = some.select("prints").mapInArrow(tidied(_trees(radius)), "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        rows = rows.where(F.col("size") > bucket).select("fingerprint", "mask")
        if depth < 2 and rows.isEmpty():
            break
    return found


def _trees(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in batch.column(0):
                x = np.unique(row.values.to_numpy().view(np.uint64))
                if len(x) == 2:
                    if int(x[0] ^ x[1]).bit_count() <= radius:
                        a.append(int(x[0])), b.append(int(x[1]))
                    continue
                todo, line = np.ones(len(x), dtype=bool), []
                for k in range(len(x)):
                    # Breadth first over what is not yet joined: each fingerprint is an end of one edge at most.
                    if not todo[k]:
                        continue
                    todo[k] = False
                    line = [k]
                    while line:
                        p = line.pop()
                        near = np.flatnonzero(todo & (np.bitwise_count(x ^ x[p]) <= radius))
                        todo[near] = False
                        a += [int(x[p])] * len(near)
                        b += x[near].tolist()
                        line += near.tolist()
            columns = [pa.array(np.array(v, dtype=np.uint64).view(np.int64), pa.int64()) for v in (a, b)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return run


def components_of(prints: DataFrame) -> DataFrame:
    """(fingerprint, root): the distinct fingerprints with the smallest one (as a signed long) that links reach."""
    distinct = written(prints.select("fingerprint").where("fingerprint is not null").distinct())
    groups = components(links(distinct))
    joined = distinct.join(groups, F.col("fingerprint") == F.col("node"), "left")
    return joined.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


#: Counters of the sketch that orders shingles; shingles of one task's part of the join; bits that tell which rows to read
#: (a megabyte at any size of the input); pairs that a task compares at once.
CELLS, PART, MARKS, PAIRS = 1 << 21, 250_000, 1 << 23, 2_000_000
#: Parities of a set's hashes by their lowest eight bits, as longs.
BITS = ["b0", "b1", "b2", "b3"]


def shingle_hashes(text: bytes, shingle: int = 5, seed: int = 42) -> tuple[int, np.ndarray]:
    """(content hash, sorted distinct hashes of the word shingles) of a text's A-Z lower-cased words; a text of fewer
    words is one shingle."""
    words = text.lower().split()
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    stops = ends[shingle - 1 :].tolist() or [len(line)]
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    parts = np.array([digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)
    return digest(line, seed), np.unique(parts)


def with_content(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with content, the hash of the A-Z lower-cased words, computed in place; null text counts as empty."""
    schema = T.StructType([*docs.schema.fields, T.StructField("content", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            found = [xxhash.xxh64_intdigest(b" ".join((v.as_py() or "").encode().lower().split()), 42) for v in texts]
            hashes = pa.array(np.array(found, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], [*batch.schema.names, "content"])

    return docs.mapInArrow(tidied(run), schema)


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(43)).astype(np.int64)


def frequencies(rows: DataFrame, sample: int) -> np.ndarray:
    """Counters of shingle hashes over one in ``sample`` contents (content, text), up to 65,535. They only say which
    shingles come first in a text's order: any order gives the same links, a good one gives fewer candidates."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for v in batch.column(0):
                np.add.at(cells, _cells(shingle_hashes((v.as_py() or "").encode())[1]), 1)
        blocks = np.minimum(cells, 65_535).astype(np.uint16).reshape(256, -1)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[k].tobytes() for k in used], pa.binary())], ["block", "cells"])

    def add(pdf):
        cells = sum(np.frombuffer(c, dtype=np.uint16).astype(np.int64) for c in pdf["cells"])
        return pdf.head(1).assign(cells=[np.minimum(cells, 65_535).astype(np.uint16).tobytes()])

    taken = rows.where(F.pmod("content", F.lit(sample)) == 0).select("text").mapInArrow(tidied(count), "block int, cells binary")
    out = np.zeros((256, CELLS // 256), dtype=np.uint16)
    for r in taken.groupBy("block").applyInPandas(add, "block int, cells binary").collect():
        out[r["block"]] = np.frombuffer(r["cells"], dtype=np.uint16)
    return out.ravel()


def least_shared(n, similarity: float):
    """Shingles that a set of n shares at least with any set of that similarity or more."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def most_apart(n, m, similarity: float):
    """Shingles that stand in one of two sets only, at most, if sets of n and m are similar. Parities differ in no more bits."""
    return (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6


def parities(h: np.ndarray) -> np.ndarray:
    """256 bits, each whether the set has an odd number of hashes with those lowest eight bits."""
    return np.packbits(np.bincount((h & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1).view(np.int64)


def _heads(cells: np.ndarray, similarity: float):
    """The first shingles of each text in the common order, so many that two similar sets have one of them in common, and its
    fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, heads, prints, bits = [], [], [], np.zeros((batch.num_rows, 4), dtype=np.int64)
            for i, v in enumerate(batch.column(1)):
                text = (v.as_py() or "").encode()
                h = shingle_hashes(text)[1]
                prints.append(fingerprint(text))
                order = np.lexsort((h, cells[_cells(h)]))
                sizes.append(len(h)), heads.append(h[order[: len(h) - int(least_shared(np.float64(len(h)), similarity)) + 1]].tobytes())
                bits[i] = parities(h)
            columns = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(heads, pa.binary()), batch.column(2), *(pa.array(bits[:, k].copy()) for k in range(4))]
            columns.append(pa.array(np.array(prints, dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["content", "n", "head", "row", *BITS, "fingerprint"])

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            heads = [np.frombuffer(v, dtype=np.int64) for v in part.column(1).to_pylist()]
            columns = [np.concatenate(heads), np.repeat(part.column(0).to_numpy(), [len(h) for h in heads])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "content"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray] | None:
    """Columns of a task's rows by shingle and content, with the first row and the size of each shingle's rows."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return None
    columns = [np.concatenate([b.column(i).to_numpy() for b in batches]) for i in range(batches[0].num_columns)]
    order = np.lexsort((columns[1], columns[0]))
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])
    return columns, first, np.diff(np.r_[first, len(order)])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shingles that two contents have, with the least content of each."""
    found = _gathered(batches)
    if found:
        columns, first, size = found
        keep = np.repeat(size > 1, size)
        columns.append(columns[1][np.repeat(first, size)])
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["shingle", "content", "pivot"])


def _apart(similarity: float, nearest: bool):
    """Pairs of contents of different labels that share a shingle, each once a flush, but for those that sizes or parities
    tell to be unlike; with ``nearest`` only each content's pair of fewest differing parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, out, held = _gathered(batches), [], 0

        def flush():
            pairs = np.unique(np.concatenate(out), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for first, size in zip(*found[1:], strict=True) if found else ():
            content, n, label, *bits = (c[first : first + size] for c in found[0][1:])
            kinds, which, count = np.unique(label, return_inverse=True, return_counts=True)
            if len(kinds) == 1:
                continue
            # Every pair has an end outside the largest label.
            others = np.flatnonzero(which != count.argmax())
            step = max(1, PAIRS // int(size))
            for at in range(0, len(others), step):
                i = others[at : at + step]
                differ = sum(np.bitwise_count((b[i, None] ^ b).view(np.uint64)).astype(np.int16) for b in bits)
                near = (label[i, None] != label) & (differ <= most_apart(n[i, None], n, similarity))
                near &= np.minimum(n[i, None], n) >= least_shared(np.maximum(n[i, None], n), similarity)
                if nearest:
                    far = np.where(near, differ, np.int16(1000))
                    y = far.argmin(axis=1)
                    met = far[np.arange(len(i)), y] < 1000
                    x, y = np.flatnonzero(met), y[met]
                else:
                    x, y = np.nonzero(near)
                x = i[x]
                out.append(np.stack([np.minimum(content[x], content[y]), np.maximum(content[x], content[y])], axis=1))
                held += len(x)
                if held > 1_000_000:
                    yield flush()
                    out, held = [], 0
        if held:
            yield flush()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_hashes((v.as_py() or "").encode())[1].tobytes() for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["content", "shingles"])


def _settled(similarity: float):
    """Pairs whose sets have that Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(both >= least_shared(np.float64(len(x) + len(y) - both), similarity))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    return run


def _marked(ends: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over hashes of the rows of ends: rows that it does not hold need not be read."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MARKS, dtype=bool)
        for batch in batches:
            bits[_place(batch.column(0).to_numpy())] = True
        blocks = np.packbits(bits).reshape(256, -1)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[k].tobytes() for k in used], pa.binary())], ["block", "bits"])

    def add(pdf):
        return pdf.head(1).assign(bits=[np.bitwise_or.reduce([np.frombuffer(v, dtype=np.uint8) for v in pdf["bits"]]).tobytes()])

    out = np.zeros((256, MARKS // 8 // 256), dtype=np.uint8)
    for r in ends.select("row").mapInArrow(tidied(mark), "block int, bits binary").groupBy("block").applyInPandas(add, "block int, bits binary").collect():
        out[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def _place(row: np.ndarray) -> np.ndarray:
    return ((row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(41)).astype(np.int64)


def _checked(pairs: DataFrame, rows: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that are similar, by the exact similarity of their shingle sets; of copies one row is read."""
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct().join(heads.select("content", "row"), "content"))
    marks = _marked(ends)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _place(batch.column(1).to_numpy())
            yield batch.filter(pa.array((marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))

    wanted = rows.select("text", "row").mapInArrow(tidied(read), "text string, row long")
    # Ends are hashed, so that texts need no sorting.
    sets = written(wanted.join(ends.hint("shuffle_hash"), "row").select("content", "text").mapInArrow(tidied(_sets), "content long, shingles binary"))
    of = lambda name: sets.select(F.col("content").alias(name), F.col("shingles").alias(f"of_{name}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b")
    both = written(both.mapInArrow(tidied(_settled(similarity)), "a long, b long"))
    removed(ends, sets)
    return both


def print_pairs(heads: DataFrame) -> DataFrame:
    """(a, b): contents that SimHash links, a tree for each group: those of one fingerprint with its least content, and the
    least contents of fingerprints that differ in at most ``RADIUS`` bits."""
    prints = heads.select("content", "fingerprint")
    least = written(prints.groupBy("fingerprint").agg(F.min("content").alias("least")))
    of = lambda name: least.select(F.col("fingerprint").alias(name), F.col("least").alias(f"_{name}"))
    across = links(least.select("fingerprint")).join(of("a"), "a").join(of("b"), "b").select("_a", "_b")
    same = prints.join(least, "fingerprint").where("content <> least").select("least", "content")
    return across.union(same).select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))


def similar_links(rows: DataFrame, similarity: float, sample: int = 4) -> DataFrame:
    """(node, root): contents of rows (content, text, row: unique) with the least one that similar pairs reach.

    Pairs that SimHash links come first, together with each content and the one that it shares most shingles with among
    the least of their shingles; an exact check of the sets follows. What lies apart after that is completed, exactly: two
    sets of Jaccard similarity s or more share a shingle among the first n - ceil(s n) + 1 of each in any common order
    (rare ones first here). Each content meets its nearest of another label, then all pairs of a shingle that still lie
    apart are compared, unless sizes or parities already tell that they are unlike.
    """
    cells = frequencies(rows, sample)
    fields = f"content long, n int, head binary, row long, {', '.join(f'{b} long' for b in BITS)}, fingerprint long"
    heads = rows.select("content", "text", "row").mapInArrow(tidied(_heads(cells, similarity)), fields)
    heads = heads.groupBy("content").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", "head", *BITS, "fingerprint")])
    heads = written(heads)
    total = heads.agg(F.sum(F.length("head") / 8)).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // PART) + 1)
    shingles = heads.select("content", "head").mapInArrow(tidied(_exploded), "shingle long, content long").repartition(parts, "shingle")
    met = written(shingles.mapInArrow(tidied(_met), "shingle long, content long, pivot long"))
    sketch = heads.select("content", "n", *BITS)
    shared = met.where("pivot <> content").groupBy("pivot", "content").agg(F.count("*").alias("n"))
    pivots = shared.groupBy("content").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot"))
    pairs = print_pairs(heads).unionByName(pivots.select(F.col("pivot").alias("a"), F.col("content").alias("b"))).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(sketch.select([F.col(c).alias(end if c == "content" else f"{end}_{c}") for c in sketch.columns]), end)
    differ = sum((F.bit_count(F.col(f"a_{b}").bitwiseXOR(F.col(f"b_{b}"))) for b in BITS), F.lit(0))
    close = F.least("a_n", "b_n") >= F.ceil(similarity * F.greatest("a_n", "b_n") - 1e-9)
    pairs = written(pairs.where(close & (differ <= most_apart(F.col("a_n"), F.col("b_n"), similarity))).select("a", "b"))
    begun = _checked(pairs, rows, heads, similarity)
    # All shingles of one pivot are compared in one task, as like contents share many: each pair then leaves it once. Of a
    # pivot with many rows shingles are dealt out to several tasks.
    hot = met.groupBy("pivot").agg(F.ceil(F.count("*") / PART).alias("parts")).where("parts > 1")
    label = F.coalesce("root", "content").alias("label")
    # What lies apart only for want of a link takes one pair a content, not all pairs of two groups; then nothing is left out.
    for nearest in (True, False):
        labels = written(components(begun))
        apart = met.join(labels, F.col("content") == F.col("node"), "left").select("shingle", "content", "pivot", label)
        apart = apart.join(hot, "pivot", "left").withColumn("part", F.pmod("shingle", F.coalesce("parts", F.lit(1))))
        apart = apart.join(sketch, "content").repartition(parts, "pivot", "part").select("shingle", "content", "n", "label", *BITS)
        apart = apart.mapInArrow(tidied(_apart(similarity, nearest)), "a long, b long").distinct()
        apart = written(apart.join(pairs, ["a", "b"], "left_anti"))
        further = _checked(apart, rows, heads, similarity)
        removed(labels)
        begun, pairs = begun.unionByName(further), pairs.unionByName(apart)
    groups = written(components(begun))
    removed(heads, met, pairs, begun)
    return groups


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row of each group of linked documents: that of the smallest id (a null id last; of repeated ids any one row).

    Documents with the same words are copies, those without words included. Others link where their sets of five-word
    shingles have the given Jaccard similarity or more: all such pairs, and only those. Columns stay as they are,
    whatever their names; an empty table gives an empty one.
    """
    # The other columns travel as one, so that no name can clash.
    rest = [c for c in docs.columns if c != text]
    inner = docs.select(F.col(text).alias("text"), struct_of(rest).alias("rest"))
    rows = written(with_content(inner).withColumn("row", F.monotonically_increasing_id()))
    groups = similar_links(rows.select("content", "text", "row"), similarity)
    named = rows.select("content", F.col("rest").getField(doc_id).alias("id"), "row")
    named = named.join(groups, F.col("content") == F.col("node"), "left").select(F.coalesce("root", "content").alias("root"), "id", "row")
    named = written(named)
    order = F.struct(F.col("id").isNull(), "id", "row")
    first = written(named.groupBy("root").agg(F.min(order).getField("row").alias("first")))
    gone = named.join(first, "root").where("row <> first").select("row")
    kept = rows.join(gone.hint("shuffle_hash"), "row", "left_anti")
    return kept.select(*[F.col("text").alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns])


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    prints = written(with_fingerprint(docs, keep_text=False))
    groups = written(components_of(prints))
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).join(groups, "fingerprint")
    named = least.groupBy("root").agg(F.min("least").alias("component_id")).join(groups, "root")
    joined = prints.join(named, "fingerprint")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return joined.select("doc_id", digits.alias("fingerprint"), "component_id")
