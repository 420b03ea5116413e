"""Hard-negative mining by segment summaries.

Every vector is stored with the mean and the deviation (root of the summed squared differences from the mean) of each of its
segments. Of two vectors' segments of m components the inner product is m times the means' product, plus or minus at most
the deviations' product. Summed over segments this bounds a pair's score from both sides; summaries of few long segments
are derived from those of many short ones. Pairs are bounded by one segment first, then by ever more of them, and dropped as
soon as their bounds tell that they can't be among the wanted; only the rest is scored, in exact integers.

Anchors and rows are dealt in blocks, so a label or the table may have any size: a task holds one block of either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import named, table, tidied, written

#: Rows and anchors of a block, cells that are bounded at once.
ROWS, ANCHORS, CELLS = 8192, 2048, 1 << 20


def segments(width: int) -> np.ndarray:
    """Where the stored segments begin and end: a power of four of them, each of about four components or more."""
    count = 1
    while 4 * count * 4 <= width and count < 256:
        count *= 4
    return np.linspace(0, width, count + 1).astype(np.int64)


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of each row."""
    cuts = segments(x.shape[1])
    parts = [x[:, a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    mean = np.stack([p.mean(axis=1) if p.shape[1] else np.zeros(len(x)) for p in parts], axis=1)
    dev = np.stack([np.sqrt(((p - m[:, None]) ** 2).sum(axis=1)) for p, m in zip(parts, mean.T)], axis=1)
    return mean, dev


def levels(mean: np.ndarray, dev: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(centres, radii) from one segment to all: the products of two rows' centres and radii are the middle and the reach
    of their bounds. Merged segments have the sizes' mean of the means and, of squares, all that is not due to it."""
    size = np.diff(segments(width)).astype(float)
    out = []
    while True:
        out.append((mean * np.sqrt(size), dev))
        if len(size) == 1:
            return out[::-1]
        square = (dev**2 + size * mean**2).reshape(len(mean), -1, 4).sum(axis=2)
        total = (mean * size).reshape(len(mean), -1, 4).sum(axis=2)
        size = size.reshape(-1, 4).sum(axis=1)
        mean = total / size
        dev = np.sqrt(np.maximum(square - size * mean**2, 0))


class Block:
    """Vectors of one width with their summaries: integers as doubles, and as Python integers where those don't hold."""

    def __init__(self, found: pa.Table, width: int):
        self.n = found.num_rows
        flat = lambda c: found[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.row, self.vec_id = (found[c].to_numpy() for c in ("row", "vec_id"))
        self.whole = flat("whole").reshape(self.n, width)
        self.x = self.whole.astype(np.float64)
        parts = len(segments(width)) - 1
        self.levels = levels(flat("mean").reshape(self.n, parts), flat("dev").reshape(self.n, parts), width)
        self.top = np.abs(self.x).max(initial=0.0)
        self.norm = np.sqrt((self.x**2).sum(axis=1))


def scores(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a and j of b, exact; beyond 64 bits the largest or smallest long."""
    if a.top * b.top * max(1, a.x.shape[1]) < 2**53:
        spread = np.unique(i).size * np.unique(j).size
        if len(i) * 4 > spread:
            rows, at = np.unique(i, return_inverse=True)
            cols, to = np.unique(j, return_inverse=True)
            return (a.x[rows] @ b.x[cols].T)[at, to].astype(np.int64)
        step = max(1, CELLS // max(1, a.x.shape[1]))
        parts = [np.einsum("nk,nk->n", a.x[i[k : k + step]], b.x[j[k : k + step]]) for k in range(0, len(i), step)]
        return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
    ends = np.iinfo(np.int64)
    one = lambda p, q: min(max(sum(x * y for x, y in zip(p.tolist(), q.tolist())), ends.min), ends.max)
    return np.array([one(a.whole[p], b.whole[q]) for p, q in zip(i.tolist(), j.tolist())], dtype=np.int64)


def survivors(a: Block, b: Block, alive: np.ndarray, at: np.ndarray, judge: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of a, rows of b) of the rows ``at`` of a with all of b that ``judge(lower, upper, alive, at)`` leaves at
    every level, from one segment to all; rows and columns without a pair are left out of the next level."""
    cols = np.arange(b.n)
    for (ca, da), (cb, db) in zip(a.levels, b.levels):
        middle, reach = ca[at] @ cb[cols].T, da[at] @ db[cols].T
        reach += 1e-6 + 1e-9 * np.outer(a.norm[at], b.norm[cols])  # for rounding
        alive = judge(middle - reach, middle + reach, alive, at)
        rows, some = alive.any(axis=1), alive.any(axis=0)
        at, cols, alive = at[rows], cols[some], alive[rows][:, some]
        if not alive.size:
            break
    i, j = np.nonzero(alive)
    return at[i], cols[j]


def best(limit: int) -> Callable:
    """Leaves those that may be among the ``limit`` highest of a row: not below as many certain lower bounds."""

    def judge(lower: np.ndarray, upper: np.ndarray, alive: np.ndarray, at: np.ndarray) -> np.ndarray:
        if alive.shape[1] <= limit:
            return alive
        floor = np.where(alive, lower, -np.inf)
        return alive & (upper >= np.partition(floor, -limit, axis=1)[:, -limit][:, None])

    return judge


def banded(low: np.ndarray, high: np.ndarray, limit: int) -> Callable:
    """Leaves those that may be among the ``limit`` highest of a row within one of its bands low to high (NaN: none)."""

    def judge(lower: np.ndarray, upper: np.ndarray, alive: np.ndarray, at: np.ndarray) -> np.ndarray:
        left = np.zeros_like(alive)
        for k in range(low.shape[1]):
            lo, hi = low[at, k][:, None], high[at, k][:, None]
            may = alive & (upper >= lo) & (lower <= hi)
            if alive.shape[1] > limit:
                sure = np.where(may & (lower >= lo) & (upper <= hi), lower, -np.inf)
                may &= upper >= np.partition(sure, -limit, axis=1)[:, -limit][:, None]
            left |= may
        return left

    return judge


def first_of(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, limit: int) -> np.ndarray:
    """Places of the first ``limit`` of each group: higher scores first, ties by smaller vec_id."""
    order = np.lexsort((row, vec_id, -score, group))
    ranked = group[order]
    begin = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]][: len(ranked)])
    turn = np.arange(len(ranked)) - np.repeat(begin, np.diff(np.r_[begin, len(ranked)]))
    return order[turn < limit]


def chunks(n: int, width: int) -> Iterator[np.ndarray]:
    step = max(1, CELLS // max(1, width))
    return (np.arange(k, min(k + step, n)) for k in range(0, n, step))


def finite_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places, rows in double) of the vectors of each width that are not null and hold finite components only."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for width in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == width)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)
        fine = np.isfinite(x).all(axis=1)
        if fine.any():
            yield int(width), at[fine], x[fine]


def summarised(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: float) -> DataFrame:
    """(row, vec_id, label, width, whole, mean, dev) of the rows that take part, written; whole is floor(scale x)."""
    src = vectors.select(F.monotonically_increasing_id().alias("row"), named(vec_id).cast("long").alias("vec_id"), named(label).alias("label"), named(embedding).alias("embedding"))
    src = src.where("vec_id is not null and label is not null and embedding is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, at, x in finite_rows(batch.column(3)):
                whole = np.floor(x * scale)
                fits = np.abs(whole).max(axis=1, initial=0.0) < 2**63
                whole, at = whole[fits], at[fits]
                mean, dev = summaries(whole)
                kept = batch.take(pa.array(at)).columns[:3]
                lists = [pa.array(list(m), pa.list_(pa.from_numpy_dtype(m.dtype))) for m in (whole.astype(np.int64), mean, dev)]
                names = ["row", "vec_id", "label", "width", "whole", "mean", "dev"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(at), width), pa.int32()), *lists], names)

    kind = src.schema["label"].dataType.simpleString()
    return written(src.mapInArrow(tidied(run), f"row long, vec_id long, label {kind}, width int, whole array<bigint>, mean array<double>, dev array<double>"))


def in_blocks(rows: DataFrame, anchors: DataFrame, keys: list[str], per_row: int, per_anchor: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``anchors`` with (block, other), each in every pair of blocks of equal ``keys``: one pair a task.

    The copies of a row are as many as there are anchor blocks of its keys, and the other way round."""
    count = lambda df, name, per: df.groupBy(*keys).agg(F.ceil(F.count("*") / per).cast("int").alias(name))
    sizes = written(count(rows, "blocks", per_row).join(count(anchors, "others", per_anchor), keys))
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(sizes, keys).withColumn("block", own("blocks")).withColumn("other", every("others"))
    right = anchors.join(sizes, keys).withColumn("other", own("others")).withColumn("block", every("blocks"))
    return left.drop("blocks", "others"), right.drop("blocks", "others")


def compared(rows: DataFrame, anchors: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
    """What ``run`` makes of each pair of blocks, the anchors' first."""
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # both sides come from one table
    return anchors.groupBy(*keys, "block", "other").cogroup(rows.groupBy(*keys, "block", "other")).applyInArrow(run, schema)


FOUND = "anchor long, row long, vec_id long, score long"


def _positives(limit: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((4, 0), dtype=np.int64)]
        if left.num_rows and right.num_rows:
            width = left["width"][0].as_py()
            a, b = Block(left, width), Block(right, width)
            for at in chunks(a.n, b.n):
                i, j = survivors(a, b, a.row[at][:, None] != b.row[None, :], at, best(limit))
                got = np.stack([a.row[i], b.row[j], b.vec_id[j], scores(a, b, i, j)])
                out.append(got[:, first_of(got[0], got[3], got[2], got[1], limit)])
        found = np.concatenate(out, axis=1)
        return pa.table(list(map(pa.array, found)), names=["anchor", "row", "vec_id", "score"])

    return run


def _negatives(limit: int, least: int, most: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((5, 0), dtype=np.int64)]
        if left.num_rows and right.num_rows:
            width = left["width"][0].as_py()
            a, b = Block(left, width), Block(right, width)
            code = pa.chunked_array([*left["label"].chunks, *right["label"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
            mine, theirs = code[: a.n], code[a.n :]
            positives = left["positives"].to_pylist()
            slots = max(map(len, positives))
            # A missing positive is -1: nothing lies from -least to -most percent.
            asked = np.array([[*p, *[-1] * (slots - len(p))] for p in positives], dtype=np.int64)
            low = np.where(asked < 0, np.nan, least * asked.astype(float) / 100 - 1)  # wider by one: for rounding
            high = np.where(asked < 0, np.nan, most * asked.astype(float) / 100 + 1)
            for at in chunks(a.n, b.n):
                i, j = survivors(a, b, mine[at][:, None] != theirs[None, :], at, banded(low, high, limit))
                s = scores(a, b, i, j)
                for k in range(slots):
                    inside = _inside(s, asked[i, k], least, most)
                    got = np.stack([a.row[i[inside]], np.full(inside.sum(), k), b.row[j[inside]], b.vec_id[j[inside]], s[inside]])
                    out.append(got[:, first_of(got[0], got[4], got[3], got[2], limit)])
        found = np.concatenate(out, axis=1)
        return pa.table([*map(pa.array, found)], names=["anchor", "slot", "row", "vec_id", "score"])

    return run


def _inside(score: np.ndarray, positive: np.ndarray, least: int, most: int) -> np.ndarray:
    """least positive <= 100 score <= most positive, in whole numbers."""
    if max(np.abs(score).max(initial=0), np.abs(positive).max(initial=0)) < 2**55:
        return (positive >= 0) & (least * positive <= 100 * score) & (100 * score <= most * positive)
    return np.array([p >= 0 and least * p <= 100 * s <= most * p for s, p in zip(score.tolist(), positive.tolist())], dtype=bool)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    scale: float = 256,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    per_row: int = ROWS,
    per_anchor: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of floor(scale x) of two vectors of equal length; those of other lengths are no
    partners. ``anchor`` is a condition on vec_id. An anchor's positives are the first other rows of its label; each gets
    the first rows of other labels whose score lies from ``least`` to ``most`` percent of the positive's; first are
    higher scores, then smaller vec_id. A positive without such rows has no row, nor has an anchor without positives;
    a negative score of a positive leaves no room for one.

    Rows with a null id, label, vector or component, a component that is not finite or whose whole number takes more than
    64 bits take no part. Rows that repeat a vec_id are rows of their own, also for their anchor. Other columns are left
    out; an empty table gives an empty one. ``least`` and ``most`` are whole, from 0.
    """
    rows = summarised(vectors, vec_id, embedding, label, scale)
    anchors = rows.where(anchor)
    left, right = in_blocks(rows, anchors, ["label", "width"], per_row, per_anchor)
    near = compared(left, right, ["label", "width"], _positives(positives), FOUND)
    turn = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row"))
    near = written(near.withColumn("slot", turn - 1).where(F.col("slot") < positives))
    lists = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "score"))), lambda p: p["score"]).alias("positives"))
    asking = written(anchors.join(lists, F.col("row") == F.col("anchor")).drop("anchor"))
    left, right = in_blocks(rows, asking, ["width"], per_row, per_anchor)
    far = compared(left, right, ["width"], _negatives(negatives, least, most), "anchor long, slot long, row long, vec_id long, score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    far = far.select("anchor", F.col("slot").cast("int").alias("slot"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    named_pairs = near.select("anchor", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(ids, "anchor")
    out = named_pairs.join(far, ["anchor", "slot"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, some labels moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER n AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW n AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER n <= 3
"""
