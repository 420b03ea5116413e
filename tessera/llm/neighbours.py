"""Embedding near-dedup: spherical k-means cells, blocked cosine products within them, one representative a group.

Cells are fitted on a bounded sample, but every vector is compared with all that can be within reach. For unit
vectors x, y of cosine t or more, |x - y| <= sqrt(2 - 2 t). If x's nearest centre is c and y's is d, then
x.(c - d) and y.(d - c) are both at least 0 and add up to at most |x - y| |c - d|; the smaller is at most half of that.
So one of the two vectors finds the other's cell within that margin of its best score, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, table, tidied, unit_hash, written

#: Vectors of a (label, cell) that one task compares with as many others.
BLOCK = 4096


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Unit centres of unit rows: farthest-first seeding is not needed, distinct random rows do."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], centres)
    return centres


def unit_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places, unit rows in double) of the usable vectors of each width: not null or empty, finite, not zero."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for width in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == width)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        with np.errstate(all="ignore"):
            top = np.abs(x).max(axis=1)
            fine = np.isfinite(top) & (top > 0)
            x = x[fine] / top[fine][:, None]
            x /= np.linalg.norm(x, axis=1)[:, None]
        if len(x):
            yield int(width), at[fine], x


def near_duplicates(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    least: float = 0.93,
    per_cell: int = 4096,
    sample: int = 20_000,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Rows link where labels are equal and not null and the cosine is ``least`` or more; a vector that is null, zero
    or holds null or non-finite components links with nothing, vectors of different length never with each other. Rows
    that repeat a vec_id are vectors of their own when links are counted and share that id's component. A null vec_id is
    its own component with null id. Extra columns are left out, an empty table gives an empty one. ``sample`` bounds the
    rows on which the cells are fitted, for the commonest length among them; vectors of any other length have one cell.
    The largest (label, cell) is dealt out in pairs of blocks.
    """
    src = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding")
    )
    src = written(src)
    usable = src.where("embedding is not null and label is not null and vec_id is not null")
    n = usable.count()
    share = min(1.0, sample / max(n, 1))
    chosen = usable.where(unit_hash("cells", F.col("vec_id")) < share).orderBy("vec_id", "row").limit(2 * sample).select("embedding").toArrow()
    x = max((u for _, _, u in unit_rows(chosen.column(0).combine_chunks())), key=len, default=np.zeros((0, 1)))
    centres = spherical_kmeans(x, max(1, min(4096, n // per_cell))) if len(x) else np.zeros((1, 1))
    gaps = np.sqrt(np.maximum(0.0, 2 - 2 * centres @ centres.T)) * np.sqrt(2 - 2 * least) / 2 + 1e-9

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, at, unit in unit_rows(batch.column(3)):
                if width == centres.shape[1]:
                    scores = unit @ centres.T
                    home = np.argmax(scores, axis=1)
                    near = scores[np.arange(len(home)), home][:, None] - scores <= gaps[home]
                    cells = [np.flatnonzero(r).astype(np.int32) for r in near]
                else:
                    home, cells = np.zeros(len(at), dtype=np.int32), [np.zeros(1, dtype=np.int32)] * len(at)
                kept = batch.take(pa.array(at))
                columns = [*kept.columns[:3], pa.array(np.full(len(at), width), pa.int32()), pa.array(list(unit), pa.list_(pa.float64()))]
                columns += [pa.array(home.astype(np.int32)), pa.array(cells, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "label", "width", "unit", "home", "cells"])

    kind = usable.schema["label"].dataType.simpleString()
    placed = written(usable.mapInArrow(tidied(assign), f"row long, vec_id long, label {kind}, width int, unit array<double>, home int, cells array<int>"))
    sizes = placed.select("label", "width", F.explode("cells").alias("cell")).groupBy("label", "width", "cell").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).drop("size")
    dealt = placed.withColumn("cell", F.explode("cells")).join(sizes, ["label", "width", "cell"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "blocks")
    links = written(dealt.groupBy("label", "width", "cell", "lo", "hi").applyInPandas(_compare(least), "a long, b long, row long, links long"))
    counts = links.where("row is not null").groupBy("row").agg(F.sum("links").alias("n_links"))
    groups = components(links.where("a is not null").select("a", "b"))
    rows = src.select("row", "vec_id").join(counts, "row", "left").join(groups, F.col("vec_id") == F.col("node"), "left")
    root = F.coalesce("root", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (F.col("vec_id") == root).alias("kept"))


def _compare(least: float):
    """Links of one pair of blocks: a count for each row that has some, and a tree of edges for each set of linked ids."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        cell, lo, hi = int(pdf["cell"][0]), int(pdf["lo"][0]), int(pdf["hi"][0])
        x = np.stack(pdf["unit"].to_numpy())
        home, own = pdf["home"].to_numpy(), pdf["own"].to_numpy()
        width = max(int(home.max()), cell, max(int(c.max()) for c in pdf["cells"])) + 1
        member = np.zeros((len(pdf), width), dtype=bool)
        for i, cells in enumerate(pdf["cells"]):
            member[i, cells] = True
        ids, rows = pdf["vec_id"].to_numpy(), pdf["row"].to_numpy()
        count = np.zeros(len(pdf), dtype=np.int64)
        parent = np.arange(len(pdf))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for at in range(0, len(pdf), 512):
            part = slice(at, min(at + 512, len(pdf)))
            i, j = np.nonzero(x[part] @ x.T >= least)
            i += at
            # A pair of blocks is complete when one vector is in each; a block with itself when both are in it.
            ok = (i < j) & ((own[i] != own[j]) if lo != hi else True)
            i, j = i[ok], j[ok]
            # Of the cells where a pair can meet (the home of one, held by the other), the lowest counts it.
            meet = np.minimum(np.where(member[j, home[i]], home[i], width), np.where(member[i, home[j]], home[j], width))
            ok = meet == cell
            i, j = i[ok], j[ok]
            np.add.at(count, i, 1)
            np.add.at(count, j, 1)
            for p, q in zip(i.tolist(), j.tolist(), strict=True) if len(i) < 4096 else _sparse(i, j):
                p, q = find(p), find(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        linked = np.flatnonzero(count)
        roots = np.array([find(i) for i in linked], dtype=np.int64)
        edges = pd.DataFrame({"a": ids[roots], "b": ids[linked]}) if len(linked) else pd.DataFrame({"a": [], "b": []})
        edges = edges[edges["a"] != edges["b"]]
        totals = pd.DataFrame({"row": rows[linked], "links": count[linked]})
        return pd.concat([edges, totals]).astype("Int64")[["a", "b", "row", "links"]]

    return run


def _sparse(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs that join the same sets as (i, j): labels spread along the pairs until they stay, then one pair a row."""
    nodes, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = flat[: len(i)], flat[len(i) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return zip(nodes.tolist(), nodes[label].tolist(), strict=True)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors, one kept of each group."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
