"""Packing token sequences: a non-negative least-squares plan over shallow length combinations.

Each task takes its documents in blocks, cuts full windows off, and counts the rest by length. All combinations of
up to three lengths that fill a window are enumerated, their repeat counts are solved against that histogram,
rounded and laid out; what is left is packed greedily, cut where a window ends. No shuffle: a block's plan needs only
the block, at most one sequence a block stays open, and a lost task repeats the same layout.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import spread

from .common import table, tidied
from .tokens import encoder

WINDOW, STEP, END = 2048, 16, 1
#: Token ids of a block: some 32 MB.
BLOCK = 1 << 23


def combinations(bins: int, present: np.ndarray) -> np.ndarray:
    """All (a, b, c), a >= b >= c >= 0, of present bin numbers (0: no piece) that add up to ``bins``."""
    a, b = np.meshgrid(np.arange(1, bins + 1), np.arange(0, bins + 1), indexing="ij")
    c = bins - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[ok], b[ok], c[ok]
    there = np.zeros(bins + 1, dtype=bool)
    there[present] = True
    there[0] = True
    ok = there[a] & there[b] & there[c]
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def nnls(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """argmin |a x - y| over x >= 0 by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    gram, rhs = a.T @ a, a.T @ y
    x, used = np.zeros(n), np.zeros(n, dtype=bool)
    slack = 1e-9 * max(1.0, np.abs(rhs).max(initial=0.0))
    for _ in range(3 * min(n, a.shape[0]) + 1):
        gain = np.where(used, -np.inf, rhs - gram @ x)
        j = int(np.argmax(gain)) if n else 0
        if not n or gain[j] <= slack:
            break
        used[j] = True
        while True:
            at = np.flatnonzero(used)
            part = gram[np.ix_(at, at)]
            part.flat[:: len(at) + 1] += 1e-9
            s = np.linalg.solve(part, rhs[at])
            if s.min(initial=1.0) > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = (x[at][low] / (x[at][low] - s[low])).min()
            x[at] = x[at] + step * (s - x[at])
            used[at[x[at] <= 1e-9]] = False
            x[~used] = 0
            if not used.any():
                break
    return x


def layout(lengths: np.ndarray, window: int = WINDOW, step: int = STEP) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length) that cover each document's tokens once and none twice."""
    out: list[list[tuple[int, int, int]]] = []
    whole, rest = np.divmod(lengths, window)
    for d in np.flatnonzero(whole):
        out += [[(int(d), i * window, window)] for i in range(whole[d])]
    queues: dict[int, list[int]] = defaultdict(list)
    for d in np.flatnonzero(rest):
        queues[-(-int(rest[d]) // step)].append(int(d))
    tail = lambda d: (d, int(whole[d]) * window, int(rest[d]))
    bins = window // step
    if queues:
        present = np.array(sorted(queues))
        combos = combinations(bins, present)
        if len(combos):
            a = np.zeros((bins + 1, len(combos)))
            for k in range(3):
                np.add.at(a, (combos[:, k], np.arange(len(combos))), 1)
            histogram = np.array([len(queues.get(b, ())) for b in range(bins + 1)], dtype=float)
            repeats = nnls(a[present], histogram[present])
            for k in np.argsort(-repeats, kind="stable"):
                parts = [int(b) for b in combos[k] if b]
                n = int(round(repeats[k]))
                while n > 0 and all(len(queues[b]) >= parts.count(b) for b in parts):
                    out.append([tail(queues[b].pop()) for b in parts])
                    n -= 1
    left = sorted((d for q in queues.values() for d in q), key=lambda d: (-rest[d], d))
    line: list[tuple[int, int, int]] = []
    room = window
    for d in left:
        _, start, n = tail(d)
        while n:
            cut = min(n, room)
            line.append((d, start, cut))
            start, n, room = start + cut, n - cut, room - cut
            if not room:
                out.append(line)
                line, room = [], window
    return out + [line] if line else out


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = WINDOW, block: int = BLOCK
) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all documents.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers, each document's followed by id 1. A null
    or empty text is that one id. ``tokenizer`` is a file on every executor. Rows are told apart by place, so repeated
    documents and null ids are packed each on its own. An empty table gives no pieces.
    """
    kind = docs.schema[doc_id].dataType
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(tokenizer), np.array([END], dtype="<u4").tobytes()
        first = TaskContext.get().partitionId() << 33
        names: list[pa.Array] = []
        held: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, names, held, size
            lengths = np.array([len(x) // 4 for x in held], dtype=np.int64)
            lines = layout(lengths, window)
            owner = pa.concat_arrays(names)
            for lo in range(0, len(lines), 1024):
                rows = [(d, s, n, k, at) for k, line in enumerate(lines[lo : lo + 1024], first + lo) for (d, s, n), at in zip(line, offsets(line), strict=True)]
                d, s, n, k, at = zip(*rows, strict=True)
                ids = pa.array([held[i][4 * a : 4 * (a + m)] for i, a, m in zip(d, s, n, strict=True)], pa.binary())
                numbers = [pa.array(x, pa.int64()) for x in (s, n, lengths[list(d)], k, at)]
                columns = [owner.take(pa.array(d)), numbers[0], numbers[1], ids, *numbers[2:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            first, names, held, size = first + len(lines), [], [], 0

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                held += [x + end for x in known.ids(part.column(1).to_pylist())]
                names.append(part.column(0))
                size += sum(len(x) for x in held[-part.num_rows :]) // 4
                if size >= block:
                    yield from flush()
        if held:
            yield from flush()

    return src.mapInArrow(tidied(run), schema)


def offsets(line: list[tuple[int, int, int]]) -> list[int]:
    """Where each piece of a sequence begins."""
    return [0, *np.cumsum([n for _, _, n in line])[:-1].tolist()]


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its place in a sequence and the checksum of its ids."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
