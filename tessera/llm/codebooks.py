"""Codes of vectors by ball k-means, in whole numbers.

Vectors are cut into equal parts, each position with a codebook of its own.  The parts that are assigned to an entry
form its ball.  A part at squared distance d from its entry can only be as near to another entry if that one's distance
from the own entry is at most twice as long, so:

* entries beyond twice the ball's radius are no neighbours of the ball and meet none of its parts;
* parts nearer than half the way to the nearest neighbour are the ball's stable core and are left alone;
* the rest lies in rings between halves of the neighbours' distances; a part of ring m meets the m nearest neighbours;
* of an entry that did not move since the last round, only neighbours that moved are looked at.

All comparisons are of whole numbers, so the assignment is the exact one, with ties to the lower index.

Vectors travel in blocks of up to ``BLOCK``.  Each round maps the blocks to blocks with new assignments and their sums,
written to the shared folder; the sums go up a tree, and only the codebooks (bounded) reach the driver and the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tree_sum, written
from .topk import quantized

BLOCK = 8192
LARGEST = 1 << 24  # scaled components below this have exact 64-bit squared distances
STATE = "_n long, _x binary, _codes binary, _sums binary"


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return np.einsum("...d,...d->...", gap, gap)


def nearest(x: np.ndarray, codes: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry of each part, its squared distance, distances computed beside those to the own entry).

    ``codes`` is an assignment: the nearest one under the entries before those that are ``moved``, or any, if all are.
    """
    best, own = codes.astype(np.int64), squared(x, entries[codes])
    least, looked = own.copy(), 0
    half = (squared(entries[:, None], entries[None]) + 3) // 4  # entry j can be as near only where own >= half
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(entries) + 1))
    for i in range(len(entries)):
        ball = order[ends[i] : ends[i + 1]]
        if not len(ball):
            continue
        radius = own[ball].max()
        around = np.flatnonzero((half[i] <= radius) & (moved | moved[i]))
        around = around[around != i]
        around = around[np.argsort(half[i, around], kind="stable")]
        ring = np.searchsorted(half[i, around], own[ball], side="right")  # 0: the stable core
        for m, j in enumerate(around):
            ball, ring = ball[ring > m], ring[ring > m]
            gap = squared(x[ball], entries[j])
            nearer = (gap < least[ball]) | ((gap == least[ball]) & (j < best[ball]))
            least[ball[nearer]], best[ball[nearer]] = gap[nearer], j
            looked += len(ball)
    return best.astype(np.uint8), least, looked


def update(entries: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries moved to the floored means; ``sums`` has the parts' sums and, last, their count."""
    n = sums[..., -1:]
    return np.where(n > 0, sums[..., :-1] // np.maximum(n, 1), entries)


def blocks(rows: DataFrame, parts: int, dims: int) -> DataFrame:
    """Rows (_id, _label, _w) as blocks: lists of ids and labels, parts and assignments as bytes."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("_id", "_label")}

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks()) for c in ("_id", "_label")]
            x = t.column("_w").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            rest = [pa.array([t.num_rows], pa.int64()), *(pa.array([v], pa.binary()) for v in (x.tobytes(), bytes(t.num_rows * parts), b""))]
            return pa.RecordBatch.from_arrays([*lists, *rest], names=["_ids", "_labels", "_n", "_x", "_codes", "_sums"])

        for b in it:
            for at in range(0, b.num_rows, BLOCK):
                piece = b.slice(at, BLOCK)
                if held and sum(h.num_rows for h in held) + piece.num_rows > BLOCK:
                    yield block()
                    held = []
                held.append(piece)
        if sum(h.num_rows for h in held):
            yield block()

    return rows.mapInArrow(pack, f"_ids array<{kinds['_id']}>, _labels array<{kinds['_label']}>, {STATE}")


def read_block(b: pa.RecordBatch, i: int, parts: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts as rows x parts x dims, their assignments) of one block."""
    n = b.column("_n")[i].as_py()
    x = np.frombuffer(b.column("_x")[i].as_buffer(), np.int32).reshape(n, parts, dims).astype(np.int64)
    return x, np.frombuffer(b.column("_codes")[i].as_buffer(), np.uint8).reshape(n, parts)


def assign(state: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """Blocks with each part's nearest entry, and the sums of each entry's parts."""
    parts, size, dims = books.shape

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                x, codes = read_block(b, i, parts, dims)
                now, sums = np.empty_like(codes), np.zeros((parts, size, dims + 1), np.int64)
                for p in range(parts):
                    now[:, p], _, _ = nearest(x[:, p], codes[:, p], books[p], moved[p])
                    np.add.at(sums[p, :, :-1], now[:, p], x[:, p])
                    sums[p, :, -1] = np.bincount(now[:, p], minlength=size)
                same = [b.column(c).slice(i, 1) for c in ("_ids", "_labels", "_n", "_x")]
                yield pa.RecordBatch.from_arrays([*same, pa.array([now.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())],
                                                 names=["_ids", "_labels", "_n", "_x", "_codes", "_sums"])

    return state.mapInArrow(step, state.schema)


def coded(state: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """``_id, _label, _code, _error`` of every vector."""
    parts, _, dims = books.shape
    kinds = {c: state.schema[f"{c}s"].dataType.elementType.simpleString() for c in ("_id", "_label")}

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                x, codes = read_block(b, i, parts, dims)
                now, error = np.empty_like(codes), np.zeros(len(x), np.int64)
                for p in range(parts):
                    now[:, p], least, _ = nearest(x[:, p], codes[:, p], books[p], moved[p])
                    error += least
                digits = now.tobytes().hex()
                text = [digits[at : at + 2 * parts] for at in range(0, len(digits), 2 * parts)]
                ids, labels = (b.column(c).slice(i, 1).flatten() for c in ("_ids", "_labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(error, pa.int64())],
                                                 names=["_id", "_label", "_code", "_error"])

    return state.mapInArrow(step, f"_id {kinds['_id']}, _label {kinds['_label']}, _code string, _error long")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8,
             size: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """(``id_col, label_col, code, error`` of every vector, the codebooks as parts x entries x components).

    Components become floor(``scale`` x).  A codebook starts as its part of the ``size`` vectors of the smallest ids
    (fewer, if there are fewer), each round assigns every part to its nearest entry (ties to the lower index) and moves
    the entries to their parts' floored means; entries without parts stay.  Then parts are assigned again: ``code``
    has two hex digits a part, ``error`` is the sum of squared distances.

    Vectors that are null or hold null or non-finite components take no part; nor do those with scaled components of
    2^24 and more, whose distances could not be held, and those whose length is not that of the smallest id's vector,
    or is no multiple of ``parts``.  Rows that repeat an id each get a code and count in the means, but a vector that
    repeats its id and components starts one entry only.  Null ids come last.  Null labels are kept.  An empty table
    gives no rows and empty codebooks.  Other columns are not read.
    """
    vector = F.col(vector_col)
    rows = df.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), quantized(vector, scale).alias("_w"))
    fits = F.forall("_w", lambda x: F.abs(x) < LARGEST) & (F.size("_w") > 0) & (F.size("_w") % parts == 0)
    rows = rows.filter(F.col("_w").isNotNull() & fits)
    seeds = rows.select("_id", "_w").distinct().orderBy(F.asc_nulls_last("_id"), "_w").limit(size).collect()
    width = len(seeds[0]._w) if seeds else parts
    seeds = [r._w for r in seeds if len(r._w) == width]
    if len(seeds) < size:  # others of that length, if vectors of several lengths are mixed
        seeds = [r._w for r in rows.filter(F.size("_w") == width).select("_id", "_w").distinct().orderBy(F.asc_nulls_last("_id"), "_w").limit(size).collect()]
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, width // parts).transpose(1, 0, 2).copy()
    moved = np.ones(books.shape[:2], bool)

    state = written(blocks(rows.filter(F.size("_w") == width), parts, width // parts), "codebooks-blocks")
    for _ in range(rounds if seeds else 0):
        state = written(assign(state, books, moved), "codebooks-round")
        sums = tree_sum(state, "_sums").reshape(*books.shape[:2], -1)
        after = update(books, sums)
        moved, books = (after != books).any(axis=2), after
    out = coded(state, books, moved)
    return out.select(F.col("_id").alias(id_col), F.col("_label").alias(label_col), F.col("_code").alias("code"), F.col("_error").alias("error")), books
