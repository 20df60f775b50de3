"""Packing of documents into fixed token windows: concatenate and cut.

Pass 1 encodes every document in place and gives it its start among the tokens of its own partition.  The
totals of the partitions (one number each) are summed up in order, which gives every partition, and so every
document, its place in one long stream; nothing is moved for that.  Pass 2 cuts each document where the stream
crosses a window edge and gives a boundary record for each piece.  No row is shuffled, whatever its source or
length.

All windows are full but the rest at the end of the stream, which is cut into powers of two: no window needs
padding.
"""

from __future__ import annotations

import json
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Recent, batches, small_batches, text_of, written
from .word_bpe import chunks

WINDOW = 4096


class ChunkIds:
    """Ids of chunks without white space from a tokenizer file of the tokenizers library, as packed bytes.

    The vocabulary drops white space, so chunks are encoded independently of each other.  New chunks go to the
    library many at once, joined by spaces; the offsets in its answer tell their ids apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.dtype = np.dtype("<u2" if top < 65536 else "<u4")
        self.memory = Recent(self.make, 600_000)

    def make(self, keys: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for start in range(0, len(keys), 256):
            some = keys[start : start + 256]
            plain = [k for k in some if "<" not in k]
            found = dict(zip(plain, self.joined(plain)))
            rest = [k for k in some if k not in found]
            for k, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
                found[k] = np.array(e.ids, self.dtype).tobytes()
            out += [found[k] for k in some]
        return out

    def joined(self, keys: list[str]) -> list[bytes]:
        """Offsets count characters of the joined text, so they tell where each chunk's ids begin."""
        e = self.tokenizer.encode(" ".join(keys), add_special_tokens=False)
        ids = np.array(e.ids, self.dtype)
        starts = np.array([o[0] for o in e.offsets], np.int64)
        edges = np.cumsum([len(k) + 1 for k in keys])
        cut = np.searchsorted(starts, edges)
        return [ids[a:b].tobytes() for a, b in zip([0, *cut], cut)]


_LOADED: dict[str, ChunkIds] = {}


def loaded(path: str) -> ChunkIds:
    if path not in _LOADED:
        _LOADED[path] = ChunkIds(path)
    return _LOADED[path]


def encoded(df: DataFrame, vocab_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pass 1: ``_id, _part, _local, _n, _ids`` (packed ids with the end id; start among the partition's tokens)."""

    def run(it):
        source = loaded(vocab_path)
        end = np.array([end_id], source.dtype).tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for b, texts in batches(it, "_text"):
            for start in range(0, len(texts), 50):
                cut = [chunks(t) for t in texts[start : start + 50]]
                known = source.memory.ready(set().union(*cut))
                ids = [b"".join(map(known.__getitem__, cs)) + end for cs in cut]
                sizes = np.array([len(x) // source.dtype.itemsize for x in ids], np.int64)
                local = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                columns = [b.column("_id").slice(start, len(cut)), pa.array([part] * len(cut), pa.int32()), pa.array(local),
                           pa.array(sizes), pa.array(ids, pa.binary()), pa.array([source.dtype.itemsize] * len(cut), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_part", "_local", "_n", "_ids", "_width"])

    id_type = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    return picked.mapInArrow(run, f"_id {id_type}, _part int, _local long, _n long, _ids binary, _width int")


def cut_points(start: int, end: int, total: int, window: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Edges of the pieces of a document at [start, end) of the stream, and (sequence, offset) of each piece."""
    full = total // window
    if end <= min(full * window, (start // window + 1) * window):
        return [0, end - start], [(start // window, start % window)]
    tail, rest = [full * window], total % window
    while rest:
        size = 1 << (rest.bit_length() - 1)
        tail.append(tail[-1] + size)
        rest -= size
    edges, places, at = [], [], start
    while at < end:
        if at < tail[0]:
            seq = at // window
            first, following = seq * window, (seq + 1) * window
        else:
            k = bisect_right(tail, at) - 1
            seq, first, following = full + k, tail[k], tail[k + 1]
        edges.append(at - start)
        places.append((seq, at - first))
        at = min(end, following)
    return [*edges, end - start], places


def pack(df: DataFrame, vocab_path: str, window: int = WINDOW, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Boundary records: ``id_col, start, length, ids, doc_tokens, sequence_id, offset``.

    One row per piece of a document: ``start`` counts the document's ids before it, ``ids`` are its ids as
    unsigned little-endian 32-bit numbers, ``offset`` is its place in sequence ``sequence_id``.  ``window`` is a
    power of two.  A null or empty text is its end id alone; repeated rows are packed each; an empty table gives
    no rows.  Other columns are not read.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    small_batches(df.sparkSession)
    docs = written(encoded(df, vocab_path, end_id, id_col, text_col), "packing-ids")
    totals = docs.groupBy("_part").agg(F.sum("_n").alias("_total"))
    # one row per partition of the scan: a running sum over those few numbers, sent to every task
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"),
                          F.sum("_total").over(Window.partitionBy()).alias("_all"))
    placed = docs.join(F.broadcast(bases), "_part").select("_id", "_n", "_ids", "_width", (F.col("_base") + F.col("_local")).alias("_at"), "_all")

    def run(it):
        for b in it:
            at, n, total, width, packed = (b.column(c).to_pylist() for c in ("_at", "_n", "_all", "_width", "_ids"))
            rows, starts, sizes, ids, seqs, offsets = [], [], [], [], [], []
            for i in range(b.num_rows):
                wide = np.frombuffer(packed[i], "<u2" if width[i] == 2 else "<u4").astype("<u4").tobytes()
                edges, places = cut_points(at[i], at[i] + n[i], total[i], window)
                for x, y, (seq, offset) in zip(edges, edges[1:], places):
                    rows.append(i)
                    starts.append(x)
                    sizes.append(y - x)
                    ids.append(wide[4 * x : 4 * y])
                    seqs.append(seq)
                    offsets.append(offset)
            take = pa.array(rows, pa.int64())
            columns = [b.column("_id").take(take), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                       b.column("_n").take(take), pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed windows themselves: ``sequence_id, length, ids`` (at most one window of ids in a group)."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return pieces.groupBy("sequence_id").agg(ordered.alias("p"), F.sum("length").alias("length")).select("sequence_id", "length", joined.alias("ids"))
