"""Importance resampling of documents towards the word statistics of a target table.

A text's UTF-8 bytes go through a table of 256 bytes that lower-cases A-Z and blanks separators; ``bytes.split`` gives
the words.  The crc32 of a run of words is extended from the crc32 of the run before it: the old value is the seed for
a blank and the next word.  Counters reduce the features of a batch, arrays of bucket counts are summed up a tree, and
the gains that follow from them (one per bucket, so bounded) go back to the tasks that weigh the documents.

Documents are ranked by one range sort: a row's place in its partition plus the counts of the partitions before it.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, text_of, to_batch, tree_sum, written

WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
TABLE = bytes(b if b in WORD_BYTES else 32 for b in bytes(range(256)).lower())  # bytes.lower changes A-Z only
PIECE = 1 << 20  # bytes of a text that are split at once
COUNTED = 1 << 18  # distinct features that a task counts before it adds them to the buckets
SPREAD = 1024


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``size`` bytes each, cut at blanks."""
    data, start = text.translate(TABLE), 0
    while len(data) - start > size:
        cut = data.find(b" ", start + size)
        if cut < 0:
            break
        yield data[start:cut].split()
        start = cut
    yield data[start:].split()


def runs(text: bytes, order: int, size: int = PIECE) -> Iterator[tuple[int, list[int]]]:
    """(new words, crc32 of all runs of 1 to ``order`` words that end in them) for each piece of a text."""
    before: list[bytes] = []
    for new in pieces(text, size):
        words = before + new
        crcs = list(map(crc32, words))
        found = crcs[len(before) :]
        for n in range(2, order + 1):
            crcs = list(map(crc32, words[n - 1 :], map(crc32, repeat(b" "), crcs)))
            found += crcs[max(0, len(before) - n + 1) :]
        yield len(new), found
        before = words[max(0, len(words) - order + 1) :]


def texts_of(b: pa.RecordBatch, column: str) -> list[bytes]:
    return b.column(column).cast(pa.binary()).to_pylist()


def bucket_counts(df: DataFrame, text_col: str, order: int, buckets: int) -> list[int]:
    """How many features of all texts fall into each bucket."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(buckets, np.int64), Counter()

        def reduce() -> None:
            at = np.fromiter(seen.keys(), np.int64, len(seen)) % buckets
            np.add.at(total, at, np.fromiter(seen.values(), np.int64, len(seen)))
            seen.clear()

        for b in it:
            for text in texts_of(b, "_text"):
                for _, found in runs(text, order):
                    seen.update(found)
                    if len(seen) > COUNTED:
                        reduce()
        reduce()
        yield pa.record_batch({"v": pa.array([total.tobytes()], pa.binary())})

    total = tree_sum(df.select(text_of(text_col).alias("_text")).mapInArrow(count, "v binary"), "v")
    return [0] * buckets if total is None else total.tolist()


def gains(target: list[int], raw: list[int]) -> list[int]:
    """floor(1000 ln(target share / raw share)) of each bucket, both smoothed by one."""
    t_all, s_all, n = sum(target), sum(raw), len(raw)
    return [math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for t, s in zip(target, raw)]


def noise(doc_id: str, seed: int) -> int:
    """floor(1000 g) for the document's own Gumbel draw g."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(df: DataFrame, gain: list[int], id_col: str, text_col: str, order: int, seed: int) -> DataFrame:
    """``_id, _words, _features, _weight, _score`` of every row."""
    table = np.array(gain, np.int64)
    id_type = df.schema[id_col].dataType.simpleString()

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = {"_words": [], "_features": [], "_weight": [], "_score": []}
            for key, text in zip(b.column("_key").to_pylist(), texts_of(b, "_text")):
                words = features = total = 0
                for new, found in runs(text, order):
                    words, features = words + new, features + len(found)
                    total += int(table[np.array(found, np.int64) % len(table)].sum()) if found else 0
                weight = total // features if features else 0
                for k, v in zip(out, (words, features, weight, weight + noise(key, seed))):
                    out[k].append(v)
            rest = to_batch(out, dict.fromkeys(out, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("_id"), *rest.columns], names=["_id", *out])

    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(score, f"_id {id_type}, _words long, _features long, _weight long, _score long")


def ranked(scored: DataFrame) -> DataFrame:
    """``scored`` with ``_rank`` 1, 2, 3... by falling ``_score``, ties to the smaller ``_id``, nulls last.

    Rows are dealt by ranges of (score, id), so many equal scores are no group of their own; equal rows are spread over
    ``SPREAD`` more ranges.  Partitions are then counted, and a row's rank is its place plus the counts before it.
    """
    order = [F.desc("_score"), F.asc_nulls_last("_id"), F.asc("_turn")]
    rows = scored.withColumn("_turn", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.drop("_turn").withColumn("_place", F.monotonically_increasing_id()), "resampling-order")
    part = F.shiftright("_place", 33)  # Spark's own layout: partition above 33 bits, place in it below
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))  # one row a partition
    with_part = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    rank = F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return with_part.withColumn("_rank", rank).drop("_part", "_start", "_place")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
             order: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """``id_col, n_words, n_features, weight, score, rank`` of every row of ``df``.

    Features are all runs of 1 to ``order`` words, in ``buckets`` buckets.  A bucket's gain is the floored 1000-fold
    logarithm of its smoothed share in ``target`` over that in ``df``; ``weight`` is the floored mean gain of a text's
    features, ``score`` adds the id's own Gumbel draw.  Of the N rows with at least ``least_words`` words the
    floor(``percent`` N / 100) highest scores are drawn, ties to the smaller id; ``rank`` is null for all others.

    A null text counts as empty: no features, weight 0.  A null id draws as the empty id and comes last among ties.  Each
    row counts, also one that repeats an id or a text; rows alike in id and score are ranked in any order.  An empty
    ``df`` gives no rows; an empty ``target`` has the same smoothed share in each bucket.  Other columns are not read.
    """
    small_batches(df.sparkSession)
    gain = gains(bucket_counts(target, target_text_col, order, buckets), bucket_counts(df, text_col, order, buckets))
    scored = written(weigh(df, gain, id_col, text_col, order, seed), "resampling-scores")
    enough = F.col("_words") >= least_words
    drawn = scored.filter(enough).count() * percent // 100
    first = ranked(scored.filter(enough)).withColumn("_rank", F.when(F.col("_rank") <= drawn, F.col("_rank")))
    rest = scored.filter(~enough).withColumn("_rank", F.lit(None).cast("long"))
    return first.unionByName(rest).select(F.col("_id").alias(id_col), F.col("_words").alias("n_words"), F.col("_features").alias("n_features"),
                                          F.col("_weight").alias("weight"), F.col("_score").alias("score"), F.col("_rank").alias("rank"))
