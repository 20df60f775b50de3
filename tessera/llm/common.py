"""Helpers shared by the text operators: reading, written intermediates, hashing and per-worker caches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir

# Rows of text per Arrow batch: with long texts this bounds what a Python task holds at once.
TEXT_BATCH_ROWS = 500


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Scan of one table with a column projection; text tasks get small Arrow batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch (never raise them) so that whole texts fit in a Python task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet under the cluster's checkpoint folder and read it back.

    Later stages start from the files, so a lost executor never repeats the work behind them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``n`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def text_of(col: str) -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def to_batch(columns: dict[str, Iterable], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in types.items()], names=list(types))


class Recent:
    """Bounded per-worker memory of key -> value, filled in bulk by ``make``.

    Two generations: when the young one holds ``limit`` entries of ordinary length, or fewer long ones of the same
    weight, it becomes the old one, and entries used again move back.  Keys of more than ``LONGEST`` characters are made
    anew each time and forgotten with the next call.  Frequent keys stay; the memory never holds more than two
    generations plus the keys of the batch at hand, whatever the keys' lengths.  Values are pure functions of their
    keys, so eviction changes no result.
    """

    LONGEST = 2000
    ORDINARY = 300  # weight of an ordinary entry: a fixed part and PER_CHARACTER for each character of the key
    FIXED, PER_CHARACTER = 200, 8

    def __init__(self, make: Callable[[list], Iterable], limit: int = 400_000):
        self.make, self.most = make, limit * self.ORDINARY
        self.young: dict = {}
        self.old: dict = {}
        self.weight = 0
        self.passing: list = []

    def ready(self, keys: Iterable) -> dict:
        """A mapping that holds every key of ``keys`` until the next call."""
        for k in self.passing:
            self.young.pop(k, None)
        self.passing = []
        if self.weight > self.most:
            self.old, self.young, self.weight = self.young, {}, 0
        young, old = self.young, self.old
        fresh, back = [], []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                    back.append(k)
                else:
                    fresh.append(k)
        if fresh:
            fresh = list(dict.fromkeys(fresh))
            young.update(zip(fresh, self.make(fresh)))
            self.passing = [k for k in fresh if len(k) > self.LONGEST]
        self.weight += self.FIXED * (len(fresh) + len(back)) + self.PER_CHARACTER * (sum(map(len, fresh)) + sum(map(len, back)))
        self.weight -= sum(self.FIXED + self.PER_CHARACTER * len(k) for k in self.passing)
        return young


def values_of(memory: Recent, lists: list[list]) -> list[list]:
    """The values (never None) of the keys of every list; keys that are remembered are looked up just once."""
    get = memory.young.get
    found = [list(map(get, keys)) for keys in lists]
    missing = [[i for i, v in enumerate(values) if v is None] for values in found]
    known = memory.ready(dict.fromkeys(keys[i] for keys, at in zip(lists, missing) for i in at))
    for keys, values, at in zip(lists, found, missing):
        for i in at:
            values[i] = known[keys[i]]
    return found


def batches(it: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches with one column as Python strings."""
    for b in it:
        if b.num_rows:
            yield b, b.column(column).to_pylist()


def tree_sum(df: DataFrame, column: str, width: int = 64) -> np.ndarray | None:
    """Element-wise sum of a binary column of int64 arrays of one length; None if there are no rows.

    Tasks add their own rows, ``width`` tasks add those sums, and at most ``width`` arrays reach the driver.  A task
    holds two arrays at a time, however many rows it reads.
    """

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in it:
            for raw in b.column(0):
                one = np.frombuffer(raw.as_buffer(), np.int64)
                total = one.copy() if total is None else total + one
        if total is not None:
            yield pa.record_batch({"v": pa.array([total.tobytes()], pa.binary())})

    own = df.select(F.col(column).alias("v")).mapInArrow(add, "v binary").withColumn("at", F.spark_partition_id())
    few = own.repartition(width, "at").select("v").mapInArrow(add, "v binary").collect()
    return sum(np.frombuffer(r.v, np.int64) for r in few) if few else None
