"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Rows are dealt into ``runs`` by a hash of their id.  Each run holds one entry per distinct text: the
digest of the normalised text, how many rows carry it and the id that stays.  The runs meet in binomial
rounds: with ``step`` = 1, fan_in, fan_in^2, ... the runs r + step, r + 2 step, ... send their entries to
run r, which merges them with its own.  A merge sorts the entries of its runs by digest and streams equal
ones past each other (Spark's sort aggregation), keeping the id that stays, until run 0 is left: its
entry has the id that stays among all rows.  The answer goes back down the same tree, one join a round.

An entry's key is SHA-256, byte length and a second 64-bit hash, so equal keys are verified equal at
every level.  No key gets more than ``fan_in`` entries in a round, however many copies a text has: a
third of all rows with one text means one entry per run, never one task with all of them.  A run is
spread over tasks by digest, so run 0 is never one task either.  Every level is written, so that a lost
executor repeats one round only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FAN_IN = 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["_sha", "_bytes", "_check"]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.

    Where every other character is one that full lower-casing leaves alone (ASCII, the small letters of
    Latin-1 and its signs), ``lower`` gives the same string faster.
    """
    plain = ~text.rlike("[^\\x00-\\x7f\\u00a0-\\u00bf\\u00df-\\u00ff]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def run_count(shuffle_partitions: int, fan_in: int = FAN_IN) -> int:
    """Runs of the lowest level: the power of the fan-in that covers the shuffle partitions, two levels at least."""
    runs = fan_in * fan_in
    while runs < shuffle_partitions:
        runs *= fan_in
    return runs


def receiver(run: Column, step: int, fan_in: int) -> Column:
    """The run that takes the entries of ``run`` in the round of this step (itself for the receivers)."""
    return (run - run % (step * fan_in)).cast("int")


def merge_runs(entries: DataFrame, keep: str) -> DataFrame:
    """One sorted entry per run and text: the id that stays and the number of rows.

    The best id travels in a struct, which makes Spark sort each side of the exchange by run and digest and merge
    equal neighbours as they stream past.  A null id loses against any other.
    """
    best, first = (F.max, F.isnotnull) if keep == "max" else (F.min, F.isnull)
    merged = entries.groupBy("_run", *KEY).agg(best(F.struct(first("_best"), F.col("_best").alias("id"))).alias("_top"), F.sum("_n").alias("_n"))
    return merged.select("_run", *KEY, F.col("_top.id").alias("_best"), "_n")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                     runs: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty.  ``keep`` says whether
    the largest ("max") or smallest ("min") id of equal texts stays.  ``group_size`` counts rows.  Rows that
    repeat an id with an equal text are one document and give one row; an id with different texts gives a row
    for each.  A null id is kept only if no row of its text has an id.  Other columns are not read, so their
    names cannot clash.  An empty table gives no rows.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    spark = df.sparkSession
    runs = runs or run_count(int(spark.conf.get("spark.sql.shuffle.partitions")), fan_in)
    normal = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = df.select(F.col(id_col).alias("_id"), normal.alias("_text")).select(
        F.pmod(F.xxhash64("_id"), F.lit(runs)).cast("int").alias("_run"),
        F.unhex(F.sha2("_text", 256)).alias("_sha"),
        F.octet_length("_text").alias("_bytes"),
        F.xxhash64("_text").alias("_check"),
        "_id",
    )
    leaf = written(rows.groupBy("_run", *KEY, "_id").agg(F.count(F.lit(1)).alias("_n")), "exact-dedup-runs")

    levels = [written(merge_runs(leaf.withColumnRenamed("_id", "_best"), keep), "exact-dedup-level")]
    step = 1
    while step < runs:
        sent = levels[-1].withColumn("_run", receiver(F.col("_run"), step, fan_in))
        levels.append(written(merge_runs(sent, keep), "exact-dedup-level"))
        step *= fan_in

    answer = levels.pop()
    for level in reversed(levels):
        step //= fan_in
        own = level.select("_run", *KEY).withColumn("_up", receiver(F.col("_run"), step, fan_in))
        answer = _down(own, answer.withColumnRenamed("_run", "_up"), "_up").drop("_up")
    out = _down(leaf.select("_run", *KEY, "_id"), answer, "_run")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_best").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_best")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def _down(below: DataFrame, above: DataFrame, run: str) -> DataFrame:
    """Give every entry of a lower run the answer that its parent run has for the same text."""
    return below.join(above.select(run, *KEY, "_best", "_n"), [run, *KEY])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, whatever their names.

    Null ids and texts, repeats and shared ids count as in ``exact_duplicates``; of rows that repeat an id with an
    equal text, one stays.  An empty table gives no rows.
    """
    key, sha = free_name(df, "_mark_id"), free_name(df, "_mark_sha")
    mark = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(key)
    ids = exact_duplicates(df, id_col, text_col, keep).filter("kept").select(mark, F.col("text_sha256").alias(sha))
    normal = F.sha2(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)
    rows = df.select("*", mark, normal.alias(sha)).join(ids, [key, sha], "left_semi")
    return rows.dropDuplicates([key, sha]).select(*df.columns)
