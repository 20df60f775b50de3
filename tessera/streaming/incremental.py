"""Incremental loading of new, corrected and withdrawn releases.

``load_changed_releases`` compares the files' SHA-256 digests with those of the last load.  Rows carry the file they
came from, so a corrected file replaces its own rows and a withdrawn one takes its rows along, while other files of the
same (edition, table_id) partition keep theirs: only the partitions that such a file touches are written again, as
what other files hold there plus the new rows.

A load is staged first, under the cluster's shared ``spark.checkpoint.dir``: the file list with digests and the whole
new content of the touched partitions.  Naming the stage in a journal is the point of no return; a load that breaks
off before it changes nothing, one that breaks off after it is finished by the next load.

``load_new_releases`` is a file stream: the ``binaryFile`` source remembers in its checkpoint which files it has
processed, and each micro-batch goes through the same replacement, so a repeated batch writes nothing twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_dir
from ..sources.manifest import new_or_changed
from ..sources.workbook import cells_of

PARTITIONS = ("edition", "table_id")
SOURCE = "source_file"
STATE_SCHEMA = "path string, sha256 string, partitions array<string>"
JOURNAL_SCHEMA = "stage string, emptied array<string>"


def release_stream(spark: SparkSession, folder: str, glob: str = "*.xlsx", max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming cells of new workbooks (path, sheet, row, col, text)."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(folder)
    )

    return cells_of(files)


def _table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame | None:
    """The Parquet table at ``path``, or None if there is none yet."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.parquet(path)
        df.head(1)
        return df
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _parts(df: DataFrame) -> list[str]:
    return [c for c in PARTITIONS if c in df.columns]


def _partition_key(parts: list[str]) -> Column:
    """The partition of a row as text; an expression of partition columns alone, so a filter on it prunes folders."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in parts]), {"ignoreNullFields": "false"})


def _held(spark: SparkSession, out_path: str, like: StructType) -> DataFrame | None:
    """The rows of the published table, with the types of ``like`` where it has the column."""
    found = _table(spark, out_path)
    if found is None:
        return None
    known = set(like.fieldNames())
    whole = StructType(list(like.fields) + [f for f in found.schema.fields if f.name not in known])
    return spark.read.schema(whole).parquet(out_path)


def _with_source(tidy: DataFrame) -> DataFrame:
    """Tidy rows with their file in ``source_file``, if the transform kept ``path``."""
    return tidy.withColumnRenamed("path", SOURCE) if "path" in tidy.columns and SOURCE not in tidy.columns else tidy


def stage_replacement(tidy: DataFrame, out_path: str, gone: DataFrame, gone_partitions: list[str] | None, stage: str) -> list[str]:
    """Write the new content of all touched partitions to ``stage``/rows; returns the partitions that end up empty.

    ``gone`` lists the files (``path``) whose old rows go; ``gone_partitions`` the partitions that hold such rows (None:
    look for them).  Without partition columns the whole table counts as one partition.
    """
    spark = tidy.sparkSession
    parts = _parts(tidy)
    key = _partition_key(parts) if parts else F.lit("{}")
    new = f"{stage}/new"
    tidy.write.parquet(new)
    tidy = spark.read.schema(tidy.schema).parquet(new)
    here = {r.k for r in tidy.select(key.alias("k")).distinct().collect()}
    held = _held(spark, out_path, tidy.schema)
    if held is None:
        tidy.write.parquet(f"{stage}/rows")
        return []
    lost = gone.select(F.col("path").alias(SOURCE))
    if gone_partitions is None:
        gone_partitions = [r.k for r in held.join(lost, SOURCE, "left_semi").select(key.alias("k")).distinct().collect()]
    touched = sorted(here | set(gone_partitions))
    if not touched:
        tidy.write.parquet(f"{stage}/rows")
        return []
    kept = held.filter(key.isin(touched)).join(lost, SOURCE, "left_anti")
    kept.unionByName(tidy, allowMissingColumns=True).write.parquet(f"{stage}/rows")
    after = spark.read.schema(StructType(held.schema.fields)).parquet(f"{stage}/rows")
    full = {r.k for r in after.select(key.alias("k")).distinct().collect()}
    return [p for p in touched if p not in full]


def publish_stage(spark: SparkSession, stage: str, emptied: list[str], out_path: str) -> None:
    """Bring the staged partitions to the published table; doing it again changes nothing."""
    rows = spark.read.parquet(f"{stage}/rows") if _table(spark, f"{stage}/rows") is not None else None
    if rows is None:
        return
    parts = _parts(rows)
    if not parts:
        rows.write.mode("overwrite").parquet(out_path)
        return
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(out_path)
    nothing = rows.drop(*parts).limit(0)
    for name in spark.createDataFrame([(e,) for e in emptied], "e string").select(
        F.from_json("e", ", ".join(f"{c} string" for c in parts)).alias("p")).collect() if emptied else []:
        folder = "/".join(f"{c}={_folder_name(name.p[c])}" for c in parts)
        nothing.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/{folder}")


def _folder_name(value: str | None) -> str:
    """A partition value as Spark writes it in a folder name."""
    if value is None or value == "":
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in '"#%\'*/:=?\\{[]^\x7f' else c for c in value)


def _journal_path(state_path: str) -> str:
    return f"{state_path.rstrip('/')}-journal"


def commit(spark: SparkSession, stage: str, emptied: list[str], out_path: str, state_path: str) -> None:
    """Name the stage in the journal, then publish it."""
    spark.createDataFrame([(stage, emptied)], JOURNAL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(_journal_path(state_path))
    finish_pending(spark, out_path, state_path)


def finish_pending(spark: SparkSession, out_path: str, state_path: str) -> bool:
    """Publish the stage that the journal names, if any, and take over its file list; True if there was one."""
    journal = _table(spark, _journal_path(state_path), JOURNAL_SCHEMA)
    entry = journal.head(1) if journal is not None else []
    if not entry:
        return False
    stage = entry[0].stage
    publish_stage(spark, stage, entry[0].emptied, out_path)
    files = _table(spark, f"{stage}/files", STATE_SCHEMA)
    if files is not None:
        files.write.mode("overwrite").parquet(state_path)
    spark.createDataFrame([], JOURNAL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(_journal_path(state_path))
    return True


def load_changed_releases(spark: SparkSession, folder: str, out_path: str, transform: Callable[[DataFrame], DataFrame],
                          state_path: str, glob: str = "*.xlsx") -> int:
    """Load files whose digest differs from the last load's and take out withdrawn ones; returns how many of both.

    ``transform`` turns cells into tidy rows and should keep ``path`` (published as ``source_file``): then only what those
    files touch is written.  If it drops ``path``, or the published table has no such column, all files are loaded
    again, for their rows cannot be told apart.  Digests are taken once and written before the files are parsed: a file
    corrected in between has its old digest on record and is loaded again next time.
    """
    finish_pending(spark, out_path, state_path)
    stage = f"{checkpoint_dir(spark).rstrip('/')}/releases-{uuid.uuid4().hex}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    files.select("path", F.sha2("content", 256).alias("sha256")).write.parquet(f"{stage}/digests")
    now = spark.read.schema("path string, sha256 string").parquet(f"{stage}/digests")
    before = _table(spark, state_path, STATE_SCHEMA)
    if before is None:
        before = spark.createDataFrame([], STATE_SCHEMA)
    changed = new_or_changed(now, before).select("path")
    withdrawn = before.join(now, "path", "left_anti").select("path")
    n = changed.count() + withdrawn.count()
    if not n:
        return 0

    cells = lambda some: cells_of(files.join(some, "path", "left_semi"))
    tidy = _with_source(transform(cells(changed)))
    held = _table(spark, out_path)
    if SOURCE in tidy.columns and (held is None or SOURCE in held.columns):
        gone = changed.unionByName(withdrawn)
        old = before.join(gone, "path", "left_semi").select(F.explode("partitions").alias("k")).distinct()
        emptied = stage_replacement(tidy, out_path, gone, [r.k for r in old.collect()], stage)
        parts = _parts(tidy)
        key = _partition_key(parts) if parts else F.lit("{}")
        where = spark.read.parquet(f"{stage}/new").groupBy(F.col(SOURCE).alias("path")).agg(F.collect_set(key).alias("fresh"))
        listed = now.join(before.select("path", F.col("partitions").alias("old")).join(changed, "path", "left_anti"), "path", "left")
        listed = listed.join(where, "path", "left").select("path", "sha256", F.coalesce("fresh", "old", F.array().cast("array<string>")).alias("partitions"))
    else:
        tidy = _with_source(transform(cells(now)))
        parts = _parts(tidy)
        tidy.write.parquet(f"{stage}/rows")
        after = spark.read.schema(tidy.schema).parquet(f"{stage}/rows")
        key = _partition_key(parts) if parts else F.lit("{}")
        keys = lambda df: {r.k for r in df.select(key.alias("k")).distinct().collect()}
        emptied = sorted(keys(_held(spark, out_path, tidy.schema)) - keys(after)) if held is not None and parts else []
        listed = now.withColumn("partitions", F.array().cast("array<string>"))
    listed.write.parquet(f"{stage}/files")
    commit(spark, stage, emptied, out_path, state_path)
    return n


def load_new_releases(
    spark: SparkSession,
    folder: str,
    out_path: str,
    transform: Callable[[DataFrame], DataFrame],
    name: str = "releases",
    glob: str = "*.xlsx",
    max_files_per_trigger: int = 100,
):
    """Process every release not seen before and publish its tidy rows; returns the finished query.

    If ``transform`` keeps ``path``, a batch replaces the rows of its own files only.  Otherwise its rows go into a
    partition of the batch's own (``batch``), so that files of several batches can share an edition and table.
    """
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}"
    state = f"{ckpt}-load"
    finish_pending(spark, out_path, state)

    def write_batch(cells: DataFrame, epoch: int) -> None:
        tidy = transform(cells)
        if tidy is None:
            return
        tidy = _with_source(tidy)
        if SOURCE in tidy.columns:
            stage = f"{checkpoint_dir(spark).rstrip('/')}/releases-{uuid.uuid4().hex}"
            emptied = stage_replacement(tidy, out_path, cells.select("path").distinct(), None, stage)
            commit(spark, stage, emptied, out_path, state)
        else:
            own = tidy.withColumn("batch", F.lit(f"{name}-{epoch}"))
            own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *_parts(tidy)).parquet(out_path)

    q = (
        release_stream(spark, folder, glob, max_files_per_trigger)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def edition_from_path(path_col: str = "path") -> F.Column:
    """Edition key from a release file name: ``<family>_<edition>.xlsx`` -> ``<edition>``."""
    return F.regexp_extract(F.col(path_col), r"_([^_/]+)\.xlsx$", 1)
