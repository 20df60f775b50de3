"""Sinks (S11-S15): partitioned Parquet, CSV copies, bounded exports, snapshot metadata.

Atomic publication of one table is Spark's output commit protocol: a job writes task
output to a staging area and commits it at the end, so readers never see a
half-written table; with dynamic partition overwrite only the partitions
present in the new data are replaced (one edition, one table id).

``publish`` does the same for several tables and their metadata: a version is written whole into a folder of its own,
and one appended pointer row makes it the current one.  A writer that breaks off leaves the version before it current.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import CSV_EXPORT_MAX, JSON_EXPORT_MAX, ReadError


def write_tidy(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Tidy table as Parquet partitioned by (edition, table_id); replaces only the partitions written."""
    parts = partition_by if partition_by is not None else [c for c in ("edition", "table_id") if c in df.columns]
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if parts:
        # Cluster rows of one partition together so each task writes few files.
        df = df.repartition(*parts)
        w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts)
    w.parquet(path)


def write_csv_copy(df: DataFrame, path: str) -> None:
    """CSV copy with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def bounded_export(df: DataFrame, order_by: list[str], limit: int | None, fmt: str = "csv", offset: int = 0) -> DataFrame:
    """An ordered extract within the format's maximum (CSV 250 000, JSON 5 000 rows).

    ``limit=None`` asks for all rows from ``offset`` on and raises when they are more than the maximum; nothing
    is left out silently.
    """
    caps = {"csv": CSV_EXPORT_MAX, "json": JSON_EXPORT_MAX}
    if fmt not in caps:
        raise ReadError(f"unknown export format {fmt!r}")
    cap = caps[fmt]
    if limit is None:
        if df.offset(offset).limit(cap + 1).count() > cap:
            raise ReadError(f"more than {cap} rows: give a limit or read page by page")
        return df.orderBy(*order_by).offset(offset)
    if not 1 <= int(limit) <= cap:
        raise ReadError(f"{fmt} export limit must be within 1..{cap}")
    return df.orderBy(*order_by).offset(offset).limit(int(limit))


def write_export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    out = df.coalesce(1)
    if fmt == "csv":
        out.write.mode("overwrite").option("header", "true").csv(path)
    else:
        out.write.mode("overwrite").json(path)


def write_snapshot(df: DataFrame, path: str, meta: dict) -> None:
    """The snapshot table plus a one-row metadata document next to it (editions, periods, caveats)."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(meta, sort_keys=True, default=str),)], "meta string").coalesce(1).write.mode("overwrite").text(
        f"{path}/meta"
    )


def write_backtest(windows: DataFrame, summary: DataFrame, path: str) -> None:
    """Backtest windows and per-model summary as Parquet tables."""
    windows.write.mode("overwrite").parquet(f"{path}/backtest_windows")
    summary.write.mode("overwrite").parquet(f"{path}/backtest_summary")


POINTER_SCHEMA = "seq long, version string"


def current_version(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """(number, folder name) of the version that readers see, or None before the first."""
    try:
        row = spark.read.schema(POINTER_SCHEMA).json(f"{path}/pointers").orderBy(F.desc("seq"), F.desc("version")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return (row.seq, row.version) if row else None


def publish(tables: dict[str, DataFrame], path: str, meta: dict, partition_by: dict[str, list[str]] | None = None) -> str:
    """Write tables and metadata as one version and make it current; returns the version.

    Everything is in place before the pointer row is appended, and appending one row is one committed file, so readers
    see all of the version or none of it.  Of two writers at once the later pointer wins; both versions stay whole.
    """
    spark = next(iter(tables.values())).sparkSession
    before = current_version(spark, path)
    seq = before[0] + 1 if before else 1
    version = f"{seq:08d}-{uuid.uuid4().hex}"
    folder = f"{path}/versions/{version}"
    for name, df in tables.items():
        w = df.write.partitionBy(*partition_by[name]) if partition_by and name in partition_by else df.write
        w.parquet(f"{folder}/{name}")
    doc = json.dumps(meta | {"tables": sorted(tables)}, sort_keys=True, default=str)
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.text(f"{folder}/_meta.json")
    spark.createDataFrame([(seq, version)], POINTER_SCHEMA).coalesce(1).write.mode("append").json(f"{path}/pointers")
    return version


def published(spark: SparkSession, path: str, version: str | None = None) -> tuple[dict[str, DataFrame], dict]:
    """The tables and metadata of the current (or a named) version; all of them belong together."""
    if version is None:
        current = current_version(spark, path)
        if current is None:
            raise ReadError(f"nothing is published at {path}")
        version = current[1]
    folder = f"{path}/versions/{version}"
    meta = json.loads(spark.read.text(f"{folder}/_meta.json", wholetext=True).first()[0])
    return {name: spark.read.parquet(f"{folder}/{name}") for name in meta["tables"]}, meta


def publish_snapshot(df: DataFrame, path: str, meta: dict) -> str:
    """The snapshot table with its metadata (editions, periods, caveats)."""
    return publish({"data": df}, path, meta)


def publish_backtest(windows: DataFrame, summary: DataFrame, path: str, predictions: DataFrame | None = None, metrics: DataFrame | None = None,
                     calibration: DataFrame | None = None, meta: dict | None = None) -> str:
    """Windows and per-model summary of a backtest, with predictions, metrics and calibration where given."""
    tables = {"backtest_windows": windows, "backtest_summary": summary, "predictions": predictions, "metrics": metrics, "calibration": calibration}
    return publish({k: v for k, v in tables.items() if v is not None}, path, meta or {})


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row, NaN/Inf as null, dates ISO, NULLs kept."""
    from pyspark.sql.types import DateType, DoubleType, FloatType, TimestampType

    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)
        elif isinstance(f.dataType, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, TimestampType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))
