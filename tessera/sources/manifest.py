"""Manifest, registry, incremental inputs and fingerprints.

File facts come from the ``binaryFile`` source (path, length, modification
time, content) and the SHA-256 is computed in Spark (``sha2``), one task per
file group; row counts come from one scan with ``input_file_name``.
Fingerprints add up file by file (S19).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_manifest(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """Path, bytes, modification time and SHA-256 of every file under ``folder``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select(
        "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"),
        F.sha2(F.col("content"), 256).alias("sha256"),
    )


def parquet_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per Parquet file (one scan, grouped by input file)."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    return df.select(F.input_file_name().alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("num_rows"))


def parquet_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the file footer (no data read)."""
    return spark.read.parquet(path).columns


def registry_snapshot(registry: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Dataset registry left-joined to the manifest; ``available`` when the file exists."""
    return registry.join(manifest, key, "left").withColumn("available", F.col("sha256").isNotNull())


def new_or_changed(manifest: DataFrame, processed: DataFrame) -> DataFrame:
    """Files whose (path, sha256) is not in the processed manifest (anti join)."""
    return manifest.join(processed.select("path", "sha256"), ["path", "sha256"], "left_anti")


def file_facts(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """Path, modification time and size of every file under ``path``; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"))


LANES = 8  # a digest as eight 32-bit numbers, so that sums of up to 2^31 files are exact


def folder_fingerprints(files: DataFrame) -> DataFrame:
    """``folder, n_files, fingerprint`` of every folder that holds files, directly or further down.

    A file's digest is that of path, time and size (and content, where there is a ``sha256`` column); a folder's
    fingerprint is the digest of the lane-wise sums of its files' digests.  Sums are the same in any order and from any
    partial sums, so files are added where they are listed and no list of them is ever made; a folder's fingerprint
    changes with any file under it and with no other.
    """
    facts = [F.col(c).cast("string") for c in ("mtime", "size_bytes", "sha256") if c in files.columns]
    digest = F.sha2(F.concat_ws("\x00", "path", *[F.coalesce(c, F.lit("")) for c in facts]), 256)
    lanes = [F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(LANES)]
    # "a/b/c.parquet" lies in "", "a" and "a/b"; the root of all is the empty folder.
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    rows = files.withColumn("_digest", digest).select(F.explode(F.array_distinct(above)).alias("folder"), *[x.alias(f"_l{i}") for i, x in enumerate(lanes)])
    sums = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"), *[F.sum(f"_l{i}").alias(f"_l{i}") for i in range(LANES)])
    parts = F.concat_ws(":", "n_files", *[f"_l{i}" for i in range(LANES)])
    return sums.select("folder", "n_files", F.sha2(parts, 256).alias("fingerprint"))


def fingerprint(manifest: DataFrame) -> DataFrame:
    """One fingerprint of all inputs (a cache key): that of the folder that holds them all."""
    return folder_fingerprints(manifest).filter(F.col("folder") == "").select("fingerprint")


def missing_inputs(required: DataFrame, available: DataFrame, tab_col: str = "tab", input_col: str = "input") -> DataFrame:
    """Per output tab, the inputs that are missing, and readiness counts."""
    miss = required.join(available.select(input_col), input_col, "left_anti")
    per_tab = required.groupBy(tab_col).agg(F.count(F.lit(1)).alias("n_required"))
    m = miss.groupBy(tab_col).agg(F.sort_array(F.collect_list(input_col)).alias("missing"))
    return per_tab.join(m, tab_col, "left").select(
        tab_col, "n_required", F.coalesce(F.size("missing"), F.lit(0)).alias("n_missing"),
        F.coalesce("missing", F.array().cast("array<string>")).alias("missing"),
        (F.coalesce(F.size("missing"), F.lit(0)) == 0).alias("ready"),
    )
