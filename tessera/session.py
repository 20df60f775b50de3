"""Spark session defaults for the library.

The library never creates a cluster session on its own: jobs receive a
``SparkSession`` from the caller.  ``local_session`` exists for tests, the
benchmark and the smoke entry point; it turns on adaptive execution (runtime
coalescing, skew-join splitting, runtime broadcast conversion) and pins the
session time zone so month arithmetic is stable.

``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the session.  Only when
it is unset (tests, local runs) does it fall back to a scratch folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for every job in the library, on any cluster size.
CORE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "tessera") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(CORE_CONF)
    conf.update(
        {
            "spark.sql.shuffle.partitions": str(shuffle_partitions),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("TESSERA_DRIVER_MEMORY", "16g"),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
        }
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local-mode session (tests, the benchmark) may fall back to a scratch
    folder; on a cluster the setting is required, because a machine-local
    folder would not survive the loss of that machine.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster's object store)")
    path = tempfile.mkdtemp(prefix="tessera-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Materialise an expensive intermediate (e.g. model fits) in the shared checkpoint folder.

    After this, losing an executor re-reads the checkpoint instead of
    refitting; the plan of later stages starts from the written data.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
