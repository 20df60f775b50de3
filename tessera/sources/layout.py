"""Physical layout for repeated joins: bucketed tables (co-located joins without a shuffle).

Products join the same large tables on the same key again and again (orders and
customers on the customer key).  Writing both once bucketed (and sorted) by
that key with the same number of buckets lets every later join read matching
buckets side by side: the plan has no exchange on either side.  Tables are
written under an explicit path (the shared warehouse or checkpoint folder of
the cluster), registered in the session catalog by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str) -> DataFrame:
    """Write ``df`` bucketed and sorted by ``keys`` into ``path`` as table ``name``; returns the table."""
    (
        df.write.mode("overwrite")
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", path)
        .format("parquet")
        .saveAsTable(name)
    )
    return df.sparkSession.table(name)


def bucketed_tables(spark: SparkSession, tables: dict[str, DataFrame], key: str, buckets: int, root: str) -> dict[str, DataFrame]:
    """Bucket several tables on one join key with the same bucket count (co-partitioned)."""
    return {name: write_bucketed(df, name, [key], buckets, f"{root.rstrip('/')}/{name}") for name, df in tables.items()}
