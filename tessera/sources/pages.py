"""Deep pages of ordered datasets from an index of key ranges.

``build_page_index`` sorts the order columns once by ranges and keeps one row a range: its lowest and highest key, how
many rows it has and how many come before.  A page then reads only the ranges that overlap it: the bounds of the first
order column become a filter that reaches the Parquet scan, and only the rows of those ranges are sorted, however large
the offset.  The total is the sum of the ranges' counts, so no page counts the table again.

The index carries the fingerprint of the files it was built from; a read under another fingerprint is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .catalog import Dataset, ReadError, apply_filters, check_page_size, read_columns
from .manifest import file_facts, fingerprint

RANGE_ROWS = 20_000  # rows a range should have; a page reads the ranges it overlaps


def dataset_fingerprint(spark: SparkSession, path: str) -> str:
    """Fingerprint of the dataset's files from names, times and sizes; no content is read."""
    return fingerprint(file_facts(spark, path)).first()["fingerprint"]


def build_page_index(spark: SparkSession, ds: Dataset, index_path: str, filters: dict[str, list] | None = None,
                     range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write and return the index of ``ds`` (of its rows that pass ``filters``), ordered by ``ds.order_by``.

    Ranges are disjoint: rows alike in all order columns lie in one.  Their order within a page is any.
    """
    if not ds.order_by:
        raise ReadError("a page index needs an explicit order")
    used = [ds.filter_columns.get(a, a) for a in filters or {}]
    rows = apply_filters(read_columns(spark, ds.path, list(dict.fromkeys(ds.order_by + used))), ds, filters)
    n = rows.count()
    key = F.struct(*ds.order_by)
    keys = [F.asc_nulls_first(c) for c in ds.order_by]
    dealt = rows.select(*ds.order_by).repartitionByRange(max(1, -(-n // range_rows)), *keys)
    per_range = dealt.groupBy(F.spark_partition_id().alias("range_id")).agg(
        F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n_rows"))
    before = F.sum("n_rows").over(Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1))
    out = per_range.withColumn("first_row", F.coalesce(before, F.lit(0)))  # one row a range
    out.withColumn("fingerprint", F.lit(dataset_fingerprint(spark, ds.path))).coalesce(1).write.mode("overwrite").parquet(index_path)
    return spark.read.parquet(index_path)


def indexed_page(spark: SparkSession, ds: Dataset, index: DataFrame, columns: list[str], filters: dict[str, list] | None = None,
                 offset: int = 0, limit: int | None = None) -> DataFrame:
    """The rows ``offset``.. of the order with ``total_rows`` and ``fingerprint``; ``index`` was built with the same filters.

    Order columns must not be null.  An empty dataset or an offset beyond the end gives no rows.
    """
    n = check_page_size(limit)
    facts = index.agg(F.sum("n_rows").alias("total"), F.max("fingerprint").alias("f")).first()
    if facts.f is not None and facts.f != dataset_fingerprint(spark, ds.path):
        raise ReadError("the dataset has changed since its page index was built")
    overlap = (F.col("first_row") < offset + n) & (F.col("first_row") + F.col("n_rows") > offset)
    span = index.filter(overlap).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first_row").alias("first")).first()
    used = [ds.filter_columns.get(a, a) for a in filters or {}]
    df = apply_filters(read_columns(spark, ds.path, list(dict.fromkeys(columns + ds.order_by + used))), ds, filters)
    total = [F.lit(facts.total or 0).cast("long").alias("total_rows"), F.lit(facts.f).cast("string").alias("fingerprint")]
    if span.low is None:
        return df.limit(0).select(*columns, *total)
    key, lead = F.struct(*ds.order_by), ds.order_by[0]
    bound = lambda row: F.struct(*[F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in ds.order_by])
    df = df.filter((F.col(lead) >= F.lit(span.low[lead])) & (F.col(lead) <= F.lit(span.high[lead])) & (key >= bound(span.low)) & (key <= bound(span.high)))
    return df.orderBy(*ds.order_by).offset(int(offset - span.first)).limit(n).select(*columns, *total)


def page_index(spark: SparkSession, ds: Dataset, filters: dict[str, list] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index of the dataset's present state, built on first use and kept under the shared checkpoint folder."""
    from pyspark.errors import AnalysisException

    name = F.sha2(F.lit(repr((ds.path, ds.order_by, sorted((filters or {}).items()), range_rows, dataset_fingerprint(spark, ds.path)))), 256)
    path = f"{checkpoint_dir(spark).rstrip('/')}/pages-{spark.range(1).select(name.alias('k')).first()['k']}"
    try:
        index = spark.read.parquet(path)
        index.head(1)
        return index
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return build_page_index(spark, ds, path, filters, range_rows)
