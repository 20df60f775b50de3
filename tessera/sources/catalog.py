"""Dataset catalog reads.

A read is: registry id -> Parquet path -> validated projection -> family
filters -> explicit order -> offset/limit page.  Projection and filters are
declared on the DataFrame so Catalyst pushes them into the Parquet scan
(``ReadSchema`` / ``PushedFilters``); nothing is read whole and filtered later.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Page size default and maximum, export caps, unprojected-read guard.
PAGE_SIZE_DEFAULT = 500
PAGE_SIZE_MAX = 10_000
CSV_EXPORT_DEFAULT = 100_000
CSV_EXPORT_MAX = 250_000
JSON_EXPORT_MAX = 5_000
FULL_SCAN_GUARD_ROWS = 50_000


class ReadError(ValueError):
    """Bad request against a dataset: unknown columns, page size, or an oversized read."""


@dataclass
class Dataset:
    dataset_id: str
    path: str
    family: str = "generic"
    title: str = ""
    order_by: list[str] = field(default_factory=list)
    # family filter columns: argument name -> column
    filter_columns: dict[str, str] = field(default_factory=dict)
    case_insensitive: set[str] = field(default_factory=set)


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan with a validated projection."""
    df = spark.read.parquet(path)
    if not columns:
        return df
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ReadError(f"unknown columns: {unknown}")
    return df.select(*columns)


def apply_filters(df: DataFrame, ds: Dataset, filters: dict[str, list] | None) -> DataFrame:
    """one ``isin`` per dimension; an empty list means no filter on it."""
    for arg, values in (filters or {}).items():
        if not values:
            continue
        col = ds.filter_columns.get(arg, arg)
        if col not in df.columns:
            raise ReadError(f"filter {arg!r} does not apply to family {ds.family!r}")
        if arg in ds.case_insensitive:
            df = df.where(F.lower(F.col(col)).isin([str(v).lower() for v in values]))
        else:
            df = df.where(F.col(col).isin(list(values)))
    return df


def check_page_size(limit: int | None) -> int:
    """default 500, refuse above 10 000."""
    n = PAGE_SIZE_DEFAULT if limit is None else int(limit)
    if n < 1 or n > PAGE_SIZE_MAX:
        raise ReadError(f"page size must be within 1..{PAGE_SIZE_MAX}")
    return n


def guard_full_scan(df: DataFrame, columns: list[str] | None, guard: int = FULL_SCAN_GUARD_ROWS) -> None:
    """an unprojected read of a table above the guard is refused.

    The test reads at most ``guard + 1`` rows, so it is bounded however large
    the table is.
    """
    if columns:
        return
    if df.limit(guard + 1).count() > guard:
        raise ReadError(f"unprojected read of more than {guard} rows; pass columns")


def page(df: DataFrame, order_by: list[str | Column], offset: int, limit: int) -> DataFrame:
    """Deterministic page (an order is required for stable pages)."""
    if not order_by:
        raise ReadError("a page needs an explicit order")
    return df.orderBy(*order_by).offset(int(offset)).limit(int(limit))


def read_page(
    spark: SparkSession,
    ds: Dataset,
    columns: list[str] | None = None,
    filters: dict[str, list] | None = None,
    offset: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Rows of one page plus the total number of matching rows (scalar subquery)."""
    n = check_page_size(limit)
    base = spark.read.parquet(ds.path)
    guard_full_scan(base, columns)
    cols = list(columns or base.columns)
    need = list(dict.fromkeys(cols + [c for c in ds.order_by if c not in cols] + [ds.filter_columns.get(a, a) for a in (filters or {})]))
    df = read_columns(spark, ds.path, need)
    df = apply_filters(df, ds, filters)
    total = df.agg(F.count(F.lit(1))).scalar()
    return page(df, ds.order_by, offset, n).select(*cols, total.alias("total_rows"))
