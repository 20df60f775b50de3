"""Role mapping of the driver tables onto the statistics data model.

nation  -> local authority (``lad_code`` = ``E06`` + 6-digit key)
region  -> region          (``region_code`` = ``E12`` + 6-digit key)
orders  -> supply facts: status = measure, total price = dwellings, order date -> financial year
customer count per nation -> population
lineitem monthly average price per region -> a monthly price index series
orders monthly average price per region   -> a monthly rent index series

Every frame here is lazy; tables are read with an explicit projection so only
the needed Parquet columns are scanned.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import financial_year_label, fy_start_year

LA_PREFIX = "E06"
REGION_PREFIX = "E12"
MEASURES = ["F", "O", "P"]


def tidy(df: DataFrame) -> DataFrame:
    """Keep a small aggregated tidy table for reuse within a job.

    Tidy tables here are aggregates at (authority or region) x period grain,
    bounded by the number of areas and periods, not by the input volume.
    Persisted blocks that are lost with an executor are rebuilt from lineage.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


_HANDLES: dict[tuple[int, str], DataFrame] = {}


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Scan of one driver table with a column projection.

    The reader handle (file listing and Parquet footer schema) is kept per
    session and path, so products that touch a table many times plan it once;
    the projection is applied per use, so every scan still reads only the
    columns it needs.  ``refresh_tables`` forgets the handles after files change.
    """
    path = f"{sf_dir}/{name}.parquet"
    key = (id(spark), path)
    df = _HANDLES.get(key)
    if df is None:
        df = spark.read.parquet(path)
        _HANDLES[key] = df
    return df.select(*cols) if cols else df


def refresh_tables() -> None:
    _HANDLES.clear()


def gss(prefix: str, key) -> F.Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(prefix), F.lpad(k.cast("string"), 6, "0"))


def la_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LA -> region lookup (J8 input): nationkey, lad_code, lad_name, region_code, region_name."""
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = read(spark, sf_dir, "region", "r_regionkey", "r_name")
    lk = n.join(r, n.n_regionkey == r.r_regionkey, "left").select(
        F.col("n_nationkey").alias("nationkey"),
        gss(LA_PREFIX, "n_nationkey").alias("lad_code"),
        F.col("n_name").alias("lad_name"),
        gss(REGION_PREFIX, "r_regionkey").alias("region_code"),
        F.col("r_name").alias("region_name"),
    )
    return lk


def la_supply(spark: SparkSession, sf_dir: str, lookup: DataFrame | None = None) -> DataFrame:
    """Tidy LA supply table: lad_code, lad_name, financial_year, fy_start, measure, dwellings.

    orders JOIN customer is the one large join (both sides shuffled on the
    customer key; AQE splits a hot customer).  The result is aggregated to
    (nation, financial year, status) with map-side partial aggregation before
    the small lookup is joined by broadcast.
    """
    lookup = lookup if lookup is not None else la_lookup(spark, sf_dir)
    o = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    agg = (
        o.join(c, o.o_custkey == c.c_custkey)
        .groupBy(
            F.col("c_nationkey"),
            financial_year_label("o_orderdate").alias("financial_year"),
            fy_start_year("o_orderdate").alias("fy_start"),
            F.col("o_orderstatus").alias("measure"),
        )
        .agg(F.sum("o_totalprice").alias("dwellings"))
    )
    # An authority that the lookup lacks keeps its rows and its code.
    return tidy(agg.join(lookup, agg.c_nationkey == lookup.nationkey, "left").select(
        F.coalesce("lad_code", gss(LA_PREFIX, "c_nationkey")).alias("lad_code"), "lad_name", "financial_year", "fy_start", "measure", "dwellings"
    ))


def population(spark: SparkSession, sf_dir: str, lookup: DataFrame | None = None) -> DataFrame:
    """Population per LA = number of customers per nation (year 2021)."""
    lookup = lookup if lookup is not None else la_lookup(spark, sf_dir)
    c = read(spark, sf_dir, "customer", "c_nationkey")
    pop = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("population"))
    return pop.join(lookup, pop.c_nationkey == lookup.nationkey, "left").select(
        F.coalesce("lad_code", gss(LA_PREFIX, "c_nationkey")).alias("lad_code"), "lad_name", "population", F.lit(2021).alias("year")
    )


def month_start(col) -> F.Column:
    return F.trunc(F.col(col) if isinstance(col, str) else col, "month").cast("date")


def price_series(spark: SparkSession, sf_dir: str, lookup: DataFrame | None = None, grain: str = "region") -> DataFrame:
    """Monthly price index analogue: average line price per supplier region (or LA) and ship month."""
    lookup = lookup if lookup is not None else la_lookup(spark, sf_dir)
    li = read(spark, sf_dir, "lineitem", "l_suppkey", "l_extendedprice", "l_shipdate")
    s = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    own = li.groupBy("l_suppkey", month_start("l_shipdate").alias("month")).agg(F.sum(cents("l_extendedprice")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    g = own.join(s, own.l_suppkey == s.s_suppkey).groupBy("s_nationkey", "month").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    g = g.join(lookup, g.s_nationkey == lookup.nationkey)
    name = "region_name" if grain == "region" else "lad_code"
    return tidy(g.groupBy(F.col(name).alias("geography"), "month").agg(money_mean(F.sum("_s"), F.sum("_n")).alias("value")))


def rent_series(spark: SparkSession, sf_dir: str, lookup: DataFrame | None = None) -> DataFrame:
    """Monthly rents index analogue: average order price per customer region and order month."""
    lookup = lookup if lookup is not None else la_lookup(spark, sf_dir)
    o = read(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderdate")
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    g = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey", month_start("o_orderdate").alias("month")).agg(
        F.sum(cents("o_totalprice")).alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    g = g.join(lookup, g.c_nationkey == lookup.nationkey)
    return tidy(g.groupBy(F.col("region_name").alias("geography"), "month").agg(money_mean(F.sum("_s"), F.sum("_n")).alias("value")))


def cents(col) -> F.Column:
    """Money in whole pence: integer sums are exact, so means do not depend on summation order."""
    return F.round(F.col(col) * 100).cast("bigint")


def money_mean(sum_cents, n) -> F.Column:
    """Mean of a money column from its exact pence total and count."""
    return sum_cents.cast("double") / n / F.lit(100.0)


def ymd(col) -> F.Column:
    """Dates leave the library as ISO text so results compare across engines."""
    return F.date_format(F.col(col) if isinstance(col, str) else col, "yyyy-MM-dd")
