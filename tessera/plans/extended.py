"""Further products on the driver tables: full snapshots, ratio families, deep pages, dense months, explorers, seasonal models.

Bound like those of ``testdata``; the DuckDB statements are in ``extended_sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce as X
from ..functions import periods as P
from ..operators import aggregate as A
from ..operators import explore as E
from ..operators import forecast as Y
from ..operators import joins as J
from ..operators import seasonal as S
from ..operators import tidy as T
from ..operators import trees as TR
from ..operators import windows as W
from ..sources import pages as PG
from ..sources.catalog import Dataset
from . import testdata as TD
from .base import MEASURES, REGION_PREFIX, cents, gss, la_lookup, la_supply, money_mean, month_start, population, price_series, read, rent_series, tidy, ymd

Q = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


NEW_BUILD = ("1-URGENT", "2-HIGH")  # order priorities that stand for new dwellings


def _sales(spark: SparkSession, d: str) -> DataFrame:
    """Sales by authority key: calendar year, financial year, price, whether newly built."""
    o = read(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus")
    c = read(spark, d, "customer", "c_custkey", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").alias("nationkey"), F.year("o_orderdate").cast("int").alias("year"), P.financial_year_label("o_orderdate").alias("fy"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").isin(*NEW_BUILD).alias("is_new"), F.col("o_orderstatus").alias("status"))


def _families(spark: SparkSession, d: str) -> DataFrame:
    """Price, earnings and ratio of the three families at the latest year that both of a family's tables have.

    Workplace and new-build prices meet the earnings of workplaces (suppliers), residence prices those of residents.
    """
    sales = _sales(spark, d)
    kinds = F.array(F.lit("workplace"), F.lit("residence"), F.lit("newbuild"))
    rows = sales.select("nationkey", "year", "price", "is_new", F.explode(kinds).alias("family")).where((F.col("family") != "newbuild") | F.col("is_new"))
    li = read(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_shipdate")
    s = read(spark, d, "supplier", "s_suppkey", "s_nationkey")
    own = li.groupBy("l_suppkey", F.year("l_shipdate").cast("int").alias("year")).agg(F.sum(cents("l_extendedprice")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    work = own.join(s, own.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").alias("nationkey"), "year").agg(
        money_mean(F.sum("_s"), F.sum("_n")).alias("earnings"))
    home = sales.where(F.col("status") == "F").groupBy("nationkey", "year").agg(money_mean(F.sum(cents("price")), F.count(F.lit(1))).alias("earnings"))
    earnings = tidy(T.union_all([work.withColumn("family", F.lit("workplace")), work.withColumn("family", F.lit("newbuild")), home.withColumn("family", F.lit("residence"))]))
    both = rows.select("family", "year").distinct().join(earnings.select("family", "year").distinct(), ["family", "year"])
    latest = both.groupBy("family").agg(F.max("year").alias("year"))  # three rows
    prices = A.exact_median(tidy(rows.join(latest, ["family", "year"]).select("family", "nationkey", "year", "price")), ["family", "nationkey", "year"], "price", "price")
    x = prices.join(earnings.join(latest, ["family", "year"]), ["family", "nationkey", "year"], "full")
    return x.withColumn("ratio", X.safe_ratio("price", "earnings"))


@query
def price_earnings_families(spark: SparkSession, d: str) -> DataFrame:
    """The three price/earnings families, one row per family and authority."""
    x = _families(spark, d).join(la_lookup(spark, d).select("nationkey", "lad_code", "lad_name"), "nationkey", "left")
    return x.select("family", "lad_code", "lad_name", "year", F.round("price", 4).alias("price"), "earnings", F.round("ratio", 6).alias("ratio"))


def _partial_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A lookup without the regions of some authorities, as published ones lag behind boundary changes."""
    lk = la_lookup(spark, d)
    unmapped = F.col("nationkey") % 6 == 1
    return lk.select("nationkey", "lad_code", "lad_name", *[F.when(~unmapped, F.col(c)).alias(c) for c in ("region_code", "region_name")])


@query
def region_supply_unmapped(spark: SparkSession, d: str) -> DataFrame:
    """Supply by region under a lookup that lacks some authorities; theirs forms the group without a region."""
    lk = la_lookup(spark, d).where(F.col("nationkey") % 6 != 1)
    la = la_supply(spark, d, lk)
    reg = TD._region_totals(la, lk)
    return reg.select("region_code", "region_name", "financial_year", "measure", F.round("dwellings", 2).alias("dwellings"), "n_la")


def _rolling_share(spark: SparkSession, d: str, years: int = 5) -> DataFrame:
    """Share of lines in bands A to C over the latest ``years`` shipping years, per region key."""
    li = read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_shipdate")
    p = read(spark, d, "part", "p_partkey", "p_size")
    s = read(spark, d, "supplier", "s_suppkey", "s_nationkey")
    n = read(spark, d, "nation", "n_nationkey", "n_regionkey")
    good = TD.size_band("p_size").isin("A", "B", "C")
    own = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_suppkey", F.year("l_shipdate").cast("int").alias("year")).agg(
        F.count_if(good).alias("_good"), F.count(F.lit(1)).alias("_n"))
    by = own.join(s, own.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey, "left").groupBy("n_regionkey", "year").agg(
        F.sum("_good").alias("_good"), F.sum("_n").alias("_n"))
    by = tidy(by)
    last = by.agg(F.max("year")).scalar()
    recent = by.where(F.col("year") > last - years)
    return recent.groupBy(gss(REGION_PREFIX, "n_regionkey").alias("region_code")).agg(
        (F.sum("_good") * 100.0 / F.sum("_n")).alias("rolling_abc_share"),
        F.concat((F.max("year") - (years - 1)).cast("string"), F.lit(" to "), F.max("year").cast("string")).alias("rolling_period"))


@query
def full_snapshot_la(spark: SparkSession, d: str) -> DataFrame:
    """Eleven sources on the authority spine, stacked and aggregated by code in one shuffle."""
    lk = tidy(_partial_lookup(spark, d))
    code = lk.select("nationkey", "lad_code")
    with_code = lambda df: df.join(code, "nationkey").drop("nationkey")
    sales = _sales(spark, d)
    latest = tidy(W.latest_rows(sales, P.period_sort_key("fy"), "fy").select("nationkey", "fy", "price", F.explode(
        F.when(F.col("is_new"), F.array(F.lit("existing"), F.lit("new"))).otherwise(F.array(F.lit("existing")))).alias("kind")))
    medians = tidy(A.exact_median(latest, ["kind", "nationkey"], "price", "median"))
    period = latest.agg(F.max("fy")).scalar()
    median = lambda kind, out: with_code(medians.where(F.col("kind") == kind).select("nationkey", F.col("median").alias(out)))
    fuel2b = T.pivot_sum(TD._fuel_tables(spark, d, lk).where(F.col("table_id") == "2b"), ["lad_code"], "dwelling_class", "value", ["Existing", "New"], prefix="mf2b_")
    series = price_series(spark, d, lk, grain="la")
    yearly = tidy(W.change_by_date(series, ["geography"], "month", "value", 12, "hpi_12m_pct"))
    newest = yearly.agg(F.max("month")).scalar()
    hpi = yearly.where(F.col("month") == newest).select(F.col("geography").alias("lad_code"), ymd("month").alias("hpi_month"), F.col("value").alias("hpi_avg_price"), "hpi_12m_pct")
    families = tidy(_families(spark, d))
    family = lambda name: with_code(families.where(F.col("family") == name).select(
        "nationkey", F.col("year").alias(f"{name}_year"), F.col("price").alias(f"{name}_price"), F.col("earnings").alias(f"{name}_earnings"), F.col("ratio").alias(f"{name}_ratio")))
    c = read(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    idle = c.join(read(spark, d, "orders", "o_custkey").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_anti")
    vacant = with_code(idle.groupBy(F.col("c_nationkey").alias("nationkey")).agg(
        F.count(F.lit(1)).alias("vacant_total"), F.count_if(F.col("c_mktsegment") == "HOUSEHOLD").alias("vacant_second_homes")))
    spine = lk.select("lad_code", "lad_name", "region_code", "region_name")
    x = J.stack_left_join(spine, "lad_code", {
        "supply": TD._latest_fy_pivot(la_supply(spark, d, lk)),
        "population": population(spark, d, lk).select("lad_code", "population"),
        "median existing": median("existing", "median_price_existing"),
        "fuel 2a": TD._fuel_shares(spark, d, lk),
        "fuel 2b": fuel2b,
        "hpi": hpi,
        "price/earnings": family("workplace"),
        "median new": median("new", "median_price_new"),
        "residence": family("residence"),
        "new-build": family("newbuild"),
        "vacant": vacant,
        "not given": None,
    })
    r = lambda c, n=4: F.round(c, n).alias(c)
    return x.select(
        "lad_code", "lad_name", "region_code", "region_name", "financial_year", *[r(f"supply_{m.lower()}", 2) for m in MEASURES], "population",
        period.alias("median_price_period"), r("median_price_existing"), r("median_price_new"), *[f"fuel_share_{f}" for f in "anr"],
        "mf2b_existing", "mf2b_new", "hpi_month", r("hpi_avg_price", 6), r("hpi_12m_pct", 6),
        *[c for f in ("workplace", "residence", "newbuild") for c in (f"{f}_year", r(f"{f}_price"), r(f"{f}_earnings", 6), r(f"{f}_ratio", 6))],
        "vacant_total", "vacant_second_homes", r_ratio("vacant_total", "population"))


def r_ratio(a: str, b: str) -> F.Column:
    return F.round(X.safe_ratio(a, b) * 100.0, 6).alias("vacant_per_100")


@query
def full_snapshot_region(spark: SparkSession, d: str) -> DataFrame:
    """The region snapshot with band shares, the rolling energy share and the growth of prices and rents."""
    lk = tidy(la_lookup(spark, d))
    reg = TD._region_totals(la_supply(spark, d, lk), lk)
    latest = W.latest_rows(reg, P.period_sort_key("financial_year"), "financial_year")
    supply = T.pivot_unique(latest, ["region_code", "financial_year"], "measure", "dwellings", MEASURES, prefix="region_supply_")
    pop = population(spark, d, lk).join(lk.select("lad_code", "region_code"), "lad_code").groupBy("region_code").agg(F.sum("population").alias("population"))
    bands = TD._band_shares(spark, d, lk).groupBy("region_code").agg(
        F.sum(F.when(F.col("band") == "C", F.col("pct"))).alias("pct_band_c"), F.sum(F.when(F.col("band").isin("A", "B", "C"), F.col("pct"))).alias("pct_bands_abc"))
    codes = lk.select("region_code", "region_name").distinct()
    both = TD._two_series(spark, d)
    growth = lambda col, out: W.first_last_growth(both, ["geography"], "month", col).select(F.col("geography").alias("region_name"), F.col("growth_pct").alias(out))
    grown = growth("hpi", "hpi_growth").join(growth("rent", "rent_growth"), "region_name").join(codes, "region_name").drop("region_name")
    x = J.stack_left_join(codes, "region_code", {"supply": supply, "population": pop, "bands": bands, "rolling": _rolling_share(spark, d), "growth": grown})
    r = lambda c, n=6: F.round(c, n).alias(c)
    return x.select("region_code", "region_name", "financial_year", *[r(f"region_supply_{m.lower()}", 2) for m in MEASURES], "population",
                    r("pct_band_c"), r("pct_bands_abc"), r("rolling_abc_share"), "rolling_period", r("hpi_growth"), r("rent_growth"))


# ---------------------------------------------------------------------------
# Deep pages, dense months, explorers
# ---------------------------------------------------------------------------

PAGE_ORDER = ["l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"]


@query
def deep_page(spark: SparkSession, d: str) -> DataFrame:
    """The last full page of 100 rows of ``lineitem``, found through the page index without a global sort."""
    ds = Dataset("lineitem", f"{d}/lineitem.parquet", family="lines", order_by=PAGE_ORDER)
    index = PG.page_index(spark, ds)
    total = index.agg(F.sum("n_rows")).first()[0] or 0
    page = PG.indexed_page(spark, ds, index, PAGE_ORDER, offset=max(0, total - 100), limit=100)
    return page.withColumn("l_shipdate", ymd("l_shipdate")).drop("fingerprint")


def _monthly_by_priority(spark: SparkSession, d: str, priority: str, out: str) -> DataFrame:
    o = read(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority").where(F.col("o_orderpriority") == priority)
    c = read(spark, d, "customer", "c_custkey", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nationkey"), month_start("o_orderdate").alias("month")).agg(
        money_mean(F.sum(cents("o_totalprice")), F.count(F.lit(1))).alias(out))


@query
def spread_12m_dense(spark: SparkSession, d: str) -> DataFrame:
    """12-month changes by date over series with missing months, with the gaps of each series."""
    dense = lambda priority, out: tidy(W.dense_months(_monthly_by_priority(spark, d, priority, out), ["nationkey"], "month"))
    price, rent = dense("1-URGENT", "price"), dense("5-LOW", "rent")
    gaps = W.month_gaps(price, ["nationkey"], "month")
    p = W.change_by_date(price, ["nationkey"], "month", "price", 12, "price_yoy").select("nationkey", "month", "price", "price_yoy", "is_gap")
    r = W.change_by_date(rent, ["nationkey"], "month", "rent", 12, "rent_yoy").select("nationkey", "month", "rent", "rent_yoy")
    x = p.join(r, ["nationkey", "month"]).join(gaps, "nationkey")
    n = lambda c: F.round(c, 6).alias(c)
    return x.select("nationkey", ymd("month").alias("month"), "is_gap", n("price"), n("rent"), n("price_yoy"), n("rent_yoy"),
                    F.round(F.col("price_yoy") - F.col("rent_yoy"), 6).alias("spread"), "n_months", "n_missing", ymd("first_missing").alias("first_missing"))


BAND_EXPLORER = E.Explorer(("region_name", "band"), "period", "n", P.period_sort_key)
INDEX_EXPLORER = E.Explorer(("geography",), "month", "value")
SUPPLY_EXPLORER = E.Explorer(("lad_name", "measure"), "financial_year", "dwellings", P.period_sort_key)


@query
def explore_bands(spark: SparkSession, d: str) -> DataFrame:
    """Counts by band and quarter of two regions, three bands, one series per region and band."""
    li = read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_shipdate")
    p = read(spark, d, "part", "p_partkey", "p_size")
    s = read(spark, d, "supplier", "s_suppkey", "s_nationkey")
    lk = la_lookup(spark, d)
    rows = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_suppkey", TD.size_band("p_size").alias("band"), P.quarter_label("l_shipdate").alias("period")).agg(
        F.count(F.lit(1)).alias("n")).join(s, F.col("l_suppkey") == s.s_suppkey).join(lk, s.s_nationkey == lk.nationkey, "left")
    return E.explore(rows, BAND_EXPLORER, {"region_name": ["EUROPE", "ASIA"], "band": ["A", "B", "C"]})


@query
def explore_index(spark: SparkSession, d: str) -> DataFrame:
    """The monthly price series of all regions."""
    x = E.explore(price_series(spark, d), INDEX_EXPLORER, {"geography": []})
    return x.select("series", ymd("period").alias("period"), "position", F.round("value", 6).alias("value"))


@query
def explore_supply(spark: SparkSession, d: str) -> DataFrame:
    """Supply by financial year and authority, measures added up."""
    x = E.explore(la_supply(spark, d), SUPPLY_EXPLORER, {"measure": ["F", "O"]}, split=("lad_name",))
    return x.select("series", "period", "position", F.round("value", 2).alias("value"))


# ---------------------------------------------------------------------------
# Seasonal smoothing and lagged trees
# ---------------------------------------------------------------------------


@query
def seasonal_smoothing(spark: SparkSession, d: str) -> DataFrame:
    """One season ahead from the end of every series, by additive trend and season."""
    parts = []
    for season, pts in TD._points_by_season(spark, d):
        ends = tidy(S.seasonal_states(pts, season, last_only=True))
        path = S.seasonal_path(ends, season, season).join(ends.select("series_id", "a", "b", "c"), "series_id")
        parts.append(path)
    x = T.union_all(parts)
    return x.select("series_id", F.col("k").cast("int").alias("k"), F.col("a").alias("w_level"), F.col("b").alias("w_trend"), F.col("c").alias("w_season"),
                    F.round("pred", 4).alias("pred"))


@query
def lagged_gbt_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Recursive forecasts of pooled lagged trees at the plan's horizons, monthly and quarterly series."""
    parts = [Y.summarise_backtest(TR.backtest(pts, TD.HORIZONS, season)) for season, pts in TD._points_by_season(spark, d)]
    r = lambda c, n=4: F.round(c, n).alias(c)
    return T.union_all(parts).select("series_id", F.col("horizon").cast("int").alias("horizon"), "model", "n_windows", r("mae"), r("rmse"), r("mape"), r("mase"),
                                     r("coverage_p10_p90", 6), r("pinball_p10"), r("pinball_p50"), r("pinball_p90"))


COVERAGE: dict[str, list[str]] = {
    "price_earnings_families": ["B6", "K6", "J4", "A7"],
    "region_supply_unmapped": ["J8", "B2"],
    "full_snapshot_la": ["J1", "B8", "T24", "A7", "W7"],
    "full_snapshot_region": ["J2", "J10", "B9", "A17", "W4"],
    "deep_page": ["K4", "S6", "S19", "B30", "F11"],
    "spread_12m_dense": ["W7", "Y1"],
    "explore_bands": ["B32", "P1"],
    "explore_index": ["B32"],
    "explore_supply": ["B32", "P1"],
    "seasonal_smoothing": ["Y5"],
    "lagged_gbt_backtest": ["Y9", "Y17", "Y13", "Y14"],
}
