"""Operator bindings on the driver tables: one function per registered query.

Each function takes (spark, sf_dir) and returns a lazy DataFrame over the
whole tables.  Products are composed from the library operators; the DuckDB
statement of the same result lives in ``oracle.py`` under the same name.
Doubles are rounded at the end so the two engines hash alike.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import coerce as X
from ..functions import periods as P
from ..operators import aggregate as A
from ..operators import joins as J
from ..operators import tidy as T
from ..operators import windows as W
from ..session import cut_lineage
from .base import MEASURES, cents, gss, tidy, money_mean, la_lookup, la_supply, month_start, population, price_series, read, rent_series, ymd

Q = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


def _region_totals(la: DataFrame, lookup: DataFrame) -> DataFrame:
    """B2: LA supply -> region via lookup (unmapped LAs form a NULL region group), sum with NULL if all NULL."""
    x = la.withColumn("lad_code", X.norm_code("lad_code")).join(
        lookup.select("lad_code", "region_code", "region_name"), "lad_code", "left"
    )
    return x.groupBy("region_code", "region_name", "financial_year", "fy_start", "measure").agg(
        A.sum_or_null("dwellings").alias("dwellings"), F.countDistinct("lad_code").alias("n_la")
    )


@query
def region_supply_by_fy(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    reg = _region_totals(la_supply(spark, d, lk), lk)
    return reg.select(
        "region_code", "region_name", "financial_year", "measure",
        F.round("dwellings", 2).alias("dwellings"), "n_la",
    )


@query
def latest_fy_region_wide(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    reg = _region_totals(la_supply(spark, d, lk), lk)
    latest = W.latest_rows(reg, P.period_sort_key("financial_year"), "financial_year")
    wide = T.pivot_unique(latest, ["region_code", "region_name", "financial_year"], "measure", "dwellings", MEASURES, prefix="dwellings_")
    return wide.select(
        "region_code", "region_name", "financial_year",
        *[F.round(f"dwellings_{m.lower()}", 2).alias(f"dwellings_{m.lower()}") for m in MEASURES],
    )


def _raw_cells(o: DataFrame) -> DataFrame:
    """Text cells as published: markers, padded numbers, ``c`` and non-integral counts."""
    key = F.col("o_custkey").cast("string")
    raw = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("[x]"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("c"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit(" "), key, F.lit(" ")))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(key, F.lit("[x]")))
        .otherwise(F.concat(key, F.lit(".5")))
    )
    return o.select("o_orderkey", raw.alias("raw_text"))


@query
def coerce_suppressed(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    cells = _raw_cells(o)
    return cells.select(
        "o_orderkey",
        "raw_text",
        X.to_double("raw_text").alias("value_plain"),
        X.to_double_marked("raw_text").alias("value_num"),
        # Nullable integers leave as double so every client (rows, pandas, Arrow) shows NULL the same way.
        X.to_count(X.strip_markers("raw_text")).cast("double").alias("value_count"),
    )


# Fixed prefixes used to give customers GSS-like codes of every level.
CODE_PREFIXES = ["K04", "E92", "W92", "E12", "E07", "W06", "E02", "W01", "S12", "X"]
# Names of the published tables that need aliasing or scoping.
SEGMENT_NAMES = {
    "AUTOMOBILE": "East",
    "BUILDING": "Northern Ireland [note 3]",
    "FURNITURE": "United Kingdom",
    "HOUSEHOLD": "Wales",
    "MACHINERY": " London ",
}


@query
def geo_level_case(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer", "c_custkey", "c_mktsegment")
    prefixes = F.array(*[F.lit(p) for p in CODE_PREFIXES])
    bucket = (F.col("c_custkey") % len(CODE_PREFIXES)).cast("int")
    code = F.when(bucket == len(CODE_PREFIXES) - 1, (F.col("c_custkey") % 100).cast("string")).otherwise(
        F.concat(F.lower(F.element_at(prefixes, bucket + 1)), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    )
    names = F.create_map(*[F.lit(x) for kv in SEGMENT_NAMES.items() for x in kv])
    raw_name = F.coalesce(F.try_element_at(names, F.col("c_mktsegment")), F.col("c_mktsegment"))
    x = c.select("c_custkey", code.alias("raw_code"), raw_name.alias("raw_name"))
    return x.select(
        "c_custkey",
        X.norm_code("raw_code").alias("area_code"),
        X.geo_level("raw_code").alias("geography_level"),
        X.canonical_name("raw_name").alias("area_name"),
        X.area_scope(X.canonical_name("raw_name")).alias("area_scope"),
    )


def _order_period_labels(o: DataFrame) -> DataFrame:
    """Quarter, financial-year, calendar-year and free-text labels of every order."""
    d = F.col("o_orderdate")
    return o.select(
        F.explode(
            F.array(
                P.quarter_label(d),
                P.financial_year_label(d),
                F.year(d).cast("string"),
                F.col("o_orderpriority"),
            )
        ).alias("period")
    )


@query
def period_labels_sorted(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders", "o_orderdate", "o_orderpriority")
    labels = _order_period_labels(o)
    counts = labels.groupBy("period").agg(F.count(F.lit(1)).alias("n_orders"))
    ordered = P.ordered_periods(counts, "period")
    return ordered.select(
        "period",
        F.col("period_key.bucket").alias("bucket"),
        F.col("period_pos").cast("bigint").alias("period_pos"),
        "n_orders",
        P.in_period_range(F.col("period_key"), "1998-99", "Jan - Mar 1996").alias("in_range"),
    )


def _pe_label(d) -> F.Column:
    m = F.month(d)
    y = F.year(d).cast("string")
    return (
        F.when(m == 9, F.concat(F.lit("Year ending Sep "), y))
        .when(m == 6, y)
        .when(m == 12, F.concat(F.lit("Year ending Dec "), y))
        .when(m == 3, F.lit(P.FIVE_YEAR_AVERAGE))
        .otherwise(P.rolling_window_label(F.year(d)))
    )


@query
def month_label_parse(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem", "l_shipdate")
    months = li.groupBy(month_start("l_shipdate").alias("m")).agg(F.count(F.lit(1)).alias("n_lines"))
    mon = F.element_at(F.array(*[F.lit(x) for x in P.MONTHS]), F.month("m"))
    x = months.select(
        "m",
        "n_lines",
        F.concat(mon, F.lit(" "), F.year("m").cast("string")).alias("month_label"),
        F.concat(mon, F.lit("-"), F.lpad((F.year("m") % 100).cast("string"), 2, "0")).alias("month_dash"),
        F.concat(F.lit("Year ending "), mon, F.lit(" "), F.year("m").cast("string")).alias("year_ending"),
        _pe_label(F.col("m")).alias("pe_label"),
    )
    return x.select(
        "month_label",
        "month_dash",
        "pe_label",
        ymd(P.month_label_date("month_label")).alias("d_label"),
        ymd(P.month_label_date("month_dash")).alias("d_dash"),
        ymd(P.year_ending_month_date("year_ending")).alias("d_year_ending"),
        # Nullable integers leave as double (see coerce_suppressed).
        P.pe_year("pe_label").cast("double").alias("pe_year"),
        P.pe_year_numeric("pe_label").cast("double").alias("pe_year_num"),
        P.year_ending_dec("pe_label").cast("double").alias("dec_year"),
        ymd(P.period_sort_date("pe_label")).alias("sort_date"),
        P.rolling_start_year("pe_label").cast("double").alias("rolling_start"),
        "n_lines",
    )


@query
def annual_last_and_mean(spark: SparkSession, d: str) -> DataFrame:
    s = price_series(spark, d)
    last = P.annualise(s, ["geography"], "month", "value", "last").withColumnRenamed("value", "last_value")
    mean = P.annualise(s, ["geography"], "month", "value", "mean").select("geography", "year", F.col("value").alias("mean_value"))
    out = last.join(mean, ["geography", "year"])
    return out.select(
        F.col("geography").alias("region_name"),
        F.col("year").cast("int").alias("year"),
        ymd("year_end").alias("year_end"),
        F.col("last_value"),
        F.round("mean_value", 8).alias("mean_value"),
    )


# Wide sheet headers: measure - sector, as in the country house-building sheets.
SECTOR_HEADERS = {
    "Started - Quantity": "l_quantity",
    "Completed - Price": "l_extendedprice",
    "Started - Discount": "l_discount",
}


@query
def melt_measures(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem", "l_returnflag", "l_shipdate", *SECTOR_HEADERS.values())
    wide = li.groupBy("l_returnflag", F.year("l_shipdate").alias("year")).agg(
        *[F.sum(c).alias(h) for h, c in SECTOR_HEADERS.items()]
    )
    long = T.melt_numeric(wide, ["l_returnflag", "year"], list(SECTOR_HEADERS), "label", "value")
    parts = T.split_label("label", T.SECTOR_RE, ["measure", "sector"])
    out = long.select("l_returnflag", "year", *parts, "value")
    return out.select(
        "l_returnflag", F.col("year").cast("int").alias("year"), F.lower("measure").alias("measure"),
        "sector", F.round("value", 2).alias("value"),
    )


@query
def melt_two_blocks(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem", "l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice")
    flags = ["A", "N", "R"]
    y = F.year("l_shipdate").cast("string").alias("Time period")
    left = li.groupBy(y).pivot("l_returnflag", flags).agg(F.sum("l_quantity"))
    right = li.groupBy(F.year("l_shipdate").cast("string").alias("Time period.1")).pivot("l_returnflag", flags).agg(
        F.sum("l_extendedprice")
    ).toDF("Time period.1", *[f"{f}.1" for f in flags])
    # Side-by-side blocks with an empty spacer column, as in the published sheet.
    sheet = left.join(right, F.col("Time period") == F.col("`Time period.1`"), "full").withColumn(
        "Unnamed: 4", F.lit(None).cast("string")
    )
    out = T.two_block_melt(
        sheet,
        ["Time period", *flags],
        ["Time period.1", *[f"{f}.1" for f in flags]],
        "time_period",
        ("quantity", "price"),
    )
    return out.select("table_block", "time_period", "series", F.round("value", 2).alias("value"))


@query
def year_property_melt(spark: SparkSession, d: str) -> DataFrame:
    """Two-row header flattened to ``year_flag`` names, melted and split once on ``_``."""
    li = read(spark, d, "lineitem", "l_linestatus", "l_returnflag", "l_shipdate", "l_extendedprice")
    li = li.withColumn("header", F.concat(F.year("l_shipdate").cast("string"), F.lit("_"), F.col("l_returnflag")))
    names = T.pivot_values(li, "header")
    wide = li.groupBy("l_linestatus").pivot("header", names).agg(F.max("l_extendedprice"))
    long = T.melt_numeric(wide, ["l_linestatus"], names, "year_property", "value").where(F.col("value").isNotNull())
    return long.select(
        "l_linestatus", *T.split_year_property("year_property"), F.round("value", 2).alias("value")
    )


@query
def pivot_measures(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity", "l_discount")
    s = read(spark, d, "supplier", "s_suppkey", "s_nationkey")
    x = li.join(s, li.l_suppkey == s.s_suppkey).join(lk, F.col("s_nationkey") == lk.nationkey)
    long = x.select(
        "lad_code",
        F.col("l_returnflag").alias("flag"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"),
        F.when(F.col("l_discount") > 0, F.col("l_quantity")).alias("v"),
    )
    flags = ["A", "N", "R"]
    firsts = T.pivot_first(long, ["lad_code"], "flag", "v", flags, order_col="ord", prefix="first_")
    sums = T.pivot_sum(long, ["lad_code"], "flag", "v", flags, prefix="sum_")
    out = sums.join(firsts, "lad_code", "left")
    return out.select("lad_code", *[f"first_{f.lower()}" for f in flags], *[F.round(f"sum_{f.lower()}", 2).alias(f"sum_{f.lower()}") for f in flags])


def size_band(col) -> F.Column:
    """Part size 1..50 -> band A..G in steps of 7 (50 joins G)."""
    idx = F.least(F.floor((F.col(col) - 1) / 7), F.lit(6)).cast("int")
    return F.when(F.col(col) >= 1, F.element_at(F.array(*[F.lit(b) for b in T.EPC_BANDS]), idx + 1))


def _band_shares(spark: SparkSession, d: str, lk: DataFrame) -> DataFrame:
    """Share (%) of lines per size band within each supplier region: region_name, band, pct."""
    li = read(spark, d, "lineitem", "l_partkey", "l_suppkey")
    p = read(spark, d, "part", "p_partkey", "p_size")
    s = read(spark, d, "supplier", "s_suppkey", "s_nationkey")
    x = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    cnt = x.groupBy("s_nationkey", size_band("p_size").alias("band")).agg(F.count(F.lit(1)).alias("n"))
    cnt = cnt.join(lk, cnt.s_nationkey == lk.nationkey).groupBy("region_code", "region_name", "band").agg(F.sum("n").alias("n"))
    tot = cnt.groupBy("region_code").agg(F.sum("n").alias("tot"))
    return tidy(cnt.join(tot, "region_code").select("region_code", "region_name", "band", (F.col("n") * 100.0 / F.col("tot")).alias("pct")))


@query
def band_share_abc(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    shares = _band_shares(spark, d, lk)
    region = shares.groupBy("region_code", "region_name").agg(
        F.sum(F.when(F.col("band").isin("A", "B", "C"), F.col("pct"))).alias("abc_share"),
        F.sum(F.when(F.col("band") == "C", F.col("pct"))).alias("c_share"),
    )
    top_c = region.agg(F.max("c_share")).scalar()
    region = region.withColumn("c_share_is_max", F.col("c_share") == top_c)
    # One regional value spread to each LA of the region, flagged as a proxy.
    la = lk.select("lad_code", "lad_name", "region_code").join(region, "region_code", "left")
    return la.select(
        "lad_code", "lad_name", "region_name",
        F.round("abc_share", 6).alias("abc_share"), "c_share",
        "c_share_is_max", F.lit(True).alias("is_region_proxy"),
    )


def _latest_fy_pivot(la: DataFrame) -> DataFrame:
    latest = W.latest_rows(la, P.period_sort_key("financial_year"), "financial_year")
    return T.pivot_unique(latest, ["lad_code", "financial_year"], "measure", "dwellings", MEASURES, prefix="supply_")


@query
def la_rankings(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    la = la_supply(spark, d, lk)
    latest = W.latest_rows(la, P.period_sort_key("financial_year"), "financial_year")
    # Starts (status O) and completions (status F) aligned by conditional aggregation.
    sc = latest.groupBy("lad_code", "lad_name", "financial_year").agg(
        F.sum(F.when(F.col("measure") == "O", F.col("dwellings"))).alias("starts"),
        F.sum(F.when(F.col("measure") == "F", F.col("dwellings"))).alias("completions"),
    )
    pop = population(spark, d, lk)
    latest_pop = W.first_per_key(pop, ["lad_code"], [F.col("year")], ["population"], last=True)
    x = sc.join(latest_pop, "lad_code", "left").withColumn("starts_per_1000", X.per_1000("starts", "population"))
    x = x.withColumn("rank_starts", W.rank_desc("starts").cast("bigint")).withColumn(
        "rank_starts_per_1000", W.rank_desc("starts_per_1000").cast("bigint")
    )
    return x.select(
        "lad_code", "lad_name", "financial_year",
        F.round("starts", 2).alias("starts"), F.round("completions", 2).alias("completions"),
        "population", F.round("starts_per_1000", 6).alias("starts_per_1000"),
        "rank_starts", "rank_starts_per_1000",
    )


def _median_price_latest_fy(spark: SparkSession, d: str, lk: DataFrame) -> DataFrame:
    o = read(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderdate")
    c = read(spark, d, "customer", "c_custkey", "c_nationkey")
    x = o.join(c, o.o_custkey == c.c_custkey).select(
        "c_nationkey", P.financial_year_label("o_orderdate").alias("financial_year"), "o_totalprice"
    )
    latest = W.latest_rows(x, P.period_sort_key("financial_year"), "financial_year")
    med = A.exact_median(latest, ["c_nationkey"], "o_totalprice", "median_price")
    return med.join(lk, med.c_nationkey == lk.nationkey).select("lad_code", "median_price")


def _earnings(spark: SparkSession, d: str, lk: DataFrame) -> DataFrame:
    c = read(spark, d, "customer", "c_nationkey", "c_acctbal")
    e = c.groupBy("c_nationkey").agg(money_mean(F.sum(cents("c_acctbal")), F.count(F.lit(1))).alias("mean_earnings"))
    return e.join(lk, e.c_nationkey == lk.nationkey).select("lad_code", "mean_earnings")


def _fuel_shares(spark: SparkSession, d: str, lk: DataFrame) -> DataFrame:
    li = read(spark, d, "lineitem", "l_suppkey", "l_returnflag")
    s = read(spark, d, "supplier", "s_suppkey", "s_nationkey")
    cnt = li.join(s, li.l_suppkey == s.s_suppkey).groupBy("s_nationkey").pivot(
        "l_returnflag", ["A", "N", "R"]
    ).agg(F.count(F.lit(1)))
    tot = F.coalesce(F.col("A"), F.lit(0)) + F.coalesce(F.col("N"), F.lit(0)) + F.coalesce(F.col("R"), F.lit(0))
    sh = cnt.select(
        "s_nationkey", *[(F.coalesce(F.col(f), F.lit(0)) * 100.0 / tot).alias(f"fuel_share_{f.lower()}") for f in "ANR"]
    )
    return sh.join(lk, sh.s_nationkey == lk.nationkey).select("lad_code", "fuel_share_a", "fuel_share_n", "fuel_share_r")


@query
def market_snapshot_la(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    spine = lk.select("lad_code", "lad_name", "region_name")
    supply = _latest_fy_pivot(la_supply(spark, d, lk))
    pop = population(spark, d, lk).select("lad_code", "population")
    med = _median_price_latest_fy(spark, d, lk)
    earn = _earnings(spark, d, lk)
    fuel = _fuel_shares(spark, d, lk)
    x = J.left_chain(spine, "lad_code", [supply, pop, med, earn, fuel])
    x = x.withColumn("price_earnings_ratio", X.safe_ratio("median_price", "mean_earnings"))
    return x.select(
        "lad_code", "lad_name", "region_name", "financial_year",
        *[F.round(f"supply_{m.lower()}", 2).alias(f"supply_{m.lower()}") for m in MEASURES],
        "population",
        F.round("median_price", 4).alias("median_price"),
        "mean_earnings",
        F.round("price_earnings_ratio", 6).alias("price_earnings_ratio"),
        *[f"fuel_share_{f}" for f in "anr"],
    )


@query
def market_snapshot_region(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    reg = _region_totals(la_supply(spark, d, lk), lk)
    latest = W.latest_rows(reg, P.period_sort_key("financial_year"), "financial_year")
    supply = T.pivot_unique(latest, ["region_code", "financial_year"], "measure", "dwellings", MEASURES, prefix="supply_")
    # Population joined to the lookup and summed to region.
    pop = population(spark, d, lk).join(lk.select("lad_code", "region_code"), "lad_code").groupBy("region_code").agg(
        F.sum("population").alias("population")
    )
    abc = _band_shares(spark, d, lk).groupBy("region_code").agg(
        F.sum(F.when(F.col("band").isin("A", "B", "C"), F.col("pct"))).alias("abc_share")
    )
    growth = W.first_last_growth(price_series(spark, d, lk), ["geography"], "month", "value").select(
        F.col("geography").alias("region_name"), F.col("growth_pct")
    )
    spine = lk.select("region_code", "region_name").distinct()
    x = J.left_chain(spine, "region_code", [supply, pop, abc]).join(growth, "region_name", "left")
    return x.select(
        "region_code", "region_name", "financial_year",
        *[F.round(f"supply_{m.lower()}", 2).alias(f"supply_{m.lower()}") for m in MEASURES],
        "population", F.round("abc_share", 6).alias("abc_share"), "growth_pct",
    )


# ---------------------------------------------------------------------------
# Joins of families, common periods, horizon deltas
# ---------------------------------------------------------------------------


def _fuel_tables(spark: SparkSession, d: str, lk: DataFrame) -> DataFrame:
    """Main-fuel analogue: 2a counts by return flag, 2b by line status with a dwelling class (K5 union)."""
    li = read(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_linestatus")
    s = read(spark, d, "supplier", "s_suppkey", "s_nationkey")
    own = li.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("_n"))
    x = own.join(s, own.l_suppkey == s.s_suppkey)
    t2a = x.groupBy("s_nationkey", F.col("l_returnflag").alias("fuel_or_method")).agg(
        F.sum("_n").cast("double").alias("value")
    ).withColumn("table_id", F.lit("2a"))
    cls = F.when(F.col("l_linestatus") == "F", F.lit("Existing")).otherwise(F.lit("New"))
    t2b = x.groupBy("s_nationkey", cls.alias("dwelling_class")).agg(F.sum("_n").cast("double").alias("value")).withColumn(
        "table_id", F.lit("2b")
    ).withColumn("fuel_or_method", F.lit("all"))
    fuel = T.union_all([t2a, t2b])
    return fuel.join(lk, fuel.s_nationkey == lk.nationkey).select(
        "lad_code", "lad_name", "table_id", "dwelling_class", "fuel_or_method", "value"
    )


@query
def supply_fuel_join(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    la = la_supply(spark, d, lk).select("lad_code", "lad_name", "financial_year", "measure", "dwellings")
    x = J.join_suffixed(la, _fuel_tables(spark, d, lk), ["lad_code"], "left", "_mf")
    return x.select(
        "lad_code", "lad_name", "financial_year", "measure", F.round("dwellings", 2).alias("dwellings"),
        "lad_name_mf", "table_id", "dwelling_class", "fuel_or_method", F.round("value", 2).alias("value"),
    )


@query
def join_report(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    la = la_supply(spark, d, lk)
    fuel = _fuel_tables(spark, d, lk)
    joined = la.join(fuel, "lad_code", "left")
    parts = [
        la.agg(F.countDistinct("lad_code").alias("value")).withColumn("metric", F.lit("supply_codes")),
        fuel.agg(F.countDistinct("lad_code").alias("value")).withColumn("metric", F.lit("fuel_codes")),
        J.missing_keys_count(la, fuel, "lad_code").withColumnRenamed("n_missing", "value").withColumn("metric", F.lit("supply_codes_without_fuel")),
        J.missing_keys_count(fuel, la, "lad_code").withColumnRenamed("n_missing", "value").withColumn("metric", F.lit("fuel_codes_without_supply")),
        joined.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("joined_rows")),
    ]
    return T.union_all(parts).select("metric", F.col("value").cast("bigint").alias("value"))


def _family_price(spark, d, lk, year_expr) -> DataFrame:
    """Median order price per customer LA and year (price family, 5a analogue)."""
    o = read(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderdate")
    c = read(spark, d, "customer", "c_custkey", "c_nationkey")
    x = o.join(c, o.o_custkey == c.c_custkey).select("c_nationkey", year_expr.alias("year"), "o_totalprice")
    med = A.exact_quantiles(x, ["c_nationkey", "year"], "o_totalprice", {"price": 0.5, "lq_price": 0.25})
    return tidy(med.join(lk, med.c_nationkey == lk.nationkey).select("lad_code", "year", "price", "lq_price"))


def _family_earnings(spark, d, lk) -> DataFrame:
    """Average line price per supplier LA and ship year (earnings family, 5b analogue).

    Lines are summed in whole pence per supplier and year before the supplier join.
    """
    li = read(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_shipdate")
    s = read(spark, d, "supplier", "s_suppkey", "s_nationkey")
    own = li.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.sum(cents("l_extendedprice")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    g = own.join(s, own.l_suppkey == s.s_suppkey).groupBy("s_nationkey", "year").agg(money_mean(F.sum("_s"), F.sum("_n")).alias("earnings"))
    return tidy(g.join(lk, g.s_nationkey == lk.nationkey).select("lad_code", "year", "earnings"))


def _family_ratio(spark, d, lk) -> DataFrame:
    """Published-ratio analogue: order value per distinct customer, by LA and financial-year start."""
    o = read(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderdate")
    c = read(spark, d, "customer", "c_custkey", "c_nationkey")
    g = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey", P.fy_start_year("o_orderdate").alias("year")).agg(
        money_mean(F.sum(cents("o_totalprice")), F.countDistinct("o_custkey")).alias("ratio")
    )
    return tidy(g.join(lk, g.c_nationkey == lk.nationkey).select("lad_code", "year", "ratio"))


def _common_year_set(*frames: DataFrame) -> DataFrame:
    """K6: INTERSECT of the distinct years of each family."""
    out = frames[0].select(F.col("year").cast("int").alias("year"))
    for f in frames[1:]:
        out = out.intersect(f.select(F.col("year").cast("int").alias("year")))
    return out


def _price_years(spark, d, year_expr=None) -> DataFrame:
    """(nationkey, year) pairs that the price family has, found without its medians."""
    o = read(spark, d, "orders", "o_custkey", "o_orderdate")
    c = read(spark, d, "customer", "c_custkey", "c_nationkey")
    own = o.select("o_custkey", (F.year("o_orderdate") if year_expr is None else year_expr).alias("year")).distinct()
    return own.join(c, own.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("nationkey"), "year").distinct()


def _earnings_years(spark, d) -> DataFrame:
    """(nationkey, year) pairs that the earnings family has, found without its means."""
    li = read(spark, d, "lineitem", "l_suppkey", "l_shipdate")
    s = read(spark, d, "supplier", "s_suppkey", "s_nationkey")
    own = li.select("l_suppkey", F.year("l_shipdate").alias("year")).distinct()
    return own.join(s, own.l_suppkey == s.s_suppkey).select(F.col("s_nationkey").alias("nationkey"), "year").distinct()


@query
def ratio_common_year(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    a = _family_price(spark, d, lk, F.year("o_orderdate"))
    b = _family_earnings(spark, d, lk)
    c = _family_ratio(spark, d, lk)
    years = _common_year_set(_price_years(spark, d), _earnings_years(spark, d), _price_years(spark, d, P.fy_start_year("o_orderdate")))
    y = years.agg(F.max("year")).scalar()
    at = lambda f: f.where(F.col("year") == y).drop("year")
    # Full outer join on the code; B7: names from the lookup.
    x = at(a).join(at(b), "lad_code", "full").join(at(c), "lad_code", "full")
    x = x.join(lk.select("lad_code", "lad_name"), "lad_code", "left").withColumn("year", y.cast("int"))
    return x.select(
        "lad_code", "lad_name", "year",
        F.round("price", 4).alias("price"), "earnings",
        F.col("ratio").alias("ratio_published"),
        F.round(X.safe_ratio("price", "earnings"), 6).alias("ratio_computed"),
    )


# Anchor window of the briefing when both years are present (else the last five common years).
ANCHOR_YEARS = (1996, 2000)
HORIZON_YEARS = 5


def _horizon_frames(spark: SparkSession, d: str):
    lk = la_lookup(spark, d)
    a = _family_price(spark, d, lk, F.year("o_orderdate"))
    b = _family_earnings(spark, d, lk)
    c = a.join(b, ["lad_code", "year"]).select("lad_code", "year", X.safe_ratio("price", "earnings").alias("ratio"))
    # The two endpoint years are parameters of every later filter: read them once (one small
    # row) and use them as literals, so year predicates push down instead of repeating a subquery.
    py, ey = _price_years(spark, d), _earnings_years(spark, d)
    years = _common_year_set(py, ey, py.join(ey, ["nationkey", "year"]))
    bounds = P.anchor_bounds(years, "year", ANCHOR_YEARS, HORIZON_YEARS).first()
    y0, y1 = F.lit(bounds["y_min"]), F.lit(bounds["y_max"])
    return lk, a, b, c, y0, y1


@query
def horizon_deltas(spark: SparkSession, d: str) -> DataFrame:
    lk, a, b, c, y0, y1 = _horizon_frames(spark, d)
    dp = A.endpoint_delta(a, "lad_code", "year", "price", y0, y1, "delta_median_price")
    de = A.endpoint_delta(b, "lad_code", "year", "earnings", y0, y1, "delta_earnings")
    dr = A.endpoint_delta(c, "lad_code", "year", "ratio", y0, y1, "delta_ratio")
    meta = lk.select("lad_code", "lad_name", "region_name")
    x = meta.join(dp, "lad_code").join(de, "lad_code").join(dr, "lad_code")
    return x.select(
        "lad_code", "lad_name", "region_name", y0.cast("int").alias("y_min"), y1.cast("int").alias("y_max"),
        F.round("delta_median_price", 4).alias("delta_median_price"),
        "delta_earnings",
        F.round("delta_ratio", 6).alias("delta_ratio"),
    )


@query
def entry_pressure(spark: SparkSession, d: str) -> DataFrame:
    lk, a, b, c, y0, y1 = _horizon_frames(spark, d)
    dm = A.endpoint_delta(a, "lad_code", "year", "price", y0, y1, "d_median")
    dl = A.endpoint_delta(a, "lad_code", "year", "lq_price", y0, y1, "d_lq")
    dr = A.endpoint_delta(c, "lad_code", "year", "ratio", y0, y1, "delta_ratio")
    x = dm.join(dl, "lad_code").join(dr, "lad_code").join(lk.select("lad_code", "region_name"), "lad_code")
    counts = x.groupBy("region_name").agg(
        F.count(F.lit(1)).alias("n_las"), F.count_if(F.col("d_lq") > F.col("d_median")).alias("n_entry_pressure")
    )
    med = A.exact_median(x, ["region_name"], "delta_ratio", "median_delta_ratio")
    return counts.join(med, "region_name").select(
        "region_name", "n_las", "n_entry_pressure", F.round("median_delta_ratio", 6).alias("median_delta_ratio")
    )


ANCHOR_FYS = ("1996-97", "2000-01")


def _label_bounds(df: DataFrame, col: str, anchors: tuple[str, str], n: int):
    """P14 on labels: anchors if both present, else the first and last of the last n labels in P1 order."""
    arr = df.agg(F.array_sort(F.collect_set(F.struct(P.period_sort_key(col).alias("k"), F.col(col).alias("p")))).alias("a"))
    labels = F.transform("a", lambda e: e["p"])
    both = F.array_contains(labels, anchors[0]) & F.array_contains(labels, anchors[1])
    lo = F.when(both, F.lit(anchors[0])).otherwise(F.element_at(labels, -F.least(F.size(labels), F.lit(n))))
    hi = F.when(both, F.lit(anchors[1])).otherwise(F.element_at(labels, -1))
    return arr.select(lo).scalar(), arr.select(hi).scalar()


@query
def region_change_top(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    reg = _region_totals(la_supply(spark, d, lk), lk)
    fy0, fy1 = _label_bounds(reg, "financial_year", ANCHOR_FYS, 5)
    g = reg.groupBy("measure", "region_name").agg(
        F.coalesce(F.sum(F.when(F.col("financial_year") == fy0, F.col("dwellings"))), F.lit(0.0)).alias("total0"),
        F.coalesce(F.sum(F.when(F.col("financial_year") == fy1, F.col("dwellings"))), F.lit(0.0)).alias("total1"),
    ).withColumn("delta", F.col("total1") - F.col("total0"))
    best = g.groupBy("measure").agg(F.min_by("region_name", F.struct(-F.col("delta"), F.col("region_name"))).alias("_top"))
    x = g.join(best, "measure").withColumn("is_top", F.col("region_name") == F.col("_top"))
    return x.select(
        "measure", "region_name", fy0.alias("fy0"), fy1.alias("fy1"),
        F.round("total0", 2).alias("total0"), F.round("total1", 2).alias("total1"),
        F.round("delta", 2).alias("delta"), "is_top",
    )


# ---------------------------------------------------------------------------
# Two monthly indices per region: rebasing, overlap growth, 12-month spread
# ---------------------------------------------------------------------------

BASE_MONTH = "1996-01-01"


def _two_series(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    hpi = price_series(spark, d, lk).withColumnRenamed("value", "hpi")
    rent = rent_series(spark, d, lk).withColumn("geography", X.canonical_name("geography")).withColumnRenamed("value", "rent")
    # Inner join on (canonical region name, month).
    return hpi.withColumn("geography", X.canonical_name("geography")).join(rent, ["geography", "month"])


@query
def index_rebased(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    hpi = W.rebase(price_series(spark, d, lk), ["geography"], "month", "value", F.lit(BASE_MONTH).cast("date"), "hpi_index_base")
    both = _two_series(spark, d)
    base = both.groupBy("geography").agg(F.min_by("hpi", "month").alias("_h0"), F.min_by("rent", "month").alias("_r0"))
    x = both.join(base, "geography").select(
        "geography", "month",
        (F.try_divide("hpi", F.when(F.col("_h0") != 0, F.col("_h0"))) * 100.0).alias("hpi_index"),
        (F.try_divide("rent", F.when(F.col("_r0") != 0, F.col("_r0"))) * 100.0).alias("rent_index"),
    )
    x = x.join(hpi.select("geography", "month", "hpi_index_base"), ["geography", "month"], "left")
    return x.select(
        F.col("geography").alias("region_name"), ymd("month").alias("month"),
        "hpi_index_base", "hpi_index", "rent_index",
        (F.col("hpi_index") - F.col("rent_index")).alias("spread"),
        F.try_divide("hpi_index", "rent_index").alias("ratio"),
    )


@query
def overlap_growth(spark: SparkSession, d: str) -> DataFrame:
    both = _two_series(spark, d)
    h = W.first_last_growth(both, ["geography"], "month", "hpi").select(
        "geography", "first_period", "last_period", "n_points", F.col("growth_pct").alias("hpi_growth")
    )
    r = W.first_last_growth(both, ["geography"], "month", "rent").select("geography", F.col("growth_pct").alias("rent_growth"))
    x = h.join(r, "geography")
    return x.select(
        F.col("geography").alias("region_name"), ymd("first_period").alias("first_month"), ymd("last_period").alias("last_month"),
        "n_points", "hpi_growth", "rent_growth",
        (F.col("hpi_growth") - F.col("rent_growth")).alias("growth_gap"),
    )


@query
def spread_12m(spark: SparkSession, d: str) -> DataFrame:
    both = _two_series(spark, d)
    x = W.pct_change_lag(both, ["geography"], "month", "hpi", 12, "hpi_yoy")
    x = W.pct_change_lag(x, ["geography"], "month", "rent", 12, "rent_yoy")
    return x.select(
        F.col("geography").alias("region_name"), ymd("month").alias("month"),
        "hpi_yoy", "rent_yoy", (F.col("hpi_yoy") - F.col("rent_yoy")).alias("spread"),
    )


# ---------------------------------------------------------------------------
# Rates per 1 000, balance, bins, KPIs, top/bottom
# ---------------------------------------------------------------------------


@query
def rates_per_1000(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    la = la_supply(spark, d, lk)
    wide = T.pivot_sum(la, ["lad_code"], "measure", "dwellings", ["O", "F"], prefix="m_").withColumnsRenamed(
        {"m_o": "starts", "m_f": "completions"}
    )
    pop = population(spark, d, lk).select("lad_code", "population")
    las = wide.join(pop, "lad_code", "left").join(lk.select("lad_code", "lad_name", "region_code", "region_name"), "lad_code")
    regions = las.groupBy("region_code", "region_name").agg(
        A.sum_or_zero("starts").alias("starts"), A.sum_or_zero("completions").alias("completions"),
        F.sum("population").alias("population"),
    )
    rows = T.union_all([
        las.select(F.lit("la").alias("geography_level"), F.col("lad_code").alias("code"), F.col("lad_name").alias("name"), "starts", "completions", "population"),
        regions.select(F.lit("region").alias("geography_level"), F.col("region_code").alias("code"), F.col("region_name").alias("name"), "starts", "completions", "population"),
    ])
    rows = rows.withColumn("starts_per_1000", X.per_1000("starts", "population")).withColumn(
        "completions_per_1000", X.per_1000("completions", "population")
    )
    rows = tidy(rows)
    la_rates = rows.where(F.col("geography_level") == "la")
    med = A.exact_median(la_rates, [], "starts_per_1000", "m").scalar()
    return rows.select(
        "geography_level", "code", "name", F.round("starts", 2).alias("starts"), F.round("completions", 2).alias("completions"),
        "population", F.round("starts_per_1000", 4).alias("starts_per_1000"),
        F.round("completions_per_1000", 4).alias("completions_per_1000"),
        F.round(med, 4).alias("median_la_starts_per_1000"),
    )


@query
def supply_balance(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    reg = _region_totals(la_supply(spark, d, lk), lk)
    latest = W.latest_rows(reg, P.period_sort_key("financial_year"), "financial_year")
    x = latest.groupBy("region_name", "financial_year").agg(
        F.sum(F.when(F.col("measure") == "O", F.col("dwellings"))).alias("starts"),
        F.sum(F.when(F.col("measure") == "F", F.col("dwellings"))).alias("completions"),
    ).withColumn("balance", X.safe_ratio("completions", "starts"))
    top = x.agg(F.max("balance")).scalar()
    return x.select(
        "region_name", "financial_year", F.round("starts", 2).alias("starts"), F.round("completions", 2).alias("completions"),
        F.round("balance", 6).alias("balance"), (F.col("balance") == top).alias("is_max"),
    )


@query
def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer", "c_custkey", "c_acctbal")
    edges = W.quantile_edges(c, "c_acctbal", 5).scalar()
    return c.select("c_custkey", "c_acctbal", W.quantile_bin("c_acctbal", edges).cast("int").alias("bin"))


@query
def metric_kpis(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    q = A.exact_quantiles(c, [], "c_acctbal", {"median": 0.5, "p10": 0.1, "p90": 0.9})
    k = c.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("c_nationkey").alias("n_nations"),
        F.avg("c_acctbal").alias("mean"), F.max("c_acctbal").alias("max"),
        F.count_if(F.col("c_acctbal") > 5000).alias("n_above_5000"),
    )
    x = k.select("*", *[q.select(name).scalar().alias(name) for name in ("median", "p10", "p90")])
    return x.select(
        "n", "n_nations", F.round("mean", 4).alias("mean"), F.round("max", 2).alias("max"), "n_above_5000",
        F.round("median", 4).alias("median"), F.round("p10", 4).alias("p10"), F.round("p90", 4).alias("p90"),
    )


@query
def top_bottom(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    tot = la_supply(spark, d, lk).groupBy("lad_code", "lad_name").agg(F.sum("dwellings").alias("total"))
    tb = A.top_and_bottom(tot, "total", 5, ["lad_code"])
    return tb.select("side", "lad_code", "lad_name", F.round("total", 2).alias("total"))


# ---------------------------------------------------------------------------
# Catalog reads, input checks, JSON, header grammars
# ---------------------------------------------------------------------------


@query
def paged_filtered_read(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.catalog import Dataset, read_page

    ds = Dataset(
        "lineitem", f"{d}/lineitem.parquet", family="lines",
        # (order, line) repeats in this table, so the page order spans every projected column.
        order_by=["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"],
        filter_columns={"flag": "l_returnflag", "status": "l_linestatus"}, case_insensitive={"flag"},
    )
    cols = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"]
    return read_page(spark, ds, cols, {"flag": ["a", "r"], "status": []}, offset=100, limit=500)


@query
def semi_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents", "doc_id", "lang", "source", "n_chars")
    labels = read(spark, d, "labels", "doc_id")
    kept = J.keep_keys(docs, labels, "doc_id")
    return kept.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars_total")
    )


@query
def missing_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Per language, sources never seen and documents not yet labelled."""
    docs = read(spark, d, "documents", "doc_id", "lang", "source")
    labels = read(spark, d, "labels", "doc_id")
    required = docs.agg(F.sort_array(F.collect_set("source"))).scalar()
    present = docs.groupBy("lang").agg(F.collect_set("source").alias("present"), F.count(F.lit(1)).alias("n_docs"))
    unlabelled = docs.join(labels, "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n_unlabelled"))
    x = present.join(unlabelled, "lang", "left")
    return x.select(
        "lang", "n_docs", F.coalesce("n_unlabelled", F.lit(0)).alias("n_unlabelled"),
        F.array_join(F.sort_array(F.array_except(required, F.col("present"))), ",").alias("missing_sources"),
    )


@query
def json_props(spark: SparkSession, d: str) -> DataFrame:
    ev = read(spark, d, "events", "event_type", "value", "props")
    k = F.from_json("props", "k INT").getField("k")
    x = ev.select("event_type", "value", k.alias("k"))
    return x.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("k").cast("bigint").alias("sum_k"), F.max("k").alias("max_k"),
        F.round(F.avg("value"), 4).alias("avg_value"), F.count_if(F.col("k").isNull()).alias("n_missing_k"),
    )


# Property types of the main-fuel sheets tried longest first (T10) and the
# meaning of the price/earnings table ids.
PROPERTY_PREFIXES = ["blue", "blue anvil", "cold", "hot", "red", "small", "small ring"]
TABLE_META = [
    ("5a", "local_authority", "median", "price"),
    ("5b", "local_authority", "median", "earnings"),
    ("5c", "local_authority", "median", "ratio"),
    ("6a", "local_authority", "lower_quartile", "price"),
]


@query
def header_split_family(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    band = size_band("p_size")
    roll_y = (F.lit(1995) + F.col("p_size") % 5).cast("int")
    labels = p.select(
        "p_partkey",
        F.concat(F.lit("Band "), band).alias("l_band"),
        F.concat(X.capitalise("p_type"), F.lit(" - Band "), band).alias("l_dim"),
        F.concat(F.col("p_name"), F.lit(" "), P.rolling_window_label(roll_y)).alias("l_roll"),
        F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("Existing ")).otherwise(F.lit("New ")), F.col("p_name")).alias("l_fuel"),
        F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type")).alias("l_prop"),
        F.concat(F.col("p_type"), F.lit(" / "), F.col("p_brand")).alias("l_slug"),
        F.element_at(F.array(*[F.lit(t[0]) for t in TABLE_META]), (F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int") % len(TABLE_META)) + 1).alias("table_id"),
    )
    meta = spark.createDataFrame(TABLE_META, "table_id string, geography_level string, percentile string, component string")
    x = T.attach_meta(labels, meta, "table_id")
    return x.select(
        "p_partkey",
        *T.split_label("l_band", T.BAND_RE, ["epc_band"]),
        *T.split_label("l_dim", T.DIM_BAND_RE, ["dimension", "dim_band"]),
        *T.split_label("l_roll", T.ROLLING_RE, ["breakdown", "rolling_period"]),
        *T.split_label("l_fuel", T.EXISTING_NEW_RE, ["dwelling_class", "fuel"]),
        *[c.alias(n) for c, n in zip(T.split_by_prefix("l_prop", PROPERTY_PREFIXES), ["property_type", "property_rest"])],
        X.snake("l_slug").alias("type_slug"),
        "table_id", "geography_level", "percentile", "component",
    )


@query
def year_columns_melt(spark: SparkSession, d: str) -> DataFrame:
    """A wide sheet with year columns and note columns; keep ``20yy`` columns, drop rows without a region code."""
    lk = la_lookup(spark, d)
    o = read(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderdate")
    c = read(spark, d, "customer", "c_custkey", "c_nationkey")
    x = o.join(c, o.o_custkey == c.c_custkey).withColumn("yr", F.year("o_orderdate").cast("string"))
    years = T.pivot_values(x, "yr")
    wide = x.groupBy("c_nationkey").pivot("yr", years).agg(F.sum("o_totalprice"))
    wide = wide.join(lk, wide.c_nationkey == lk.nationkey).withColumn("Notes", F.lit("provisional"))
    keep = T.year_columns(wide)
    wide = wide.where(F.col("region_code").isNotNull())
    long = T.melt_numeric(wide, ["lad_code", "region_code"], keep, "year", "value").where(F.col("value").isNotNull())
    return long.select("lad_code", "region_code", F.col("year").cast("int").alias("year"), F.round("value", 2).alias("value"))


@query
def metric_melt(spark: SparkSession, d: str) -> DataFrame:
    """T20 headline pair, T21 breakdown, T27 wide->long, T28 absent columns, T29 aliases."""
    lk = la_lookup(spark, d)
    o = read(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = read(spark, d, "customer", "c_custkey", "c_nationkey")
    x = o.join(c, o.o_custkey == c.c_custkey).join(lk, F.col("c_nationkey") == lk.nationkey)
    head = x.groupBy("lad_code").agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("Vacant dwellings"),
        F.count_if(F.col("o_orderstatus") == "P").alias("Second homes (with no usual residents)"),
    )
    pair = T.melt(head, ["lad_code"], None, "label", "v").select(
        "lad_code",
        F.when(F.col("label") == "Vacant dwellings", F.lit("vacant")).otherwise(F.lit("second_home")).alias("dwelling_group"),
        F.col("v").cast("bigint").alias("value"),
    )
    pair = T.ensure_columns(pair, {"breakdown_type": "string", "breakdown_label": "string"})
    brk = x.groupBy("lad_code", "o_orderpriority").agg(F.count(F.lit(1)).alias("value")).select(
        "lad_code", F.lit("vacant").alias("dwelling_group"), F.lit("priority").alias("breakdown_type"),
        X.snake("o_orderpriority").alias("breakdown_label"), "value",
    )
    out = T.union_all([pair, brk])
    out = T.alias_columns(out, {"dwellings": "value"})
    return out.select("lad_code", "dwelling_group", "breakdown_type", "breakdown_label", "value", "dwellings")


# ---------------------------------------------------------------------------
# Filters, formatting, aggregate family
# ---------------------------------------------------------------------------

# Region preset and the aggregate rows excluded from regional views.
REGION_PRESET = ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
EXCLUDED_AGGREGATES = ["MIDDLE EAST"]


@query
def fills_and_filters(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    o = read(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read(spark, d, "customer", "c_custkey", "c_nationkey")
    x = o.where(F.trim("o_orderpriority") == "1-URGENT").join(c, o.o_custkey == c.c_custkey).join(
        lk, F.col("c_nationkey") == lk.nationkey
    )
    x = x.where(F.col("region_name").isin(REGION_PRESET) & ~F.col("region_name").isin(EXCLUDED_AGGREGATES))
    g = x.groupBy("region_name", F.year("o_orderdate").alias("year")).agg(
        F.sum("o_totalprice").alias("total"), F.sum(cents("o_totalprice")).alias("total_pence")
    ).na.drop(subset=["total"])
    w = Window.partitionBy("region_name").orderBy("year")
    g = g.withColumn("pct_change", X.pct_change(F.lag("total").over(w), F.col("total")))
    frac = F.col("pct_change") / 100.0
    freq = F.when(F.col("year") % 2 == 0, F.lit("Monthly")).otherwise(F.lit("Quarterly"))
    return g.select(
        X.capitalise("region_name").alias("region_label"), F.col("year").cast("int").alias("year"),
        F.round("total", 2).alias("total"), X.fmt_gbp(F.floor((F.col("total_pence") + 50) / 100)).alias("total_label"),
        F.round("pct_change", 4).alias("pct_change"),
        X.horizon_bucket(F.col("year") - 1994).cast("int").alias("horizon_bucket"),
        X.delta_class(frac).alias("delta_class"), F.round(X.logistic(frac), 6).alias("logistic_change"),
        F.round(X.clamp(frac), 4).alias("clamped_change"), X.contains_ci("region_name", "Eu").alias("has_eu"),
        P.season_length(freq).cast("int").alias("season_length"),
    )


@query
def aggregate_family(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority")
    c = read(spark, d, "customer", "c_custkey", "c_nationkey")
    x = o.join(c, o.o_custkey == c.c_custkey).join(lk, F.col("c_nationkey") == lk.nationkey)
    n_years = o.agg(F.countDistinct(F.year("o_orderdate"))).scalar()
    g = x.groupBy("lad_code").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("o_totalprice").alias("total"),
        A.sum_or_zero(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("total_p"),
        F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_orderkey"),
        money_mean(F.sum(cents("o_totalprice")), F.count(F.lit(1))).alias("mean_price"),
        F.max("o_totalprice").alias("max_price"),
        F.max_by("o_orderkey", F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))).alias("argmax_orderkey"),
        A.mode_label("o_orderpriority").alias("mode_priority"),
    )
    g = g.withColumn("mean_per_year", F.col("total") / n_years.cast("double"))
    g = g.withColumn("rank_mean_price", W.rank_desc("mean_price").cast("bigint"))
    g = A.zscore(g, ["total"])
    lo, hi = g.agg(F.min("total")).scalar(), g.agg(F.max("total")).scalar()
    g = g.withColumn("hist_bin", A.equal_width_bucket("total", lo, hi, 10))
    return g.select(
        "lad_code", "n_orders", F.round("total", 2).alias("total"), F.round("total_p", 2).alias("total_p"),
        "first_orderkey", F.round("mean_per_year", 6).alias("mean_per_year"), "mean_price",
        "rank_mean_price", F.round("max_price", 2).alias("max_price"), "argmax_orderkey", "mode_priority",
        F.round("total_z", 6).alias("total_z"), "hist_bin",
    )


# ---------------------------------------------------------------------------
# Latest rows, dedup, lags, leaders
# ---------------------------------------------------------------------------


@query
def latest_rows(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    last = W.first_per_key(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], last=True)
    return last.select("o_custkey", "o_orderkey", ymd("o_orderdate").alias("o_orderdate"), "o_totalprice")


@query
def latest_period_rows(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    la = la_supply(spark, d, lk)
    latest = W.latest_rows(la, P.period_sort_key("financial_year"), "financial_year")
    return latest.select("lad_code", "lad_name", "financial_year", "measure", F.round("dwellings", 2).alias("dwellings"))


@query
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    ev = read(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    first = W.first_per_key(ev, ["user_id"], [F.col("ts"), F.col("event_id")])
    # Lookup built from the fact table, first user per event type.
    lookup = J.lookup_from_fact(first, "event_type", ["user_id"], "event_id").withColumnRenamed("user_id", "first_user")
    x = first.join(lookup, "event_type", "left")
    return x.select(
        "user_id", "event_id", "event_type", "value",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"),
        (F.col("first_user") == F.col("user_id")).alias("is_type_first_user"),
    )


@query
def lag_family(spark: SparkSession, d: str) -> DataFrame:
    s = price_series(spark, d)
    x = W.lag_features(s, ["geography"], "month", "value", [1, 2, 3, 12], lead=1)
    x = x.withColumn("is_train", W.chrono_split_flag(["geography"], "month", 0.8))
    return x.select(
        F.col("geography").alias("region_name"), ymd("month").alias("month"), "value",
        "lag_1", "lag_2", "lag_3", "lag_12", "lead_1", "diff_1", "is_train",
    )


@query
def yoy_last_two(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    reg = _region_totals(la_supply(spark, d, lk), lk)
    tot = reg.groupBy("region_name", "financial_year").agg(F.sum("dwellings").alias("v"))
    arr = tot.agg(F.array_sort(F.collect_set(F.struct(P.period_sort_key("financial_year").alias("k"), F.col("financial_year").alias("p")))).alias("a"))
    last = arr.select(F.element_at("a", -1).getField("p")).scalar()
    prev = arr.select(F.element_at("a", -2).getField("p")).scalar()
    g = tot.groupBy("region_name").agg(
        F.max(F.when(F.col("financial_year") == last, F.col("v"))).alias("v_last"),
        F.max(F.when(F.col("financial_year") == prev, F.col("v"))).alias("v_prev"),
    )
    return g.select(
        "region_name", last.alias("fy_last"), prev.alias("fy_prev"), F.round("v_last", 2).alias("v_last"),
        F.round("v_prev", 2).alias("v_prev"), F.round(X.pct_change("v_prev", "v_last"), 4).alias("yoy_pct"),
    )


@query
def leaders_trend(spark: SparkSession, d: str) -> DataFrame:
    """The three LAs leading the latest year's starts, and their whole series."""
    lk = la_lookup(spark, d)
    la = la_supply(spark, d, lk).where(F.col("measure") == "O")
    latest = W.latest_rows(la, P.period_sort_key("financial_year"), "financial_year")
    leaders = A.top_k(latest, "dwellings", 3, ["lad_code"]).select("lad_code")
    trend = J.keep_keys(la, leaders, "lad_code")
    return trend.select("lad_code", "lad_name", "financial_year", F.round("dwellings", 2).alias("dwellings"))


@query
def line_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Financial year x measure totals with absent categories kept as NULL rows."""
    lk = la_lookup(spark, d)
    la = la_supply(spark, d, lk)
    measures = T.pivot_values(la, "measure")
    wide = la.groupBy("financial_year").pivot("measure", measures).agg(F.sum("dwellings"))
    long = wide.unpivot(["financial_year"], measures, "measure", "dwellings")
    return long.select("financial_year", "measure", F.round("dwellings", 2).alias("dwellings"))


@query
def distinct_dims(spark: SparkSession, d: str) -> DataFrame:
    """Sorted distinct values of each dimension with their position."""
    o = read(spark, d, "orders", "o_orderpriority", "o_orderstatus")
    c = read(spark, d, "customer", "c_mktsegment")
    p = read(spark, d, "part", "p_type")
    parts = [
        o.select(F.lit("priority").alias("dimension"), F.col("o_orderpriority").alias("value")).distinct(),
        o.select(F.lit("status").alias("dimension"), F.col("o_orderstatus").alias("value")).distinct(),
        c.select(F.lit("segment").alias("dimension"), F.col("c_mktsegment").alias("value")).distinct(),
        p.select(F.lit("part_type").alias("dimension"), F.col("p_type").alias("value")).distinct(),
    ]
    x = T.union_all(parts)
    w = Window.partitionBy("dimension").orderBy("value")
    return x.select("dimension", "value", F.row_number().over(w).cast("bigint").alias("position"))


# ---------------------------------------------------------------------------
# Context joins, affordability, population, mapped metric, findings
# ---------------------------------------------------------------------------


def _region_year_totals(spark: SparkSession, d: str, lk: DataFrame) -> DataFrame:
    o = read(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderdate")
    c = read(spark, d, "customer", "c_custkey", "c_nationkey")
    g = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey", F.year("o_orderdate").cast("int").alias("year")).agg(
        F.sum("o_totalprice").alias("total")
    )
    return g.join(lk, g.c_nationkey == lk.nationkey).groupBy("region_name", "year").agg(F.sum("total").alias("total"))


@query
def region_context_joins(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    tot = _region_year_totals(spark, d, lk)
    # Index to the first year's value of each region.
    base = tot.groupBy("region_name").agg(F.min_by("total", "year").alias("_base"))
    x = tot.join(base, "region_name").withColumn("index_to_base", X.safe_ratio("total", "_base") * 100.0)
    # P12 + J6: yearly mean of the monthly rents series, inner join on (region, year).
    rent = rent_series(spark, d, lk).groupBy(F.col("geography").alias("region_name"), F.year("month").cast("int").alias("year")).agg(
        F.avg("value").alias("rent_mean")
    )
    x = x.join(rent, ["region_name", "year"])
    # Only context columns not already present, context deduplicated.
    x = J.add_missing_context(x, lk.select("region_name", "region_code"), "region_name")
    # Region shares joined by code, both sides one row per code.
    abc = _band_shares(spark, d, lk).groupBy("region_code").agg(
        F.sum(F.when(F.col("band").isin("A", "B", "C"), F.col("pct"))).alias("abc_share")
    )
    x = x.join(abc, "region_code")
    # LA counts per region joined by name.
    n_las = lk.groupBy("region_name").agg(F.count(F.lit(1)).alias("n_las"))
    x = x.join(n_las, "region_name", "left")
    return x.select(
        "region_code", "region_name", "year", F.round("total", 2).alias("total"),
        F.round("index_to_base", 6).alias("index_to_base"), F.round("rent_mean", 8).alias("rent_mean"),
        F.round("abc_share", 6).alias("abc_share"), "n_las",
    )


@query
def affordability_compare(spark: SparkSession, d: str) -> DataFrame:
    """Three ratio families on their own period labels, aligned on the common years."""
    lk = la_lookup(spark, d)
    a = _family_price(spark, d, lk, F.year("o_orderdate")).select(
        F.lit("price").alias("family"), "lad_code", F.concat(F.lit("Year ending Sep "), F.col("year").cast("string")).alias("period_label"),
        F.round("price", 4).alias("value"),
    )
    b = _family_earnings(spark, d, lk).select(
        F.lit("earnings").alias("family"), "lad_code", F.col("year").cast("string").alias("period_label"), F.col("earnings").alias("value")
    )
    c = _family_ratio(spark, d, lk).select(
        F.lit("ratio").alias("family"), "lad_code", F.col("year").cast("string").alias("period_label"), F.col("ratio").alias("value")
    )
    fams = [f.withColumn("pe_year", P.pe_year("period_label")) for f in (a, b, c)]
    common = _common_year_set(*[f.withColumnRenamed("pe_year", "year") for f in fams]).withColumnRenamed("year", "pe_year")
    x = T.union_all(fams).join(common, "pe_year", "left_semi")
    return x.select(
        "family", "lad_code", "period_label", "pe_year", ymd(P.period_sort_date("period_label")).alias("sort_date"), "value",
    )


@query
def population_by_la(spark: SparkSession, d: str) -> DataFrame:
    """B1: population per LA as the sum over a category (segment), zero if all NULL."""
    lk = la_lookup(spark, d)
    c = read(spark, d, "customer", "c_nationkey", "c_mktsegment")
    by_cat = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("observation"))
    pop = by_cat.groupBy("c_nationkey").agg(F.coalesce(F.sum("observation"), F.lit(0)).cast("bigint").alias("population"))
    return pop.join(lk, pop.c_nationkey == lk.nationkey).select("lad_code", "lad_name", "population", F.lit(2021).alias("year"))


@query
def mapped_metric(spark: SparkSession, d: str) -> DataFrame:
    """One metric per LA with quantile bins, the median KPI and top/bottom five."""
    lk = la_lookup(spark, d)
    la = la_supply(spark, d, lk)
    latest = W.latest_rows(la, P.period_sort_key("financial_year"), "financial_year")
    tot = latest.groupBy("lad_code", "lad_name").agg(F.sum("dwellings").alias("supply"))
    pop = population(spark, d, lk).select("lad_code", "population")
    m = tidy(tot.join(pop, "lad_code", "left").withColumn("metric", X.per_1000("supply", "population")))
    edges = W.quantile_edges(m, "metric", 5).scalar()
    med = A.exact_median(m, [], "metric", "m").scalar()
    top = A.top_k(m.where(F.col("metric").isNotNull()), "metric", 5, ["lad_code"]).select("lad_code", F.lit("top").alias("side"))
    bottom = A.top_k(m.where(F.col("metric").isNotNull()), "metric", 5, ["lad_code"], ascending=True).select(
        "lad_code", F.lit("bottom").alias("side")
    )
    x = m.join(T.union_all([top, bottom]), "lad_code", "left")
    return x.select(
        "lad_code", "lad_name", F.round("metric", 4).alias("metric"), W.quantile_bin("metric", edges, 5).cast("int").alias("bin"),
        F.round(med, 4).alias("median_metric"), "side",
    )


@query
def findings(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic sentences built from the arg-max rows of the product tables."""
    lead = region_supply_by_fy(spark, d).where(F.col("measure") == "O")
    lead = W.latest_rows(lead, P.period_sort_key("financial_year"), "financial_year")
    lead = lead.agg(F.max_by(F.struct("region_name", "financial_year", "dwellings"), F.struct(F.col("dwellings"), F.col("region_name"))).alias("r"))
    f1 = lead.select(
        F.lit(1).alias("finding_id"),
        F.format_string("%s leads new supply in %s with %.2f", "r.region_name", "r.financial_year", F.round("r.dwellings", 2)).alias("text"),
    )
    change = region_change_top(spark, d).where((F.col("measure") == "O") & F.col("is_top"))
    f2 = change.select(
        F.lit(2).alias("finding_id"),
        F.format_string("%s had the largest change in new supply between %s and %s: %.2f", "region_name", "fy0", "fy1", "delta").alias("text"),
    )
    gap = overlap_growth(spark, d).agg(
        F.max_by(F.struct("region_name", "hpi_growth", "rent_growth"), F.struct(F.col("growth_gap"), F.col("region_name"))).alias("r")
    )
    f3 = gap.select(
        F.lit(3).alias("finding_id"),
        F.format_string("%s: price index grew %.2f%% against rents %.2f%%", "r.region_name", F.round("r.hpi_growth", 2), F.round("r.rent_growth", 2)).alias("text"),
    )
    snap = market_snapshot_la(spark, d)
    f4 = snap.agg(
        F.count_if(F.col("price_earnings_ratio") > 30).alias("k"), F.count(F.lit(1)).alias("n"), F.max("price_earnings_ratio").alias("mx")
    ).select(
        F.lit(4).alias("finding_id"),
        F.format_string("%d of %d authorities have a price to earnings ratio above 30, the highest is %.2f", "k", "n", F.round("mx", 2)).alias("text"),
    )
    return T.union_all([f1, f2, f3, f4])


@query
def summary_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Headline numbers of the summary page, one row."""
    lk = la_lookup(spark, d)
    la = la_supply(spark, d, lk)
    la_tot = la.groupBy("lad_code").agg(F.sum("dwellings").alias("t"))
    reg = _region_totals(la, lk).groupBy("region_name").agg(F.sum("dwellings").alias("t"))
    latest_fy = la.agg(F.max(F.struct(P.period_sort_key("financial_year").alias("k"), F.col("financial_year").alias("p"))).getField("p")).scalar()
    total = la.agg(F.sum("dwellings")).scalar()
    mean_la = la_tot.agg(F.avg("t")).scalar()
    one = la.agg(
        F.round(F.sum("dwellings"), 2).alias("total_supply"),
        F.countDistinct("lad_code").alias("n_las"),
        F.round(F.sum(F.when(F.col("financial_year") == latest_fy, F.col("dwellings"))), 2).alias("latest_fy_total"),
    )
    return one.select(
        "total_supply", "n_las", latest_fy.alias("latest_fy"), "latest_fy_total",
        reg.agg(F.countDistinct("region_name")).scalar().alias("n_regions"),
        F.round(A.exact_median(la_tot, [], "t", "m").scalar(), 2).alias("median_la_total"),
        F.round(reg.agg(F.max("t")).scalar() / total * 100.0, 4).alias("top_region_share_pct"),
        la_tot.agg(F.count_if(F.col("t") > mean_la)).scalar().alias("n_las_above_mean"),
    )


# ---------------------------------------------------------------------------
# Series catalog, backtest plan, SQL-side baselines, bands, classifier metrics
# ---------------------------------------------------------------------------

from ..operators import forecast as Y  # noqa: E402

HORIZONS = [1, 3, 6, 12]
MODELS = ["seasonal_naive", "seasonal_repeat", "drift", "smoothing", "ensemble", "lagged_gbt"]
# Seasons of the series frequencies.
SEASONS = {"monthly": 12, "quarterly": 4}


def _series(spark: SparkSession, d: str) -> DataFrame:
    """Monthly price series per region and per LA, plus a quarterly supply series per region."""
    lk = la_lookup(spark, d)
    reg = price_series(spark, d, lk).select(
        F.concat(F.lit("price:"), F.col("geography")).alias("series_id"), F.lit("region").alias("level"),
        F.lit("monthly").alias("frequency"), F.col("month").alias("ts"), "value",
    )
    la = price_series(spark, d, lk, grain="la").select(
        F.concat(F.lit("price:"), F.col("geography")).alias("series_id"), F.lit("la").alias("level"),
        F.lit("monthly").alias("frequency"), F.col("month").alias("ts"), "value",
    )
    o = read(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderdate")
    c = read(spark, d, "customer", "c_custkey", "c_nationkey")
    q = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey", F.trunc("o_orderdate", "quarter").cast("date").alias("ts")).agg(
        F.sum("o_totalprice").alias("v")
    )
    q = q.join(lk, q.c_nationkey == lk.nationkey).groupBy("region_name", "ts").agg(F.sum("v").alias("value")).select(
        F.concat(F.lit("supply:"), F.col("region_name")).alias("series_id"), F.lit("region").alias("level"),
        F.lit("quarterly").alias("frequency"), "ts", "value",
    )
    return T.union_all([reg, la, q])


@query
def series_catalog(spark: SparkSession, d: str) -> DataFrame:
    cat = Y.series_catalog(_series(spark, d))
    return cat.select(
        "series_id", "level", "frequency", "n_points", ymd("first_ts").alias("first_ts"), ymd("last_ts").alias("last_ts"),
        "season_length", "min_train",
    )


@query
def backtest_plan(spark: SparkSession, d: str) -> DataFrame:
    cat = Y.series_catalog(_series(spark, d))
    plan = Y.backtest_plan(cat, HORIZONS, MODELS)
    return plan.select("series_id", "horizon", "model", "engine", "n_origins", "horizon_bucket")


def _points_by_season(spark: SparkSession, d: str) -> list[tuple[int, DataFrame]]:
    s = tidy(_series(spark, d))
    return [(season, tidy(Y.index_points(s.where(F.col("frequency") == f)))) for f, season in SEASONS.items()]


@query
def seasonal_naive_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Every series x every horizon x the SQL models."""
    parts = [Y.summarise_backtest(Y.baseline_backtest(pts, HORIZONS, season, Y.DEFAULT_MIN_TRAIN)) for season, pts in _points_by_season(spark, d)]
    summ = T.union_all(parts)
    r = lambda c, n=4: F.round(c, n).alias(c)
    return summ.select(
        "series_id", F.col("horizon").cast("int").alias("horizon"), "model", "n_windows", r("mae"), r("rmse"), r("mape"), r("mase"),
        r("coverage_p10_p90", 6), r("pinball_p10"), r("pinball_p50"), r("pinball_p90"), "is_best",
    )


@query
def prob_bands(spark: SparkSession, d: str) -> DataFrame:
    """Six periods ahead for every series (four for quarterly ones: the forecast stays within one season)."""
    fc = T.union_all([Y.forward_seasonal_naive(pts, horizon=min(6, season), season=season) for season, pts in _points_by_season(spark, d)])
    r = lambda c: F.round(c, 4).alias(c)
    return fc.select("series_id", "h", r("point"), r("p10"), r("p50"), r("p90"), r("lower"), r("upper"), r("last_value"), r("pct_vs_last"))


@query
def classifier_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Brier, AUC (average ranks), F1 and mean fold Brier of a deterministic document score."""
    from ..operators import models as M

    docs = read(spark, d, "documents", "doc_id", "n_chars")
    labels = read(spark, d, "labels", "doc_id", "quality", "toxic")
    x = docs.join(labels, "doc_id").select(
        "doc_id", F.round(X.logistic((F.col("n_chars") - 2400) / 1500.0), 3).alias("score"), "quality", "toxic"
    )
    long = x.unpivot(["doc_id", "score"], ["quality", "toxic"], "target", "y")
    long = long.withColumn("fold", (F.col("doc_id") % 5).cast("int"))
    met = M.binary_metrics(long, ["target"], "score", "y", threshold=0.5)
    folds = M.binary_metrics(long, ["target", "fold"], "score", "y", threshold=0.5).groupBy("target").agg(
        F.avg("brier").alias("mean_fold_brier")
    )
    out = met.join(folds, "target")
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("target", "n", r("positive_rate"), r("brier"), r("auc"), r("f1"), r("mean_fold_brier"))


# ---------------------------------------------------------------------------
# Fitted models (rows-only checks: no SQL statement exists for a model fit)
# ---------------------------------------------------------------------------

from . import playbook as PB  # noqa: E402


@query
def lagged_gbt(spark: SparkSession, d: str) -> DataFrame:
    """One boosted-tree model pooled over all monthly series on lags 1,2,3,12; chronological 80/20 split."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    s = _series(spark, d).where(F.col("frequency") == "monthly").withColumnRenamed("value", "y")
    x = W.lag_features(s, ["series_id"], "ts", "y", [1, 2, 3, 12]).na.drop(subset=["lag_1", "lag_2", "lag_3", "lag_12"])
    x = x.withColumn("is_train", W.chrono_split_flag(["series_id"], "ts", 0.8))
    feats = ["lag_1", "lag_2", "lag_3", "lag_12"]
    model = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features"), GBTRegressor(featuresCol="features", labelCol="y", maxDepth=5, seed=42)]).fit(
        x.where("is_train")
    )
    pred = model.transform(x.where(~F.col("is_train")))
    e = F.col("prediction") - F.col("y")
    n_train = x.where("is_train").groupBy("series_id").agg(F.count(F.lit(1)).alias("n_train"))
    out = pred.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")
    ).join(n_train, "series_id", "left")
    return out.select("series_id", "n_train", "n_test", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


def _customer_features(spark: SparkSession, d: str) -> DataFrame:
    lk = la_lookup(spark, d)
    o = read(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    agg = o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("max_price"),
        F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("share_urgent"),
        F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("double").alias("span_days"),
        F.sum("o_totalprice").alias("total_value"),
    )
    # customers without orders stay, with a total of 0
    x = c.join(agg, c.c_custkey == agg.o_custkey, "left").join(lk, F.col("c_nationkey") == lk.nationkey, "left")
    x = x.withColumns({"n_orders": F.coalesce("n_orders", F.lit(0)), "total_value": F.coalesce("total_value", F.lit(0.0))})
    return x.select("c_custkey", "region_name", "c_acctbal", "n_orders", "mean_price", "max_price", "share_urgent", "span_days", "total_value")


CV_FEATURES = ["c_acctbal", "n_orders", "mean_price", "max_price", "share_urgent", "span_days"]


def _cv_query(spark: SparkSession, d: str, model: str) -> DataFrame:
    from ..operators import models as M

    feats = _customer_features(spark, d)
    preds, metrics = M.grouped_cv(feats, "c_custkey", CV_FEATURES, "total_value", "region_name", k=5, model=model, log_target=True)
    # a row per fold goes to the rows; dealt by fold, all rows would land in as many tasks as there are folds
    out = preds.join(F.broadcast(metrics.withColumnsRenamed({"n": "fold_n", "mae": "fold_mae", "rmse": "fold_rmse", "r2": "fold_r2"})), "fold")
    cols = ["c_custkey", "region_name", "fold", "actual", "predicted", "residual", "fold_n", "fold_r2", "fold_mae", "fold_rmse"]
    if "top_feature" in out.columns:
        cols.append("top_feature")
    return out.select(*cols)


@query
def fold_assignment(spark: SparkSession, d: str) -> DataFrame:
    """M3: fold of each region, customers counted."""
    from ..operators import models as M

    x = _customer_features(spark, d)
    sizes = x.groupBy("region_name").agg(F.count(F.lit(1)).alias("n"))
    return M.fold_table(x, "region_name", 5).join(sizes, "region_name").select("region_name", "fold", "n")


@query
def fold_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M4: metrics per fold of a fixed predictor of the order total (orders x 150 000), folds by region."""
    from ..operators import models as M

    x = _customer_features(spark, d)
    scored = x.join(M.fold_table(x, "region_name", 5), "region_name").select(
        "fold", F.col("total_value").alias("actual"), (F.col("total_value") - F.col("n_orders") * 150000.0).alias("residual"))
    r = lambda c, n: F.round(c, n).alias(c)
    return M.fold_metrics(scored).select("fold", "n", r("r2", 6), r("mae", 2), r("rmse", 2))


@query
def scenario_shocks(spark: SparkSession, d: str) -> DataFrame:
    """Drivers of the scenario table and their values in the low and high scenario, with the drivers' own score."""
    from ..operators import models as M

    snap = tidy(market_snapshot_la(spark, d).select("lad_code", *SCENARIO_DRIVERS))
    out = snap.withColumn("driver_score", M.driver_score(snap, SCENARIO_DRIVERS))
    for name, shock in (("low", -M.SHOCK), ("high", M.SHOCK)):
        moved = M.shocked(snap, SCENARIO_DRIVERS, shock)
        out = out.join(moved.select("lad_code", *[F.round(c, 4).alias(f"{c}_{name}") for c in SCENARIO_DRIVERS]), "lad_code")
    return out.select("lad_code", F.round("driver_score", 6).alias("driver_score"), *[f"{c}_{n}" for n in ("low", "high") for c in SCENARIO_DRIVERS])


@query
def group_kfold_elastic_net(spark: SparkSession, d: str) -> DataFrame:
    """M1/M3/M4: elastic net (alpha 0.05, l1 0.5) with median impute and scaling, grouped by region."""
    return _cv_query(spark, d, "elastic_net")


@query
def group_kfold_gbt(spark: SparkSession, d: str) -> DataFrame:
    """M2/M3/M4: boosted trees (200 trees, 0.05, depth 6, subsample 0.9) with importances, grouped by region."""
    return _cv_query(spark, d, "gbt")


def _embedding_vectors(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import models as M

    e = read(spark, d, "embeddings", "vec_id", "embedding", "label").where(F.col("embedding").isNotNull())
    return M.scaled_vectors(e, "embedding")


KMEANS_K = 5


@query
def kmeans_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """M5/M7/M9: best of 10 k-means starts, silhouette, labels attached by id."""
    from ..operators import models as M

    v = _embedding_vectors(spark, d).persist()
    model, cost = M.kmeans_best_of(v, KMEANS_K)
    out = model.transform(v)
    sil = M.silhouette(out)
    ids = read(spark, d, "embeddings", "vec_id", "label")
    labelled = J.keep_keys(ids, out, "vec_id").join(out.select("vec_id", "cluster"), "vec_id", "left")
    return labelled.select(
        "vec_id", "label", "cluster", F.lit(sil).cast("double").alias("silhouette"), F.lit(float(cost)).alias("training_cost")
    )


@query
def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    """M8: two principal components of the centred, scaled embeddings."""
    from ..operators import models as M

    out, var = M.pca_2d(_embedding_vectors(spark, d))
    return out.select(
        "vec_id", "label", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"),
        F.lit(round(var[0], 6)).alias("explained_1"), F.lit(round(var[1], 6)).alias("explained_2"),
    )


@query
def bisecting(spark: SparkSession, d: str) -> DataFrame:
    """M6 (re-aimed): bisecting k-means clusters of the embeddings."""
    from ..operators import models as M

    return M.bisecting(_embedding_vectors(spark, d), KMEANS_K).select("vec_id", "label", "cluster")


# Drivers of the scenario table and the way each moves in the high scenario (1: supply, -1: pressure).
SCENARIO_DRIVERS = {"supply_f": 1, "supply_o": 1, "supply_p": 1, "population": 1, "median_price": 1, "mean_earnings": 1, "price_earnings_ratio": -1, "fuel_share_a": 1, "fuel_share_n": 1, "fuel_share_r": 1}


@query
def scenario_table(spark: SparkSession, d: str) -> DataFrame:
    """LA snapshot drivers -> growth of the LA price series; base, low and high scenarios."""
    from ..operators import models as M

    lk = la_lookup(spark, d)
    snap = market_snapshot_la(spark, d)
    growth = W.first_last_growth(price_series(spark, d, lk, grain="la"), ["geography"], "month", "value").select(
        F.col("geography").alias("lad_code"), F.col("growth_pct").alias("hpi_growth")
    )
    base = tidy(snap.join(growth, "lad_code", "left"))
    out = M.scenario_table(base, "lad_code", SCENARIO_DRIVERS, ["hpi_growth", "price_earnings_ratio"])
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("lad_code", r("scenario_baseline"), r("scenario_low"), r("scenario_high"), "target_metric", "target_is_proxy")


@query
def playbook_scoreboard(spark: SparkSession, d: str) -> DataFrame:
    """Scoreboard over targets and geographies.

    The panels are small aggregates, written once; the targets are independent fits and are submitted together.
    """
    lk = la_lookup(spark, d)
    pts = tidy(Y.index_points(_series(spark, d).where(F.col("frequency") == "monthly")))
    states = tidy(Y.smoothing_states(pts))
    _, a, b, c, _, _ = _horizon_frames(spark, d)
    c = tidy(c)
    spread = tidy(spread_12m(spark, d).withColumn("month", F.to_date("month")))
    # Vacancy pressure: change of the open-order share between the last two financial years per LA.
    la = tidy(la_supply(spark, d, lk))
    fy_last = la.agg(F.max(F.struct(P.period_sort_key("financial_year").alias("k"), F.col("financial_year").alias("p")))).scalar().getField("p")
    share = la.groupBy("lad_code", "financial_year", "fy_start").agg(
        (F.sum(F.when(F.col("measure") == "O", F.col("dwellings"))) / F.sum("dwellings")).alias("open_share")
    )
    w = Window.partitionBy("lad_code").orderBy("fy_start")
    share = share.withColumn("delta", (F.col("open_share") - F.lag("open_share").over(w)) * 100.0).where(F.col("financial_year") == fy_last)
    vac = tidy(market_snapshot_la(spark, d).join(share.select("lad_code", "delta"), "lad_code"))
    # Supply shortfall: completions (status F) below starts (status O) in an authority's financial year.
    sc = tidy(la.groupBy("lad_code", "fy_start").agg(
        F.sum(F.when(F.col("measure") == "O", F.col("dwellings"))).alias("starts"),
        F.sum(F.when(F.col("measure") == "F", F.col("dwellings"))).alias("completions"),
        F.sum(F.when(F.col("measure") == "P", F.col("dwellings"))).alias("pending"),
    ).withColumn("short", (F.col("completions") < F.col("starts")).cast("int")).withColumn("key", F.concat_ws("-", "lad_code", "fy_start")))
    open_share = sc.withColumn("open_share", F.col("starts") / (F.coalesce("starts", F.lit(0.0)) + F.coalesce("completions", F.lit(0.0)) + F.coalesce("pending", F.lit(0.0))))
    targets = [
        *[lambda h=h: PB.hpi_growth_target(pts, holdout=h, states=states) for h in (12, 24)],
        *[lambda h=h: PB.affordability_target(c, "lad_code", "year", "ratio", h) for h in (1, 2, 3)],
        lambda: PB.price_band_target(c, "lad_code", "year", "ratio"),
        lambda: PB.divergence_target(spread, "region_name", "month", "spread"),
        lambda: PB.trend_target(_region_year_totals(spark, d, lk), "region_name", "year", "total", "supply_trend"),
        lambda: PB.adoption_target(open_share, "lad_code", "fy_start", "open_share", ["completions", "pending"]),
        lambda: PB.vacancy_class_target(vac, "lad_code", ["population", "median_price", "mean_earnings", "fuel_share_a"], "delta"),
        lambda: PB.shortfall_target(sc, "key", ["starts", "pending", "fy_start"], "short"),
    ]
    with ThreadPoolExecutor(max_workers=4) as pool:
        board = PB.scoreboard(list(pool.map(lambda target: target(), targets)))
    r = lambda col: F.round(col, 6).alias(col)
    return board.select("target", "geography", "model", "metric", r("value"), r("baseline_value"), r("delta_vs_baseline"),
                        r("estimate"), r("estimate_p10"), r("estimate_p90"), "note")


# ---------------------------------------------------------------------------
# Briefing products: buy-vs-rent caption, national endpoints, narrative panels, payload index
# ---------------------------------------------------------------------------


@query
def buy_vs_rent_spread(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative growth spread (price index minus rents index) from the first overlapping month, with a caption."""
    both = _two_series(spark, d)
    g = both.groupBy("geography").agg(
        F.min_by("hpi", "month").alias("h0"), F.max_by("hpi", "month").alias("h1"),
        F.min_by("rent", "month").alias("r0"), F.max_by("rent", "month").alias("r1"),
        F.min("month").alias("m0"), F.max("month").alias("m1"), F.count(F.lit(1)).alias("n"),
    ).where((F.col("n") >= 2) & (F.col("h0") != 0) & (F.col("r0") != 0))
    spread = (F.col("h1") / F.col("h0") * 100.0 - 100.0) - (F.col("r1") / F.col("r0") * 100.0 - 100.0)
    x = g.select("geography", "m0", "m1", spread.alias("spread_pp"))
    caption = F.format_string(
        "%s, up to %s: house prices have outgrown rents by %+.1f points since their first shared month (both start at 100).",
        F.col("geography"), F.date_format("m1", "MMM yyyy"), F.round("spread_pp", 1),
    )
    return x.select(
        F.col("geography").alias("region_name"), ymd("m0").alias("first_month"), ymd("m1").alias("last_month"),
        F.round("spread_pp", 6).alias("spread_pp"), caption.alias("caption"),
    )


@query
def national_ratio_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """National price-to-earnings ratio (all areas) at the two horizon endpoints."""
    lk, a, b, c, y0, y1 = _horizon_frames(spark, d)
    o = read(spark, d, "orders", "o_totalprice", "o_orderdate").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    price = A.exact_median(o, ["year"], "o_totalprice", "price")
    li = read(spark, d, "lineitem", "l_extendedprice", "l_shipdate")
    earn = li.groupBy(F.year("l_shipdate").alias("year")).agg(money_mean(F.sum(cents("l_extendedprice")), F.count(F.lit(1))).alias("earnings"))
    r = price.join(earn, "year").select("year", X.safe_ratio("price", "earnings").alias("ratio"))
    one = r.agg(
        F.max(F.when(F.col("year") == y0, F.col("ratio"))).alias("ratio_start"),
        F.max(F.when(F.col("year") == y1, F.col("ratio"))).alias("ratio_end"),
    )
    return one.select(
        y0.cast("int").alias("y_min"), y1.cast("int").alias("y_max"), F.round("ratio_start", 6).alias("ratio_start"),
        F.round("ratio_end", 6).alias("ratio_end"), F.round(F.col("ratio_end") - F.col("ratio_start"), 6).alias("change"),
    )


@query
def narrative_panels(spark: SparkSession, d: str) -> DataFrame:
    """Narrative page panels in long form: a region's supply by year (X8), top-15 fuel shares (K1),
    supply rate against the regional band share (J13)."""
    lk = la_lookup(spark, d)
    reg = _region_totals(la_supply(spark, d, lk), lk)
    p1 = reg.where(X.contains_ci("region_name", "europe")).groupBy("financial_year").agg(F.sum("dwellings").alias("v")).select(
        F.lit("supply_by_fy").alias("panel"), F.col("financial_year").alias("label"), F.round("v", 2).alias("value")
    )
    fuel = _fuel_shares(spark, d, lk)
    p2 = A.top_k(fuel, "fuel_share_a", 15, ["lad_code"]).select(F.lit("fuel_top15").alias("panel"), F.col("lad_code").alias("label"), F.col("fuel_share_a").alias("value"))
    rates = rates_per_1000(spark, d).where(F.col("geography_level") == "region").select(F.col("name").alias("region_name"), "starts_per_1000")
    shares = band_share_abc(spark, d).select("region_name", "abc_share").distinct()
    p3 = rates.join(shares, "region_name").select(
        F.lit("rate_per_share_point").alias("panel"), F.col("region_name").alias("label"),
        F.round(X.safe_ratio("starts_per_1000", "abc_share"), 3).alias("value"),
    )
    return T.union_all([p1, p2, p3])


@query
def briefing_sections(spark: SparkSession, d: str) -> DataFrame:
    """The briefing payload in long form, (section, item, field, value, text), built from the products."""
    frames = []
    for name, (keys, numbers, text) in BRIEFING.items():
        x = tidy(BRIEFING_QUERIES[name](spark, d))
        item = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("item")
        if numbers:
            wide = x.select(item, *[F.round(F.col(c).cast("double"), 4).alias(c) for c in numbers])
            frames.append(wide.unpivot(["item"], numbers, "field", "value").select(F.lit(name).alias("section"), "item", "field", "value", F.lit(None).cast("string").alias("text")))
        if text:
            frames.append(x.select(F.lit(name).alias("section"), item, F.lit(text).alias("field"), F.lit(None).cast("double").alias("value"), F.col(text).alias("text")))
    return T.union_all(frames)


# Section -> key columns, number columns, text column.
BRIEFING = {
    "horizon_deltas": (["lad_code"], ["delta_median_price", "delta_earnings", "delta_ratio"], None),
    "entry_pressure": (["region_name"], ["n_las", "n_entry_pressure", "median_delta_ratio"], None),
    "region_change_top": (["measure", "region_name"], ["total0", "total1", "delta"], None),
    "index_rebased": (["region_name", "month"], ["hpi_index_base", "hpi_index", "rent_index", "spread", "ratio"], None),
    "national_ratio_endpoints": (["y_min", "y_max"], ["ratio_start", "ratio_end", "change"], None),
    "findings": (["finding_id"], [], "text"),
    "missing_inputs": (["lang"], ["n_docs", "n_unlabelled"], "missing_sources"),
}
BRIEFING_QUERIES = {
    "horizon_deltas": horizon_deltas, "entry_pressure": entry_pressure, "region_change_top": region_change_top,
    "index_rebased": index_rebased, "national_ratio_endpoints": national_ratio_endpoints, "findings": findings, "missing_inputs": missing_inputs,
}


@query
def forward_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Forward table, 12 months or 4 quarters ahead, over every series and model."""
    out = T.union_all([Y.forward_table(pts, season, season) for season, pts in _points_by_season(spark, d)])
    r = lambda c: F.round(c, 4).alias(c)
    return out.select("series_id", "model", "horizon", r("last_value"), r("end_level"), r("pct_change"), r("p10"), r("p90"), "error")

