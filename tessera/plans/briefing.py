"""Briefing, map and summary products in full: every mapped metric, hero metrics, findings by topic, panels, statistics.

Built on the products of ``testdata`` and ``extended``; the DuckDB statements are in ``briefing_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import coerce as X
from ..functions import periods as P
from ..operators import aggregate as A
from ..operators import tidy as T
from ..operators import windows as W
from . import extended as EX
from . import testdata as TD
from .base import cents, la_lookup, la_supply, money_mean, price_series, read, rent_series, tidy, ymd

Q = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


# Mapped metric -> (column of the wide authority frame, label style).
METRICS = {
    "house_building": ("supply_o", "count"),
    "house_building_per_1000": ("starts_per_1000", "decimal"),
    "house_building_mainfuel": ("fuel_share_a", "share"),
    "median_price_existing": ("median_price_existing", "pound"),
    "median_price_new": ("median_price_new", "pound"),
    "affordability_ratio": ("workplace_ratio", "decimal"),
    "snapshot_vacant_per_100": ("vacant_per_100", "share"),
    "snapshot_hpi_12m_pct": ("hpi_12m_pct", "signed"),
    "epc_band_c": ("c_share", "share"),
}
BINS = 5
TOP = 5


def metric_label(style: str, value: Column) -> Column:
    """X11: a mapped value as shown: pounds, thousands, shares, signed changes; an em dash without a value."""
    if style == "pound":
        return X.fmt_gbp(value)
    if style == "signed":
        return X.fmt_signed(F.round(value, 1), 1)
    return X.fmt_thousands(F.round(value, {"count": 0, "share": 1, "decimal": 2}[style]), {"count": 0, "share": 1, "decimal": 2}[style])


@query
def mapped_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every mapped metric of every authority with quantile bin, label, the metric's median, count, top and bottom five."""
    snap = EX.full_snapshot_la(spark, d)
    bands = TD.band_share_abc(spark, d).select("lad_code", F.round("c_share", 6).alias("c_share"))
    wide = snap.join(bands, "lad_code", "left").withColumn("starts_per_1000", F.round(X.per_1000("supply_o", "population"), 6))
    cols = [F.col(c).cast("double").alias(m) for m, (c, _) in METRICS.items()]
    x = wide.select("lad_code", "lad_name", X.dash_if_blank("region_name").alias("region_name"), *cols)
    x = tidy(x.unpivot(["lad_code", "lad_name", "region_name"], list(METRICS), "metric", "value"))
    # one value per authority and metric: the exact percentile's buffers are bounded by the number of authorities
    at = F.percentile("value", F.array(*[F.lit(i / BINS) for i in range(BINS + 1)], F.lit(0.5)))
    stats = x.groupBy("metric").agg(at.alias("_q")).select(
        "metric", F.array_distinct(F.slice("_q", 1, BINS + 1)).alias("edges"), F.element_at("_q", BINS + 2).alias("median_value"))
    per = Window.partitionBy("metric")
    down = F.row_number().over(per.orderBy(F.desc_nulls_last("value"), "lad_code"))
    up = F.row_number().over(per.orderBy(F.asc_nulls_last("value"), "lad_code"))
    there = F.col("value").isNotNull()
    x = x.withColumns({"is_top": there & (down <= TOP), "is_bottom": there & (up <= TOP), "n_values": F.count("value").over(per)}).join(stats, "metric", "left")
    label = F.coalesce(*[F.when(F.col("metric") == m, metric_label(style, F.col("value"))) for m, (_, style) in METRICS.items()])
    return x.select("metric", "lad_code", "lad_name", "region_name", "value", label.alias("label"), W.quantile_bin("value", "edges", BINS).cast("int").alias("bin"),
                    F.round("median_value", 4).alias("median_value"), "n_values", "is_top", "is_bottom")


WATCHLIST = ("NATION_3", "NATION_7", "NATION_12", "NATION_21")


@query
def price_watchlist(spark: SparkSession, d: str) -> DataFrame:
    """Median prices of the watched authorities, by the years of ``Year ending Dec`` labels within the horizon."""
    lk, *_, y0, y1 = TD._horizon_frames(spark, d)
    watched = lk.where(F.col("lad_name").isin(*WATCHLIST)).select("nationkey", "lad_code", "lad_name")
    o = read(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderdate")
    c = read(spark, d, "customer", "c_custkey", "c_nationkey").join(watched, F.col("c_nationkey") == watched.nationkey)
    label = F.concat(F.lit("Year ending Dec "), F.year("o_orderdate").cast("string"))
    sales = o.join(c, o.o_custkey == c.c_custkey).select("lad_code", "lad_name", label.alias("period_label"), "o_totalprice")
    sales = sales.withColumn("year", P.year_ending_dec("period_label")).where(F.col("year").between(y0, y1))
    return A.exact_median(tidy(sales), ["lad_code", "lad_name", "year"], "o_totalprice", "m").select(
        "lad_code", "lad_name", "year", F.round("m", 4).alias("median_price"))


@query
def rent_inflation_panel(spark: SparkSession, d: str) -> DataFrame:
    """Mean 12-month rent change of each calendar year against the regional price to earnings ratio."""
    lk = la_lookup(spark, d)
    yoy = W.change_by_date(rent_series(spark, d, lk), ["geography"], "month", "value", 12, "yoy")
    rent = yoy.groupBy(F.col("geography").alias("region_name"), F.year("month").cast("int").alias("year")).agg(F.avg("yoy").alias("rent_yoy_avg"))
    o = read(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderdate")
    c = read(spark, d, "customer", "c_custkey", "c_nationkey")
    named = lk.select("nationkey", "region_name")
    sales = o.join(c, o.o_custkey == c.c_custkey).join(named, F.col("c_nationkey") == named.nationkey).select(
        "region_name", F.year("o_orderdate").cast("int").alias("year"), "o_totalprice")
    price = A.exact_median(sales, ["region_name", "year"], "o_totalprice", "price")
    li = read(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_shipdate")
    s = read(spark, d, "supplier", "s_suppkey", "s_nationkey")
    own = li.groupBy("l_suppkey", F.year("l_shipdate").cast("int").alias("year")).agg(F.sum(cents("l_extendedprice")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    earn = own.join(s, own.l_suppkey == s.s_suppkey).join(named, F.col("s_nationkey") == named.nationkey).groupBy("region_name", "year").agg(
        money_mean(F.sum("_s"), F.sum("_n")).alias("earnings"))
    ratio = price.join(earn, ["region_name", "year"]).withColumn("ratio", X.safe_ratio("price", "earnings"))
    return rent.join(ratio, ["region_name", "year"]).select(
        "region_name", "year", F.round("rent_yoy_avg", 6).alias("rent_yoy_avg"), F.round("ratio", 6).alias("affordability_ratio"))


EXPLORED_REGIONS = ("EUROPE", "ASIA")


@query
def starts_explorer(spark: SparkSession, d: str) -> DataFrame:
    """Starts of two regions: totals in view, by financial year in period order, by authority from the largest."""
    lk = la_lookup(spark, d)
    regions = lk.where(F.col("region_name").isin(*EXPLORED_REGIONS)).select("lad_code", "region_name")
    x = tidy(la_supply(spark, d, lk).where(F.col("measure") == "O").join(regions, "lad_code"))
    none = F.lit(None).cast("string")
    kpi = x.agg(F.sum("dwellings").alias("total_starts"), F.countDistinct("lad_name").cast("double").alias("n_las"),
                F.countDistinct("financial_year").cast("double").alias("n_years"))
    kpi = kpi.unpivot([], ["total_starts", "n_las", "n_years"], "label", "value").select(F.lit("totals").alias("panel"), "label", none.alias("region_name"), F.lit(None).cast("int").alias("position"), "value")
    by_year = x.groupBy(F.col("financial_year").alias("label"), "fy_start").agg(F.sum("dwellings").alias("value"))
    by_year = by_year.select(F.lit("by_year").alias("panel"), "label", none.alias("region_name"), F.row_number().over(Window.orderBy("fy_start")).alias("position"), "value")
    by_la = x.groupBy(F.col("lad_name").alias("label"), "region_name").agg(F.round(F.sum("dwellings"), 2).alias("value"))
    by_la = by_la.select(F.lit("by_la").alias("panel"), "label", "region_name", F.row_number().over(Window.orderBy(F.desc_nulls_last("value"), "label")).alias("position"), "value")
    return T.union_all([kpi, by_year, by_la]).withColumn("value", F.round("value", 2))


ROLLING_YEARS = 5
NATIONAL = "All regions"


@query
def energy_trend(spark: SparkSession, d: str) -> DataFrame:
    """Share of bands A to C over every five-year window, by region and for all regions."""
    li = read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_shipdate")
    p = read(spark, d, "part", "p_partkey", "p_size")
    s = read(spark, d, "supplier", "s_suppkey", "s_nationkey")
    lk = la_lookup(spark, d).select("nationkey", "region_name")
    own = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_suppkey", F.year("l_shipdate").cast("int").alias("year")).agg(
        F.count_if(TD.size_band("p_size").isin("A", "B", "C")).alias("_good"), F.count(F.lit(1)).alias("_n"))
    by = own.join(s, own.l_suppkey == s.s_suppkey).join(lk, F.col("s_nationkey") == lk.nationkey)
    # each year's counts once for its region and once for all regions
    by = by.select(F.explode(F.array("region_name", F.lit(NATIONAL))).alias("geography"), "year", "_good", "_n")
    by = tidy(by.groupBy("geography", "year").agg(F.sum("_good").alias("_good"), F.sum("_n").alias("_n")))
    first = by.agg(F.min("year")).scalar()
    recent = Window.partitionBy("geography").orderBy("year").rangeBetween(1 - ROLLING_YEARS, 0)
    x = by.withColumns({"_g": F.sum("_good").over(recent), "_t": F.sum("_n").over(recent)}).where(F.col("year") >= first + (ROLLING_YEARS - 1))
    start = F.col("year") - (ROLLING_YEARS - 1)
    return x.select("geography", F.concat(start.cast("string"), F.lit(" to "), F.col("year").cast("string")).alias("rolling_period"),
                    F.dense_rank().over(Window.partitionBy("geography").orderBy("year")).alias("position"),
                    F.round(F.col("_g") * 100.0 / F.col("_t"), 6).alias("abc_share"))


@query
def supply_vs_energy(spark: SparkSession, d: str) -> DataFrame:
    """Starts per 1 000 residents of each authority beside its region's latest rolling share."""
    la = EX.full_snapshot_la(spark, d).withColumn("starts_per_1000", X.per_1000("supply_o", "population"))
    reg = EX.full_snapshot_region(spark, d).select("region_name", "rolling_abc_share", "rolling_period").dropDuplicates(["region_name"])
    x = la.join(reg, "region_name").where(F.col("starts_per_1000").isNotNull() & F.col("rolling_abc_share").isNotNull())
    return x.select("lad_code", "lad_name", "region_name", F.round("starts_per_1000", 4).alias("starts_per_1000"), "rolling_abc_share", "rolling_period")


# ---------------------------------------------------------------------------
# Hero metrics and findings by topic
# ---------------------------------------------------------------------------


def _energy_rank(spark: SparkSession, d: str) -> DataFrame:
    """Regions with their share of bands A to C; one row per region."""
    return TD.band_share_abc(spark, d).where(F.col("region_name").isNotNull()).select("region_name", "abc_share").distinct()


def _best(df: DataFrame, value: str, tie: str, *cols: str, largest: bool = True) -> DataFrame:
    """One row ``r`` with the columns of the largest (or smallest) value; ties go to the smaller name."""
    by = F.struct(-F.col(value) if largest else F.col(value), F.col(tie))
    return df.where(F.col(value).isNotNull()).agg(F.min_by(F.struct(*cols), by).alias("r"))


@query
def hero_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The briefing's headline numbers, one row."""
    ends = tidy(TD.national_ratio_endpoints(spark, d))
    pressure = TD.entry_pressure(spark, d).agg(F.sum("n_entry_pressure")).scalar()
    supply = tidy(TD.region_change_top(spark, d).where((F.col("measure") == "O") & F.col("is_top")))
    rank = tidy(_energy_rank(spark, d))
    top = tidy(_best(rank, "abc_share", "region_name", "region_name", "abc_share"))
    low = tidy(_best(rank, "abc_share", "region_name", "region_name", "abc_share", largest=False))
    delta = F.concat(X.fmt_signed(F.round("change", 2), 2), F.lit(" vs "), F.col("y_min").cast("string"))
    one = lambda df, c, out: df.select(F.col(c)).scalar().alias(out)
    return ends.select(
        "ratio_start", "ratio_end", F.when(F.col("change").isNotNull(), delta).alias("ratio_delta"), pressure.alias("entry_pressure_n"),
        one(supply, "region_name", "supply_region"), one(supply, "delta", "supply_delta"), one(supply, "fy0", "supply_fy0"), one(supply, "fy1", "supply_fy1"),
        one(top, "r.region_name", "epc_best_region"), one(top, "r.abc_share", "epc_best_pct"),
        one(low, "r.region_name", "epc_worst_region"), one(low, "r.abc_share", "epc_worst_pct"))


NOTE = "These lines restate published figures by fixed rules; they explain no causes."


def _entry_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Change of the lower-quartile and of the median price of each authority over the horizon, and their gap."""
    lk, a, _b, _c, y0, y1 = TD._horizon_frames(spark, d)
    dm = A.endpoint_delta(a, "lad_code", "year", "price", y0, y1, "d_median")
    dl = A.endpoint_delta(a, "lad_code", "year", "lq_price", y0, y1, "d_lq")
    x = dm.join(dl, "lad_code").join(lk.select("lad_code", "lad_name"), "lad_code")
    return x.where(F.col("d_median").isNotNull() & F.col("d_lq").isNotNull()).select(
        "lad_code", "lad_name", F.round("d_median", 4).alias("d_median"), F.round("d_lq", 4).alias("d_lq"),
        F.round(F.col("d_lq") - F.col("d_median"), 4).alias("gap"))


@query
def entry_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Authorities by the gap between the changes of the lower-quartile and the median price, largest first."""
    x = _entry_gaps(spark, d)
    return x.select("*", F.row_number().over(Window.orderBy(F.desc("gap"), "lad_code")).alias("position"))


@query
def findings_by_topic(spark: SparkSession, d: str) -> DataFrame:
    """The findings of each topic, one sentence a row; a sentence without its figures is left out."""
    n2 = lambda c: F.format_number(F.round(c, 2), 2)
    pounds = lambda c: F.format_number(F.round(c, 0), 0)
    deltas = tidy(TD.horizon_deltas(spark, d))
    regional = A.exact_median(deltas, ["region_name"], "delta_ratio", "m").withColumn("m", F.round("m", 6))
    gaps = tidy(_entry_gaps(spark, d))
    hero = tidy(hero_metrics(spark, d))
    latest = W.latest_rows(TD.region_supply_by_fy(spark, d), P.period_sort_key("financial_year"), "financial_year")
    latest = tidy(latest.where(F.col("region_name").isNotNull()).groupBy("region_name", "financial_year", "measure").agg(F.round(F.sum("dwellings"), 2).alias("v")))
    panel = tidy(rent_inflation_panel(spark, d))
    ratios = panel.select("region_name", "year", F.col("affordability_ratio").alias("v"))
    years = ratios.agg(F.min("year").alias("y0"), F.max("year").alias("y1")).first()
    at = lambda y, out: ratios.where(F.col("year") == y).select("region_name", F.col("v").alias(out))
    moved = tidy(at(years["y0"], "v0").join(at(years["y1"], "v1"), "region_name").select(
        "region_name", "v1", F.round(F.col("v1") - F.col("v0"), 6).alias("dv"), F.round(X.safe_ratio("v1", "v0") * 100.0, 6).alias("idx")))
    volume = lambda m: _best(latest.where(F.col("measure") == m), "v", "region_name", "region_name", "financial_year", "v")
    y0, y1 = F.lit(str(years["y0"])), F.lit(str(years["y1"]))
    rows = [
        ("affordability", 1, _best(deltas, "delta_ratio", "lad_code", "lad_name", "delta_ratio", "y_min", "y_max"),
         [F.col("r.lad_name"), F.lit(" saw its price to earnings ratio rise most, by "), n2("r.delta_ratio"), F.lit(" from "), F.col("r.y_min").cast("string"), F.lit(" to "), F.col("r.y_max").cast("string")]),
        ("affordability", 2, _best(regional, "m", "region_name", "region_name", "m"),
         [F.lit("Half of the authorities of "), F.col("r.region_name"), F.lit(" rose by "), n2("r.m"), F.lit(" or more, the highest regional median")]),
        ("entry", 1, hero, [F.col("entry_pressure_n").cast("string"), F.lit(" authorities have lower-quartile prices that grew more than their medians")]),
        ("entry", 2, _best(gaps, "gap", "lad_code", "lad_name", "gap", "d_lq", "d_median"),
         [F.lit("The widest entry gap is in "), F.col("r.lad_name"), F.lit(": "), pounds("r.gap"), F.lit(" (lower quartile "), pounds("r.d_lq"), F.lit(", median "), pounds("r.d_median"), F.lit(")")]),
        ("regions", 1, _best(moved, "v1", "region_name", "region_name", "v1"), [F.col("r.region_name"), F.lit(" has the highest ratio of "), y1, F.lit(": "), n2("r.v1")]),
        ("regions", 2, _best(moved, "dv", "region_name", "region_name", "dv"),
         [F.lit("From "), y0, F.lit(" to "), y1, F.lit(" the ratio of "), F.col("r.region_name"), F.lit(" moved up most: "), n2("r.dv")]),
        ("regions", 3, _best(moved, "idx", "region_name", "region_name", "idx"),
         [F.lit("With "), y0, F.lit(" as 100, "), F.col("r.region_name"), F.lit(" stands highest in "), y1, F.lit(" at "), n2("r.idx")]),
        ("supply", 1, hero, [F.lit("Starts changed most in "), F.col("supply_region"), F.lit(" between "), F.col("supply_fy0"), F.lit(" and "), F.col("supply_fy1"), F.lit(": "), n2("supply_delta")]),
        ("supply", 2, volume("O"), [F.col("r.region_name"), F.lit(" has the most starts of "), F.col("r.financial_year"), F.lit(": "), n2("r.v")]),
        ("supply", 3, volume("F"), [F.col("r.region_name"), F.lit(" has the most completions of "), F.col("r.financial_year"), F.lit(": "), n2("r.v")]),
        ("energy", 1, hero, [F.lit("Bands A to C are most common in "), F.col("epc_best_region"), F.lit(" ("), n2("epc_best_pct"), F.lit("%), least in "), F.col("epc_worst_region"), F.lit(" ("), n2("epc_worst_pct"), F.lit("%)")]),
        ("energy", 2, hero, [n2(F.round(F.col("epc_best_pct") - F.col("epc_worst_pct"), 6)), F.lit(" points lie between the two")]),
    ]
    out = [df.select(F.lit(topic).alias("topic"), F.lit(i).alias("position"), F.concat(*parts).alias("text")) for topic, i, df, parts in rows]
    return T.union_all(out).where(F.col("text").isNotNull()).select("*", F.lit(NOTE).alias("note"))


# ---------------------------------------------------------------------------
# Narrative statistics and the summary payload
# ---------------------------------------------------------------------------

HIGH_RATIO = 30
HIGH_YEAR = 200_000


def _items(df: DataFrame, section: str, item: Column, numbers: list[str], texts: list[str] = ()) -> DataFrame:
    """Rows (section, item, field, value, text) from the named columns of a small table."""
    pair = [F.struct(F.lit(c).alias("field"), F.round(F.col(c).cast("double"), 6).alias("value"), F.lit(None).cast("string").alias("text")) for c in numbers]
    pair += [F.struct(F.lit(c).alias("field"), F.lit(None).cast("double").alias("value"), F.col(c).cast("string").alias("text")) for c in texts]
    return df.select(F.lit(section).alias("section"), item.alias("item"), F.explode(F.array(*pair)).alias("p")).select("section", "item", "p.*")


@query
def narrative_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The figures of the written narrative: snapshot ratios, regional medians, yearly starts, rolling shares, captions."""
    snap = tidy(TD.market_snapshot_la(spark, d))
    ratio = snap.agg(F.count(F.lit(1)).alias("rows"), F.count("price_earnings_ratio").alias("ratio_non_null"),
                     F.count_if(F.col("price_earnings_ratio") > HIGH_RATIO).alias("ratio_high"), F.max("price_earnings_ratio").alias("ratio_max"))
    medians = A.exact_median(snap, ["region_name"], "median_price", "median_price").withColumn("median_price", F.round("median_price", 0))
    years = tidy(la_supply(spark, d).where(F.col("measure") == "O").groupBy("financial_year", "fy_start").agg(F.round(F.sum("dwellings"), 2).alias("v")))
    starts = years.agg(F.min_by("financial_year", "fy_start").alias("period_min"), F.max_by("financial_year", "fy_start").alias("period_max"),
                       F.min_by("v", "fy_start").alias("starts_first"), F.max_by("v", "fy_start").alias("starts_last"),
                       F.count(F.lit(1)).alias("financial_years"), F.count_if(F.col("v") > HIGH_YEAR).alias("years_high"))
    energy = energy_trend(spark, d).where(F.col("geography") == NATIONAL).agg(
        F.min_by("rolling_period", "position").alias("first_period"), F.max_by("rolling_period", "position").alias("last_period"),
        F.min_by("abc_share", "position").alias("share_first"), F.max_by("abc_share", "position").alias("share_last"))
    alone = F.lit("all")
    return T.union_all([
        _items(ratio, "snapshot", alone, ["rows", "ratio_non_null", "ratio_high", "ratio_max"]),
        _items(medians, "median_by_region", F.col("region_name"), ["median_price"]),
        _items(starts, "starts", alone, ["starts_first", "starts_last", "financial_years", "years_high"], ["period_min", "period_max"]),
        _items(energy, "energy", alone, ["share_first", "share_last"], ["first_period", "last_period"]),
        _items(TD.buy_vs_rent_spread(spark, d), "buy_vs_rent", F.col("region_name"), [], ["caption"]),
    ])


@query
def summary_payload(spark: SparkSession, d: str) -> DataFrame:
    """The summary page in long form: country, regions, leading authorities, rates, energy, bands, rents and prices."""
    lk = tidy(la_lookup(spark, d))
    la = la_supply(spark, d, lk)
    wide = lambda df, *keys: df.groupBy(*keys).agg(
        F.round(F.sum(F.when(F.col("measure") == "O", F.col("dwellings"))), 2).alias("starts"),
        F.round(F.sum(F.when(F.col("measure") == "F", F.col("dwellings"))), 2).alias("completions"))
    named = la.join(lk.select("lad_code", "region_name"), "lad_code", "left")
    country = wide(named, "financial_year", "fy_start")
    before = country.select((F.col("fy_start") + 1).alias("fy_start"), F.col("starts").alias("_s"))
    country = country.join(before, "fy_start", "left").withColumn("starts_change_pct", X.pct_change("_s", "starts"))
    newest = tidy(W.latest_rows(named, P.period_sort_key("financial_year"), "financial_year"))
    region = wide(newest, "region_name", "financial_year")
    leaders = A.top_k(wide(newest, "lad_code", "lad_name"), "starts", 10, ["lad_code"])
    rates = TD.rates_per_1000(spark, d).where(F.col("geography_level") == "region")
    trend = tidy(energy_trend(spark, d))
    last = trend.agg(F.max("position")).scalar()
    bands = TD._band_shares(spark, d, lk).where(F.col("band").isNotNull())

    def index(series: DataFrame) -> DataFrame:
        changed = tidy(W.change_by_date(series, ["geography"], "month", "value", 12, "change_12m_pct"))
        return changed.where(F.col("month") == changed.agg(F.max("month")).scalar()).withColumn("month", ymd("month"))

    return T.union_all([
        _items(country, "country", F.col("financial_year"), ["starts", "completions", "starts_change_pct"]),
        _items(region, "region", F.col("region_name"), ["starts", "completions"], ["financial_year"]),
        _items(leaders, "authority", F.col("lad_name"), ["starts", "completions"]),
        _items(rates, "rates", F.col("name"), ["population", "starts_per_1000", "completions_per_1000"]),
        _items(trend.where(F.col("position") == last), "energy", F.col("geography"), ["abc_share"], ["rolling_period"]),
        _items(bands, "bands", F.concat_ws("|", "region_name", "band"), ["pct"]),
        _items(index(rent_series(spark, d, lk)), "rents", F.col("geography"), ["value", "change_12m_pct"], ["month"]),
        _items(index(price_series(spark, d, lk)), "prices", F.col("geography"), ["value", "change_12m_pct"], ["month"]),
    ])


COVERAGE: dict[str, list[str]] = {
    "mapped_metrics": ["B23", "X11", "W12", "A7", "A8", "K2"],
    "price_watchlist": ["B14", "P5", "A7"],
    "entry_gaps": ["B14", "A19"],
    "rent_inflation_panel": ["B25", "J6", "W7"],
    "starts_explorer": ["B28", "A1", "A3", "K1"],
    "energy_trend": ["B29", "P9"],
    "supply_vs_energy": ["B29", "J13"],
    "hero_metrics": ["B17", "B16"],
    "findings_by_topic": ["B17", "A14"],
    "narrative_statistics": ["B27", "A7", "A8"],
    "summary_payload": ["B19", "K1", "W11", "A12"],
}
