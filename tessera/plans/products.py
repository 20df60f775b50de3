"""Data products over the reference's tidy tables (column names of SURVEY 1.3).

These are the library calls a user of the published pipeline runs: they take
tidy DataFrames (from ``plans.families`` or existing Parquet) and return the
product tables.  The bindings in ``testdata.py`` run the same compositions on
the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as X
from ..functions import periods as P
from ..operators import aggregate as A
from ..operators import joins as J
from ..operators import windows as W

# Measure spellings that mean the same thing (H1) and the briefing anchor window.
MEASURE_ALIASES = {"completed": "completions", "started": "starts"}
DEFAULT_PE_ANCHOR_YEARS = (2021, 2025)


def canonical_measure(col) -> F.Column:
    """H1: ``completed``/``started`` and ``completions``/``starts`` are one measure."""
    m = F.lower(F.trim(F.col(col) if isinstance(col, str) else col))
    return X.canonical_name(m, MEASURE_ALIASES)


def derived_lookup(supply_la: DataFrame) -> DataFrame:
    """J9/S7 fallback: LA code -> region name from the fact table, first name per code wins."""
    x = supply_la.select(X.norm_code("Local Authority Code").alias("lad_code"), F.trim("Region or Country Name").alias("region_name"))
    return x.where(F.col("lad_code").isNotNull()).groupBy("lad_code").agg(F.min("region_name").alias("region_name"))


def region_supply(supply_la: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """B2: LA supply -> region by lookup (unmapped LAs kept as a NULL region), sum NULL when all NULL (A1)."""
    lk = lookup if lookup is not None else derived_lookup(supply_la)
    x = supply_la.select(
        X.norm_code("Local Authority Code").alias("lad_code"), "financial_year", canonical_measure("measure").alias("measure"), "dwellings"
    ).join(lk.select("lad_code", "region_name"), "lad_code", "left")
    return x.groupBy("region_name", "financial_year", "measure").agg(
        A.sum_or_null("dwellings").alias("dwellings"), F.countDistinct("lad_code").alias("n_la")
    )


def la_rankings(supply_la: DataFrame, population: DataFrame | None = None, financial_year: str | None = None) -> DataFrame:
    """Starts and completions of one financial year (latest by default), per-capita starts, ranks (min method)."""
    x = supply_la.select(
        X.norm_code("Local Authority Code").alias("lad_code"), "financial_year", canonical_measure("measure").alias("measure"), "dwellings"
    )
    x = W.latest_rows(x, P.period_sort_key("financial_year"), "financial_year") if financial_year is None else x.where(
        F.col("financial_year") == financial_year
    )
    la = x.groupBy("lad_code", "financial_year").agg(
        F.max(F.when(F.col("measure") == "starts", F.col("dwellings"))).alias("starts"),
        F.max(F.when(F.col("measure") == "completions", F.col("dwellings"))).alias("completions"),
    ).withColumn("completions_per_start", F.try_divide(F.col("completions"), F.when(F.col("starts") != 0, F.col("starts"))))
    if population is not None:
        pop = W.first_per_key(population.select(X.norm_code("lad_code").alias("lad_code"), "year", "population"), ["lad_code"], [F.col("year")], ["population"], last=True)
        la = la.join(pop, "lad_code", "left").withColumn(
            "starts_per_capita", F.try_divide(F.col("starts"), F.when(F.col("population") != 0, F.col("population")))
        )
        la = la.withColumn("rank_starts_per_capita", W.rank_desc("starts_per_capita"))
    return la.withColumn("rank_starts", W.rank_desc("starts"))


def hpi_rents_overlap_growth(hpi: DataFrame, rents: DataFrame) -> DataFrame:
    """Growth of the price index and the rents index over their common months, per region.

    ``hpi``: time_period (``Jan 2020``), geography, value.  ``rents``: month_label (``Jan-20``),
    geography_name, variable, value (only ``variable = 'index'`` rows are used).
    """
    h = hpi.select(
        X.canonical_name("geography").alias("region_name"), P.month_label_date("time_period").alias("period"),
        X.to_double("value").alias("hpi_index"),
    ).na.drop()
    r = rents.where(F.col("variable") == "index").select(
        X.canonical_name("geography_name").alias("region_name"), P.month_label_date("month_label").alias("period"),
        X.to_double("value").alias("prpi_index"),
    ).na.drop()
    j = h.join(r, ["region_name", "period"])
    g = j.groupBy("region_name").agg(
        F.min_by("hpi_index", "period").alias("h0"), F.max_by("hpi_index", "period").alias("h1"),
        F.min_by("prpi_index", "period").alias("r0"), F.max_by("prpi_index", "period").alias("r1"), F.count(F.lit(1)).alias("n"),
    ).where((F.col("n") >= 2) & (F.col("h0") != 0) & (F.col("r0") != 0))
    hg = (F.col("h1") / F.col("h0") - 1.0) * 100.0
    rg = (F.col("r1") / F.col("r0") - 1.0) * 100.0
    return g.select("region_name", hg.alias("hpi_growth_overlap_pct"), rg.alias("prpi_growth_overlap_pct"), (hg - rg).alias("hpi_minus_prpi_growth_pp"))


def _pe_panel(df: DataFrame) -> DataFrame:
    """Price/earnings tidy rows with pe_year (P3) and a normalised LA code."""
    return df.select(
        X.norm_code("local_authority_code").alias("lad_code"), "local_authority_name", "country_region_name",
        P.pe_year("period_label").alias("pe_year"), X.to_double("value").alias("value"),
    ).where(F.col("pe_year").isNotNull())


def pe_horizon(d5a: DataFrame, d5b: DataFrame, d5c: DataFrame, horizon_years: int = 5,
               anchors: tuple[int, int] = DEFAULT_PE_ANCHOR_YEARS, region_allow: list[str] | None = None):
    """One row per LA with the change in median price, earnings and ratio over the horizon; returns (table, y_min, y_max)."""
    a, b, c = _pe_panel(d5a), _pe_panel(d5b), _pe_panel(d5c)
    years = a.select("pe_year").intersect(b.select("pe_year")).intersect(c.select("pe_year"))
    bounds = P.anchor_bounds(years, "pe_year", anchors, horizon_years).first()
    y0, y1 = bounds["y_min"], bounds["y_max"]
    if y0 is None:
        return None, None, None
    dp = A.endpoint_delta(a, "lad_code", "pe_year", "value", F.lit(y0), F.lit(y1), "delta_median_price")
    de = A.endpoint_delta(b, "lad_code", "pe_year", "value", F.lit(y0), F.lit(y1), "delta_earnings")
    dr = A.endpoint_delta(c, "lad_code", "pe_year", "value", F.lit(y0), F.lit(y1), "delta_ratio")
    meta = W.first_per_key(a.where(F.col("pe_year") == y1), ["lad_code"], [F.col("local_authority_name")],
                           ["local_authority_name", "country_region_name"]).withColumnsRenamed(
        {"local_authority_name": "la_name", "country_region_name": "region"})
    out = meta.join(dp, "lad_code").join(de, "lad_code").join(dr, "lad_code")
    if region_allow is not None:
        out = out.where(F.col("region").isin(region_allow))
    return out, y0, y1


def entry_pressure_count(d5a: DataFrame, d6a: DataFrame, y0: int, y1: int, region_allow: list[str] | None = None) -> DataFrame:
    """Number of LAs whose lower-quartile price rose more than the median price (same years)."""
    a, q = _pe_panel(d5a), _pe_panel(d6a)
    if region_allow is not None:
        codes = a.where((F.col("pe_year") == y1) & F.col("country_region_name").isin(region_allow)).select("lad_code").distinct()
        a, q = J.keep_keys(a, codes, "lad_code"), J.keep_keys(q, codes, "lad_code")
    dm = A.endpoint_delta(a, "lad_code", "pe_year", "value", F.lit(y0), F.lit(y1), "d_median_price")
    dl = A.endpoint_delta(q, "lad_code", "pe_year", "value", F.lit(y0), F.lit(y1), "d_lq_price")
    return dm.join(dl, "lad_code").agg(F.count_if(F.col("d_lq_price") > F.col("d_median_price")).alias("n_entry_pressure"))
