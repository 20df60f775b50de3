"""Scalar functions: coercion, codes, names, period labels (facts of the reference's tests)."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import coerce as X
from tessera.functions import periods as P


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_numeric_coercion_rules(spark):
    assert one(spark, X.to_double, " 12 ") == 12.0
    assert one(spark, X.to_double, "1e3") == 1000.0
    assert one(spark, X.to_double, "1,234") is None
    assert one(spark, X.to_double, "x") is None
    assert one(spark, X.to_double, "NaN") is None
    assert one(spark, X.to_double_marked, "[x]") is None
    assert one(spark, X.to_double_marked, "12.5[x]") == 12.5


def test_suppressed_counts(spark):
    assert one(spark, X.to_count, "c") is None
    assert one(spark, X.to_count, "") is None
    assert one(spark, X.to_count, " 7 ") == 7
    assert one(spark, X.to_count, "1.5") is None


def test_geo_level_prefixes(spark):
    cases = {"K04000001": "england_and_wales", "E92000001": "country", "W92000004": "country", "E12000007": "region",
             "E06000001": "local_authority_district", "E09000001": "local_authority_district", "E02000001": "msoa",
             "W01000001": "lsoa", "S12000033": "other", "E0": "unknown", " e12000001 ": "region"}
    for code, level in cases.items():
        assert one(spark, X.geo_level, code) == level, code


def test_name_alias_and_scope(spark):
    assert one(spark, X.canonical_name, "East") == "East of England"
    assert one(spark, X.canonical_name, "Northern Ireland [note 3]") == "Northern Ireland"
    assert one(spark, X.canonical_name, " London ") == "London"
    assert one(spark, X.area_scope, "United Kingdom") == "UK aggregate"
    assert one(spark, X.area_scope, "Northern Ireland") == "Country"
    assert one(spark, X.area_scope, "London") == "English region"


def test_ratios_and_labels(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, 4.0)], "a double, b double")
    r = [x[0] for x in df.select(X.safe_ratio("a", "b")).collect()]
    assert r == [None, 2.5]
    assert one(spark, X.horizon_bucket, 5, "int") == 6
    assert one(spark, X.horizon_bucket, 30, "int") == 24
    assert one(spark, X.delta_class, 0.2, "double") == "rising"
    assert one(spark, X.delta_class, -0.2, "double") == "falling"
    assert one(spark, X.delta_class, 0.05, "double") == "stable"
    assert one(spark, X.fmt_gbp, 1234567.0, "double") == "£1,234,567"
    assert one(spark, X.fmt_gbp, None, "double") == "—"
    assert one(spark, X.capitalise, "NORTH EAST") == "North east"


def test_period_order_is_chronological(spark):
    labels = ["2019-20", "Oct - Dec 2000", "Jan - Mar 2001", "2018", "Apr - Jun 2000", "2009-2010", "2018-19", "5-Year Average"]
    df = spark.createDataFrame([(x,) for x in labels], "p string")
    got = [r["period"] for r in P.ordered_periods(df.withColumnRenamed("p", "period"), "period").orderBy("period_pos").collect()]
    assert got == ["Apr - Jun 2000", "Oct - Dec 2000", "Jan - Mar 2001", "2018-19", "2019-20", "2018", "2009-2010", "5-Year Average"]


def test_pe_year_and_dates(spark):
    assert one(spark, P.pe_year, "Year ending Sep 2025") == 2025
    assert one(spark, P.pe_year, "2019") == 2019
    assert one(spark, P.pe_year, "5-Year Average") is None
    assert one(spark, P.year_ending_dec, "Year ending Dec 1995") == 1995
    assert one(spark, P.month_label_date, "Jan 2020") == dt.date(2020, 1, 1)
    assert one(spark, P.month_label_date, "Jul-98") == dt.date(1998, 7, 1)
    assert one(spark, P.month_label_date, "Jul-17") == dt.date(2017, 7, 1)
    assert one(spark, P.month_label_date, "bad") is None
    assert one(spark, P.year_ending_month_date, "Year ending Sep 2025") == dt.date(2025, 9, 1)
    assert one(spark, P.period_sort_date, "5-Year Average") == dt.date(2099, 12, 31)
    assert one(spark, P.rolling_start_year, "Q2 2008 to Q1 2013") == 2008


def test_horizon_bounds(spark):
    ys = spark.createDataFrame([(y,) for y in range(2018, 2025)], "year int")
    b = P.horizon_bounds(ys, "year", 5).first()
    assert (b["y_min"], b["y_max"]) == (2020, 2024)
    a = P.anchor_bounds(ys, "year", (2019, 2023), 5).first()
    assert (a["y_min"], a["y_max"]) == (2019, 2023)


def test_period_range_swaps_bounds(spark):
    df = spark.createDataFrame([(x,) for x in ["2017-18", "2018-19", "2019-20", "2020-21"]], "p string")
    got = sorted(r["p"] for r in P.filter_period_range(df, "p", "2019-20", "2018-19").collect())
    assert got == ["2018-19", "2019-20"]


def test_annualise_last_and_mean(spark):
    rows = [(dt.date(2020, m, 1), float(m)) for m in range(1, 13)] + [(dt.date(2021, 1, 1), 100.0)]
    df = spark.createDataFrame(rows, "month date, v double").withColumn("g", F.lit("x"))
    last = {r["year"]: r["v"] for r in P.annualise(df, ["g"], "month", "v", "last").collect()}
    mean = {r["year"]: r["v"] for r in P.annualise(df, ["g"], "month", "v", "mean").collect()}
    assert last[2020] == 12.0 and mean[2020] == 6.5 and last[2021] == 100.0


def test_number_labels(spark):
    assert one(spark, X.fmt_thousands, 1234567.0, "double") == "1,234,567"
    assert one(spark, X.fmt_thousands, None, "double") == "—"
    assert one(spark, X.fmt_signed, 2.5, "double") == "+2.5"
    assert one(spark, X.fmt_signed, -2.5, "double") == "-2.5"
    assert one(spark, X.dash_if_blank, "  ") == "—"


def test_numeric_feature_selection(spark):
    from tessera.operators.models import numeric_features

    df = spark.createDataFrame([("a", 1, 2.0, "x", 3)], "lad_code string, n int, v double, s string, target long")
    assert numeric_features(df, ["target"]) == ["n", "v"]
