"""Products over the reference's tidy schemas (facts of the reference's tests)."""

import pytest

from tessera.plans import products as PR


def test_overlap_growth_alias_and_values(spark):
    hpi = spark.createDataFrame([("Jan 2020", "East", 100.0), ("Feb 2020", "East", 110.0)], "time_period string, geography string, value double")
    rents = spark.createDataFrame([("Jan-20", "East of England", "index", 100.0), ("Feb-20", "East of England", "index", 105.0),
                                   ("Feb-20", "East of England", "year_change", 9.0)], "month_label string, geography_name string, variable string, value double")
    r = PR.hpi_rents_overlap_growth(hpi, rents).first()
    assert r["region_name"] == "East of England"
    assert (round(r["hpi_growth_overlap_pct"], 2), round(r["prpi_growth_overlap_pct"], 2), round(r["hpi_minus_prpi_growth_pp"], 2)) == (10.0, 5.0, 5.0)


def _pe(spark, rows):
    return spark.createDataFrame(rows, "local_authority_code string, local_authority_name string, country_region_name string, period_label string, value double")


def test_pe_horizon_and_entry_pressure(spark):
    la = ("E06000001", "Alpha", "North East")
    d5a = _pe(spark, [(*la, "Year ending Sep 2020", 100000.0), (*la, "Year ending Sep 2024", 120000.0), (*la, "5-Year Average", 1.0)])
    d5b = _pe(spark, [(*la, "2020", 30000.0), (*la, "2024", 32000.0)])
    d5c = _pe(spark, [(*la, "2020", 3.0), (*la, "2024", 3.5)])
    d6a = _pe(spark, [(*la, "Year ending Sep 2020", 80000.0), (*la, "Year ending Sep 2024", 115000.0)])
    out, y0, y1 = PR.pe_horizon(d5a, d5b, d5c)
    assert (y0, y1) == (2020, 2024)
    row = out.first()
    assert (row["delta_median_price"], row["delta_earnings"], row["delta_ratio"]) == (pytest.approx(20000), pytest.approx(2000), pytest.approx(0.5))
    assert row["la_name"] == "Alpha" and row["region"] == "North East"
    assert PR.entry_pressure_count(d5a, d6a, y0, y1).first()[0] == 1
    assert PR.entry_pressure_count(d5a, d6a, y0, y1, region_allow=["London"]).first()[0] == 0


def test_region_supply_and_rankings(spark):
    cols = "`Region Type` string, `Region or Country Name` string, `Local Authority Code` string, `Local Authority Name` string, financial_year string, measure string, dwellings double"
    rows = [("LA", "North East", "e06000001 ", "Hartlepool", "2023-24", "starts", 100.0), ("LA", "North East", "E06000001", "Hartlepool", "2023-24", "completed", 80.0),
            ("LA", "North East", "E06000002", "Middlesbrough", "2023-24", "starts", 100.0), ("LA", "North East", "E06000002", "Middlesbrough", "2023-24", "completions", None),
            ("LA", "North East", "E06000002", "Middlesbrough", "2022-23", "starts", 5.0)]
    supply = spark.createDataFrame(rows, cols)
    reg = {(r["financial_year"], r["measure"]): r["dwellings"] for r in PR.region_supply(supply).collect()}
    assert reg == {("2023-24", "starts"): 200.0, ("2023-24", "completions"): 80.0, ("2022-23", "starts"): 5.0}
    pop = spark.createDataFrame([("E06000001", 2020, 90000), ("E06000001", 2021, 92000), ("E06000002", 2021, 140000)], "lad_code string, year int, population long")
    rk = {r["lad_code"]: r for r in PR.la_rankings(supply, pop).collect()}
    assert rk["E06000001"]["financial_year"] == "2023-24" and rk["E06000001"]["population"] == 92000
    assert rk["E06000001"]["rank_starts"] == 1 and rk["E06000002"]["rank_starts"] == 1  # ties share the lowest rank
    assert rk["E06000001"]["rank_starts_per_capita"] == 1 and rk["E06000002"]["rank_starts_per_capita"] == 2
