"""Sheet families described by layouts, on the published header shapes (FIXTURES.md)."""

import pytest

from tessera.operators.tidy import LayoutError
from tessera.plans import sheets as SH

CODE = ["Country or region code", "Country or region name"]
LA = ["Region code", "Region name", "Local authority district code", "Local authority district name"]


def S(spark, cols, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{c}` string" for c in cols))


def rows(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def test_energy_five_year(spark):
    df = SH.energy_five_year(S(spark, [CODE[1], CODE[0], "All Q2 2008 to Q1 2013", "Semi-detached Q2 2009 to Q1 2014"], ["England", "E92000001", "40.5", "x"]), "1c")
    assert df.columns == ["table_id", "country_or_region_name", "country_or_region_code", "measure_breakdown", "rolling_period", "value"]
    assert rows(df, "measure_breakdown", "rolling_period", "value") == {("All", "Q2 2008 to Q1 2013", 40.5), ("Semi-detached", "Q2 2009 to Q1 2014", None)}
    with pytest.raises(LayoutError):
        SH.energy_five_year(S(spark, [CODE[1], CODE[0], "All 2013"], ["England", "E92000001", "1"]), "1c")


def test_main_fuel(spark):
    a = SH.main_fuel(S(spark, [*LA, "Mains gas", "Oil"], ["E12", "NE", "E06000001", "Hartlepool", "80", "[c]"]), "2a")
    assert a.columns == ["table_id", "region_code", "region_name", "local_authority_district_code", "local_authority_district_name", "fuel_or_method", "value"]
    assert rows(a, "table_id", "fuel_or_method", "value") == {("2a", "Mains gas", 80.0), ("2a", "Oil", None)}
    b = SH.main_fuel(S(spark, [*CODE, "Existing Mains gas", "New Electric heating"], ["E92", "England", "1", "2"]), "1b")
    assert rows(b, "dwelling_class", "fuel_or_method", "value") == {("Existing", "Mains gas", 1.0), ("New", "Electric heating", 2.0)}
    c = SH.main_fuel(S(spark, [*CODE, "Semi-detached Mains gas", "Detached Oil", "Flats and maisonettes Heat network"], ["E92", "England", "1", "2", "3"]), "1c")
    assert rows(c, "property_type", "fuel_or_method", "value") == {("Semi-detached", "Mains gas", 1.0), ("Detached", "Oil", 2.0), ("Flats and maisonettes", "Heat network", 3.0)}
    for bad, sheet in (([*CODE, "Bungalow Oil"], "1c"), ([*CODE, "Old Oil"], "1b"), ([*LA, "Oil"], "1a"), ([*CODE, "Oil"], "4a")):
        with pytest.raises(LayoutError):
            SH.main_fuel(S(spark, bad, ["x"] * len(bad)), sheet)


def test_energy_scores(spark):
    a = SH.median_energy_score(S(spark, [*CODE, "All", "New"], ["E92", "England", "67", None]), "5a")
    assert a.columns == ["table_id", *SH.COUNTRY.values(), "measure_label", "median_score"]
    assert rows(a, "measure_label", "median_score") >= {("All", 67.0)}
    b = SH.median_energy_score(S(spark, [*LA, "All"], ["E12", "NE", "E06", "H", "60"]), "2a")
    assert rows(b, "local_authority_district_code", "median_score") == {("E06", 60.0)}
    with pytest.raises(LayoutError):
        SH.median_energy_score(S(spark, [*LA, "All"], ["E12", "NE", "E06", "H", "60"]), "9z")


def test_median_price_and_its_latest_values(spark):
    head = ["Region/Country code", "Region/Country name", "Local authority code", "Local authority name", "Year ending Dec 1995", "Year ending Mar 1996"]
    old = SH.median_price(S(spark, head, ["E12", "NE", "E06000001", "Hartlepool", "40000", "41000"], ["E12", "NE", "E06000002", "Boro", "50000", ":"]), "2a", "existing")
    new = SH.median_price(S(spark, head, ["E12", "NE", "E06000001", "Hartlepool", "70000", None]), "2a", "new")
    assert old.columns == ["table_id", "dwelling_class", "geography_level", "property_band", "region_country_code", "region_country_name",
                           "local_authority_code", "local_authority_name", "period_label", "median_price_gbp"]
    assert old.first()["geography_level"] == "local_authority" and old.first()["property_band"] == "all"
    got = SH.latest_median_price(old.unionByName(new))
    assert rows(got, *got.columns) == {("E06000001", 41000.0, 70000.0), ("E06000002", 50000.0, None)}
    with pytest.raises(LayoutError):
        SH.median_price(S(spark, head, ["x"] * 6), "2f", "new")


def test_national_park(spark):
    df = SH.national_park(S(spark, ["Park code", "Park name", "Year ending Dec 1995"], ["E26000001", "Dartmoor", "310"]), "1b")
    assert rows(df, *df.columns) == {("1b", "sales_count", "national_park", "detached", "E26000001", "Dartmoor", "Year ending Dec 1995", 310.0)}


def test_vacant_breakdown(spark):
    df = SH.vacant_breakdown(S(spark, ["Area Code", "Area Name", "Detached", "Flat, maisonette or apartment"], ["E06000001", "Hartlepool", "120", "c"]), "2")
    assert rows(df, "geography_level", "dwelling_group", "breakdown_type", "breakdown_label", "value") == {
        ("local_authority_district", "vacant", "accommodation_type", "detached", 120), ("local_authority_district", "vacant", "accommodation_type", "flat_maisonette_or_apartment", None)}


def test_price_per_size(spark):
    df = SH.price_per_size(S(spark, ["Region code", "Region name", "LA code", "LA name", "2004", "2005", "Note"], ["E12", "NE", "E06", "H", "900", "950", "x"],
                             [None, None, None, "total", "1", "2", None]), "Table10")
    assert rows(df, "metric", "la_code", "year", "value") == {("price_per_sqm", "E06", 2004, 900.0), ("price_per_sqm", "E06", 2005, 950.0)}
    with pytest.raises(LayoutError):
        SH.price_per_size(S(spark, ["Code", "Region name", "2004"], ["a", "b", "1"]), "Table1")


def test_price_explorer(spark):
    one = SH.price_explorer(S(spark, ["LA Name", "LA Code", "2010", "2011"], ["H", "E06", "1", "2"]), "1. Price Data")
    assert rows(one, "table_kind", "la_code", "year", "value") == {("median_price", "E06", 2010, 1.0), ("median_price", "E06", 2011, 2.0)}
    three = SH.price_explorer(S(spark, ["a", "b", "2010_Flat", "2011_Semi_detached"], ["H", "E06", "5", "6"]), "3. Count Data")
    assert rows(three, "year", "property_type", "value") == {(2010, "Flat", 5.0), (2011, "Semi_detached", 6.0)}
    four = SH.price_explorer(S(spark, ["LA Code", "LA Name", "Flat"], ["E06", "H", "90000"]), "4.Type Price Data")
    assert four.columns == ["table_id", "table_kind", "la_code", "la_name", "property_type", "median_price_gbp"]
