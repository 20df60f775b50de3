"""Published sheets described by layouts, and one transform that turns any of them into its tidy table.

A layout says which leading headers identify a row, how the other headers are read (a label, a pattern with
groups, a known prefix), which of them count as values, and what the sheet's id means.  ``tidy_sheet`` melts and
splits accordingly; a header that doesn't fit raises ``LayoutError``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import geo_level, to_count, to_double
from ..operators import tidy as T
from ..operators.tidy import LayoutError

# ---------------------------------------------------------------------------
# Fixed values of the published layouts.
COUNTRY = {"Country or region code": "country_or_region_code", "Country or region name": "country_or_region_name"}
COUNTRY_NAME_FIRST = {"Country or region name": "country_or_region_name", "Country or region code": "country_or_region_code"}
REGION_LA = {
    "Region code": "region_code", "Region name": "region_name",
    "Local authority district code": "local_authority_district_code", "Local authority district name": "local_authority_district_name",
}
LA_MSOA = {
    "Local authority district code": "local_authority_district_code", "Local authority district name": "local_authority_district_name",
    "Middle super output layer (MSOA) code": "msoa_code", "Middle super output layer (MSOA) name": "msoa_name",
}
CONSTITUENCY = {"Parliamentary constituency code": "parliamentary_constituency_code", "Parliamentary constituency name": "parliamentary_constituency_name"}
EXPLORER = {"LA Name": "la_name", "LA Code": "la_code"}
AREA = ["area_code", "area_name"]
FUEL_PROPERTY_TYPES = ["Flats and maisonettes", "Semi-detached", "Terraced", "Detached"]
PROPERTY_BANDS = {"a": "all", "b": "detached", "c": "semi_detached", "d": "terraced", "e": "flats_maisonettes"}
MEDIAN_PRICE_LEVELS = {"1": "region", "2": "local_authority", "3": "county_unitary", "4": "combined_authority"}
NATIONAL_PARK_MEASURES = {"1": "sales_count", "2": "median_price_gbp", "3": "lower_quartile_price_gbp"}
# Energy score sheets by id columns.
SCORE_SHEETS = {
    "country": (COUNTRY, ["1a", "1b", "1c", "1d", "1e", "1f", "5a", "5b"]),
    "region_la": (REGION_LA, ["2a", "2b", "2c", "2d", "2e", "5c", "5d"]),
    "la_msoa": (LA_MSOA, ["3a", "3b", "3c"]),
    "pc": (CONSTITUENCY, ["4a", "4b", "4c", "4d"]),
}
# Price per square metre and per room: sheet, metric, dwelling segment, geography level.
PRICE_PER_SIZE = [
    ("Table1", "price_per_sqm", "house_and_flat", "region"), ("Table2", "price_per_sqm", "flats_only", "region"),
    ("Table3", "price_per_sqm", "excluding_flats", "region"), ("Table4", "price_per_room", "house_and_flat", "region"),
    ("Table5", "price_per_room", "flats_only", "region"), ("Table6", "price_per_room", "excluding_flats", "region"),
    ("Table7", "price_per_room", "house_and_flat", "local_authority"), ("Table8", "price_per_room", "flats_only", "local_authority"),
    ("Table9", "price_per_room", "excluding_flats", "local_authority"), ("Table10", "price_per_sqm", "house_and_flat", "local_authority"),
    ("Table11", "price_per_sqm", "flats_only", "local_authority"), ("Table12", "price_per_sqm", "excluding_flats", "local_authority"),
]
# Vacant and second homes breakdowns: sheet -> dwelling group, breakdown type.
VACANT_BREAKDOWNS = {
    "2": ("vacant", "accommodation_type"), "3": ("vacant", "bedrooms"),
    "4": ("second_home", "accommodation_type"), "5": ("second_home", "bedrooms"),
}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """``ids``: header -> tidy name, in order (None: every header that is no value, snake-cased).  ``names``: columns
    read from a value header by the groups of ``pattern``.  ``values``: which headers are values (None: the rest)."""

    ids: dict[str, str] | None
    names: tuple[str, ...]
    pattern: str = "^(.*)$"
    constants: dict[str, str] = field(default_factory=dict)
    values: str | None = None
    value: str = "value"
    read: Callable[[str], Column] = to_double
    order: tuple[str, ...] = ()


def tidy_sheet(wide: DataFrame, sheet: str, layout: Layout) -> DataFrame:
    """table_id, constants, ids, label columns and the value of one sheet; ``layout.order`` overrides the order."""
    w = T.drop_empty(wide.toDF(*[c.strip() for c in wide.columns]))
    if layout.ids is None:
        values = [c for c in w.columns if re.match(layout.values, c)]
        ids = {c: T.snake_name(c) for c in w.columns if c not in values}
    else:
        ids = layout.ids
        T.assert_headers(w, list(ids), f"sheet {sheet}")
        values = [c for c in w.columns if c not in ids and (layout.values is None or re.match(layout.values, c))]
    if not ids or not values:
        raise LayoutError(f"sheet {sheet} holds no {'values' if ids else 'ids'}")
    odd = [c for c in values if not re.match(layout.pattern, c)]
    if odd:
        raise LayoutError(f"sheet {sheet}: header {odd[0]!r} does not read as {', '.join(layout.names)}")
    long = T.melt(w, list(ids), values, "_label", "_v")
    parts = {n: F.trim(p) for n, p in zip(layout.names, T.split_label(F.col("_label"), layout.pattern, list(layout.names)))}
    columns = {"table_id": F.lit(sheet)} | {k: F.lit(v) for k, v in layout.constants.items()}
    columns |= {name: F.col(f"`{header}`") for header, name in ids.items()} | parts | {layout.value: layout.read("_v")}
    return long.select(*[columns[c].alias(c) for c in layout.order or columns])


def energy_five_year(wide: DataFrame, sheet: str) -> DataFrame:
    """``All Q2 2008 to Q1 2013`` -> breakdown and rolling period."""
    return tidy_sheet(wide, sheet, Layout(COUNTRY_NAME_FIRST, ("measure_breakdown", "rolling_period"), T.ROLLING_RE))


def main_fuel(wide: DataFrame, sheet: str) -> DataFrame:
    """Sheets 1 by country, 2 by authority, 3 by small area; a all, b existing and new, c property types."""
    ids = {"1": COUNTRY, "2": REGION_LA, "3": LA_MSOA}.get(sheet[:1])
    longest_first = sorted(FUEL_PROPERTY_TYPES, key=len, reverse=True)
    labels = {
        "a": (("fuel_or_method",), "^(.*)$"),
        "b": (("dwelling_class", "fuel_or_method"), T.EXISTING_NEW_RE),
        "c": (("property_type", "fuel_or_method"), f"^({'|'.join(map(re.escape, longest_first))}) (.+)$"),
    }
    if ids is None or sheet[1:] not in labels or (sheet[1:] == "c" and sheet != "1c"):
        raise LayoutError(f"{sheet!r} is no main-fuel sheet")
    return tidy_sheet(wide, sheet, Layout(ids, *labels[sheet[1:]]))


def median_energy_score(wide: DataFrame, sheet: str) -> DataFrame:
    """Median energy scores with the id columns of the sheet's layout."""
    for ids, sheets in SCORE_SHEETS.values():
        if sheet in sheets:
            return tidy_sheet(wide, sheet, Layout(ids, ("measure_label",), value="median_score"))
    raise LayoutError(f"{sheet!r} is no energy score sheet")


def median_price(wide: DataFrame, sheet: str, dwelling_class: str) -> DataFrame:
    """Median price by period ("Year ending ..."), the sheet id giving level and property band."""
    if len(sheet) != 2 or sheet[0] not in MEDIAN_PRICE_LEVELS or sheet[1] not in PROPERTY_BANDS:
        raise LayoutError(f"{sheet!r} is no median price sheet")
    meaning = {"dwelling_class": dwelling_class, "geography_level": MEDIAN_PRICE_LEVELS[sheet[0]], "property_band": PROPERTY_BANDS[sheet[1]]}
    return tidy_sheet(wide, sheet, Layout(None, ("period_label",), constants=meaning, values="Year ending", value="median_price_gbp"))


def national_park(wide: DataFrame, sheet: str) -> DataFrame:
    """National park sales and prices by period."""
    if len(sheet) != 2 or sheet[0] not in NATIONAL_PARK_MEASURES or sheet[1] not in PROPERTY_BANDS:
        raise LayoutError(f"{sheet!r} is no national park sheet")
    meaning = {"measure": NATIONAL_PARK_MEASURES[sheet[0]], "geography_level": "national_park", "property_band": PROPERTY_BANDS[sheet[1]]}
    return tidy_sheet(wide, sheet, Layout(None, ("period_label",), constants=meaning, values="Year ending"))


def vacant_breakdown(wide: DataFrame, sheet: str) -> DataFrame:
    """Accommodation types or bedrooms (slugged), suppressed counts NULL."""
    if sheet not in VACANT_BREAKDOWNS:
        raise LayoutError(f"{sheet!r} is no vacant homes breakdown")
    group, kind = VACANT_BREAKDOWNS[sheet]
    w = T.rename_positional(wide, AREA)
    meaning = {"dwelling_group": group, "breakdown_type": kind}
    out = tidy_sheet(w, sheet, Layout({c: c for c in AREA}, ("breakdown_label",), constants=meaning, read=to_count))
    slug = F.array_join(F.regexp_extract_all(F.lower("breakdown_label"), F.lit("([a-z0-9]+)")), "_")
    return out.select("table_id", geo_level("area_code").alias("geography_level"), "area_code", "area_name", "dwelling_group", "breakdown_type",
                      slug.alias("breakdown_label"), "value")


def price_per_size(wide: DataFrame, sheet: str) -> DataFrame:
    """Price per square metre or room by year; rows without a region code are dropped."""
    meaning = {s: dict(zip(("metric", "dwelling_segment", "geography_level"), m)) for s, *m in PRICE_PER_SIZE}.get(sheet)
    if meaning is None:
        raise LayoutError(f"{sheet!r} is no price per size sheet")
    names = ["region_code", "region_name"] + (["la_code", "la_name"] if meaning["geography_level"] == "local_authority" else [])
    first = [c.strip().lower() for c in wide.columns[:2]]
    if len(wide.columns) <= len(names) or first[0] not in ("area code", "region code") or not {"region", "name"} <= set(first[1].split()):
        raise LayoutError(f"sheet {sheet} begins with {first}, not with a region's code and name")
    w = T.rename_positional(wide, names)
    out = tidy_sheet(w, sheet, Layout({n: n for n in names}, ("year",), constants=meaning, values=r"20\d{2}$"))
    return out.where(F.col("region_code").isNotNull()).withColumn("year", F.col("year").cast("int"))


def price_explorer(wide: DataFrame, sheet: str) -> DataFrame:
    """Yearly medians (1), yearly counts (2), counts by year and type (3, headers ``2010_Flat``), medians by type (4)."""
    year = F.col("year").cast("int")
    if sheet in ("1. Price Data", "2. Count Data Totals"):
        kind = "median_price" if sheet[0] == "1" else "sale_count_total"
        order = ("table_id", "table_kind", "la_code", "la_name", "year", "value")
        return tidy_sheet(wide, sheet, Layout(EXPLORER, ("year",), r"^(\d{4})(?:\.0)?$", {"table_kind": kind}, order=order)).withColumn("year", year)
    if sheet == "3. Count Data":
        order = ("table_id", "table_kind", "la_code", "la_name", "year", "property_type", "value")
        return tidy_sheet(T.rename_positional(wide, list(EXPLORER)), sheet,
                          Layout(EXPLORER, ("year", "property_type"), r"^(\d{4})(?:\.0)?_(.+)$", {"table_kind": "count_by_type"}, order=order)).withColumn("year", year)
    if sheet == "4.Type Price Data":
        order = ("table_id", "table_kind", "la_code", "la_name", "property_type", "median_price_gbp")
        ids = {h: EXPLORER[h] for h in ("LA Code", "LA Name")}
        return tidy_sheet(wide, sheet, Layout(ids, ("property_type",), constants={"table_kind": "median_by_type_snapshot"}, value="median_price_gbp", order=order))
    raise LayoutError(f"{sheet!r} is no price explorer sheet")


def latest_median_price(tidy: DataFrame) -> DataFrame:
    """Latest median price per local authority for existing and new dwellings (all property types)."""
    from ..functions import periods as P

    x = tidy.where((F.col("geography_level") == "local_authority") & (F.col("property_band") == "all") & F.col("median_price_gbp").isNotNull())
    x = x.withColumn("month", P.year_ending_month_date("period_label"))
    last = x.groupBy("local_authority_code", "dwelling_class").agg(F.max("month").alias("month"))
    at = x.join(last, ["local_authority_code", "dwelling_class", "month"])
    price = lambda c: F.max(F.when(F.col("dwelling_class") == c, F.col("median_price_gbp"))).alias(f"median_price_{c}")
    return at.groupBy("local_authority_code").agg(price("existing"), price("new"))
