"""Period labels: parsing, ordering and alignment (operators P1-P15).

Published tables mix quarter labels (``Jan - Mar 2000``), financial years
(``2019-20``), calendar years (``2019``), rolling windows
(``Q2 2008 to Q1 2013``), month labels (``Jan 2020``, ``Jan-20``) and
``Year ending Sep 2025``.  Everything here is a Spark expression; ordering is
by a sortable ``struct`` so that ``max``/``orderBy``/``dense_rank`` work
without a Python sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coerce import _c, to_double

# ---------------------------------------------------------------------------
# Month abbreviations and the quarter-start months of quarterly labels.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
QUARTER_START_MONTHS = ["Jan", "Apr", "Jul", "Oct"]
# Two-digit years from this value up belong to the 1900s (C library %y rule).
TWO_DIGIT_CENTURY_PIVOT = 69
FIVE_YEAR_AVERAGE = "5-Year Average"
FAR_FUTURE = "2099-12-31"
# ---------------------------------------------------------------------------

_MONTH_ALT = "|".join(MONTHS)
QUARTER_RE = rf"^({'|'.join(QUARTER_START_MONTHS)})\s*-\s*(?:{_MONTH_ALT})\s+(\d{{4}})$"
FY_RE = r"^(\d{4})-(\d{2})$"
CY_RE = r"^(\d{4})$"


def _month_number(abbrev: Column) -> Column:
    """1..12 for an English month abbreviation (case as published), NULL otherwise."""
    pos = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), abbrev)
    return F.when(pos > 0, pos.cast("int"))


def _extract(s: Column, pattern: str, idx: int) -> Column:
    """regexp_extract that gives NULL (not '') on no match."""
    return F.nullif(F.regexp_extract(s, pattern, idx), F.lit(""))


def period_sort_key(col) -> Column:
    """struct(bucket, y, q, txt) — quarters < financial years < calendar years < other text.

    The label kind is tested with ``rlike``; year and quarter come from fixed
    positions of the matched layouts.  This keeps the expression small (no
    repeated extract-and-null-check trees), which matters because the key is
    used inside aggregates, comparisons and sorts.
    """
    s = F.trim(_c(col).cast("string"))
    is_q = s.rlike(QUARTER_RE)
    is_fy = s.rlike(FY_RE)
    is_cy = s.rlike(CY_RE)
    qstarts = F.array(*[F.lit(m) for m in QUARTER_START_MONTHS])
    bucket = F.when(is_q, 0).when(is_fy, 1).when(is_cy, 2).otherwise(3)
    y = F.when(is_q, F.substring(s, -4, 4).cast("int")).when(is_fy | is_cy, F.substring(s, 1, 4).cast("int")).otherwise(0)
    q = (
        F.when(is_q, (F.array_position(qstarts, F.substring(s, 1, 3)) - 1).cast("int"))
        .when(is_fy, F.substring(s, 6, 2).cast("int"))
        .otherwise(0)
    )
    txt = F.when(is_q | is_fy | is_cy, F.lit("")).otherwise(s)
    return F.struct(bucket.alias("bucket"), y.alias("y"), q.alias("q"), txt.alias("txt"))


def fy_start_year(date_col) -> Column:
    """Start year of the April-March financial year containing a date."""
    d = _c(date_col)
    return (F.year(d) - F.when(F.month(d) < 4, 1).otherwise(0)).cast("int")


def financial_year_label(date_col) -> Column:
    """``YYYY-YY`` label of the April-March financial year of a date."""
    y = fy_start_year(date_col)
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def fy_label_from_start(start_year) -> Column:
    y = _c(start_year)
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def quarter_label(date_col) -> Column:
    """``Jan - Mar 2000`` style label of the calendar quarter of a date."""
    d = _c(date_col)
    q = F.quarter(d)
    months = F.array(*[F.lit(m) for m in MONTHS])
    start = F.element_at(months, ((q - 1) * 3 + 1).cast("int"))
    end = F.element_at(months, (q * 3).cast("int"))
    return F.concat(start, F.lit(" - "), end, F.lit(" "), F.year(d).cast("string"))


def pe_year(col) -> Column:
    """``Year ending Sep YYYY`` or ``YYYY`` -> int; ``5-Year Average`` and anything else -> NULL."""
    s = F.trim(_c(col).cast("string"))
    return F.coalesce(
        _extract(s, r"^Year ending Sep (\d{4})", 1),
        _extract(s, r"^(\d{4})$", 1),
    ).cast("int")


def pe_year_numeric(col) -> Column:
    """P3 with a numeric fallback (``2019.0`` -> 2019)."""
    v = to_double(col)
    return F.coalesce(pe_year(col), F.when(v == F.floor(v), v.cast("int")))


def year_ending_dec(col) -> Column:
    """P5: ``Year ending Dec YYYY`` -> YYYY."""
    return _extract(F.trim(_c(col).cast("string")), r"^Year ending Dec (\d{4})$", 1).cast("int")


def month_label_date(col) -> Column:
    """``Jan 2020`` or ``Jan-20`` -> first day of that month; anything else -> NULL (N8 for two digits)."""
    s = F.trim(_c(col).cast("string"))
    pat = rf"^({_MONTH_ALT})[ -](\d{{4}}|\d{{2}})$"
    mon = _month_number(_extract(s, pat, 1))
    ytxt = _extract(s, pat, 2)
    yy = ytxt.cast("int")
    year = F.when(F.length(ytxt) == 4, yy).when(
        yy >= TWO_DIGIT_CENTURY_PIVOT, yy + 1900
    ).otherwise(yy + 2000)
    return F.when(mon.isNotNull() & year.isNotNull(), F.make_date(year, mon, F.lit(1)))


def year_ending_month_date(col) -> Column:
    """``Year ending Sep 2025`` -> 2025-09-01."""
    s = F.trim(_c(col).cast("string"))
    return month_label_date(F.regexp_replace(s, r"^Year ending\s+", ""))


def period_sort_date(col) -> Column:
    """Sep 30 for ``Year ending Sep YYYY``, Jun 15 for ``YYYY``, far future for the 5-year average."""
    s = F.trim(_c(col).cast("string"))
    ye = _extract(s, r"^Year ending Sep (\d{4})", 1).cast("int")
    cy = _extract(s, r"^(\d{4})$", 1).cast("int")
    return (
        F.when(s == FIVE_YEAR_AVERAGE, F.to_date(F.lit(FAR_FUTURE)))
        .when(ye.isNotNull(), F.make_date(ye, F.lit(9), F.lit(30)))
        .when(cy.isNotNull(), F.make_date(cy, F.lit(6), F.lit(15)))
    )


def rolling_start_year(col) -> Column:
    """Start year of ``Q2 2008 to Q1 2013``."""
    return _extract(F.trim(_c(col).cast("string")), r"^Q2 (\d{4})", 1).cast("int")


def rolling_window_label(start_year) -> Column:
    y = _c(start_year)
    return F.concat(F.lit("Q2 "), y.cast("string"), F.lit(" to Q1 "), (y + 5).cast("string"))


def season_length(freq_col) -> Column:
    """12 for monthly, 4 for quarterly, 1 for yearly series."""
    f = F.lower(_c(freq_col))
    return (
        F.when(f.contains("month"), 12)
        .when(f.contains("quarter"), 4)
        .when(f.contains("financial") | f.contains("calendar") | f.contains("annual"), 1)
        .otherwise(4)
    )


# ---------------------------------------------------------------------------
# DataFrame-level period operators
# ---------------------------------------------------------------------------


def ordered_periods(df: DataFrame, period_col: str) -> DataFrame:
    """One row per distinct label with its sort key and 1-based chronological position.

    Other columns of ``df`` are kept when ``df`` already holds one row per
    label (e.g. label counts); the global window runs over labels, not rows.
    """
    from pyspark.sql import Window

    d = df.where(F.col(period_col).isNotNull())
    if d.columns == [period_col]:
        d = d.distinct()
    d = d.withColumn("period_key", period_sort_key(period_col))
    w = Window.orderBy("period_key")
    return d.withColumn("period_pos", F.row_number().over(w))


def in_period_range(key: Column, lo: str, hi: str) -> Column:
    """P10 as a predicate on a P1 key column; bounds are swapped if given reversed."""
    k_lo = period_sort_key(F.lit(lo))
    k_hi = period_sort_key(F.lit(hi))
    return (key >= F.least(k_lo, k_hi)) & (key <= F.greatest(k_lo, k_hi))


def latest_period(df: DataFrame, period_col: str) -> DataFrame:
    """One-row DataFrame holding the last label in P1 order."""
    key = period_sort_key(period_col)
    return df.where(F.col(period_col).isNotNull()).agg(
        F.max(F.struct(key.alias("k"), F.col(period_col).alias("p"))).getField("p").alias(period_col)
    )


def filter_period_range(df: DataFrame, period_col: str, lo: str, hi: str) -> DataFrame:
    """P10: rows with lo <= period <= hi in P1 order; bounds are swapped if given reversed."""
    return df.withColumn("_pk", period_sort_key(period_col)).where(in_period_range(F.col("_pk"), lo, hi)).drop("_pk")


def annualise(df: DataFrame, keys: list[str], date_col: str, value_col: str, how: str = "last") -> DataFrame:
    """Calendar-year value of a monthly series (``last`` = latest month, ``mean`` = average).

    Output: keys, year, year_end (Dec 31 date), value.
    """
    d = df.where(F.col(value_col).isNotNull()).withColumn("year", F.year(date_col))
    if how == "last":
        agg = F.max_by(F.col(value_col), F.col(date_col))
    elif how == "mean":
        agg = F.avg(value_col)
    else:
        raise ValueError(f"unknown annualise rule {how!r}")
    out = d.groupBy(*keys, "year").agg(agg.alias(value_col))
    return out.withColumn("year_end", F.make_date(F.col("year"), F.lit(12), F.lit(31)))


def horizon_bounds(years: DataFrame, year_col: str, n: int) -> DataFrame:
    """(y_min, y_max) of the last n distinct years; one row."""
    n = max(1, int(n))
    ys = years.agg(F.array_sort(F.collect_set(F.col(year_col).cast("int"))).alias("ys"))
    return ys.select(
        F.element_at("ys", -F.least(F.size("ys"), F.lit(n))).alias("y_min"),
        F.element_at("ys", -1).alias("y_max"),
    )


def anchor_bounds(years: DataFrame, year_col: str, anchors: tuple[int, int], n: int) -> DataFrame:
    """The anchor years if both are present, otherwise P13."""
    ys = years.agg(F.array_sort(F.collect_set(F.col(year_col).cast("int"))).alias("ys"))
    both = F.array_contains("ys", anchors[0]) & F.array_contains("ys", anchors[1])
    n = max(1, int(n))
    return ys.select(
        F.when(both, F.lit(anchors[0])).otherwise(F.element_at("ys", -F.least(F.size("ys"), F.lit(n)))).alias("y_min"),
        F.when(both, F.lit(anchors[1])).otherwise(F.element_at("ys", -1)).alias("y_max"),
    )
