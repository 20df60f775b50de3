"""Scalar column functions: numeric coercion, codes, names, ratios, labels.

Every function returns a ``Column`` built from Spark's own expressions, so it
stays inside whole-stage code generation and can be pushed through Catalyst.
Arguments accept a column name or a ``Column``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------------------
# Fixed values that must equal the published conventions.
# Suppression markers seen in the releases:
SUPPRESSION_MARKERS = ["[x]", "[x1]", "[z]", "[c]"]
# Count tables use a bare "c" (confidential) or a blank cell for a suppressed count.
COUNT_SUPPRESSED = ["c", ""]
# Geography code prefixes (GSS) and the level they stand for, in test order.
GEO_LEVEL_PREFIXES = [
    (["K04"], "england_and_wales"),
    (["E92", "W92"], "country"),
    (["E12"], "region"),
    (["E06", "W06"], "local_authority_district"),
    (["E07", "E08", "E09"], "local_authority_district"),
    (["E02", "W02"], "msoa"),
    (["E01", "W01"], "lsoa"),
]
# Region name aliases between the price index and the rents index.
NAME_ALIASES = {
    "East": "East of England",
    "Northern Ireland [note 3]": "Northern Ireland",
}
UK_AGGREGATES = ["United Kingdom", "Great Britain"]
COUNTRIES = ["England", "Wales", "Scotland"]
# Horizon buckets used to group backtests of different lengths.
HORIZON_BUCKETS = [1, 3, 6, 12, 24]
EM_DASH = "—"
# ---------------------------------------------------------------------------


def to_double(col) -> Column:
    """Text or number to double; blanks, words, thousands separators and NaN become NULL."""
    v = _try_double(F.trim(_c(col).cast("string")))
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def _try_double(c: Column) -> Column:
    # try_cast keeps ANSI mode on for the rest of the plan while giving NULL on bad text.
    return c.try_cast("double")


def strip_markers(col, markers: list[str] | None = None) -> Column:
    """Remove suppression markers such as ``[x]`` from a text cell."""
    out = _c(col).cast("string")
    for m in markers or SUPPRESSION_MARKERS:
        out = F.replace(out, F.lit(m), F.lit(""))
    return out


def to_double_marked(col, markers: list[str] | None = None) -> Column:
    """Coercion after dropping suppression markers."""
    return to_double(strip_markers(col, markers))


def to_count(col) -> Column:
    """Integer count; blank and ``c`` are suppressed (NULL); non-integral values are NULL."""
    txt = F.trim(_c(col).cast("string"))
    v = F.when(F.lower(txt).isin(COUNT_SUPPRESSED), F.lit(None)).otherwise(to_double(txt))
    return F.when(v == F.floor(v), v.cast("bigint"))


def is_integral(col) -> Column:
    v = to_double(col)
    return F.when(v.isNull(), F.lit(None).cast("boolean")).otherwise(v == F.floor(v))


def norm_code(col) -> Column:
    """Strip + upper of a geography code; NULL stays NULL (no ``"NAN"`` keys)."""
    return F.upper(F.trim(_c(col).cast("string")))


def geo_level(col) -> Column:
    """Geography level from the GSS code prefix."""
    code = norm_code(col)
    expr = F.when(F.length(code) < 3, F.lit("unknown"))
    for prefixes, level in GEO_LEVEL_PREFIXES:
        cond = None
        for p in prefixes:
            t = code.startswith(p)
            cond = t if cond is None else (cond | t)
        expr = expr.when(cond, F.lit(level))
    return F.when(code.isNull(), F.lit("unknown")).otherwise(expr.otherwise(F.lit("other")))


def canonical_name(col, aliases: dict[str, str] | None = None) -> Column:
    """Map known aliases to the canonical name, otherwise the trimmed name."""
    aliases = NAME_ALIASES if aliases is None else aliases
    s = F.trim(_c(col).cast("string"))
    if not aliases:
        return s
    m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(m, s), s)


def area_scope(col) -> Column:
    """UK aggregate / Country / English region."""
    s = F.trim(_c(col).cast("string"))
    return (
        F.when(s.isin(UK_AGGREGATES), F.lit("UK aggregate"))
        .when(s.startswith("Northern Ireland") | s.isin(COUNTRIES), F.lit("Country"))
        .otherwise(F.lit("English region"))
    )


def contains_ci(col, needle: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(_c(col)).contains(needle.lower())


def safe_ratio(num, den) -> Column:
    """Num / den, NULL when den is NULL or not positive."""
    d = _c(den)
    return F.try_divide(_c(num), F.when(d > 0, d))


def per_1000(num, den) -> Column:
    return safe_ratio(num, den) * F.lit(1000.0)


def pct_change(old, new) -> Column:
    """(new / old - 1) * 100, NULL when old is 0 or NULL."""
    o = _c(old)
    return (F.try_divide(_c(new), F.when(o != 0, o)) - F.lit(1.0)) * F.lit(100.0)


def fmt_thousands(col, decimals: int = 0) -> Column:
    """X11: ``12,345`` style; em dash for NULL."""
    return F.coalesce(F.format_number(_c(col).cast("double"), decimals), F.lit(EM_DASH))


def fmt_gbp(col) -> Column:
    return F.when(_c(col).isNull(), F.lit(EM_DASH)).otherwise(
        F.concat(F.lit("£"), F.format_number(_c(col).cast("double"), 0))
    )


def fmt_signed(col, decimals: int = 1) -> Column:
    c = _c(col).cast("double")
    return F.when(c.isNull(), F.lit(EM_DASH)).otherwise(
        F.concat(F.when(c >= 0, F.lit("+")).otherwise(F.lit("")), F.format_number(c, decimals))
    )


def dash_if_blank(col) -> Column:
    s = F.trim(_c(col).cast("string"))
    return F.when(s.isNull() | (s == ""), F.lit(EM_DASH)).otherwise(s)


def json_safe(col) -> Column:
    """X12 for one double column: NaN and +-Infinity become NULL."""
    c = _c(col)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def row_json(df_cols: list[str]) -> Column:
    """One JSON object per row, NULLs kept as ``null``."""
    return F.to_json(F.struct(*[F.col(c) for c in df_cols]), {"ignoreNullFields": "false"})


def horizon_bucket(col) -> Column:
    """Smallest of 1, 3, 6, 12, 24 that is >= h, else 24."""
    h = _c(col)
    expr = None
    for b in HORIZON_BUCKETS:
        expr = F.when(h <= b, F.lit(b)) if expr is None else expr.when(h <= b, F.lit(b))
    return F.when(h.isNull(), F.lit(None).cast("int")).otherwise(expr.otherwise(F.lit(HORIZON_BUCKETS[-1])))


def delta_class(col, band: float = 0.1) -> Column:
    """Rising / falling / stable around +-band."""
    d = _c(col)
    return F.when(d > band, F.lit("rising")).when(d < -band, F.lit("falling")).otherwise(F.lit("stable"))


def logistic(col) -> Column:
    """1 / (1 + e^-x)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(col)))


def clamp(col, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(_c(col), F.lit(lo)), F.lit(hi))


def capitalise(col) -> Column:
    """First letter upper, rest lower."""
    s = _c(col)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 20)))


def snake(col) -> Column:
    """T15 on values: lower-case, runs of other characters to ``_``, trimmed."""
    s = F.regexp_replace(F.lower(F.trim(_c(col).cast("string"))), r"[^a-z0-9]+", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")
