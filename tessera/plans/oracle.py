"""DuckDB statements of the registered queries (same names, same output columns).

These are the correctness oracle: the driver runs each statement on the same
Parquet tables (pre-registered as views) and compares row count, schema and
an order-insensitive hash of values with the Spark result.
"""

from __future__ import annotations


def _fy_start(c: str) -> str:
    return f"CAST(year({c}) - CASE WHEN month({c}) < 4 THEN 1 ELSE 0 END AS INTEGER)"


def _fy_label(c: str) -> str:
    s = _fy_start(c)
    return f"(CAST({s} AS VARCHAR) || '-' || lpad(CAST(({s} + 1) % 100 AS VARCHAR), 2, '0'))"


def _gss(prefix: str, c: str) -> str:
    return f"('{prefix}' || lpad(CAST({c} AS VARCHAR), 6, '0'))"


LK = f"""lk AS (
  SELECT n_nationkey AS nationkey, {_gss('E06', 'n_nationkey')} AS lad_code, n_name AS lad_name,
         {_gss('E12', 'r_regionkey')} AS region_code, r_name AS region_name
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey)"""

LA = f"""la AS (
  SELECT lk.lad_code, lk.lad_name, a.financial_year, a.fy_start, a.measure, a.dwellings
  FROM (SELECT c_nationkey, {_fy_label('o_orderdate')} AS financial_year, {_fy_start('o_orderdate')} AS fy_start,
               o_orderstatus AS measure, sum(o_totalprice) AS dwellings
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) a
  JOIN lk ON a.c_nationkey = lk.nationkey)"""

REG = """reg AS (
  SELECT lk.region_code, lk.region_name, la.financial_year, la.fy_start, la.measure,
         sum(la.dwellings) AS dwellings, count(DISTINCT la.lad_code) AS n_la
  FROM la LEFT JOIN lk ON upper(trim(la.lad_code)) = lk.lad_code GROUP BY ALL)"""

POP = """pop AS (
  SELECT lk.lad_code, lk.lad_name, count(*) AS population, 2021 AS year
  FROM customer JOIN lk ON c_nationkey = lk.nationkey GROUP BY ALL)"""

PRICE_SERIES = """ps AS (
  SELECT lk.region_name AS geography, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN lk ON s_nationkey = lk.nationkey GROUP BY ALL)"""

RENT_SERIES = """rs AS (
  SELECT lk.region_name AS geography, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lk ON c_nationkey = lk.nationkey GROUP BY ALL)"""

# P1 sort key pieces on a label column ``s``.
_Q_RE = r"^(Jan|Apr|Jul|Oct)\s*-\s*(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{4})$"


def _p1(s: str) -> dict[str, str]:
    qy = f"nullif(regexp_extract({s}, '{_Q_RE}', 2), '')"
    qm = f"nullif(regexp_extract({s}, '{_Q_RE}', 1), '')"
    fa = f"nullif(regexp_extract({s}, '^(\\d{{4}})-(\\d{{2}})$', 1), '')"
    fb = f"nullif(regexp_extract({s}, '^(\\d{{4}})-(\\d{{2}})$', 2), '')"
    cy = f"nullif(regexp_extract({s}, '^(\\d{{4}})$', 1), '')"
    bucket = f"CASE WHEN {qy} IS NOT NULL THEN 0 WHEN {fa} IS NOT NULL THEN 1 WHEN {cy} IS NOT NULL THEN 2 ELSE 3 END"
    y = f"CASE WHEN {qy} IS NOT NULL THEN CAST({qy} AS INTEGER) WHEN {fa} IS NOT NULL THEN CAST({fa} AS INTEGER) WHEN {cy} IS NOT NULL THEN CAST({cy} AS INTEGER) ELSE 0 END"
    q = f"CASE WHEN {qy} IS NOT NULL THEN list_position(['Jan','Apr','Jul','Oct'], {qm}) - 1 WHEN {fa} IS NOT NULL THEN CAST({fb} AS INTEGER) ELSE 0 END"
    txt = f"CASE WHEN ({bucket}) = 3 THEN {s} ELSE '' END"
    return {"bucket": bucket, "y": y, "q": q, "txt": txt}


MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"


def _month_label_date(s: str) -> str:
    pat = r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[ -](\d{4}|\d{2})$"
    mon = f"list_position({MONTHS}, nullif(regexp_extract({s}, '{pat}', 1), ''))"
    yt = f"nullif(regexp_extract({s}, '{pat}', 2), '')"
    year = f"CASE WHEN length({yt}) = 4 THEN CAST({yt} AS INTEGER) WHEN CAST({yt} AS INTEGER) >= 69 THEN CAST({yt} AS INTEGER) + 1900 ELSE CAST({yt} AS INTEGER) + 2000 END"
    return f"CASE WHEN {mon} IS NOT NULL AND {yt} IS NOT NULL THEN strftime(make_date({year}, {mon}, 1), '%Y-%m-%d') END"


SQL: dict[str, str] = {}

SQL["region_supply_by_fy"] = f"""
WITH {LK}, {LA}, {REG}
SELECT region_code, region_name, financial_year, measure, round(dwellings, 2) AS dwellings, n_la FROM reg"""

SQL["latest_fy_region_wide"] = f"""
WITH {LK}, {LA}, {REG},
latest AS (SELECT * FROM reg WHERE financial_year = (SELECT arg_max(financial_year, fy_start) FROM reg))
SELECT region_code, region_name, financial_year,
  round(max(CASE WHEN measure = 'F' THEN dwellings END), 2) AS dwellings_f,
  round(max(CASE WHEN measure = 'O' THEN dwellings END), 2) AS dwellings_o,
  round(max(CASE WHEN measure = 'P' THEN dwellings END), 2) AS dwellings_p
FROM latest GROUP BY ALL"""

_RAW = """CASE o_orderpriority WHEN '1-URGENT' THEN '[x]' WHEN '2-HIGH' THEN 'c'
  WHEN '3-MEDIUM' THEN ' ' || CAST(o_custkey AS VARCHAR) || ' '
  WHEN '4-NOT SPECIFIED' THEN CAST(o_custkey AS VARCHAR) || '[x]'
  ELSE CAST(o_custkey AS VARCHAR) || '.5' END"""

SQL["coerce_suppressed"] = f"""
WITH cells AS (SELECT o_orderkey, {_RAW} AS raw_text FROM orders),
s AS (SELECT *, replace(replace(replace(replace(raw_text, '[x]', ''), '[x1]', ''), '[z]', ''), '[c]', '') AS stripped FROM cells),
v AS (SELECT *, CASE WHEN lower(trim(stripped)) IN ('c', '') THEN NULL ELSE TRY_CAST(trim(stripped) AS DOUBLE) END AS cv FROM s)
SELECT o_orderkey, raw_text,
  TRY_CAST(trim(raw_text) AS DOUBLE) AS value_plain,
  TRY_CAST(trim(stripped) AS DOUBLE) AS value_num,
  CAST(CASE WHEN cv = floor(cv) THEN CAST(cv AS BIGINT) END AS DOUBLE) AS value_count
FROM v"""

SQL["geo_level_case"] = """
WITH c AS (
  SELECT c_custkey,
    CASE WHEN c_custkey % 10 = 9 THEN CAST(c_custkey % 100 AS VARCHAR)
         ELSE lower(['K04','E92','W92','E12','E07','W06','E02','W01','S12','X'][CAST(c_custkey % 10 AS INTEGER) + 1]) || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS raw_code,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'East' WHEN 'BUILDING' THEN 'Northern Ireland [note 3]'
         WHEN 'FURNITURE' THEN 'United Kingdom' WHEN 'HOUSEHOLD' THEN 'Wales' WHEN 'MACHINERY' THEN ' London '
         ELSE c_mktsegment END AS raw_name
  FROM customer),
n AS (SELECT c_custkey, upper(trim(raw_code)) AS code,
        CASE trim(raw_name) WHEN 'East' THEN 'East of England' WHEN 'Northern Ireland [note 3]' THEN 'Northern Ireland'
             ELSE trim(raw_name) END AS area_name FROM c)
SELECT c_custkey, code AS area_code,
  CASE WHEN code IS NULL THEN 'unknown' WHEN length(code) < 3 THEN 'unknown'
       WHEN starts_with(code, 'K04') THEN 'england_and_wales'
       WHEN starts_with(code, 'E92') OR starts_with(code, 'W92') THEN 'country'
       WHEN starts_with(code, 'E12') THEN 'region'
       WHEN starts_with(code, 'E06') OR starts_with(code, 'W06') THEN 'local_authority_district'
       WHEN starts_with(code, 'E07') OR starts_with(code, 'E08') OR starts_with(code, 'E09') THEN 'local_authority_district'
       WHEN starts_with(code, 'E02') OR starts_with(code, 'W02') THEN 'msoa'
       WHEN starts_with(code, 'E01') OR starts_with(code, 'W01') THEN 'lsoa'
       ELSE 'other' END AS geography_level,
  area_name,
  CASE WHEN area_name IN ('United Kingdom', 'Great Britain') THEN 'UK aggregate'
       WHEN starts_with(area_name, 'Northern Ireland') OR area_name IN ('England', 'Wales', 'Scotland') THEN 'Country'
       ELSE 'English region' END AS area_scope
FROM n"""

_PK = _p1("period")
SQL["period_labels_sorted"] = f"""
WITH labels AS (
  SELECT CASE quarter(o_orderdate) WHEN 1 THEN 'Jan - Mar ' WHEN 2 THEN 'Apr - Jun ' WHEN 3 THEN 'Jul - Sep ' ELSE 'Oct - Dec ' END
         || CAST(year(o_orderdate) AS VARCHAR) AS period FROM orders
  UNION ALL SELECT {_fy_label('o_orderdate')} FROM orders
  UNION ALL SELECT CAST(year(o_orderdate) AS VARCHAR) FROM orders
  UNION ALL SELECT o_orderpriority FROM orders),
counts AS (SELECT period, count(*) AS n_orders FROM labels WHERE period IS NOT NULL GROUP BY period),
keyed AS (SELECT period, n_orders, {_PK['bucket']} AS bucket, {_PK['y']} AS y, {_PK['q']} AS q, {_PK['txt']} AS txt FROM counts)
SELECT period, CAST(bucket AS INTEGER) AS bucket,
  row_number() OVER (ORDER BY bucket, y, q, txt) AS period_pos, n_orders,
  ((bucket, y, q, txt) >= (0, 1996, 0, '') AND (bucket, y, q, txt) <= (1, 1998, 99, '')) AS in_range
FROM keyed"""

_PE = """CASE month(m) WHEN 9 THEN 'Year ending Sep ' || CAST(year(m) AS VARCHAR)
  WHEN 6 THEN CAST(year(m) AS VARCHAR)
  WHEN 12 THEN 'Year ending Dec ' || CAST(year(m) AS VARCHAR)
  WHEN 3 THEN '5-Year Average'
  ELSE 'Q2 ' || CAST(year(m) AS VARCHAR) || ' to Q1 ' || CAST(year(m) + 5 AS VARCHAR) END"""

SQL["month_label_parse"] = f"""
WITH months AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m, count(*) AS n_lines FROM lineitem GROUP BY 1),
x AS (SELECT m, n_lines,
   {MONTHS}[month(m)] || ' ' || CAST(year(m) AS VARCHAR) AS month_label,
   {MONTHS}[month(m)] || '-' || lpad(CAST(year(m) % 100 AS VARCHAR), 2, '0') AS month_dash,
   'Year ending ' || {MONTHS}[month(m)] || ' ' || CAST(year(m) AS VARCHAR) AS year_ending,
   {_PE} AS pe_label FROM months)
SELECT month_label, month_dash, pe_label,
  {_month_label_date('month_label')} AS d_label,
  {_month_label_date('month_dash')} AS d_dash,
  {_month_label_date("regexp_replace(trim(year_ending), '^Year ending\\s+', '')")} AS d_year_ending,
  CAST(CAST(coalesce(nullif(regexp_extract(pe_label, '^Year ending Sep (\\d{{4}})', 1), ''), nullif(regexp_extract(pe_label, '^(\\d{{4}})$', 1), '')) AS INTEGER) AS DOUBLE) AS pe_year,
  CAST(CAST(coalesce(nullif(regexp_extract(pe_label, '^Year ending Sep (\\d{{4}})', 1), ''), nullif(regexp_extract(pe_label, '^(\\d{{4}})$', 1), '')) AS INTEGER) AS DOUBLE) AS pe_year_num,
  CAST(CAST(nullif(regexp_extract(pe_label, '^Year ending Dec (\\d{{4}})$', 1), '') AS INTEGER) AS DOUBLE) AS dec_year,
  CASE WHEN pe_label = '5-Year Average' THEN '2099-12-31'
       WHEN regexp_matches(pe_label, '^Year ending Sep (\\d{{4}})') THEN strftime(make_date(CAST(regexp_extract(pe_label, '^Year ending Sep (\\d{{4}})', 1) AS INTEGER), 9, 30), '%Y-%m-%d')
       WHEN regexp_matches(pe_label, '^(\\d{{4}})$') THEN strftime(make_date(CAST(pe_label AS INTEGER), 6, 15), '%Y-%m-%d') END AS sort_date,
  CAST(CAST(nullif(regexp_extract(pe_label, '^Q2 (\\d{{4}})', 1), '') AS INTEGER) AS DOUBLE) AS rolling_start,
  n_lines
FROM x"""

SQL["annual_last_and_mean"] = f"""
WITH {LK}, {PRICE_SERIES}
SELECT geography AS region_name, CAST(year(month) AS INTEGER) AS year,
  strftime(make_date(CAST(year(month) AS INTEGER), 12, 31), '%Y-%m-%d') AS year_end,
  arg_max(value, month) AS last_value, round(avg(value), 8) AS mean_value
FROM ps WHERE value IS NOT NULL GROUP BY geography, year(month)"""

SQL["melt_measures"] = """
WITH w AS (SELECT l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS year,
  sum(l_quantity) AS q, sum(l_extendedprice) AS p, sum(l_discount) AS d FROM lineitem GROUP BY ALL)
SELECT l_returnflag, year, 'started' AS measure, 'Quantity' AS sector, round(q, 2) AS value FROM w
UNION ALL SELECT l_returnflag, year, 'completed', 'Price', round(p, 2) FROM w
UNION ALL SELECT l_returnflag, year, 'started', 'Discount', round(d, 2) FROM w"""

SQL["melt_two_blocks"] = """
SELECT 'quantity' AS table_block, CAST(year(l_shipdate) AS VARCHAR) AS time_period, l_returnflag AS series, round(sum(l_quantity), 2) AS value
FROM lineitem GROUP BY ALL
UNION ALL
SELECT 'price', CAST(year(l_shipdate) AS VARCHAR), l_returnflag, round(sum(l_extendedprice), 2) FROM lineitem GROUP BY ALL"""

SQL["year_property_melt"] = """
SELECT l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS property_type, round(max(l_extendedprice), 2) AS value
FROM lineitem GROUP BY ALL"""

SQL["pivot_measures"] = f"""
WITH {LK},
long AS (SELECT lk.lad_code, l_returnflag AS flag, l_orderkey * 100 + l_linenumber AS ord,
                CASE WHEN l_discount > 0 THEN l_quantity END AS v
         FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN lk ON s_nationkey = lk.nationkey),
f AS (SELECT lad_code,
        arg_min(v, (ord, v)) FILTER (WHERE flag = 'A' AND v IS NOT NULL) AS first_a,
        arg_min(v, (ord, v)) FILTER (WHERE flag = 'N' AND v IS NOT NULL) AS first_n,
        arg_min(v, (ord, v)) FILTER (WHERE flag = 'R' AND v IS NOT NULL) AS first_r
      FROM long WHERE v IS NOT NULL GROUP BY lad_code),
s AS (SELECT lad_code,
        coalesce(sum(v) FILTER (WHERE flag = 'A'), 0) AS sum_a,
        coalesce(sum(v) FILTER (WHERE flag = 'N'), 0) AS sum_n,
        coalesce(sum(v) FILTER (WHERE flag = 'R'), 0) AS sum_r
      FROM long GROUP BY lad_code)
SELECT s.lad_code, f.first_a, f.first_n, f.first_r, round(sum_a, 2) AS sum_a, round(sum_n, 2) AS sum_n, round(sum_r, 2) AS sum_r
FROM s LEFT JOIN f USING (lad_code)"""

_BAND = "CASE WHEN p_size >= 1 THEN ['A','B','C','D','E','F','G'][CAST(least(floor((p_size - 1) / 7), 6) AS INTEGER) + 1] END"
BANDS = f"""bs AS (
  SELECT region_code, region_name, band, n * 100.0 / sum(n) OVER (PARTITION BY region_code) AS pct FROM (
    SELECT lk.region_code, lk.region_name, {_BAND} AS band, count(*) AS n
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN lk ON s_nationkey = lk.nationkey
    GROUP BY ALL))"""

SQL["band_share_abc"] = f"""
WITH {LK}, {BANDS},
r AS (SELECT region_code, region_name, sum(pct) FILTER (WHERE band IN ('A','B','C')) AS abc_share,
        sum(pct) FILTER (WHERE band = 'C') AS c_share FROM bs GROUP BY ALL)
SELECT lk.lad_code, lk.lad_name, r.region_name, round(r.abc_share, 6) AS abc_share, r.c_share,
  r.c_share = (SELECT max(c_share) FROM r) AS c_share_is_max, TRUE AS is_region_proxy
FROM lk LEFT JOIN r ON lk.region_code = r.region_code"""

SQL["la_rankings"] = f"""
WITH {LK}, {LA}, {POP},
latest AS (SELECT * FROM la WHERE financial_year = (SELECT arg_max(financial_year, fy_start) FROM la)),
sc AS (SELECT lad_code, lad_name, financial_year,
         sum(CASE WHEN measure = 'O' THEN dwellings END) AS starts,
         sum(CASE WHEN measure = 'F' THEN dwellings END) AS completions FROM latest GROUP BY ALL),
x AS (SELECT sc.*, pop.population,
        CASE WHEN pop.population > 0 THEN sc.starts / pop.population * 1000.0 END AS starts_per_1000
      FROM sc LEFT JOIN pop USING (lad_code))
SELECT lad_code, lad_name, financial_year, round(starts, 2) AS starts, round(completions, 2) AS completions, population,
  round(starts_per_1000, 6) AS starts_per_1000,
  CASE WHEN starts IS NOT NULL THEN rank() OVER (ORDER BY starts DESC NULLS LAST) END AS rank_starts,
  CASE WHEN starts_per_1000 IS NOT NULL THEN rank() OVER (ORDER BY starts_per_1000 DESC NULLS LAST) END AS rank_starts_per_1000
FROM x"""

_SNAP_PARTS = f"""
supply AS (SELECT lad_code, financial_year,
   max(CASE WHEN measure = 'F' THEN dwellings END) AS supply_f,
   max(CASE WHEN measure = 'O' THEN dwellings END) AS supply_o,
   max(CASE WHEN measure = 'P' THEN dwellings END) AS supply_p
 FROM la WHERE financial_year = (SELECT arg_max(financial_year, fy_start) FROM la) GROUP BY ALL),
op AS (SELECT c_nationkey, {_fy_label('o_orderdate')} AS financial_year, {_fy_start('o_orderdate')} AS fy_start, o_totalprice
       FROM orders JOIN customer ON o_custkey = c_custkey),
med AS (SELECT lk.lad_code, quantile_cont(o_totalprice, 0.5) AS median_price FROM op JOIN lk ON c_nationkey = lk.nationkey
        WHERE financial_year = (SELECT arg_max(financial_year, fy_start) FROM op) GROUP BY ALL),
earn AS (SELECT lk.lad_code, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS mean_earnings
         FROM customer JOIN lk ON c_nationkey = lk.nationkey GROUP BY ALL),
fuel AS (SELECT lk.lad_code,
   count(*) FILTER (WHERE l_returnflag = 'A') * 100.0 / count(*) AS fuel_share_a,
   count(*) FILTER (WHERE l_returnflag = 'N') * 100.0 / count(*) AS fuel_share_n,
   count(*) FILTER (WHERE l_returnflag = 'R') * 100.0 / count(*) AS fuel_share_r
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN lk ON s_nationkey = lk.nationkey GROUP BY ALL)"""

SQL["market_snapshot_la"] = f"""
WITH {LK}, {LA}, {POP}, {_SNAP_PARTS}
SELECT lk.lad_code, lk.lad_name, lk.region_name, supply.financial_year,
  round(supply_f, 2) AS supply_f, round(supply_o, 2) AS supply_o, round(supply_p, 2) AS supply_p,
  pop.population, round(median_price, 4) AS median_price, mean_earnings,
  round(CASE WHEN mean_earnings > 0 THEN median_price / mean_earnings END, 6) AS price_earnings_ratio,
  fuel_share_a, fuel_share_n, fuel_share_r
FROM lk LEFT JOIN supply USING (lad_code) LEFT JOIN pop USING (lad_code) LEFT JOIN med USING (lad_code)
  LEFT JOIN earn USING (lad_code) LEFT JOIN fuel USING (lad_code)"""

SQL["market_snapshot_region"] = f"""
WITH {LK}, {LA}, {REG}, {BANDS}, {PRICE_SERIES},
supply AS (SELECT region_code, financial_year,
   max(CASE WHEN measure = 'F' THEN dwellings END) AS supply_f,
   max(CASE WHEN measure = 'O' THEN dwellings END) AS supply_o,
   max(CASE WHEN measure = 'P' THEN dwellings END) AS supply_p
 FROM reg WHERE financial_year = (SELECT arg_max(financial_year, fy_start) FROM reg) GROUP BY ALL),
pop AS (SELECT lk.region_code, count(*) AS population FROM customer JOIN lk ON c_nationkey = lk.nationkey GROUP BY ALL),
abc AS (SELECT region_code, sum(pct) FILTER (WHERE band IN ('A','B','C')) AS abc_share FROM bs GROUP BY ALL),
g AS (SELECT geography AS region_name, arg_min(value, month) AS fv, arg_max(value, month) AS lv, count(*) AS n
      FROM ps WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
spine AS (SELECT DISTINCT region_code, region_name FROM lk)
SELECT spine.region_code, spine.region_name, supply.financial_year,
  round(supply_f, 2) AS supply_f, round(supply_o, 2) AS supply_o, round(supply_p, 2) AS supply_p,
  pop.population, round(abc.abc_share, 6) AS abc_share,
  (CASE WHEN fv <> 0 THEN lv / fv END - 1.0) * 100.0 AS growth_pct
FROM spine LEFT JOIN supply USING (region_code) LEFT JOIN pop USING (region_code) LEFT JOIN abc USING (region_code)
  LEFT JOIN g ON spine.region_name = g.region_name"""

FUEL = """fuel AS (
  SELECT lk.lad_code, lk.lad_name, '2a' AS table_id, CAST(NULL AS VARCHAR) AS dwelling_class, l_returnflag AS fuel_or_method, CAST(count(*) AS DOUBLE) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN lk ON s_nationkey = lk.nationkey GROUP BY ALL
  UNION ALL
  SELECT lk.lad_code, lk.lad_name, '2b', CASE WHEN l_linestatus = 'F' THEN 'Existing' ELSE 'New' END, 'all', CAST(count(*) AS DOUBLE)
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN lk ON s_nationkey = lk.nationkey GROUP BY ALL)"""

SQL["supply_fuel_join"] = f"""
WITH {LK}, {LA}, {FUEL}
SELECT la.lad_code, la.lad_name, la.financial_year, la.measure, round(la.dwellings, 2) AS dwellings,
  fuel.lad_name AS lad_name_mf, fuel.table_id, fuel.dwelling_class, fuel.fuel_or_method, round(fuel.value, 2) AS value
FROM la LEFT JOIN fuel ON la.lad_code = fuel.lad_code"""

SQL["join_report"] = f"""
WITH {LK}, {LA}, {FUEL}
SELECT 'supply_codes' AS metric, CAST(count(DISTINCT lad_code) AS BIGINT) AS value FROM la
UNION ALL SELECT 'fuel_codes', count(DISTINCT lad_code) FROM fuel
UNION ALL SELECT 'supply_codes_without_fuel', count(*) FROM (SELECT DISTINCT lad_code FROM la WHERE lad_code NOT IN (SELECT lad_code FROM fuel))
UNION ALL SELECT 'fuel_codes_without_supply', count(*) FROM (SELECT DISTINCT lad_code FROM fuel WHERE lad_code NOT IN (SELECT lad_code FROM la))
UNION ALL SELECT 'joined_rows', count(*) FROM la LEFT JOIN fuel ON la.lad_code = fuel.lad_code"""


def _fam_price(year_expr: str) -> str:
    return f"""fa AS MATERIALIZED (SELECT lk.lad_code, {year_expr} AS year, quantile_cont(o_totalprice, 0.5) AS price, quantile_cont(o_totalprice, 0.25) AS lq_price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lk ON c_nationkey = lk.nationkey GROUP BY ALL)"""


def _fam_earn() -> str:
    return f"""fb AS MATERIALIZED (SELECT lk.lad_code, CAST(year(l_shipdate) AS INTEGER) AS year,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS earnings
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN lk ON s_nationkey = lk.nationkey GROUP BY ALL)"""


FAM_RATIO = f"""fc AS MATERIALIZED (SELECT lk.lad_code, {_fy_start('o_orderdate')} AS year,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(DISTINCT o_custkey) / 100.0 AS ratio
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lk ON c_nationkey = lk.nationkey GROUP BY ALL)"""

SQL["ratio_common_year"] = f"""
WITH {LK}, {_fam_price('CAST(year(o_orderdate) AS INTEGER)')}, {_fam_earn()}, {FAM_RATIO},
y AS (SELECT max(year) AS y FROM (SELECT year FROM fa INTERSECT SELECT year FROM fb INTERSECT SELECT year FROM fc)),
a AS (SELECT lad_code, price FROM fa WHERE year = (SELECT y FROM y)),
b AS (SELECT lad_code, earnings FROM fb WHERE year = (SELECT y FROM y)),
c AS (SELECT lad_code, ratio FROM fc WHERE year = (SELECT y FROM y)),
j AS (SELECT coalesce(a.lad_code, b.lad_code, c.lad_code) AS lad_code, price, earnings, ratio
      FROM a FULL JOIN b ON a.lad_code = b.lad_code FULL JOIN c ON coalesce(a.lad_code, b.lad_code) = c.lad_code)
SELECT j.lad_code, lk.lad_name, CAST((SELECT y FROM y) AS INTEGER) AS year, round(price, 4) AS price, earnings,
  ratio AS ratio_published, round(CASE WHEN earnings > 0 THEN price / earnings END, 6) AS ratio_computed
FROM j LEFT JOIN lk ON j.lad_code = lk.lad_code"""

HORIZON = f"""{_fam_price('CAST(year(o_orderdate) AS INTEGER)')}, {_fam_earn()},
fc AS (SELECT fa.lad_code, fa.year, CASE WHEN earnings > 0 THEN price / earnings END AS ratio FROM fa JOIN fb ON fa.lad_code = fb.lad_code AND fa.year = fb.year),
yrs AS (SELECT year FROM fa INTERSECT SELECT year FROM fb INTERSECT SELECT year FROM fc),
bounds AS (SELECT
   CASE WHEN (SELECT count(*) FROM yrs WHERE year IN (1996, 2000)) = 2 THEN 1996
        ELSE (SELECT min(year) FROM (SELECT year FROM yrs ORDER BY year DESC LIMIT 5)) END AS y_min,
   CASE WHEN (SELECT count(*) FROM yrs WHERE year IN (1996, 2000)) = 2 THEN 2000 ELSE (SELECT max(year) FROM yrs) END AS y_max),
dp AS (SELECT lad_code, min(price) FILTER (WHERE year = (SELECT y_max FROM bounds)) - min(price) FILTER (WHERE year = (SELECT y_min FROM bounds)) AS delta_median_price,
              min(lq_price) FILTER (WHERE year = (SELECT y_max FROM bounds)) - min(lq_price) FILTER (WHERE year = (SELECT y_min FROM bounds)) AS d_lq
       FROM fa GROUP BY lad_code),
de AS (SELECT lad_code, min(earnings) FILTER (WHERE year = (SELECT y_max FROM bounds)) - min(earnings) FILTER (WHERE year = (SELECT y_min FROM bounds)) AS delta_earnings
       FROM fb GROUP BY lad_code),
dr AS (SELECT lad_code, min(ratio) FILTER (WHERE year = (SELECT y_max FROM bounds)) - min(ratio) FILTER (WHERE year = (SELECT y_min FROM bounds)) AS delta_ratio
       FROM fc GROUP BY lad_code)"""

SQL["horizon_deltas"] = f"""
WITH {LK}, {HORIZON}
SELECT lk.lad_code, lk.lad_name, lk.region_name, CAST((SELECT y_min FROM bounds) AS INTEGER) AS y_min, CAST((SELECT y_max FROM bounds) AS INTEGER) AS y_max,
  round(delta_median_price, 4) AS delta_median_price, delta_earnings, round(delta_ratio, 6) AS delta_ratio
FROM lk JOIN dp ON lk.lad_code = dp.lad_code JOIN de ON lk.lad_code = de.lad_code JOIN dr ON lk.lad_code = dr.lad_code
WHERE delta_median_price IS NOT NULL AND delta_earnings IS NOT NULL AND delta_ratio IS NOT NULL"""

SQL["entry_pressure"] = f"""
WITH {LK}, {HORIZON},
x AS (SELECT lk.region_name, dp.delta_median_price AS d_median, dp.d_lq, dr.delta_ratio
      FROM dp JOIN dr ON dp.lad_code = dr.lad_code JOIN lk ON dp.lad_code = lk.lad_code
      WHERE dp.delta_median_price IS NOT NULL AND dp.d_lq IS NOT NULL AND dr.delta_ratio IS NOT NULL)
SELECT region_name, count(*) AS n_las, count(*) FILTER (WHERE d_lq > d_median) AS n_entry_pressure,
  round(quantile_cont(delta_ratio, 0.5), 6) AS median_delta_ratio
FROM x GROUP BY region_name"""

SQL["region_change_top"] = f"""
WITH {LK}, {LA}, {REG},
fys AS (SELECT DISTINCT financial_year, fy_start FROM reg),
b AS (SELECT CASE WHEN (SELECT count(*) FROM fys WHERE financial_year IN ('1996-97', '2000-01')) = 2 THEN '1996-97'
                  ELSE (SELECT arg_min(financial_year, fy_start) FROM (SELECT * FROM fys ORDER BY fy_start DESC LIMIT 5)) END AS fy0,
             CASE WHEN (SELECT count(*) FROM fys WHERE financial_year IN ('1996-97', '2000-01')) = 2 THEN '2000-01'
                  ELSE (SELECT arg_max(financial_year, fy_start) FROM fys) END AS fy1),
g AS (SELECT measure, region_name,
        coalesce(sum(dwellings) FILTER (WHERE financial_year = (SELECT fy0 FROM b)), 0) AS total0,
        coalesce(sum(dwellings) FILTER (WHERE financial_year = (SELECT fy1 FROM b)), 0) AS total1
      FROM reg GROUP BY ALL),
g2 AS (SELECT *, total1 - total0 AS delta, row_number() OVER (PARTITION BY measure ORDER BY total1 - total0 DESC, region_name) AS rn FROM g)
SELECT measure, region_name, (SELECT fy0 FROM b) AS fy0, (SELECT fy1 FROM b) AS fy1, round(total0, 2) AS total0, round(total1, 2) AS total1,
  round(delta, 2) AS delta, rn = 1 AS is_top
FROM g2"""

TWO = f"""{PRICE_SERIES}, {RENT_SERIES},
both_s AS (SELECT ps.geography, ps.month, ps.value AS hpi, rs.value AS rent FROM ps JOIN rs ON ps.geography = rs.geography AND ps.month = rs.month)"""

SQL["index_rebased"] = f"""
WITH {LK}, {TWO},
base AS (SELECT geography, arg_min(hpi, month) AS h0, arg_min(rent, month) AS r0 FROM both_s GROUP BY geography),
hb AS (SELECT geography, max(value) AS b FROM ps WHERE month = DATE '{'1996-01-01'}' GROUP BY geography),
x AS (SELECT both_s.geography, both_s.month, CASE WHEN h0 <> 0 THEN hpi / h0 END * 100.0 AS hpi_index,
        CASE WHEN r0 <> 0 THEN rent / r0 END * 100.0 AS rent_index,
        CASE WHEN hb.b <> 0 THEN hpi / hb.b END * 100.0 AS hpi_index_base
      FROM both_s JOIN base ON both_s.geography = base.geography LEFT JOIN hb ON both_s.geography = hb.geography)
SELECT geography AS region_name, strftime(month, '%Y-%m-%d') AS month, hpi_index_base,
  hpi_index, rent_index, hpi_index - rent_index AS spread,
  CASE WHEN rent_index <> 0 THEN hpi_index / rent_index END AS ratio
FROM x"""

SQL["overlap_growth"] = f"""
WITH {LK}, {TWO},
g AS (SELECT geography, arg_min(hpi, month) AS h0, arg_max(hpi, month) AS h1, arg_min(rent, month) AS r0, arg_max(rent, month) AS r1,
        min(month) AS m0, max(month) AS m1, count(*) AS n FROM both_s GROUP BY geography HAVING count(*) >= 2),
x AS (SELECT *, (CASE WHEN h0 <> 0 THEN h1 / h0 END - 1.0) * 100.0 AS hg, (CASE WHEN r0 <> 0 THEN r1 / r0 END - 1.0) * 100.0 AS rg FROM g)
SELECT geography AS region_name, strftime(m0, '%Y-%m-%d') AS first_month, strftime(m1, '%Y-%m-%d') AS last_month, n AS n_points,
  hg AS hpi_growth, rg AS rent_growth, hg - rg AS growth_gap
FROM x"""

SQL["spread_12m"] = f"""
WITH {LK}, {TWO},
x AS (SELECT geography, month,
   (hpi / nullif(lag(hpi, 12) OVER w, 0) - 1.0) * 100.0 AS hy,
   (rent / nullif(lag(rent, 12) OVER w, 0) - 1.0) * 100.0 AS ry
  FROM both_s WINDOW w AS (PARTITION BY geography ORDER BY month))
SELECT geography AS region_name, strftime(month, '%Y-%m-%d') AS month, hy AS hpi_yoy, ry AS rent_yoy, hy - ry AS spread
FROM x"""

SQL["rates_per_1000"] = f"""
WITH {LK}, {LA}, {POP},
w AS (SELECT lad_code, coalesce(sum(dwellings) FILTER (WHERE measure = 'O'), 0) AS starts,
        coalesce(sum(dwellings) FILTER (WHERE measure = 'F'), 0) AS completions FROM la GROUP BY lad_code),
las AS (SELECT w.lad_code, lk.lad_name, lk.region_code, lk.region_name, starts, completions, pop.population
        FROM w LEFT JOIN pop ON w.lad_code = pop.lad_code JOIN lk ON w.lad_code = lk.lad_code),
rows_ AS (
  SELECT 'la' AS geography_level, lad_code AS code, lad_name AS name, starts, completions, population FROM las
  UNION ALL
  SELECT 'region', region_code, region_name, coalesce(sum(starts), 0), coalesce(sum(completions), 0), sum(population) FROM las GROUP BY ALL),
r AS (SELECT *, CASE WHEN population > 0 THEN starts / population * 1000.0 END AS spk,
             CASE WHEN population > 0 THEN completions / population * 1000.0 END AS cpk FROM rows_)
SELECT geography_level, code, name, round(starts, 2) AS starts, round(completions, 2) AS completions, CAST(population AS BIGINT) AS population,
  round(spk, 4) AS starts_per_1000, round(cpk, 4) AS completions_per_1000,
  round((SELECT quantile_cont(spk, 0.5) FROM r WHERE geography_level = 'la'), 4) AS median_la_starts_per_1000
FROM r"""

SQL["supply_balance"] = f"""
WITH {LK}, {LA}, {REG},
x AS (SELECT region_name, financial_year, sum(dwellings) FILTER (WHERE measure = 'O') AS starts, sum(dwellings) FILTER (WHERE measure = 'F') AS completions
      FROM reg WHERE financial_year = (SELECT arg_max(financial_year, fy_start) FROM reg) GROUP BY ALL),
y AS (SELECT *, CASE WHEN starts > 0 THEN completions / starts END AS balance FROM x)
SELECT region_name, financial_year, round(starts, 2) AS starts, round(completions, 2) AS completions, round(balance, 6) AS balance,
  balance = (SELECT max(balance) FROM y) AS is_max
FROM y"""

SQL["quantile_bins"] = """
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(c_acctbal, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM customer WHERE c_acctbal IS NOT NULL)
SELECT c_custkey, c_acctbal,
  CAST(CASE WHEN c_acctbal IS NOT NULL THEN greatest(len(list_filter((SELECT edges FROM e), lambda x: x < c_acctbal)) - 1, 0) END AS INTEGER) AS bin
FROM customer"""

SQL["metric_kpis"] = """
SELECT count(*) AS n, count(DISTINCT c_nationkey) AS n_nations, round(avg(c_acctbal), 4) AS mean, round(max(c_acctbal), 2) AS max,
  count(*) FILTER (WHERE c_acctbal > 5000) AS n_above_5000,
  round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(quantile_cont(c_acctbal, 0.1), 4) AS p10, round(quantile_cont(c_acctbal, 0.9), 4) AS p90
FROM customer"""

SQL["top_bottom"] = f"""
WITH {LK}, {LA},
t AS (SELECT lad_code, lad_name, sum(dwellings) AS total FROM la GROUP BY ALL)
(SELECT 'top' AS side, lad_code, lad_name, round(total, 2) AS total FROM t WHERE total IS NOT NULL ORDER BY total DESC, lad_code LIMIT 5)
UNION ALL
(SELECT 'bottom', lad_code, lad_name, round(total, 2) FROM t WHERE total IS NOT NULL ORDER BY total ASC, lad_code LIMIT 5)"""

SQL["paged_filtered_read"] = """
WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_extendedprice FROM lineitem
           WHERE lower(l_returnflag) IN ('a', 'r'))
SELECT *, (SELECT count(*) FROM f) AS total_rows FROM f ORDER BY l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_extendedprice LIMIT 500 OFFSET 100"""

SQL["semi_filter"] = """
SELECT lang, source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars_total FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL"""

SQL["missing_inputs"] = """
WITH req AS (SELECT list_sort(list(DISTINCT source)) AS r FROM documents),
p AS (SELECT lang, list(DISTINCT source) AS present, count(*) AS n_docs FROM documents GROUP BY lang),
u AS (SELECT lang, count(*) AS n_unlabelled FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang)
SELECT p.lang, p.n_docs, coalesce(u.n_unlabelled, 0) AS n_unlabelled,
  array_to_string(list_sort(list_filter((SELECT r FROM req), lambda s: NOT list_contains(p.present, s))), ',') AS missing_sources
FROM p LEFT JOIN u ON p.lang = u.lang"""

SQL["json_props"] = """
WITH e AS (SELECT event_type, value, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_type, count(*) AS n_events, CAST(sum(k) AS BIGINT) AS sum_k, max(k) AS max_k, round(avg(value), 4) AS avg_value,
  count(*) FILTER (WHERE k IS NULL) AS n_missing_k
FROM e GROUP BY event_type"""

_SIZE_BAND = "CASE WHEN p_size >= 1 THEN ['A','B','C','D','E','F','G'][CAST(least(floor((p_size - 1) / 7), 6) AS INTEGER) + 1] END"


def _ext(s: str, pat: str, i: int) -> str:
    return f"nullif(regexp_extract({s}, '{pat}', {i}), '')"


ROLL_RE = r"^(.*)\s(Q2 \d{4} to Q1 \d{4})$"
SQL["header_split_family"] = f"""
WITH l AS (
  SELECT p_partkey,
    'Band ' || {_SIZE_BAND} AS l_band,
    upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' - Band ' || {_SIZE_BAND} AS l_dim,
    p_name || ' Q2 ' || CAST(1995 + p_size % 5 AS VARCHAR) || ' to Q1 ' || CAST(2000 + p_size % 5 AS VARCHAR) AS l_roll,
    CASE WHEN p_size % 2 = 0 THEN 'Existing ' ELSE 'New ' END || p_name AS l_fuel,
    p_name || ' ' || lower(p_type) AS l_prop,
    p_type || ' / ' || p_brand AS l_slug,
    ['5a','5b','5c','6a'][CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 4 + 1] AS table_id
  FROM part)
SELECT p_partkey,
  {_ext('l_band', '^Band ([A-G])$', 1)} AS epc_band,
  {_ext('l_dim', '^(.*) - Band ([A-G])$', 1)} AS dimension, {_ext('l_dim', '^(.*) - Band ([A-G])$', 2)} AS dim_band,
  {_ext('l_roll', ROLL_RE, 1)} AS breakdown, {_ext('l_roll', ROLL_RE, 2)} AS rolling_period,
  {_ext('l_fuel', '^(Existing|New)\\s+(.+)$', 1)} AS dwelling_class, {_ext('l_fuel', '^(Existing|New)\\s+(.+)$', 2)} AS fuel,
  {_ext('l_prop', '^(small ring|blue anvil|small|blue|cold|red|hot)\\s+(.+)$', 1)} AS property_type,
  {_ext('l_prop', '^(small ring|blue anvil|small|blue|cold|red|hot)\\s+(.+)$', 2)} AS property_rest,
  regexp_replace(regexp_replace(lower(trim(l_slug)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS type_slug,
  table_id,
  'local_authority' AS geography_level,
  CASE table_id WHEN '6a' THEN 'lower_quartile' ELSE 'median' END AS percentile,
  CASE table_id WHEN '5b' THEN 'earnings' WHEN '5c' THEN 'ratio' ELSE 'price' END AS component
FROM l"""

SQL["year_columns_melt"] = f"""
WITH {LK}
SELECT lk.lad_code, lk.region_code, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lk ON c_nationkey = lk.nationkey
WHERE regexp_matches(CAST(year(o_orderdate) AS VARCHAR), '^20\\d{{2}}$') AND lk.region_code IS NOT NULL
GROUP BY ALL"""

SQL["metric_melt"] = f"""
WITH {LK},
x AS (SELECT lk.lad_code, o_orderstatus, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN lk ON c_nationkey = lk.nationkey),
u AS (
  SELECT lad_code, 'vacant' AS dwelling_group, CAST(NULL AS VARCHAR) AS breakdown_type, CAST(NULL AS VARCHAR) AS breakdown_label,
         count(*) FILTER (WHERE o_orderstatus = 'O') AS value FROM x GROUP BY lad_code
  UNION ALL
  SELECT lad_code, 'second_home', NULL, NULL, count(*) FILTER (WHERE o_orderstatus = 'P') FROM x GROUP BY lad_code
  UNION ALL
  SELECT lad_code, 'vacant', 'priority', regexp_replace(regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), count(*)
  FROM x GROUP BY lad_code, o_orderpriority)
SELECT lad_code, dwelling_group, breakdown_type, breakdown_label, value, value AS dwellings FROM u"""

SQL["fills_and_filters"] = f"""
WITH {LK},
g AS (SELECT lk.region_name, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS total,
             sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS total_pence
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN lk ON c_nationkey = lk.nationkey
      WHERE trim(o_orderpriority) = '1-URGENT' AND lk.region_name IN ('AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')
        AND lk.region_name NOT IN ('MIDDLE EAST')
      GROUP BY ALL HAVING sum(o_totalprice) IS NOT NULL),
p AS (SELECT *, (total / nullif(lag(total) OVER (PARTITION BY region_name ORDER BY year), 0) - 1.0) * 100.0 AS pct_change FROM g)
SELECT upper(substr(region_name, 1, 1)) || lower(substr(region_name, 2)) AS region_label, year, round(total, 2) AS total,
  '£' || format('{{:,}}', CAST(floor((total_pence + 50) / 100) AS BIGINT)) AS total_label,
  round(pct_change, 4) AS pct_change,
  CASE WHEN year - 1994 <= 1 THEN 1 WHEN year - 1994 <= 3 THEN 3 WHEN year - 1994 <= 6 THEN 6 WHEN year - 1994 <= 12 THEN 12 ELSE 24 END AS horizon_bucket,
  CASE WHEN pct_change / 100.0 > 0.1 THEN 'rising' WHEN pct_change / 100.0 < -0.1 THEN 'falling' ELSE 'stable' END AS delta_class,
  round(1.0 / (1.0 + exp(-(pct_change / 100.0))), 6) AS logistic_change,
  round(least(greatest(pct_change / 100.0, 0.0), 1.0), 4) AS clamped_change,
  contains(lower(region_name), 'eu') AS has_eu,
  CASE WHEN year % 2 = 0 THEN 12 ELSE 4 END AS season_length
FROM p"""

SQL["aggregate_family"] = f"""
WITH {LK},
x AS (SELECT lk.lad_code, o_orderkey, o_totalprice, o_orderdate, o_orderstatus, o_orderpriority
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN lk ON c_nationkey = lk.nationkey),
m AS (SELECT lad_code, first(o_orderpriority ORDER BY n DESC, o_orderpriority) AS mode_priority
      FROM (SELECT lad_code, o_orderpriority, count(*) AS n FROM x GROUP BY ALL) GROUP BY lad_code),
g AS (SELECT lad_code, count(*) AS n_orders, sum(o_totalprice) AS total,
        coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0) AS total_p,
        first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_orderkey,
        CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS mean_price, max(o_totalprice) AS max_price,
        first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS argmax_orderkey
      FROM x GROUP BY lad_code),
s AS (SELECT min(total) AS lo, max(total) AS hi, avg(total) AS mu, stddev_pop(total) AS sd FROM g)
SELECT g.lad_code, n_orders, round(total, 2) AS total, round(total_p, 2) AS total_p, first_orderkey,
  round(total / (SELECT count(DISTINCT year(o_orderdate)) FROM orders), 6) AS mean_per_year,
  mean_price,
  CASE WHEN mean_price IS NOT NULL THEN rank() OVER (ORDER BY mean_price DESC NULLS LAST) END AS rank_mean_price,
  round(max_price, 2) AS max_price, argmax_orderkey, m.mode_priority,
  round(CASE WHEN (SELECT sd FROM s) > 0 THEN (total - (SELECT mu FROM s)) / (SELECT sd FROM s) END, 6) AS total_z,
  CAST(CASE WHEN (SELECT hi - lo FROM s) = 0 THEN 1
       ELSE least(floor((total - (SELECT lo FROM s)) / (SELECT hi - lo FROM s) * 10) + 1, 10) END AS INTEGER) AS hist_bin
FROM g JOIN m ON g.lad_code = m.lad_code"""

SQL["latest_rows"] = """
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
  strftime(max(o_orderdate), '%Y-%m-%d') AS o_orderdate,
  arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice
FROM orders GROUP BY o_custkey"""

SQL["latest_period_rows"] = f"""
WITH {LK}, {LA}
SELECT lad_code, lad_name, financial_year, measure, round(dwellings, 2) AS dwellings FROM la
WHERE financial_year = (SELECT arg_max(financial_year, fy_start) FROM la)"""

SQL["dedup_first"] = """
WITH f AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type,
             arg_min(value, (ts, event_id)) AS value, min(ts) AS ts FROM events GROUP BY user_id),
lk AS (SELECT event_type, arg_min(user_id, event_id) AS first_user FROM f GROUP BY event_type)
SELECT f.user_id, f.event_id, f.event_type, f.value, strftime(f.ts, '%Y-%m-%d %H:%M:%S') AS first_ts,
  lk.first_user = f.user_id AS is_type_first_user
FROM f LEFT JOIN lk ON f.event_type = lk.event_type"""

SQL["lag_family"] = f"""
WITH {LK}, {PRICE_SERIES},
x AS (SELECT geography, month, value,
  lag(value, 1) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2, lag(value, 3) OVER w AS lag_3, lag(value, 12) OVER w AS lag_12,
  lead(value, 1) OVER w AS lead_1, value - lag(value, 1) OVER w AS diff_1,
  row_number() OVER w <= floor(count(*) OVER (PARTITION BY geography) * 0.8) AS is_train
  FROM ps WINDOW w AS (PARTITION BY geography ORDER BY month))
SELECT geography AS region_name, strftime(month, '%Y-%m-%d') AS month, value, lag_1, lag_2, lag_3, lag_12, lead_1, diff_1, is_train
FROM x"""

SQL["yoy_last_two"] = f"""
WITH {LK}, {LA}, {REG},
t AS (SELECT region_name, financial_year, fy_start, sum(dwellings) AS v FROM reg GROUP BY ALL),
fys AS (SELECT DISTINCT financial_year, fy_start FROM t ORDER BY fy_start DESC LIMIT 2),
b AS (SELECT arg_max(financial_year, fy_start) AS fy_last, arg_min(financial_year, fy_start) AS fy_prev FROM fys),
g AS (SELECT region_name, max(v) FILTER (WHERE financial_year = (SELECT fy_last FROM b)) AS v_last,
        max(v) FILTER (WHERE financial_year = (SELECT fy_prev FROM b)) AS v_prev FROM t GROUP BY region_name)
SELECT region_name, (SELECT fy_last FROM b) AS fy_last, (SELECT fy_prev FROM b) AS fy_prev, round(v_last, 2) AS v_last, round(v_prev, 2) AS v_prev,
  round((v_last / nullif(v_prev, 0) - 1.0) * 100.0, 4) AS yoy_pct
FROM g"""

SQL["leaders_trend"] = f"""
WITH {LK}, {LA},
o AS (SELECT * FROM la WHERE measure = 'O'),
leaders AS (SELECT lad_code FROM o WHERE financial_year = (SELECT arg_max(financial_year, fy_start) FROM o)
            ORDER BY dwellings DESC NULLS LAST, lad_code LIMIT 3)
SELECT lad_code, lad_name, financial_year, round(dwellings, 2) AS dwellings FROM o WHERE lad_code IN (SELECT lad_code FROM leaders)"""

SQL["line_by_year"] = f"""
WITH {LK}, {LA},
fy AS (SELECT DISTINCT financial_year FROM la), ms AS (SELECT DISTINCT measure FROM la WHERE measure IS NOT NULL),
t AS (SELECT financial_year, measure, sum(dwellings) AS d FROM la GROUP BY ALL)
SELECT fy.financial_year, ms.measure, round(t.d, 2) AS dwellings
FROM fy CROSS JOIN ms LEFT JOIN t ON fy.financial_year = t.financial_year AND ms.measure = t.measure"""

SQL["distinct_dims"] = """
WITH x AS (
  SELECT DISTINCT 'priority' AS dimension, o_orderpriority AS value FROM orders
  UNION ALL SELECT DISTINCT 'status', o_orderstatus FROM orders
  UNION ALL SELECT DISTINCT 'segment', c_mktsegment FROM customer
  UNION ALL SELECT DISTINCT 'part_type', p_type FROM part)
SELECT dimension, value, row_number() OVER (PARTITION BY dimension ORDER BY value) AS position FROM x"""

_Y = "CAST(year(o_orderdate) AS INTEGER)"

SQL["region_context_joins"] = f"""
WITH {LK}, {RENT_SERIES}, {BANDS},
tot AS (SELECT lk.region_name, {_Y} AS year, sum(o_totalprice) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN lk ON c_nationkey = lk.nationkey GROUP BY ALL),
base AS (SELECT region_name, arg_min(total, year) AS b FROM tot GROUP BY region_name),
rent AS (SELECT geography AS region_name, CAST(year(month) AS INTEGER) AS year, avg(value) AS rent_mean FROM rs GROUP BY ALL),
abc AS (SELECT region_code, sum(pct) FILTER (WHERE band IN ('A','B','C')) AS abc_share FROM bs GROUP BY region_code),
ctx AS (SELECT region_name, first(region_code) AS region_code FROM lk GROUP BY region_name),
nl AS (SELECT region_name, count(*) AS n_las FROM lk GROUP BY region_name)
SELECT ctx.region_code, tot.region_name, tot.year, round(total, 2) AS total,
  round(CASE WHEN b > 0 THEN total / b END * 100.0, 6) AS index_to_base, round(rent.rent_mean, 8) AS rent_mean,
  round(abc.abc_share, 6) AS abc_share, nl.n_las
FROM tot JOIN base ON tot.region_name = base.region_name
  JOIN rent ON tot.region_name = rent.region_name AND tot.year = rent.year
  LEFT JOIN ctx ON tot.region_name = ctx.region_name
  JOIN abc ON ctx.region_code = abc.region_code
  LEFT JOIN nl ON tot.region_name = nl.region_name"""

_PE_YEAR = "CAST(coalesce(nullif(regexp_extract(period_label, '^Year ending Sep (\\d{4})', 1), ''), nullif(regexp_extract(period_label, '^(\\d{4})$', 1), '')) AS INTEGER)"
_SORT_DATE = """CASE WHEN period_label = '5-Year Average' THEN '2099-12-31'
  WHEN regexp_matches(period_label, '^Year ending Sep (\\d{4})') THEN strftime(make_date(CAST(regexp_extract(period_label, '^Year ending Sep (\\d{4})', 1) AS INTEGER), 9, 30), '%Y-%m-%d')
  WHEN regexp_matches(period_label, '^(\\d{4})$') THEN strftime(make_date(CAST(period_label AS INTEGER), 6, 15), '%Y-%m-%d') END"""

SQL["affordability_compare"] = f"""
WITH {LK}, {_fam_price(_Y)}, {_fam_earn()}, {FAM_RATIO},
fams0 AS MATERIALIZED (SELECT 'price' AS family, lad_code, 'Year ending Sep ' || CAST(year AS VARCHAR) AS period_label, round(price, 4) AS value FROM fa
  UNION ALL SELECT 'earnings', lad_code, CAST(year AS VARCHAR), earnings FROM fb
  UNION ALL SELECT 'ratio', lad_code, CAST(year AS VARCHAR), ratio FROM fc),
labels AS MATERIALIZED (SELECT period_label, {_PE_YEAR} AS pe_year, {_SORT_DATE} AS sort_date FROM (SELECT DISTINCT period_label FROM fams0)),
fams AS MATERIALIZED (SELECT fams0.*, pe_year, sort_date FROM fams0 JOIN labels USING (period_label)),
common AS MATERIALIZED (SELECT pe_year FROM fams GROUP BY pe_year HAVING count(DISTINCT family) = 3)
SELECT family, lad_code, period_label, pe_year, sort_date, value FROM fams JOIN common USING (pe_year)"""

SQL["population_by_la"] = f"""
WITH {LK}
SELECT lk.lad_code, lk.lad_name, CAST(coalesce(sum(observation), 0) AS BIGINT) AS population, 2021 AS year
FROM (SELECT c_nationkey, c_mktsegment, count(*) AS observation FROM customer GROUP BY ALL) c JOIN lk ON c.c_nationkey = lk.nationkey
GROUP BY ALL"""

SQL["mapped_metric"] = f"""
WITH {LK}, {LA}, {POP},
t AS (SELECT lad_code, lad_name, sum(dwellings) AS supply FROM la WHERE financial_year = (SELECT arg_max(financial_year, fy_start) FROM la) GROUP BY ALL),
m AS (SELECT t.lad_code, t.lad_name, CASE WHEN pop.population > 0 THEN t.supply / pop.population END * 1000.0 AS metric
      FROM t LEFT JOIN pop ON t.lad_code = pop.lad_code),
e AS (SELECT list_sort(list_distinct(quantile_cont(metric, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM m WHERE metric IS NOT NULL),
top AS (SELECT lad_code, 'top' AS side FROM m WHERE metric IS NOT NULL ORDER BY metric DESC, lad_code LIMIT 5),
bot AS (SELECT lad_code, 'bottom' AS side FROM m WHERE metric IS NOT NULL ORDER BY metric ASC, lad_code LIMIT 5),
sides AS (SELECT * FROM top UNION ALL SELECT * FROM bot)
SELECT m.lad_code, m.lad_name, round(metric, 4) AS metric,
  CAST(CASE WHEN metric IS NOT NULL THEN greatest(len(list_filter((SELECT edges FROM e), lambda x: x < metric)) - 1, 0) END AS INTEGER) AS bin,
  round((SELECT quantile_cont(metric, 0.5) FROM m), 4) AS median_metric, sides.side
FROM m LEFT JOIN sides ON m.lad_code = sides.lad_code"""

SQL["findings"] = f"""
WITH f1 AS (
  SELECT 1 AS finding_id, printf('%s leads new supply in %s with %.2f', r.region_name, r.financial_year, round(r.dwellings, 2)) AS text
  FROM (SELECT * FROM ({SQL['region_supply_by_fy']}) x WHERE measure = 'O'
          AND financial_year = (SELECT arg_max(financial_year, CAST(left(financial_year, 4) AS INTEGER)) FROM ({SQL['region_supply_by_fy']}) y WHERE measure = 'O')
        ORDER BY dwellings DESC, region_name DESC LIMIT 1) r),
f2 AS (SELECT 2 AS finding_id, printf('%s had the largest change in new supply between %s and %s: %.2f', region_name, fy0, fy1, delta) AS text
       FROM ({SQL['region_change_top']}) z WHERE measure = 'O' AND is_top),
f3 AS (SELECT 3 AS finding_id, printf('%s: price index grew %.2f%% against rents %.2f%%', region_name, round(hpi_growth, 2), round(rent_growth, 2)) AS text
       FROM (SELECT * FROM ({SQL['overlap_growth']}) g ORDER BY growth_gap DESC, region_name DESC LIMIT 1)),
f4 AS (SELECT 4 AS finding_id, printf('%d of %d authorities have a price to earnings ratio above 30, the highest is %.2f',
         count(*) FILTER (WHERE price_earnings_ratio > 30), count(*), round(max(price_earnings_ratio), 2)) AS text
       FROM ({SQL['market_snapshot_la']}) s)
SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4"""

SQL["summary_numbers"] = f"""
WITH {LK}, {LA}, {REG},
lt AS (SELECT lad_code, sum(dwellings) AS t FROM la GROUP BY lad_code),
rt AS (SELECT region_name, sum(dwellings) AS t FROM reg GROUP BY region_name),
lf AS (SELECT arg_max(financial_year, fy_start) AS fy FROM la)
SELECT round(sum(dwellings), 2) AS total_supply, count(DISTINCT lad_code) AS n_las, (SELECT fy FROM lf) AS latest_fy,
  round(sum(dwellings) FILTER (WHERE financial_year = (SELECT fy FROM lf)), 2) AS latest_fy_total,
  (SELECT count(DISTINCT region_name) FROM rt) AS n_regions,
  round((SELECT quantile_cont(t, 0.5) FROM lt), 2) AS median_la_total,
  round((SELECT max(t) FROM rt) / sum(dwellings) * 100.0, 4) AS top_region_share_pct,
  (SELECT count(*) FROM lt WHERE t > (SELECT avg(t) FROM lt)) AS n_las_above_mean
FROM la"""

PS_LA = """psl AS (
  SELECT lk.lad_code AS geography, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN lk ON s_nationkey = lk.nationkey GROUP BY ALL)"""

SERIES = f"""{PRICE_SERIES}, {PS_LA},
sq AS (SELECT lk.region_name, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS ts, sum(o_totalprice) AS value
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN lk ON c_nationkey = lk.nationkey GROUP BY ALL),
s AS (SELECT 'price:' || geography AS series_id, 'region' AS level, 'monthly' AS frequency, month AS ts, value FROM ps
  UNION ALL SELECT 'price:' || geography, 'la', 'monthly', month, value FROM psl
  UNION ALL SELECT 'supply:' || region_name, 'region', 'quarterly', ts, value FROM sq),
cat AS (SELECT series_id, level, frequency, count(*) AS n_points, min(ts) AS first_ts, max(ts) AS last_ts,
          CAST(CASE WHEN lower(frequency) LIKE '%month%' THEN 12 WHEN lower(frequency) LIKE '%quarter%' THEN 4
               WHEN lower(frequency) LIKE '%financial%' OR lower(frequency) LIKE '%calendar%' OR lower(frequency) LIKE '%annual%' THEN 1 ELSE 4 END AS INTEGER) AS season_length,
          CAST(CASE WHEN lower(frequency) LIKE '%annual%' THEN
                 greatest(1, least(15, count(*) - 1))
               ELSE 36 END AS INTEGER) AS min_train
        FROM s WHERE value IS NOT NULL GROUP BY series_id, level, frequency)"""

SQL["series_catalog"] = f"""
WITH {LK}, {SERIES}
SELECT series_id, level, frequency, n_points, strftime(first_ts, '%Y-%m-%d') AS first_ts, strftime(last_ts, '%Y-%m-%d') AS last_ts,
  season_length, min_train FROM cat"""

SQL["backtest_plan"] = f"""
WITH {LK}, {SERIES}
SELECT series_id, CAST(h.horizon AS INTEGER) AS horizon, m.model,
  CASE m.model WHEN 'lagged_gbt' THEN 'spark_ml' ELSE 'sql' END AS engine,
  CAST(greatest(n_points - h.horizon - min_train + 1, 0) AS BIGINT) AS n_origins,
  CAST(CASE WHEN h.horizon <= 1 THEN 1 WHEN h.horizon <= 3 THEN 3 WHEN h.horizon <= 6 THEN 6 WHEN h.horizon <= 12 THEN 12 ELSE 24 END AS INTEGER) AS horizon_bucket
FROM cat CROSS JOIN (VALUES (1), (3), (6), (12)) h(horizon)
  CROSS JOIN (VALUES ('seasonal_naive'), ('seasonal_repeat'), ('drift'), ('smoothing'), ('ensemble'), ('lagged_gbt')) m(model)"""

_Z10 = "1.2815515655446004"
_Z95 = "1.959963984540054"


def _sigma(length: str, season: int) -> str:
    nd = f"(CASE WHEN {length} > {season} THEN {length} - {season} ELSE {length} - 1 END)"
    s = f"(CASE WHEN {length} > {season} THEN sds ELSE sd1 END)"
    ss = f"(CASE WHEN {length} > {season} THEN sdds ELSE sdd1 END)"
    sd = f"sqrt(greatest({ss} / CAST({nd} AS DOUBLE) - ({s} / CAST({nd} AS DOUBLE)) * ({s} / CAST({nd} AS DOUBLE)), 0.0))"
    fb = f"greatest(sqrt(greatest(syy / CAST({length} AS DOUBLE) - (sy / CAST({length} AS DOUBLE)) * (sy / CAST({length} AS DOUBLE)), 0.0)), 1e-6)"
    return f"CASE WHEN {length} >= 6 AND {nd} >= 3 AND {sd} > 1e-12 THEN {sd} ELSE {fb} END"


def _pts(frequency: str, season: int) -> str:
    return f"""pts AS MATERIALIZED (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS INTEGER) AS t, value AS y
             FROM s WHERE frequency = '{frequency}' AND value IS NOT NULL),
n AS MATERIALIZED (SELECT series_id, count(*) AS n FROM pts GROUP BY series_id),
st AS MATERIALIZED (SELECT series_id, t, y,
         sum(y) OVER run AS sy, sum(y * y) OVER run AS syy, sum(ds) OVER run AS sds, sum(ds * ds) OVER run AS sdds,
         sum(d1) OVER run AS sd1, sum(d1 * d1) OVER run AS sdd1
       FROM (SELECT *, y - lag(y, {season}) OVER (PARTITION BY series_id ORDER BY t) AS ds, y - lag(y, 1) OVER (PARTITION BY series_id ORDER BY t) AS d1 FROM pts)
       WINDOW run AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
holt(series_id, a, b, t, level, trend, sse) AS (
  SELECT y0.series_id, CAST(ga.a AS DOUBLE), CAST(gb.b AS DOUBLE), 1, y1.y, y1.y - y0.y, CAST(0 AS DOUBLE)
  FROM pts y0 JOIN pts y1 ON y1.series_id = y0.series_id AND y0.t = 0 AND y1.t = 1,
       (VALUES (0.2), (0.4), (0.6), (0.8)) ga(a), (VALUES (0.1), (0.3)) gb(b)
  UNION ALL
  SELECT h.series_id, a, b, p.t, a * y + (1.0 - a) * (level + trend),
    b * ((a * y + (1.0 - a) * (level + trend)) - level) + (1.0 - b) * trend, sse + (y - (level + trend)) * (y - (level + trend))
  FROM holt h JOIN pts p ON p.series_id = h.series_id AND p.t = h.t + 1),
hs AS MATERIALIZED (SELECT series_id, t + 1 AS o, arg_min(level, (sse, a, b)) AS level, arg_min(trend, (sse, a, b)) AS trend
       FROM holt WHERE t + 1 >= 8 GROUP BY series_id, t)"""


_SEASONS = {"monthly": 12, "quarterly": 4}


def _backtest(frequency: str, season: int) -> str:
    sn = f"CASE WHEN o >= {season} + horizon AND horizon <= {season} THEN y_sn END"
    rep = f"CASE WHEN o >= {season} THEN y_rep END"
    smooth = "level + k * trend"
    models = {"seasonal_naive": sn, "seasonal_repeat": rep, "drift": "CASE WHEN o >= 2 THEN y_last + k * (y_last - y_prev) END", "smoothing": smooth,
              "ensemble": f"coalesce(({rep} + ({smooth})) / 2.0, {rep}, {smooth})"}
    preds = "\n  UNION ALL ".join(f"SELECT series_id, horizon, o, k, y, sigma, {sn} AS naive, '{m}' AS model, {e} AS pred FROM x" for m, e in models.items())
    return f"""(WITH RECURSIVE {_pts(frequency, season)},
orig AS (SELECT series_id, horizon, unnest(generate_series(36, n - horizon)) AS o FROM n, (VALUES (1), (3), (6), (12)) hz(horizon) WHERE n - horizon >= 36),
og AS (SELECT orig.series_id, horizon, orig.o, st.y AS y_last, {_sigma('orig.o', season)} AS sigma, p.y AS y_prev, hs.level, hs.trend
       FROM orig JOIN st ON st.series_id = orig.series_id AND st.t = orig.o - 1
       LEFT JOIN pts p ON p.series_id = orig.series_id AND p.t = orig.o - 2
       LEFT JOIN hs ON hs.series_id = orig.series_id AND hs.o = orig.o),
cells AS (SELECT og.*, unnest(generate_series(1, horizon)) AS k FROM og),
x AS MATERIALIZED (SELECT c.*, a.y, sn.y AS y_sn, rep.y AS y_rep FROM cells c
      JOIN pts a ON a.series_id = c.series_id AND a.t = c.o + c.k - 1
      LEFT JOIN pts sn ON sn.series_id = c.series_id AND sn.t = c.o - {season} + c.k - 1
      LEFT JOIN pts rep ON rep.series_id = c.series_id AND rep.t = c.o - {season} + (c.k - 1) % {season}),
preds AS ({preds}),
b AS (SELECT *, pred - {_Z10} * (sigma * sqrt(CAST(k AS DOUBLE))) AS p10, pred AS p50, pred + {_Z10} * (sigma * sqrt(CAST(k AS DOUBLE))) AS p90 FROM preds)
SELECT series_id, horizon, model, o,
        avg(abs(pred - y)) AS mae, sqrt(avg((pred - y) * (pred - y))) AS rmse,
        avg(CASE WHEN abs(y) >= 1e-9 THEN abs((pred - y) / y) END) * 100.0 AS mape,
        avg(CASE WHEN naive IS NOT NULL THEN abs(pred - y) END) / greatest(avg(CASE WHEN naive IS NOT NULL THEN abs(y - naive) END), 1e-12) AS mase,
        avg(CASE WHEN y >= p10 AND y <= p90 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS coverage_p10_p90,
        avg(greatest(0.1 * (y - p10), (0.1 - 1.0) * (y - p10))) AS pinball_p10,
        avg(greatest(0.5 * (y - p50), (0.5 - 1.0) * (y - p50))) AS pinball_p50,
        avg(greatest(0.9 * (y - p90), (0.9 - 1.0) * (y - p90))) AS pinball_p90
      FROM b GROUP BY series_id, horizon, model, o HAVING count(pred) = horizon)"""


SQL["seasonal_naive_backtest"] = f"""
WITH {LK}, {SERIES.replace("s AS (SELECT 'price:'", "s AS MATERIALIZED (SELECT 'price:'")},
w AS ({" UNION ALL ".join(f"SELECT * FROM {_backtest(f, n)}" for f, n in _SEASONS.items())}),
sm AS MATERIALIZED (SELECT series_id, horizon, model, count(*) AS n_windows, avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape, avg(mase) AS mase,
         avg(coverage_p10_p90) AS coverage_p10_p90, avg(pinball_p10) AS pinball_p10, avg(pinball_p50) AS pinball_p50, avg(pinball_p90) AS pinball_p90
       FROM w GROUP BY series_id, horizon, model),
best AS (SELECT series_id, horizon, arg_min(model, (round(mae, 6), model)) AS best FROM sm WHERE mae IS NOT NULL GROUP BY series_id, horizon)
SELECT sm.series_id, CAST(sm.horizon AS INTEGER) AS horizon, model, n_windows, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape, 4) AS mape, round(mase, 4) AS mase,
  round(coverage_p10_p90, 6) AS coverage_p10_p90, round(pinball_p10, 4) AS pinball_p10, round(pinball_p50, 4) AS pinball_p50,
  round(pinball_p90, 4) AS pinball_p90, coalesce(model = best.best, FALSE) AS is_best
FROM sm LEFT JOIN best ON sm.series_id = best.series_id AND sm.horizon = best.horizon"""


def _bands_sql(frequency: str, season: int) -> str:
    h = min(6, season)
    return f"""(WITH RECURSIVE {_pts(frequency, season)},
nn AS (SELECT * FROM n WHERE n >= {season} + {h}),
og AS (SELECT nn.series_id, nn.n, st.y AS last_value, {_sigma('nn.n', season)} AS sigma FROM nn JOIN st ON st.series_id = nn.series_id AND st.t = nn.n - 1),
cells AS (SELECT og.*, unnest(generate_series(1, {h})) AS h FROM og)
SELECT cells.*, p.y AS point FROM cells JOIN pts p ON p.series_id = cells.series_id AND p.t = cells.n - {season} + cells.h - 1)"""


SQL["prob_bands"] = f"""
WITH {LK}, {SERIES},
x AS ({" UNION ALL ".join(f"SELECT * FROM {_bands_sql(f, n)}" for f, n in _SEASONS.items())})
SELECT series_id, CAST(h AS INTEGER) AS h, round(point, 4) AS point,
  round(point - {_Z10} * (sigma * sqrt(CAST(h AS DOUBLE))), 4) AS p10, round(point, 4) AS p50,
  round(point + {_Z10} * (sigma * sqrt(CAST(h AS DOUBLE))), 4) AS p90,
  round(point - {_Z95} * (sigma * sqrt(CAST(h AS DOUBLE))), 4) AS lower,
  round(point + {_Z95} * (sigma * sqrt(CAST(h AS DOUBLE))), 4) AS upper,
  round(last_value, 4) AS last_value, round((point / nullif(last_value, 0) - 1.0) * 100.0, 4) AS pct_vs_last
FROM x"""


def _forward_sql(frequency: str, season: int) -> str:
    smooth = f"level + {season} * trend"
    models = {"seasonal_repeat": "y_rep", "smoothing": smooth, "ensemble": f"coalesce((y_rep + ({smooth})) / 2.0, y_rep, {smooth})"}
    each = " UNION ALL ".join(f"SELECT series_id, '{m}' AS model, last_value, sigma, {e} AS end_level FROM x" for m, e in models.items())
    return f"""(WITH RECURSIVE {_pts(frequency, season)},
x AS MATERIALIZED (SELECT n.series_id, st.y AS last_value, {_sigma('n.n', season)} AS sigma, hs.level, hs.trend, r.y AS y_rep
      FROM n JOIN st ON st.series_id = n.series_id AND st.t = n.n - 1 LEFT JOIN hs ON hs.series_id = n.series_id AND hs.o = n.n
      LEFT JOIN pts r ON r.series_id = n.series_id AND r.t = n.n - {season} + ({season} - 1) % {season})
SELECT *, {season} AS horizon, {_Z10} * sigma * sqrt(CAST({season} AS DOUBLE)) AS half FROM ({each}))"""


SQL["forward_forecasts"] = f"""
WITH {LK}, {SERIES},
x AS ({" UNION ALL ".join(f"SELECT * FROM {_forward_sql(f, n)}" for f, n in _SEASONS.items())})
SELECT series_id, model, CAST(horizon AS INTEGER) AS horizon, round(last_value, 4) AS last_value, round(end_level, 4) AS end_level,
  round((end_level / nullif(last_value, 0) - 1.0) * 100.0, 4) AS pct_change, round(end_level - half, 4) AS p10, round(end_level + half, 4) AS p90,
  CASE WHEN end_level IS NULL THEN 'too few points' END AS error
FROM x"""

_BIN = """
  SELECT {keys}, count(*) AS n, avg(CAST(y AS DOUBLE)) AS positive_rate, avg((score - y) * (score - y)) AS brier,
    count(*) FILTER (WHERE score >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND y = 0) AS fp,
    count(*) FILTER (WHERE score < 0.5 AND y = 1) AS fn, CAST(sum(y) AS DOUBLE) AS pos
  FROM long GROUP BY {keys}"""

SQL["classifier_metrics"] = f"""
WITH x AS (SELECT d.doc_id, round(1.0 / (1.0 + exp(-(CAST(n_chars - 2400 AS DOUBLE) / 1500.0))), 3) AS score, quality, toxic
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
long AS (SELECT doc_id, score, 'quality' AS target, quality AS y, CAST(doc_id % 5 AS INTEGER) AS fold FROM x
         UNION ALL SELECT doc_id, score, 'toxic', toxic, CAST(doc_id % 5 AS INTEGER) FROM x),
base AS ({_BIN.format(keys='target')}),
fb AS (SELECT target, avg(brier) AS mean_fold_brier FROM ({_BIN.format(keys='target, fold')}) GROUP BY target),
lv AS (SELECT target, score, CAST(sum(y) AS DOUBLE) AS lp, CAST(sum(1 - y) AS DOUBLE) AS ln FROM long GROUP BY target, score),
lb AS (SELECT *, coalesce(sum(ln) OVER (PARTITION BY target ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM lv),
auc AS (SELECT target, sum(lp * (below + 0.5 * ln)) AS num FROM lb GROUP BY target)
SELECT base.target, n, round(positive_rate, 6) AS positive_rate, round(brier, 6) AS brier,
  round(CASE WHEN pos > 0 AND n - pos > 0 THEN num / (pos * (n - pos)) END, 6) AS auc,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1,
  round(mean_fold_brier, 6) AS mean_fold_brier
FROM base JOIN auc ON base.target = auc.target JOIN fb ON base.target = fb.target"""

SQL["buy_vs_rent_spread"] = f"""
WITH {LK}, {TWO},
g AS (SELECT geography, arg_min(hpi, month) AS h0, arg_max(hpi, month) AS h1, arg_min(rent, month) AS r0, arg_max(rent, month) AS r1,
        min(month) AS m0, max(month) AS m1, count(*) AS n FROM both_s GROUP BY geography),
x AS (SELECT geography, m0, m1, (h1 / h0 * 100.0 - 100.0) - (r1 / r0 * 100.0 - 100.0) AS spread_pp FROM g WHERE n >= 2 AND h0 <> 0 AND r0 <> 0)
SELECT geography AS region_name, strftime(m0, '%Y-%m-%d') AS first_month, strftime(m1, '%Y-%m-%d') AS last_month, round(spread_pp, 6) AS spread_pp,
  printf('%s, up to %s: house prices have outgrown rents by %+.1f points since their first shared month (both start at 100).',
         geography, strftime(m1, '%b %Y'), round(spread_pp, 1)) AS caption
FROM x"""

SQL["national_ratio_endpoints"] = f"""
WITH {LK}, {HORIZON},
p AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, quantile_cont(o_totalprice, 0.5) AS price FROM orders GROUP BY 1),
e AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS earnings FROM lineitem GROUP BY 1),
r AS (SELECT p.year, CASE WHEN earnings > 0 THEN price / earnings END AS ratio FROM p JOIN e ON p.year = e.year),
one AS (SELECT max(ratio) FILTER (WHERE year = (SELECT y_min FROM bounds)) AS ratio_start, max(ratio) FILTER (WHERE year = (SELECT y_max FROM bounds)) AS ratio_end FROM r)
SELECT CAST((SELECT y_min FROM bounds) AS INTEGER) AS y_min, CAST((SELECT y_max FROM bounds) AS INTEGER) AS y_max,
  round(ratio_start, 6) AS ratio_start, round(ratio_end, 6) AS ratio_end, round(ratio_end - ratio_start, 6) AS change
FROM one"""

SQL["narrative_panels"] = f"""
WITH {LK}, {LA}, {REG}, {_SNAP_PARTS},
p1 AS (SELECT 'supply_by_fy' AS panel, financial_year AS label, round(sum(dwellings), 2) AS value FROM reg
       WHERE contains(lower(region_name), 'europe') GROUP BY financial_year),
p2 AS (SELECT 'fuel_top15' AS panel, lad_code AS label, fuel_share_a AS value FROM fuel ORDER BY fuel_share_a DESC NULLS LAST, lad_code LIMIT 15),
rt AS (SELECT code, name, starts_per_1000 FROM ({SQL['rates_per_1000']}) WHERE geography_level = 'region'),
sh AS (SELECT DISTINCT region_name, abc_share FROM ({SQL['band_share_abc']})),
p3 AS (SELECT 'rate_per_share_point' AS panel, rt.name AS label, round(CASE WHEN sh.abc_share > 0 THEN rt.starts_per_1000 / sh.abc_share END, 3) AS value
       FROM rt JOIN sh ON rt.name = sh.region_name)
SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3"""

# Section -> key columns, number columns, text column.
_BRIEFING = {
    "horizon_deltas": (["lad_code"], ["delta_median_price", "delta_earnings", "delta_ratio"], None),
    "entry_pressure": (["region_name"], ["n_las", "n_entry_pressure", "median_delta_ratio"], None),
    "region_change_top": (["measure", "region_name"], ["total0", "total1", "delta"], None),
    "index_rebased": (["region_name", "month"], ["hpi_index_base", "hpi_index", "rent_index", "spread", "ratio"], None),
    "national_ratio_endpoints": (["y_min", "y_max"], ["ratio_start", "ratio_end", "change"], None),
    "findings": (["finding_id"], [], "text"),
    "missing_inputs": (["lang"], ["n_docs", "n_unlabelled"], "missing_sources"),
}
_LONG = []
for _name, (_keys, _numbers, _text) in _BRIEFING.items():
    _item = " || '|' || ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in _keys)
    _LONG += [f"SELECT '{_name}' AS section, {_item} AS item, '{c}' AS field, round(CAST({c} AS DOUBLE), 4) AS value, CAST(NULL AS VARCHAR) AS text FROM {_name}" for c in _numbers]
    _LONG += [f"SELECT '{_name}', {_item}, '{_text}', CAST(NULL AS DOUBLE), CAST({_text} AS VARCHAR) FROM {_name}"] if _text else []
SQL["briefing_sections"] = (
    "WITH " + ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in _BRIEFING) + " " + " UNION ALL ".join(_LONG))


_FOLDS = f"""{LK},
cust AS (SELECT c_custkey, c_nationkey, (SELECT region_name FROM lk WHERE lk.nationkey = c_nationkey) AS region_name FROM customer),
tot AS (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total_value FROM orders GROUP BY o_custkey),
x AS (SELECT region_name, coalesce(n_orders, 0) AS n_orders, coalesce(total_value, 0) AS total_value FROM cust LEFT JOIN tot ON c_custkey = o_custkey),
folds AS (SELECT region_name, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, region_name) - 1 AS INTEGER) AS fold FROM x GROUP BY region_name)"""

# Five regions and five folds: the greedy choice gives each region its own fold, by size.
SQL["fold_assignment"] = f"""
WITH {_FOLDS}
SELECT region_name, fold, n FROM folds"""

SQL["fold_metrics"] = f"""
WITH {_FOLDS},
s AS (SELECT fold, total_value AS actual, total_value - n_orders * CAST(150000 AS DOUBLE) AS residual FROM x JOIN folds ON x.region_name = folds.region_name)
SELECT fold, count(*) AS n, round(1 - sum(residual * residual) / (sum(actual * actual) - sum(actual) * sum(actual) / count(actual)), 6) AS r2,
  round(avg(abs(residual)), 2) AS mae, round(sqrt(avg(residual * residual)), 2) AS rmse
FROM s GROUP BY fold"""

_DRIVERS = {"supply_f": 1, "supply_o": 1, "supply_p": 1, "population": 1, "median_price": 1, "mean_earnings": 1, "price_earnings_ratio": -1, "fuel_share_a": 1, "fuel_share_n": 1, "fuel_share_r": 1}
_Z = {c: f"(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0)) * {v}.0" for c, v in _DRIVERS.items()}
SQL["scenario_shocks"] = f"""
WITH snap AS MATERIALIZED ({SQL['market_snapshot_la']}),
z AS (SELECT *, {", ".join(f"{e} AS z_{c}" for c, e in _Z.items())} FROM snap)
SELECT lad_code, round(({" + ".join(f"coalesce(z_{c}, 0)" for c in _DRIVERS)})
    / nullif({" + ".join(f"CAST(z_{c} IS NOT NULL AS INTEGER)" for c in _DRIVERS)}, 0), 6) AS driver_score,
  {", ".join(f"round({c} * (1.0 + CAST({s} AS DOUBLE) * {v}), 4) AS {c}_{n}" for n, s in (("low", -0.1), ("high", 0.1)) for c, v in _DRIVERS.items())}
FROM z"""
