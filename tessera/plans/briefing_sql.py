"""DuckDB statements of the queries in ``briefing`` (same names, same output columns)."""

from __future__ import annotations

from . import extended_sql, oracle
from .oracle import _BAND, BANDS, HORIZON, LA, LK, PRICE_SERIES, RENT_SERIES

SQL: dict[str, str] = {}
_O, _X = oracle.SQL, extended_sql.SQL

# Metric -> column and label, as in ``briefing.METRICS``.
_LABELS = {
    "count": "format('{:,}', CAST(round(value, 0) AS BIGINT))",
    "share": "format('{:,.1f}', round(value, 1))",
    "decimal": "format('{:,.2f}', round(value, 2))",
    "pound": "'£' || format('{:,}', CAST(round_even(value, 0) AS BIGINT))",
    "signed": "CASE WHEN round(value, 1) >= 0 THEN '+' ELSE '' END || format('{:,.1f}', round(value, 1))",
}
_METRICS = {
    "house_building": ("supply_o", "count"), "house_building_per_1000": ("starts_per_1000", "decimal"), "house_building_mainfuel": ("fuel_share_a", "share"),
    "median_price_existing": ("median_price_existing", "pound"), "median_price_new": ("median_price_new", "pound"),
    "affordability_ratio": ("workplace_ratio", "decimal"), "snapshot_vacant_per_100": ("vacant_per_100", "share"),
    "snapshot_hpi_12m_pct": ("hpi_12m_pct", "signed"), "epc_band_c": ("c_share", "share"),
}
_LONG = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, lad_code, lad_name, coalesce(region_name, '—') AS region_name, CAST({c} AS DOUBLE) AS value, '{style}' AS style FROM wide" for m, (c, style) in _METRICS.items())
_LABEL = "CASE style " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _LABELS.items()) + " END"

SQL["mapped_metrics"] = f"""
WITH snap AS MATERIALIZED ({_X['full_snapshot_la']}), band AS MATERIALIZED (SELECT lad_code, round(c_share, 6) AS c_share FROM ({_O['band_share_abc']})),
wide AS MATERIALIZED (SELECT snap.*, c_share, round(CASE WHEN population > 0 THEN supply_o / population * 1000.0 END, 6) AS starts_per_1000 FROM snap LEFT JOIN band USING (lad_code)),
m AS MATERIALIZED ({_LONG}),
st AS (SELECT metric, list_sort(list_distinct(quantile_cont(value, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges, quantile_cont(value, 0.5) AS med, count(value) AS n
  FROM m WHERE value IS NOT NULL GROUP BY metric)
SELECT m.metric, lad_code, lad_name, region_name, value, coalesce({_LABEL}, '—') AS label,
  CAST(CASE WHEN value IS NOT NULL THEN greatest(len(list_filter(edges, lambda x: x < value)) - 1, 0) END AS INTEGER) AS bin,
  round(med, 4) AS median_value, coalesce(n, 0) AS n_values,
  value IS NOT NULL AND row_number() OVER (PARTITION BY m.metric ORDER BY value DESC NULLS LAST, lad_code) <= 5 AS is_top,
  value IS NOT NULL AND row_number() OVER (PARTITION BY m.metric ORDER BY value ASC NULLS LAST, lad_code) <= 5 AS is_bottom
FROM m LEFT JOIN st ON m.metric = st.metric"""

SQL["price_watchlist"] = f"""
WITH {LK}, {HORIZON}
SELECT lk.lad_code, lk.lad_name, CAST(fa.year AS INTEGER) AS year, round(price, 4) AS median_price FROM fa JOIN lk ON fa.lad_code = lk.lad_code
WHERE lad_name IN ('NATION_3', 'NATION_7', 'NATION_12', 'NATION_21') AND year BETWEEN (SELECT y_min FROM bounds) AND (SELECT y_max FROM bounds)"""

SQL["entry_gaps"] = f"""
WITH {LK}, {HORIZON},
x AS (SELECT lk.lad_code, lk.lad_name, round(delta_median_price, 4) AS d_median, round(d_lq, 4) AS d_lq, round(d_lq - delta_median_price, 4) AS gap
  FROM dp JOIN lk ON dp.lad_code = lk.lad_code WHERE delta_median_price IS NOT NULL AND d_lq IS NOT NULL)
SELECT *, CAST(row_number() OVER (ORDER BY gap DESC, lad_code) AS INTEGER) AS position FROM x"""

SQL["rent_inflation_panel"] = f"""
WITH {LK}, {RENT_SERIES},
yoy AS (SELECT a.geography AS region_name, CAST(year(a.month) AS INTEGER) AS year, avg((a.value / nullif(b.value, 0) - 1.0) * 100.0) AS rent_yoy
  FROM rs a LEFT JOIN rs b ON a.geography = b.geography AND b.month = a.month - INTERVAL 12 MONTH GROUP BY ALL),
price AS (SELECT region_name, CAST(year(o_orderdate) AS INTEGER) AS year, quantile_cont(o_totalprice, 0.5) AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lk ON c_nationkey = nationkey GROUP BY ALL),
earn AS (SELECT region_name, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS earnings
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN lk ON s_nationkey = nationkey GROUP BY ALL)
SELECT region_name, year, round(rent_yoy, 6) AS rent_yoy_avg, round(CASE WHEN earnings > 0 THEN price / earnings END, 6) AS affordability_ratio
FROM yoy JOIN price USING (region_name, year) JOIN earn USING (region_name, year)"""

SQL["starts_explorer"] = f"""
WITH {LK}, {LA},
x AS MATERIALIZED (SELECT la.*, region_name FROM la JOIN lk ON la.lad_code = lk.lad_code WHERE measure = 'O' AND region_name IN ('EUROPE', 'ASIA')),
k AS (SELECT sum(dwellings) AS t, CAST(count(DISTINCT lad_name) AS DOUBLE) AS l, CAST(count(DISTINCT financial_year) AS DOUBLE) AS y FROM x),
n AS (SELECT lad_name AS label, region_name, round(sum(dwellings), 2) AS value FROM x GROUP BY ALL),
f AS (SELECT financial_year AS label, fy_start, sum(dwellings) AS value FROM x GROUP BY ALL),
a AS (SELECT 'totals' AS panel, 'total_starts' AS label, CAST(NULL AS VARCHAR) AS region_name, CAST(NULL AS INTEGER) AS position, t AS value FROM k
  UNION ALL SELECT 'totals', 'n_las', NULL, NULL, l FROM k UNION ALL SELECT 'totals', 'n_years', NULL, NULL, y FROM k
  UNION ALL SELECT 'by_year', label, NULL, CAST(row_number() OVER (ORDER BY fy_start) AS INTEGER), value FROM f
  UNION ALL SELECT 'by_la', label, region_name, CAST(row_number() OVER (ORDER BY value DESC NULLS LAST, label) AS INTEGER), value FROM n)
SELECT panel, label, region_name, position, round(value, 2) AS value FROM a"""

SQL["energy_trend"] = f"""
WITH {LK},
l AS MATERIALIZED (SELECT region_name, CAST(year(l_shipdate) AS INTEGER) AS year, {_BAND} AS band
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN lk ON s_nationkey = nationkey),
b AS (SELECT region_name AS geography, year, count(*) FILTER (WHERE band IN ('A','B','C')) AS good, count(*) AS n FROM l GROUP BY ALL
  UNION ALL SELECT 'All regions', year, count(*) FILTER (WHERE band IN ('A','B','C')), count(*) FROM l GROUP BY ALL),
w AS (SELECT geography, year, sum(good) OVER r AS g, sum(n) OVER r AS t FROM b WINDOW r AS (PARTITION BY geography ORDER BY year RANGE BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT geography, CAST(year - 4 AS VARCHAR) || ' to ' || CAST(year AS VARCHAR) AS rolling_period,
  CAST(dense_rank() OVER (PARTITION BY geography ORDER BY year) AS INTEGER) AS position, round(g * 100.0 / t, 6) AS abc_share
FROM w WHERE year >= (SELECT min(year) FROM b) + 4"""

SQL["supply_vs_energy"] = f"""
WITH la_ AS ({_X['full_snapshot_la']}), reg_ AS ({_X['full_snapshot_region']})
SELECT lad_code, lad_name, la_.region_name, round(CASE WHEN la_.population > 0 THEN supply_o / la_.population * 1000.0 END, 4) AS starts_per_1000, rolling_abc_share, rolling_period
FROM la_ JOIN reg_ ON la_.region_name = reg_.region_name WHERE la_.population > 0 AND supply_o IS NOT NULL AND rolling_abc_share IS NOT NULL"""

SQL["hero_metrics"] = f"""
WITH ends AS MATERIALIZED ({_O['national_ratio_endpoints']}), ep AS ({_O['entry_pressure']}), ch AS MATERIALIZED ({_O['region_change_top']}),
s AS (SELECT * FROM ch WHERE measure = 'O' AND is_top), rk AS MATERIALIZED (SELECT DISTINCT region_name, abc_share FROM ({_O['band_share_abc']}) WHERE abc_share IS NOT NULL),
t AS (SELECT * FROM rk ORDER BY abc_share DESC, region_name LIMIT 1), l AS (SELECT * FROM rk ORDER BY abc_share, region_name LIMIT 1)
SELECT ratio_start, ratio_end, printf('%+.2f vs %d', round(change, 2), y_min) AS ratio_delta, (SELECT CAST(sum(n_entry_pressure) AS BIGINT) FROM ep) AS entry_pressure_n,
  (SELECT region_name FROM s) AS supply_region, (SELECT delta FROM s) AS supply_delta, (SELECT fy0 FROM s) AS supply_fy0, (SELECT fy1 FROM s) AS supply_fy1,
  (SELECT region_name FROM t) AS epc_best_region, (SELECT abc_share FROM t) AS epc_best_pct,
  (SELECT region_name FROM l) AS epc_worst_region, (SELECT abc_share FROM l) AS epc_worst_pct
FROM ends"""


def _n2(c: str) -> str:
    return f"format('{{:,.2f}}', round({c}, 2))"


def _n0(c: str) -> str:
    return f"format('{{:,}}', CAST(round({c}, 0) AS BIGINT))"


SQL["findings_by_topic"] = f"""
WITH de AS MATERIALIZED ({_O['horizon_deltas']}), h AS MATERIALIZED ({SQL['hero_metrics']}), ga AS MATERIALIZED ({SQL['entry_gaps']}),
pa AS MATERIALIZED ({SQL['rent_inflation_panel']}), su AS MATERIALIZED ({_O['region_supply_by_fy']}),
md AS MATERIALIZED (SELECT region_name, round(quantile_cont(delta_ratio, 0.5), 6) AS m FROM de GROUP BY region_name),
yb AS MATERIALIZED (SELECT min(year) AS y0, max(year) AS y1 FROM pa),
mv AS MATERIALIZED (SELECT a.region_name, b.affordability_ratio AS v1, round(b.affordability_ratio - a.affordability_ratio, 6) AS dv,
    round(CASE WHEN a.affordability_ratio > 0 THEN b.affordability_ratio / a.affordability_ratio * 100.0 END, 6) AS idx
  FROM pa a JOIN pa b ON a.region_name = b.region_name WHERE a.year = (SELECT y0 FROM yb) AND b.year = (SELECT y1 FROM yb)),
vo AS MATERIALIZED (SELECT region_name, financial_year, measure, round(sum(dwellings), 2) AS v FROM su WHERE region_name IS NOT NULL
  AND financial_year = (SELECT arg_max(financial_year, CAST(left(financial_year, 4) AS INTEGER)) FROM su) GROUP BY ALL),
f AS (
  SELECT 'affordability' AS topic, 1 AS position, (SELECT lad_name || ' saw its price to earnings ratio rise most, by ' || {_n2('delta_ratio')} || ' from ' || y_min || ' to ' || y_max
    FROM de WHERE delta_ratio IS NOT NULL ORDER BY delta_ratio DESC, lad_code LIMIT 1) AS text
  UNION ALL SELECT 'affordability', 2, (SELECT 'Half of the authorities of ' || region_name || ' rose by ' || {_n2('m')} || ' or more, the highest regional median' FROM md WHERE m IS NOT NULL ORDER BY m DESC, region_name LIMIT 1)
  UNION ALL SELECT 'entry', 1, (SELECT entry_pressure_n || ' authorities have lower-quartile prices that grew more than their medians' FROM h)
  UNION ALL SELECT 'entry', 2, (SELECT 'The widest entry gap is in ' || lad_name || ': ' || {_n0('gap')} || ' (lower quartile ' || {_n0('d_lq')} || ', median ' || {_n0('d_median')} || ')' FROM ga WHERE position = 1)
  UNION ALL SELECT 'regions', 1, (SELECT region_name || ' has the highest ratio of ' || (SELECT y1 FROM yb) || ': ' || {_n2('v1')} FROM mv WHERE v1 IS NOT NULL ORDER BY v1 DESC, region_name LIMIT 1)
  UNION ALL SELECT 'regions', 2, (SELECT 'From ' || (SELECT y0 FROM yb) || ' to ' || (SELECT y1 FROM yb) || ' the ratio of ' || region_name || ' moved up most: ' || {_n2('dv')} FROM mv WHERE dv IS NOT NULL ORDER BY dv DESC, region_name LIMIT 1)
  UNION ALL SELECT 'regions', 3, (SELECT 'With ' || (SELECT y0 FROM yb) || ' as 100, ' || region_name || ' stands highest in ' || (SELECT y1 FROM yb) || ' at ' || {_n2('idx')} FROM mv WHERE idx IS NOT NULL ORDER BY idx DESC, region_name LIMIT 1)
  UNION ALL SELECT 'supply', 1, (SELECT 'Starts changed most in ' || supply_region || ' between ' || supply_fy0 || ' and ' || supply_fy1 || ': ' || {_n2('supply_delta')} FROM h)
  UNION ALL SELECT 'supply', 2, (SELECT region_name || ' has the most starts of ' || financial_year || ': ' || {_n2('v')} FROM vo WHERE measure = 'O' ORDER BY v DESC, region_name LIMIT 1)
  UNION ALL SELECT 'supply', 3, (SELECT region_name || ' has the most completions of ' || financial_year || ': ' || {_n2('v')} FROM vo WHERE measure = 'F' ORDER BY v DESC, region_name LIMIT 1)
  UNION ALL SELECT 'energy', 1, (SELECT 'Bands A to C are most common in ' || epc_best_region || ' (' || {_n2('epc_best_pct')} || '%), least in ' || epc_worst_region || ' (' || {_n2('epc_worst_pct')} || '%)' FROM h)
  UNION ALL SELECT 'energy', 2, (SELECT {_n2('round(epc_best_pct - epc_worst_pct, 6)')} || ' points lie between the two' FROM h))
SELECT topic, position, text, 'These lines restate published figures by fixed rules; they explain no causes.' AS note FROM f WHERE text IS NOT NULL"""


def _items(table: str, section: str, item: str, numbers: list[str], texts: list[str] = ()) -> str:
    parts = [f"SELECT '{section}' AS section, {item} AS item, '{c}' AS field, round(CAST({c} AS DOUBLE), 6) AS value, CAST(NULL AS VARCHAR) AS text FROM {table}" for c in numbers]
    parts += [f"SELECT '{section}' AS section, {item} AS item, '{c}' AS field, CAST(NULL AS DOUBLE) AS value, CAST({c} AS VARCHAR) AS text FROM {table}" for c in texts]
    return " UNION ALL ".join(parts)


SQL["narrative_statistics"] = f"""
WITH {LK}, {LA}, snap AS MATERIALIZED ({_O['market_snapshot_la']}), tr AS MATERIALIZED (SELECT * FROM ({SQL['energy_trend']}) WHERE geography = 'All regions'),
r AS MATERIALIZED (SELECT count(*) AS rows, count(price_earnings_ratio) AS ratio_non_null, count(*) FILTER (WHERE price_earnings_ratio > 30) AS ratio_high, max(price_earnings_ratio) AS ratio_max FROM snap),
m AS MATERIALIZED (SELECT region_name, round(quantile_cont(median_price, 0.5), 0) AS median_price FROM snap GROUP BY region_name),
y AS MATERIALIZED (SELECT financial_year, fy_start, round(sum(dwellings), 2) AS v FROM la WHERE measure = 'O' GROUP BY ALL),
s AS MATERIALIZED (SELECT arg_min(financial_year, fy_start) AS period_min, arg_max(financial_year, fy_start) AS period_max, arg_min(v, fy_start) AS starts_first, arg_max(v, fy_start) AS starts_last,
  count(*) AS financial_years, count(*) FILTER (WHERE v > 200000) AS years_high FROM y),
e AS MATERIALIZED (SELECT arg_min(rolling_period, position) AS first_period, arg_max(rolling_period, position) AS last_period,
  arg_min(abc_share, position) AS share_first, arg_max(abc_share, position) AS share_last FROM tr),
c AS MATERIALIZED ({_O['buy_vs_rent_spread']})
{_items('r', 'snapshot', "'all'", ['rows', 'ratio_non_null', 'ratio_high', 'ratio_max'])} UNION ALL {_items('m', 'median_by_region', 'region_name', ['median_price'])}
UNION ALL {_items('s', 'starts', "'all'", ['starts_first', 'starts_last', 'financial_years', 'years_high'], ['period_min', 'period_max'])}
UNION ALL {_items('e', 'energy', "'all'", ['share_first', 'share_last'], ['first_period', 'last_period'])} UNION ALL {_items('c', 'buy_vs_rent', 'region_name', [], ['caption'])}"""

_SC = "round(sum(dwellings) FILTER (WHERE measure = 'O'), 2) AS starts, round(sum(dwellings) FILTER (WHERE measure = 'F'), 2) AS completions"


def _index(name: str) -> str:
    return f"""(SELECT a.geography, strftime(a.month, '%Y-%m-%d') AS month, a.value, (a.value / nullif(b.value, 0) - 1.0) * 100.0 AS change_12m_pct
  FROM {name} a LEFT JOIN {name} b ON a.geography = b.geography AND b.month = a.month - INTERVAL 12 MONTH WHERE a.month = (SELECT max(month) FROM {name}))"""


SQL["summary_payload"] = f"""
WITH {LK}, {LA}, {BANDS}, {RENT_SERIES}, {PRICE_SERIES},
x AS MATERIALIZED (SELECT la.*, region_name FROM la LEFT JOIN lk ON la.lad_code = lk.lad_code),
c0 AS MATERIALIZED (SELECT financial_year, fy_start, {_SC} FROM x GROUP BY ALL),
co AS MATERIALIZED (SELECT a.financial_year, a.starts, a.completions, (a.starts / nullif(b.starts, 0) - 1.0) * 100.0 AS starts_change_pct FROM c0 a LEFT JOIN c0 b ON b.fy_start = a.fy_start - 1),
nw AS MATERIALIZED (SELECT * FROM x WHERE financial_year = (SELECT arg_max(financial_year, fy_start) FROM x)),
re AS MATERIALIZED (SELECT region_name, financial_year, {_SC} FROM nw GROUP BY ALL),
le AS MATERIALIZED (SELECT lad_code, lad_name, {_SC} FROM nw GROUP BY ALL ORDER BY starts DESC NULLS LAST, lad_code LIMIT 10),
ra AS MATERIALIZED (SELECT * FROM ({_O['rates_per_1000']}) WHERE geography_level = 'region'),
tr AS MATERIALIZED ({SQL['energy_trend']}), en AS MATERIALIZED (SELECT * FROM tr WHERE position = (SELECT max(position) FROM tr)),
ba AS MATERIALIZED (SELECT * FROM bs WHERE band IS NOT NULL), ri AS MATERIALIZED {_index('rs')}, pi AS MATERIALIZED {_index('ps')}
{_items('co', 'country', 'financial_year', ['starts', 'completions', 'starts_change_pct'])} UNION ALL {_items('re', 'region', 'region_name', ['starts', 'completions'], ['financial_year'])}
UNION ALL {_items('le', 'authority', 'lad_name', ['starts', 'completions'])} UNION ALL {_items('ra', 'rates', 'name', ['population', 'starts_per_1000', 'completions_per_1000'])}
UNION ALL {_items('en', 'energy', 'geography', ['abc_share'], ['rolling_period'])} UNION ALL {_items('ba', 'bands', "region_name || '|' || band", ['pct'])}
UNION ALL {_items('ri', 'rents', 'geography', ['value', 'change_12m_pct'], ['month'])} UNION ALL {_items('pi', 'prices', 'geography', ['value', 'change_12m_pct'], ['month'])}"""
