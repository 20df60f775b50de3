"""DuckDB statements of the queries in ``extended`` (same names, same output columns)."""

from __future__ import annotations

from ..operators import seasonal as S
from .oracle import _BAND, _SEASONS, BANDS, LA, LK, POP, PRICE_SERIES, PS_LA, RENT_SERIES, SERIES, _fy_label, _fy_start

SQL: dict[str, str] = {}

_Y = "CAST(year(o_orderdate) AS INTEGER)"
_MEAN = "CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0"

FAMILIES = f"""sales AS MATERIALIZED (SELECT c_nationkey AS nationkey, {_Y} AS year, {_fy_label('o_orderdate')} AS fy, {_fy_start('o_orderdate')} AS fy_start,
   o_totalprice AS price, o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_new, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey),
fp AS MATERIALIZED (SELECT family, nationkey, year, quantile_cont(price, 0.5) AS price FROM sales, (VALUES ('workplace'), ('residence'), ('newbuild')) f(family)
   WHERE family <> 'newbuild' OR is_new GROUP BY ALL),
work AS (SELECT s_nationkey AS nationkey, CAST(year(l_shipdate) AS INTEGER) AS year, {_MEAN.format(c='l_extendedprice')} AS earnings
   FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
fe AS MATERIALIZED (SELECT 'workplace' AS family, * FROM work UNION ALL SELECT 'newbuild', * FROM work
   UNION ALL SELECT 'residence', nationkey, year, {_MEAN.format(c='price')} FROM sales WHERE status = 'F' GROUP BY nationkey, year),
fy_max AS (SELECT family, max(year) AS year FROM (SELECT DISTINCT family, year FROM fp) JOIN (SELECT DISTINCT family, year FROM fe) USING (family, year) GROUP BY family),
fam AS MATERIALIZED (SELECT *, CASE WHEN earnings > 0 THEN price / earnings END AS ratio FROM
   (SELECT fp.* FROM fp JOIN fy_max USING (family, year)) FULL JOIN (SELECT fe.* FROM fe JOIN fy_max USING (family, year)) USING (family, nationkey, year))"""

SQL["price_earnings_families"] = f"""
WITH {LK}, {FAMILIES}
SELECT family, lad_code, lad_name, year, round(price, 4) AS price, earnings, round(ratio, 6) AS ratio FROM fam LEFT JOIN lk USING (nationkey)"""

SQL["region_supply_unmapped"] = f"""
WITH {LK}, mapped AS (SELECT * FROM lk WHERE nationkey % 6 <> 1),
la AS (SELECT c_nationkey, {_fy_label('o_orderdate')} AS financial_year, o_orderstatus AS measure, sum(o_totalprice) AS dwellings
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT region_code, region_name, financial_year, measure, round(sum(dwellings), 2) AS dwellings, count(DISTINCT c_nationkey) AS n_la
FROM la LEFT JOIN mapped ON c_nationkey = nationkey GROUP BY ALL"""

_FAMILY_COLUMNS = ", ".join(f"{f}.year AS {f}_year, round({f}.price, 4) AS {f}_price, round({f}.earnings, 6) AS {f}_earnings, round({f}.ratio, 6) AS {f}_ratio"
                            for f in ("workplace", "residence", "newbuild"))
_FAMILY_JOINS = " ".join(f"LEFT JOIN fam {f} ON {f}.family = '{f}' AND {f}.nationkey = lk.nationkey" for f in ("workplace", "residence", "newbuild"))

SQL["full_snapshot_la"] = f"""
WITH {LK}, {LA}, {POP}, {PS_LA}, {FAMILIES},
supply AS (SELECT lad_code, financial_year, max(CASE WHEN measure = 'F' THEN dwellings END) AS supply_f, max(CASE WHEN measure = 'O' THEN dwellings END) AS supply_o,
   max(CASE WHEN measure = 'P' THEN dwellings END) AS supply_p FROM la WHERE financial_year = (SELECT arg_max(financial_year, fy_start) FROM la) GROUP BY ALL),
last_fy AS (SELECT arg_max(fy, fy_start) AS fy FROM sales),
med AS (SELECT nationkey, quantile_cont(price, 0.5) AS existing, quantile_cont(price, 0.5) FILTER (WHERE is_new) AS new FROM sales WHERE fy = (SELECT fy FROM last_fy) GROUP BY nationkey),
lines AS (SELECT s_nationkey AS nationkey, l_returnflag, l_linestatus FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
fuel AS (SELECT nationkey, {", ".join(f"count(*) FILTER (WHERE l_returnflag = '{f}') * 100.0 / count(*) AS fuel_share_{f.lower()}" for f in "ANR")},
   CAST(nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS DOUBLE) AS mf2b_existing,
   CAST(nullif(count(*) FILTER (WHERE l_linestatus IS DISTINCT FROM 'F'), 0) AS DOUBLE) AS mf2b_new FROM lines GROUP BY nationkey),
hpi AS (SELECT a.geography AS lad_code, strftime(a.month, '%Y-%m-%d') AS hpi_month, a.value AS hpi_avg_price, (a.value / nullif(b.value, 0) - 1.0) * 100.0 AS hpi_12m_pct
   FROM psl a LEFT JOIN psl b ON a.geography = b.geography AND b.month = a.month - INTERVAL 12 MONTH WHERE a.month = (SELECT max(month) FROM psl)),
vac AS (SELECT c_nationkey AS nationkey, count(*) AS vacant_total, count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS vacant_second_homes
   FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) GROUP BY c_nationkey)
SELECT lk.lad_code, lk.lad_name, CASE WHEN lk.nationkey % 6 <> 1 THEN region_code END AS region_code, CASE WHEN lk.nationkey % 6 <> 1 THEN region_name END AS region_name,
  supply.financial_year, round(supply_f, 2) AS supply_f, round(supply_o, 2) AS supply_o, round(supply_p, 2) AS supply_p, pop.population,
  (SELECT fy FROM last_fy) AS median_price_period, round(existing, 4) AS median_price_existing, round(new, 4) AS median_price_new,
  fuel_share_a, fuel_share_n, fuel_share_r, mf2b_existing, mf2b_new, hpi_month, round(hpi_avg_price, 6) AS hpi_avg_price, round(hpi_12m_pct, 6) AS hpi_12m_pct,
  {_FAMILY_COLUMNS}, vacant_total, vacant_second_homes,
  round(CASE WHEN pop.population > 0 THEN CAST(vacant_total AS DOUBLE) / pop.population END * 100.0, 6) AS vacant_per_100
FROM lk LEFT JOIN supply ON supply.lad_code = lk.lad_code LEFT JOIN pop ON pop.lad_code = lk.lad_code LEFT JOIN med ON med.nationkey = lk.nationkey
  LEFT JOIN fuel ON fuel.nationkey = lk.nationkey LEFT JOIN hpi ON hpi.lad_code = lk.lad_code LEFT JOIN vac ON vac.nationkey = lk.nationkey {_FAMILY_JOINS}"""

SQL["full_snapshot_region"] = f"""
WITH {LK}, {LA}, {BANDS}, {PRICE_SERIES}, {RENT_SERIES},
reg AS (SELECT region_code, financial_year, fy_start, measure, sum(dwellings) AS dwellings FROM la JOIN lk ON la.lad_code = lk.lad_code GROUP BY ALL),
supply AS (SELECT region_code, financial_year, max(CASE WHEN measure = 'F' THEN dwellings END) AS f, max(CASE WHEN measure = 'O' THEN dwellings END) AS o,
   max(CASE WHEN measure = 'P' THEN dwellings END) AS p FROM reg WHERE financial_year = (SELECT arg_max(financial_year, fy_start) FROM reg) GROUP BY ALL),
pop AS (SELECT region_code, count(*) AS population FROM customer JOIN lk ON c_nationkey = nationkey GROUP BY region_code),
bands AS (SELECT region_code, sum(pct) FILTER (WHERE band = 'C') AS c, sum(pct) FILTER (WHERE band IN ('A','B','C')) AS abc FROM bs GROUP BY region_code),
yl AS MATERIALIZED (SELECT region_code, CAST(year(l_shipdate) AS INTEGER) AS year, {_BAND} AS band
   FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN lk ON s_nationkey = nationkey),
roll AS (SELECT region_code, count(*) FILTER (WHERE band IN ('A','B','C')) * 100.0 / count(*) AS share, CAST(max(year) - 4 AS VARCHAR) || ' to ' || CAST(max(year) AS VARCHAR) AS period
   FROM yl WHERE year > (SELECT max(year) FROM yl) - 5 GROUP BY region_code),
two AS (SELECT ps.geography, ps.month, ps.value AS hpi, rs.value AS rent FROM ps JOIN rs ON ps.geography = rs.geography AND ps.month = rs.month),
g AS (SELECT geography, arg_min(hpi, month) AS h0, arg_max(hpi, month) AS h1, arg_min(rent, month) AS r0, arg_max(rent, month) AS r1 FROM two GROUP BY geography HAVING count(*) >= 2),
spine AS (SELECT DISTINCT region_code, region_name FROM lk)
SELECT spine.region_code, region_name, financial_year, round(f, 2) AS region_supply_f, round(o, 2) AS region_supply_o, round(p, 2) AS region_supply_p, population,
  round(c, 6) AS pct_band_c, round(abc, 6) AS pct_bands_abc, round(share, 6) AS rolling_abc_share, period AS rolling_period,
  round((h1 / nullif(h0, 0) - 1.0) * 100.0, 6) AS hpi_growth, round((r1 / nullif(r0, 0) - 1.0) * 100.0, 6) AS rent_growth
FROM spine LEFT JOIN supply USING (region_code) LEFT JOIN pop USING (region_code) LEFT JOIN bands USING (region_code) LEFT JOIN roll USING (region_code)
  LEFT JOIN g ON g.geography = region_name"""

SQL["deep_page"] = """
SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, l_suppkey, l_partkey, l_quantity, l_extendedprice, total_rows FROM (
  SELECT *, count(*) OVER () AS total_rows,
    row_number() OVER (ORDER BY l_orderkey DESC, l_linenumber DESC, l_shipdate DESC, l_suppkey DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC) AS r FROM lineitem)
WHERE r <= 100"""


def _dense(name: str, priority: str, out: str) -> str:
    mean = _MEAN.format(c="o_totalprice")
    return f"""{name}0 AS MATERIALIZED (SELECT c_nationkey AS nationkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, {mean} AS {out}
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '{priority}' GROUP BY ALL),
{name} AS MATERIALIZED (SELECT s.nationkey, s.month, v.{out}, v.nationkey IS NULL AS is_gap FROM (
    SELECT nationkey, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM {name}0 GROUP BY nationkey) s
  LEFT JOIN {name}0 v ON v.nationkey = s.nationkey AND v.month = s.month)"""


SQL["spread_12m_dense"] = f"""
WITH {_dense('p', '1-URGENT', 'price')}, {_dense('r', '5-LOW', 'rent')},
gaps AS (SELECT nationkey, count(*) AS n_months, count(*) FILTER (WHERE is_gap) AS n_missing, min(CASE WHEN is_gap THEN month END) AS first_missing FROM p GROUP BY nationkey),
x AS (SELECT p.nationkey, p.month, p.is_gap, p.price, r.rent, (p.price / nullif(p0.price, 0) - 1.0) * 100.0 AS price_yoy, (r.rent / nullif(r0.rent, 0) - 1.0) * 100.0 AS rent_yoy
  FROM p JOIN r ON p.nationkey = r.nationkey AND p.month = r.month
  LEFT JOIN p p0 ON p0.nationkey = p.nationkey AND p0.month = CAST(p.month - INTERVAL 12 MONTH AS DATE)
  LEFT JOIN r r0 ON r0.nationkey = r.nationkey AND r0.month = CAST(r.month - INTERVAL 12 MONTH AS DATE))
SELECT x.nationkey, strftime(month, '%Y-%m-%d') AS month, is_gap, round(price, 6) AS price, round(rent, 6) AS rent, round(price_yoy, 6) AS price_yoy,
  round(rent_yoy, 6) AS rent_yoy, round(price_yoy - rent_yoy, 6) AS spread, n_months, n_missing, strftime(first_missing, '%Y-%m-%d') AS first_missing
FROM x JOIN gaps ON x.nationkey = gaps.nationkey"""

_QUARTER = "CASE quarter(l_shipdate) WHEN 1 THEN 'Jan - Mar ' WHEN 2 THEN 'Apr - Jun ' WHEN 3 THEN 'Jul - Sep ' ELSE 'Oct - Dec ' END || CAST(year(l_shipdate) AS VARCHAR)"

SQL["explore_bands"] = f"""
WITH {LK}, x AS (SELECT region_name || ' | ' || {_BAND} AS series, {_QUARTER} AS period, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN lk ON s_nationkey = nationkey
  WHERE region_name IN ('EUROPE', 'ASIA') AND {_BAND} IN ('A', 'B', 'C'))
SELECT series, period, CAST(dense_rank() OVER (ORDER BY q) AS INTEGER) AS position, CAST(count(*) AS DOUBLE) AS value FROM x GROUP BY series, period, q"""

SQL["explore_index"] = f"""
WITH {LK}, {PRICE_SERIES}
SELECT geography AS series, strftime(month, '%Y-%m-%d') AS period, CAST(dense_rank() OVER (ORDER BY month) AS INTEGER) AS position, round(value, 6) AS value FROM ps"""

SQL["explore_supply"] = f"""
WITH {LK}, {LA}
SELECT lad_name AS series, financial_year AS period, CAST(dense_rank() OVER (ORDER BY fy_start) AS INTEGER) AS position, round(sum(dwellings), 2) AS value
FROM la WHERE measure IN ('F', 'O') GROUP BY lad_name, financial_year, fy_start"""


def _smoothing(frequency: str, s: int) -> str:
    """Both grids as recursions over the points of one frequency, and the path after the last point."""
    least = S.min_points(s)
    values = ", ".join(f"({a}, {b}, {c})" for a, b, c in S.COARSE)
    steps = ", ".join(f"({a}, {b}, {c})" for a, b, c in S.STEPS)
    first = f"list_sum(list_slice(ys, 1, {s})) / {s}.0"
    second = f"list_sum(list_slice(ys, {s + 1}, {2 * s})) / {s}.0"
    ahead = "(level + trend + ring[1])"
    level = "(a * (y - ring[1]) + (1.0 - a) * (level + trend))"

    def fold(name: str, source: str, keep: str) -> str:
        cols = "series_id, " + keep + "a, b, c"
        return f"""{name}(series_id, {keep}a, b, c, o, level, trend, ring, sse) AS (
  SELECT {cols}, {s}, {first}, ({second} - {first}) / {s}.0, [v - {first} FOR v IN list_slice(ys, 1, {s})], CAST(0 AS DOUBLE) FROM {source}
  UNION ALL
  SELECT f.series_id, {keep.replace('k', 'f.k')}a, b, c, o + 1, {level}, b * ({level} - level) + (1.0 - b) * trend,
    list_concat(list_slice(ring, 2, {s}), [c * (y - {level}) + (1.0 - c) * ring[1]]), sse + (y - {ahead}) * (y - {ahead})
  FROM {name} f JOIN pts p ON p.series_id = f.series_id AND p.t = f.o)"""

    return f"""(WITH RECURSIVE pts AS MATERIALIZED (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS INTEGER) AS t, value AS y
  FROM s WHERE frequency = '{frequency}' AND value IS NOT NULL),
ys AS MATERIALIZED (SELECT series_id, list(y ORDER BY t) AS ys FROM pts GROUP BY series_id HAVING count(*) >= {least}),
g0 AS MATERIALIZED (SELECT ys.*, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c FROM ys, (VALUES {values}) g(a, b, c)),
{fold('f0', 'g0', '')},
best0 AS MATERIALIZED (SELECT series_id, arg_min(struct_pack(a := a, b := b, c := c), (round(sse, 6), a, b, c)) AS k FROM f0
  JOIN (SELECT series_id, len(ys) AS n FROM ys) USING (series_id) WHERE o = n GROUP BY series_id),
g1 AS MATERIALIZED (SELECT DISTINCT ys.*, k, round(least(greatest(k.a + CAST(da AS DOUBLE), 0.01), 0.99), 2) AS a, round(least(greatest(k.b + CAST(db AS DOUBLE), 0.01), 0.99), 2) AS b,
  round(least(greatest(k.c + CAST(dc AS DOUBLE), 0.01), 0.99), 2) AS c FROM ys JOIN best0 USING (series_id), (VALUES {steps}) d(da, db, dc)),
{fold('f1', 'g1', 'k, ')},
e AS MATERIALIZED (SELECT series_id, arg_min(struct_pack(level := level, trend := trend, ring := ring, a := a, b := b, c := c), (round(sse, 6), a, b, c)) AS z FROM f1
  JOIN (SELECT series_id, len(ys) AS n FROM ys) USING (series_id) WHERE o = n GROUP BY series_id)
SELECT series_id, CAST(k AS INTEGER) AS k, z.a AS w_level, z.b AS w_trend, z.c AS w_season, round(z.level + k * z.trend + z.ring[k], 4) AS pred
FROM e, range(1, {s + 1}) r(k))"""


SQL["seasonal_smoothing"] = f"""
WITH {LK}, {SERIES.replace("s AS (SELECT 'price:'", "s AS MATERIALIZED (SELECT 'price:'")}
{" UNION ALL ".join(f"SELECT * FROM {_smoothing(f, n)}" for f, n in _SEASONS.items())}"""
