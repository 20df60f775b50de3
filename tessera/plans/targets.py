"""Forecast targets on the driver tables beside the scoreboard: quantile bands, baselines, fold means and extreme residuals.

Bound like the queries of ``testdata``; each has its DuckDB statement here, save the fitted quantile bands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import models as M
from ..operators import quantile_boosting as QB
from ..operators import tidy as T
from . import playbook as PB
from . import testdata as TD
from .base import cents, read, tidy
from .oracle import _FOLDS, HORIZON, LK

Q = {}
SQL: dict[str, str] = {}
BANDS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
CHANGE_HORIZONS = (1, 2, 3)
FLAT_RATE = 150_000  # predicted total of one order, for queries on residuals
EXTREMES = 15  # fixed value: rows on either side


def query(fn):
    Q[fn.__name__] = fn
    return fn


def _ratios(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Authority lookup and the price/earnings ratio by authority and year."""
    lk, _, _, ratios, _, _ = TD._horizon_frames(spark, d)
    return lk, tidy(ratios.where(F.col("ratio").isNotNull()))


@query
def price_quantile_bands(spark: SparkSession, d: str) -> DataFrame:
    """P10, P50 and P90 of next year's ratio by quantile boosting, against the conformal band and the training quantiles.

    Losses and coverage on the years after the training part, and the mean band of the year after the last.
    25 rounds of step 0.2 (the operator's defaults are 100 of 0.1).  With too few years the result has no row.
    """
    _, ratios = _ratios(spark, d)
    x = tidy(PB.price_panel(ratios, "lad_code", "year", "ratio"))
    known = x.where(F.col("target").isNotNull())
    cuts = PB.year_cuts(known, "year", 0.6, 0.8)
    if cuts is None:
        return spark.createDataFrame([], "model string, metric string, value double")
    fit_y, cal_y = cuts
    feats = ["ratio", "lag_1", "lag_2"]
    rows = x.withColumn("is_train", F.col("year") <= cal_y)
    later = rows.where(~F.col("is_train"))
    boosted = QB.quantile_boost(rows, feats, "target", "is_train", BANDS, rounds=25, step=0.2).where(~F.col("is_train"))
    train, cal = known.where(F.col("year") <= fit_y), known.where((F.col("year") > fit_y) & (F.col("year") <= cal_y))
    conformal = PB.conformal_bands(train, cal, later, feats)
    flat = A.exact_quantiles(known.where(F.col("year") <= cal_y), [], "target", BANDS).first()
    constant = later.withColumns({n: F.lit(flat[n]) for n in BANDS})
    parts = []
    for name, bands in (("quantile_boosting", boosted), ("gbt_conformal", conformal), ("training_quantiles", constant)):
        tested = QB.band_losses(bands, [], "target", BANDS).withColumn("n", F.col("n").cast("double"))
        ahead = bands.where(F.col("target").isNull()).agg(*[F.avg(n).alias(f"next_{n}") for n in BANDS])
        for part in (tested, ahead):
            parts.append(part.unpivot([], part.columns, "metric", "value").select(F.lit(name).alias("model"), "metric", F.round("value", 6).alias("value")))
    return T.union_all(parts)


@query
def price_band_baseline(spark: SparkSession, d: str) -> DataFrame:
    """A region's training quantiles as the band of the later years: pinball losses and coverage by region."""
    lk, ratios = _ratios(spark, d)
    x = tidy(ratios.join(lk.select("lad_code", "region_name"), "lad_code"))
    years = x.select("year").distinct()
    order = years.agg(F.sort_array(F.collect_set("year")).alias("ys"))  # distinct years: a short list
    cut = order.select(F.element_at("ys", F.greatest(F.lit(1), F.floor(F.size("ys") * 0.8).cast("int")))).scalar()
    bands = A.exact_quantiles(x.where(F.col("year") <= cut), ["region_name"], "ratio", BANDS)
    out = QB.band_losses(x.where(F.col("year") > cut).join(bands, "region_name"), ["region_name"], "ratio", BANDS)
    return out.select("region_name", "n", *[F.round(c, 6).alias(c) for c in ("pinball_p10", "pinball_p50", "pinball_p90", "coverage")])


_RATIO_YEARS = f"""{HORIZON},
r AS MATERIALIZED (SELECT lad_code, year, ratio FROM fc WHERE ratio IS NOT NULL)"""

SQL["price_band_baseline"] = f"""
WITH {LK}, {_RATIO_YEARS},
x AS MATERIALIZED (SELECT region_name, year, ratio FROM r JOIN lk ON r.lad_code = lk.lad_code),
ys AS (SELECT year, row_number() OVER (ORDER BY year) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT year FROM x)),
cut AS (SELECT max(year) AS y FROM ys WHERE i = greatest(1, floor(n * 0.8))),
b AS (SELECT region_name, quantile_cont(ratio, 0.1) AS p10, quantile_cont(ratio, 0.5) AS p50, quantile_cont(ratio, 0.9) AS p90
      FROM x WHERE year <= (SELECT y FROM cut) GROUP BY region_name)
SELECT x.region_name, count(*) AS n, round(avg(greatest(0.1 * (ratio - p10), -0.9 * (ratio - p10))), 6) AS pinball_p10,
  round(avg(greatest(0.5 * (ratio - p50), -0.5 * (ratio - p50))), 6) AS pinball_p50,
  round(avg(greatest(0.9 * (ratio - p90), -0.1 * (ratio - p90))), 6) AS pinball_p90,
  round(avg(CASE WHEN ratio BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END), 6) AS coverage
FROM x JOIN b ON x.region_name = b.region_name WHERE year > (SELECT y FROM cut) GROUP BY x.region_name"""


@query
def change_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Change of the ratio over 1, 2 and 3 years; the median change of the training part and its error afterwards."""
    _, ratios = _ratios(spark, d)
    parts = []
    for h in CHANGE_HORIZONS:
        x = tidy(PB.change_panel(ratios, "lad_code", "year", "ratio", h))
        cut = PB.known_cut(x)
        if cut is None:
            continue
        train, test = x.where(F.col("_known") <= cut), x.where(F.col("_known") > cut)
        middle = A.exact_median(train, [], "target").first()[0]
        s = test.agg(F.count(F.lit(1)).alias("n_test"), F.avg(F.abs(F.col("target") - F.lit(middle))).alias("baseline_mae"))
        parts.append(s.select(F.lit(h).alias("horizon_years"), F.lit(cut).cast("int").alias("last_training_year"), "n_test",
                              F.round(F.lit(middle), 6).alias("median_change"), F.round("baseline_mae", 6).alias("baseline_mae")))
    if not parts:
        return spark.createDataFrame([], "horizon_years int, last_training_year int, n_test long, median_change double, baseline_mae double")
    return T.union_all(parts)


SQL["change_baselines"] = f"""
WITH {LK}, {_RATIO_YEARS},
hs AS (SELECT * FROM (VALUES {", ".join(f"({h})" for h in CHANGE_HORIZONS)}) t(h)),
w AS MATERIALIZED (SELECT lad_code, year, ratio, row_number() OVER (PARTITION BY lad_code ORDER BY year) AS i FROM r),
x AS MATERIALIZED (SELECT h, b.year AS known, b.ratio - a.ratio AS target FROM w a JOIN hs ON true JOIN w b ON a.lad_code = b.lad_code AND b.i = a.i + h WHERE a.i > 1),
ys AS (SELECT h, known, row_number() OVER (PARTITION BY h ORDER BY known) AS i, count(*) OVER (PARTITION BY h) AS n FROM (SELECT DISTINCT h, known FROM x)),
cut AS (SELECT h, max(known) AS y FROM ys WHERE i = greatest(1, floor(n * 0.8)) GROUP BY h),
m AS (SELECT x.h, quantile_cont(target, 0.5) AS m FROM x JOIN cut ON x.h = cut.h WHERE known <= y GROUP BY x.h),
t AS (SELECT x.h, count(*) AS n_test, avg(abs(target - m)) AS mae FROM x JOIN cut ON x.h = cut.h JOIN m ON x.h = m.h WHERE known > y GROUP BY x.h)
SELECT CAST(cut.h AS INTEGER) AS horizon_years, CAST(y AS INTEGER) AS last_training_year, coalesce(n_test, 0) AS n_test,
  round(m, 6) AS median_change, round(mae, 6) AS baseline_mae
FROM cut JOIN m ON cut.h = m.h LEFT JOIN t ON cut.h = t.h"""


def _flat_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders: total, residual against a flat rate per order (from whole pence) and region."""
    lk = TD.la_lookup(spark, d)
    o = read(spark, d, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(
        F.sum(cents("o_totalprice")).alias("pence"), F.count(F.lit(1)).alias("n_orders"))
    c = read(spark, d, "customer", "c_custkey", "c_nationkey").join(lk, F.col("c_nationkey") == lk.nationkey, "left")
    off = F.col("pence") - F.col("n_orders") * (FLAT_RATE * 100)
    return o.join(c, o.o_custkey == c.c_custkey).select(
        "c_custkey", "region_name", (F.col("pence").cast("double") / 100.0).alias("actual"), (off.cast("double") / 100.0).alias("residual"))


@query
def residual_extremes(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen customers furthest above and below a flat rate per order."""
    out = M.extreme_residuals(_flat_residuals(spark, d), "c_custkey", EXTREMES)
    return out.select("side", "place", "c_custkey", "region_name", "actual", "residual")


_FLAT = f"""{LK},
o AS (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS pence, count(*) AS n_orders FROM orders GROUP BY o_custkey),
f AS MATERIALIZED (SELECT c_custkey, region_name, CAST(pence AS DOUBLE) / 100.0 AS actual, CAST(pence - n_orders * {FLAT_RATE * 100} AS DOUBLE) / 100.0 AS residual
   FROM o JOIN customer ON o_custkey = c_custkey LEFT JOIN lk ON c_nationkey = lk.nationkey)"""

SQL["residual_extremes"] = f"""
WITH {_FLAT},
p AS (SELECT 'top' AS side, CAST(row_number() OVER (ORDER BY residual DESC, c_custkey) AS INTEGER) AS place, * FROM f
      UNION ALL SELECT 'bottom', CAST(row_number() OVER (ORDER BY residual, c_custkey) AS INTEGER), * FROM f)
SELECT side, place, c_custkey, region_name, actual, residual FROM p WHERE place <= {EXTREMES}"""


@query
def mean_fold_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean over the folds of the fold metrics (M4), each fold counting once."""
    out = M.mean_fold_scores(TD.fold_metrics(spark, d))
    return out.select("n_folds", F.round("mean_r2", 5).alias("mean_r2"), F.round("mean_mae", 1).alias("mean_mae"), F.round("mean_rmse", 1).alias("mean_rmse"))


SQL["mean_fold_scores"] = f"""
WITH {_FOLDS},
s AS (SELECT fold, total_value AS actual, total_value - n_orders * CAST({FLAT_RATE} AS DOUBLE) AS residual FROM x JOIN folds ON x.region_name = folds.region_name),
m AS (SELECT fold, round(1 - sum(residual * residual) / (sum(actual * actual) - sum(actual) * sum(actual) / count(actual)), 6) AS r2,
  round(avg(abs(residual)), 2) AS mae, round(sqrt(avg(residual * residual)), 2) AS rmse FROM s GROUP BY fold)
SELECT count(*) AS n_folds, round(avg(r2), 5) AS mean_r2, round(avg(mae), 1) AS mean_mae, round(avg(rmse), 1) AS mean_rmse FROM m"""


COVERAGE: dict[str, list[str]] = {
    "price_quantile_bands": ["M13", "M18"],
    "price_band_baseline": ["M13", "M18"],
    "change_baselines": ["M12"],
    "residual_extremes": ["M21", "K2"],
    "mean_fold_scores": ["M21", "M4"],
}
