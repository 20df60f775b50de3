"""Boosted trees on lags with recursive forecasts.

One model is fitted per frequency and lag set, pooled over all series of that kind, on the first part of each series.
From every later origin the forecast walks ``horizon`` steps ahead: each scoring pass predicts one period for all series
and origins at once and pushes the prediction into the row's array of recent values, where the next pass reads its lags.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import forecast as Y

# Lags of long and short series, points that a long one has more than, least history and training rows.
LONG_LAGS, SHORT_LAGS = (1, 2, 3, 12), (1, 2, 3)
LONG_FROM, SPARE_POINTS, LEAST_ROWS = 14, 5, 10


def series_arrays(pts: DataFrame, train_share: float = 0.8) -> DataFrame:
    """``series_id, ys, n, cut``: values in order, their number and how many of them a model may learn from."""
    ys = pts.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "y"))), lambda e: e["y"]).alias("ys"))
    return ys.select("series_id", "ys", F.size("ys").alias("n"), F.floor(F.size("ys") * train_share).cast("int").alias("cut"))


def lag_vector(recent: Column, lags: tuple[int, ...]) -> Column:
    """Features of the period after ``recent`` (values in order)."""
    return array_to_vector(F.array(*[F.element_at(recent, -k) for k in lags]))


def of_kind(series: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """Series that use this lag set and are long enough for it."""
    long = F.col("n") > LONG_FROM
    return series.where((long if lags == LONG_LAGS else ~long) & (F.col("n") > max(lags) + SPARE_POINTS))


def training_rows(series: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """``features, label`` of every period of the learning part that has all its lags."""
    at = series.where(F.col("cut") > max(lags)).select("ys", F.explode(F.sequence(F.lit(max(lags)), F.col("cut") - 1)).alias("t"))
    return at.select(lag_vector(F.slice("ys", F.col("t") - max(lags) + 1, max(lags)), lags).alias("features"), F.element_at("ys", F.col("t") + 1).alias("label"))


def fit(series: DataFrame, lags: tuple[int, ...], depth: int = 5, trees: int = 20) -> GBTRegressionModel | None:
    """The pooled model, or None if there are too few rows to learn from."""
    rows = training_rows(series, lags).persist()
    try:
        if rows.limit(LEAST_ROWS).count() < LEAST_ROWS:
            return None
        return GBTRegressor(maxDepth=depth, maxIter=trees, seed=42).fit(rows)
    finally:
        rows.unpersist()


def recursive_paths(model: GBTRegressionModel, rows: DataFrame, lags: tuple[int, ...], horizon: int) -> DataFrame:
    """Rows with ``recent`` (values up to an origin) and, in ``path``, the ``horizon`` predictions after it.

    Each pass is cut off in the shared checkpoint folder: it scores once, and the plan does not grow with the horizon.
    """
    rows = rows.withColumn("path", F.array().cast("array<double>"))
    for _ in range(horizon):
        rows = model.transform(rows.withColumn("features", lag_vector(F.col("recent"), lags)))
        rows = rows.withColumn("recent", F.concat(F.slice("recent", 2, max(lags) - 1), F.array("prediction")))
        rows = cut_lineage(rows.withColumn("path", F.concat("path", F.array("prediction"))).drop("features", "prediction"))
    return rows


def backtest(pts: DataFrame, horizons: list[int], season: int, train_share: float = 0.8) -> DataFrame:
    """Window metrics of the lagged trees, one row per (series, horizon, origin), as the other models have.

    Origins are all periods from the end of a series' learning part to its last point less the horizon.  Series too short
    for their lag set, and kinds with too few training rows, give no rows.
    """
    series = series_arrays(pts, train_share).persist()
    parts = []
    for lags in (LONG_LAGS, SHORT_LAGS):
        mine = of_kind(series, lags)
        model = fit(mine, lags)
        if model is None:
            continue
        origins = mine.where(F.col("cut") >= max(lags)).select("series_id", "n", F.explode(F.sequence("cut", F.col("n") - 1)).alias("o"), "ys").select(
            "series_id", "n", "o", F.slice("ys", F.col("o") - max(lags) + 1, max(lags)).alias("recent"))
        paths = recursive_paths(model, origins, lags, max(horizons))
        parts.append(paths.select("series_id", "n", "o", F.posexplode("path").alias("k", "pred")).withColumn("k", F.col("k") + 1))
    if not parts:
        empty = "series_id string, horizon int, model string, o int, " + ", ".join(f"{m} double" for m in Y.METRICS)
        return pts.sparkSession.createDataFrame([], empty)
    paths = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    wanted = paths.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    wanted = wanted.where((F.col("k") <= F.col("horizon")) & (F.col("o") + F.col("horizon") <= F.col("n")))
    actual = pts.select("series_id", (F.col("t")).alias("_t"), "y")
    x = wanted.withColumn("_t", F.col("o") + F.col("k") - 1).join(actual, ["series_id", "_t"]).drop("_t")
    naive = pts.select("series_id", (F.col("t") + season).alias("_t"), F.col("y").alias("_n"))
    x = x.withColumn("_t", F.col("o") + F.col("k") - 1).join(naive, ["series_id", "_t"], "left").drop("_t")
    x = x.withColumn("naive", F.when((F.col("o") >= season + F.col("horizon")) & (F.col("horizon") <= season), F.col("_n")))
    stats = Y.history_stats(pts, season).alias("st")
    x = x.join(stats, (x.series_id == F.col("st.series_id")) & (F.col("st.t") == x.o - 1)).select(
        x.series_id, "horizon", x.o, "k", x.y, "naive", "pred", Y.residual_scale(x.o, season).alias("sigma"), F.lit("lagged_gbt").alias("model"))
    return Y.window_metrics(x.select("*", *Y._bands(F.col("pred"), F.col("sigma"), F.col("k"))))
