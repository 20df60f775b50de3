"""Time-series operators (Y1-Y20) expressed as Spark jobs.

The unit of work is (series, origin, model).  Everything that is arithmetic
on history — seasonal naive, repeating seasonal naive, drift, residual
scales, probabilistic bands, error metrics — is a join or a window over a
long table ``(series_id, t, y)``; no series is ever collected.  Smoothing folds over
one array per series on the JVM side; lagged trees are one ``pyspark.ml`` fit.

Windows here are partitioned by ``series_id`` over one row per period, so a
partition holds the length of one series (hundreds of points), however many
series and rows the input has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce as X
from ..functions import periods as P

# Normal quantiles of the P10/P90 and 95 % bands.
Z10 = 1.2815515655446004
Z95 = 1.959963984540054
# Minimum points for a residual scale, minimum number of differences, smallest usable scale.
SCALE_MIN_POINTS = 6
SCALE_MIN_DIFFS = 3
SCALE_EPS = 1e-12
FALLBACK_SCALE_MIN = 1e-6
MAPE_EPS = 1e-9
MASE_EPS = 1e-12
# Default training length for non-annual series.
DEFAULT_MIN_TRAIN = 36

ENGINES = {
    "seasonal_naive": "sql",
    "seasonal_repeat": "sql",
    "drift": "sql",
    "smoothing": "sql",
    "ensemble": "sql",
    "lagged_gbt": "spark_ml",
}


def default_min_train(freq: Column, n: Column, horizon: Column | int = 1) -> Column:
    """Annual series train on what the horizon leaves, 1 to 15 points; others on 36."""
    h = horizon if isinstance(horizon, Column) else F.lit(horizon)
    annual = F.greatest(F.lit(1), F.least(F.lit(15), n - h))
    return F.when(F.lower(freq).contains("annual"), annual).otherwise(F.lit(DEFAULT_MIN_TRAIN)).cast("int")


def series_catalog(series: DataFrame) -> DataFrame:
    """One row per series with length, span, season length (P15) and default training length."""
    s = series.where(F.col("value").isNotNull())
    cat = s.groupBy("series_id", "level", "frequency").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return cat.withColumn("season_length", P.season_length("frequency").cast("int")).withColumn(
        "min_train", default_min_train(F.col("frequency"), F.col("n_points"))
    )


def backtest_plan(catalog: DataFrame, horizons: list[int], models: list[str]) -> DataFrame:
    """Series x horizons x models as one table (generated by ``explode``), with the number of origins."""
    engines = F.create_map(*[F.lit(x) for kv in ENGINES.items() for x in kv])
    x = catalog.select(
        "*",
        F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"),
    ).select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    return x.select(
        "series_id", F.col("horizon").cast("int").alias("horizon"), "model",
        F.coalesce(F.try_element_at(engines, F.col("model")), F.lit("unknown")).alias("engine"),
        F.greatest(F.col("n_points") - F.col("horizon") - F.col("min_train") + 1, F.lit(0)).cast("bigint").alias("n_origins"),
        X.horizon_bucket("horizon").cast("int").alias("horizon_bucket"),
    )


def index_points(series: DataFrame, ts_col: str = "ts") -> DataFrame:
    """(series_id, ts, value) -> (series_id, t, y) with t = 0, 1, ... in time order (F8: NULL values dropped)."""
    s = series.where(F.col("value").isNotNull())
    w = Window.partitionBy("series_id").orderBy(ts_col)
    return s.select("series_id", ts_col, (F.row_number().over(w) - 1).cast("int").alias("t"), F.col("value").alias("y"))


def history_stats(pts: DataFrame, season: int) -> DataFrame:
    """Running sums at each t over y[0..t] and over the seasonal / first differences (for W10 scales)."""
    w = Window.partitionBy("series_id").orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = pts.withColumn("ds", F.col("y") - F.lag("y", season).over(w)).withColumn("d1", F.col("y") - F.lag("y", 1).over(w))
    out = x.select(
        "series_id", "t", "y",
        F.sum("y").over(run).alias("sy"), F.sum(F.col("y") * F.col("y")).over(run).alias("syy"),
        F.sum("ds").over(run).alias("sds"), F.sum(F.col("ds") * F.col("ds")).over(run).alias("sdds"),
        F.sum("d1").over(run).alias("sd1"), F.sum(F.col("d1") * F.col("d1")).over(run).alias("sdd1"),
    )
    return out


def _pop_std(s: Column, ss: Column, n: Column) -> Column:
    m = s / n
    return F.sqrt(F.greatest(ss / n - m * m, F.lit(0.0)))


def residual_scale(length: Column, season: int, st: str = "st") -> Column:
    """Population std of seasonal (or first) differences of y[:length]; fallback std(y), at least 1e-6."""
    c = lambda name: F.col(f"{st}.{name}")
    if season > 1:
        use_seasonal = length > season
        n_d = F.when(use_seasonal, length - season).otherwise(length - 1)
        s = F.when(use_seasonal, c("sds")).otherwise(c("sd1"))
        ss = F.when(use_seasonal, c("sdds")).otherwise(c("sdd1"))
    else:
        n_d, s, ss = length - 1, c("sd1"), c("sdd1")
    sd = _pop_std(s, ss, n_d.cast("double"))
    ok = (length >= SCALE_MIN_POINTS) & (n_d >= SCALE_MIN_DIFFS) & (sd > SCALE_EPS)
    fallback = F.greatest(_pop_std(c("sy"), c("syy"), length.cast("double")), F.lit(FALLBACK_SCALE_MIN))
    return F.when(ok, sd).otherwise(fallback)


def _bands(point: Column, sigma: Column, k: Column) -> list[Column]:
    """P10/P50/P90 and the 95 % interval around a point path, sigma * sqrt(h)."""
    sh = sigma * F.sqrt(k.cast("double"))
    return [
        (point - F.lit(Z10) * sh).alias("p10"), point.alias("p50"), (point + F.lit(Z10) * sh).alias("p90"),
        (point - F.lit(Z95) * sh).alias("lower"), (point + F.lit(Z95) * sh).alias("upper"),
    ]


# Parameter grid of the smoothing (level weight, trend weight) and the least history it is used on.
SMOOTHING_GRID = [(a, b) for a in (0.2, 0.4, 0.6, 0.8) for b in (0.1, 0.3)]
SMOOTHING_MIN_POINTS = 8


def smoothing_states(pts: DataFrame) -> DataFrame:
    """Exponential smoothing with additive trend, (series_id, o, level, trend) after the first ``o`` points.

    One row per series and grid entry carries the series as an array (as long as the series has periods); a fold
    over it keeps level, trend and the sum of squared one-step errors after each point.  Of the grid the entry
    with the least error up to ``o`` is taken, ties to the smaller weights.
    """
    ys = pts.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "y"))), lambda e: e["y"]).alias("ys"))
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SMOOTHING_GRID])
    rows = ys.where(F.size("ys") >= 2).select("series_id", "ys", F.explode(grid).alias("g"))

    def state(level, trend, sse):
        return F.struct(level.alias("level"), trend.alias("trend"), sse.alias("sse"))

    def step(acc, y):
        last = F.element_at(acc, -1)
        ahead = last["level"] + last["trend"]
        level = F.col("g.a") * y + (F.lit(1.0) - F.col("g.a")) * ahead
        trend = F.col("g.b") * (level - last["level"]) + (F.lit(1.0) - F.col("g.b")) * last["trend"]
        return F.concat(acc, F.array(state(level, trend, last["sse"] + (y - ahead) * (y - ahead))))

    y0, y1 = F.element_at("ys", 1), F.element_at("ys", 2)
    states = F.aggregate(F.slice("ys", F.lit(3), F.greatest(F.size("ys") - 2, F.lit(0))), F.array(state(y1, y1 - y0, F.lit(0.0))), step)
    each = rows.select("series_id", "g", F.posexplode(states).alias("p", "s"))
    best = each.groupBy("series_id", (F.col("p") + 2).alias("o")).agg(
        F.min_by(F.struct("s.level", "s.trend"), F.struct("s.sse", "g.a", "g.b")).alias("s"))
    return best.where(F.col("o") >= SMOOTHING_MIN_POINTS).select("series_id", "o", "s.level", "s.trend")


def baseline_backtest(pts: DataFrame, horizons: list[int], season: int, min_train: int) -> DataFrame:
    """Rolling-origin backtest, one row per (series, horizon, model, origin).

    Origins run from ``min_train`` to ``n - horizon``; the training window of
    origin ``o`` is ``y[0..o-1]``.  Predictions are equi-joins into the
    history; a window is kept only if all its ``horizon`` predictions exist
    (the reference skips non-finite paths).  The seasonal naive forecast needs
    a horizon within one season.
    """
    n = pts.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = n.select("series_id", "n", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    orig = wanted.where(F.col("n") - F.col("horizon") >= min_train).select(
        "series_id", "horizon", F.explode(F.sequence(F.lit(min_train).cast("long"), F.col("n") - F.col("horizon"))).alias("o")
    )
    stats = history_stats(pts, season).alias("st")
    prev = pts.select("series_id", (F.col("t") + 2).alias("o"), F.col("y").alias("y_prev"))
    og = orig.join(stats, (orig.series_id == F.col("st.series_id")) & (F.col("st.t") == orig.o - 1)).select(
        orig.series_id, "horizon", orig.o, F.col("st.y").alias("y_last"), residual_scale(orig.o, season).alias("sigma")
    ).join(prev, ["series_id", "o"], "left").join(smoothing_states(pts), ["series_id", "o"], "left")
    cells = og.select("*", F.explode(F.sequence(F.lit(1), F.col("horizon"))).alias("k"))
    cells = cells.withColumn("ti", F.col("o") + F.col("k") - 1).withColumn("tsn", F.col("o") - season + F.col("k") - 1).withColumn(
        "trep", F.col("o") - season + (F.col("k") - 1) % season
    )
    ya = pts.select("series_id", F.col("t").alias("ti"), F.col("y"))
    ysn = pts.select("series_id", F.col("t").alias("tsn"), F.col("y").alias("y_sn"))
    yrep = pts.select("series_id", F.col("t").alias("trep"), F.col("y").alias("y_rep"))
    x = cells.join(ya, ["series_id", "ti"]).join(ysn, ["series_id", "tsn"], "left").join(yrep, ["series_id", "trep"], "left")
    sn = F.when((F.col("o") >= season + F.col("horizon")) & (F.col("horizon") <= season), F.col("y_sn"))
    rep = F.when(F.col("o") >= season, F.col("y_rep"))
    drift = F.when(F.col("o") >= 2, F.col("y_last") + F.col("k") * (F.col("y_last") - F.col("y_prev")))
    smooth = F.col("level") + F.col("k") * F.col("trend")
    both = F.coalesce((rep + smooth) / 2.0, rep, smooth)
    models = {"seasonal_naive": sn, "seasonal_repeat": rep, "drift": drift, "smoothing": smooth, "ensemble": both}
    preds = x.select(
        "series_id", "horizon", "o", "k", "y", "sigma", sn.alias("naive"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("model"), c.alias("pred")) for m, c in models.items()])).alias("m"),
    ).select("series_id", "horizon", "o", "k", "y", "sigma", "naive", "m.model", "m.pred")
    return window_metrics(preds.select("*", *_bands(F.col("pred"), F.col("sigma"), F.col("k"))))


def window_metrics(preds: DataFrame) -> DataFrame:
    """MAE, RMSE, MAPE, MASE vs naive, P10-P90 coverage and pinball losses per (series, horizon, model, origin)."""
    e = F.col("pred") - F.col("y")
    d = lambda q: F.col("y") - F.col(q)
    pin = lambda q, col: F.avg(F.greatest(F.lit(q) * d(col), F.lit(q - 1.0) * d(col)))
    has_naive = F.col("naive").isNotNull()
    g = preds.groupBy("series_id", "horizon", "model", "o").agg(
        F.count("pred").alias("_n_pred"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.when(F.abs(F.col("y")) >= MAPE_EPS, F.abs(e / F.col("y")))) * 100.0).alias("mape"),
        F.try_divide(
            F.avg(F.when(has_naive, F.abs(e))),
            F.greatest(F.avg(F.when(has_naive, F.abs(F.col("y") - F.col("naive")))), F.lit(MASE_EPS)),
        ).alias("mase"),
        F.avg(F.when((F.col("y") >= F.col("p10")) & (F.col("y") <= F.col("p90")), 1.0).otherwise(0.0)).alias("coverage_p10_p90"),
        pin(0.1, "p10").alias("pinball_p10"),
        pin(0.5, "p50").alias("pinball_p50"),
        pin(0.9, "p90").alias("pinball_p90"),
    )
    return g.where(F.col("_n_pred") == F.col("horizon")).drop("_n_pred")


METRICS = ["mae", "rmse", "mape", "mase", "coverage_p10_p90", "pinball_p10", "pinball_p50", "pinball_p90"]


def summarise_backtest(windows: DataFrame) -> DataFrame:
    """Mean metric per (series, horizon, model), number of windows, and the best model by MAE."""
    s = windows.groupBy("series_id", "horizon", "model").agg(
        F.count(F.lit(1)).alias("n_windows"), *[F.avg(m).alias(m) for m in METRICS]
    )
    # Ties at reporting precision (e.g. two baselines with the same predictions) go to the model name.
    best = s.where(F.col("mae").isNotNull()).groupBy("series_id", "horizon").agg(
        F.min_by("model", F.struct(F.round("mae", 6), F.col("model"))).alias("_best")
    )
    return s.join(best, ["series_id", "horizon"], "left").withColumn("is_best", F.coalesce(F.col("model") == F.col("_best"), F.lit(False))).drop("_best")


def forward_table(pts: DataFrame, horizon: int, season: int) -> DataFrame:
    """End level, change and P10-P90 after ``horizon`` periods per series and model; failures keep a row with an error."""
    n = pts.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    stats = history_stats(pts, season).alias("st")
    og = n.join(stats, (n.series_id == F.col("st.series_id")) & (F.col("st.t") == n.n - 1)).select(
        n.series_id, n.n, F.col("st.y").alias("last_value"), residual_scale(n.n, season).alias("sigma"))
    states = smoothing_states(pts).select("series_id", F.col("o").alias("n"), "level", "trend")
    tail = pts.select("series_id", F.col("t").alias("trep"), F.col("y").alias("y_rep"))
    x = og.join(states, ["series_id", "n"], "left").withColumn("trep", F.col("n") - season + (horizon - 1) % season).join(tail, ["series_id", "trep"], "left")
    smooth = F.col("level") + F.lit(horizon) * F.col("trend")
    models = {"seasonal_repeat": F.col("y_rep"), "smoothing": smooth, "ensemble": F.coalesce((F.col("y_rep") + smooth) / 2.0, F.col("y_rep"), smooth)}
    m = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), v.alias("end_level")) for k, v in models.items()])).alias("m")
    x = x.select("series_id", "last_value", "sigma", m).select("series_id", "last_value", "sigma", "m.model", "m.end_level")
    half = F.lit(Z10) * F.col("sigma") * F.sqrt(F.lit(float(horizon)))
    return x.select(
        "series_id", "model", F.lit(horizon).alias("horizon"), "last_value", "end_level",
        X.pct_change("last_value", "end_level").alias("pct_change"), (F.col("end_level") - half).alias("p10"), (F.col("end_level") + half).alias("p90"),
        F.when(F.col("end_level").isNull(), F.lit("too few points")).alias("error"))


def forward_seasonal_naive(pts: DataFrame, horizon: int, season: int) -> DataFrame:
    """Forward path from the whole history with bands, end level and change vs the last value."""
    n = pts.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= season + horizon)
    stats = history_stats(pts, season).alias("st")
    og = n.join(stats, (n.series_id == F.col("st.series_id")) & (F.col("st.t") == n.n - 1)).select(
        n.series_id, n.n, F.col("st.y").alias("last_value"), residual_scale(n.n, season).alias("sigma")
    )
    cells = og.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    cells = cells.withColumn("tp", F.col("n") - season + F.col("h") - 1)
    ys = pts.select("series_id", F.col("t").alias("tp"), F.col("y").alias("point"))
    x = cells.join(ys, ["series_id", "tp"])
    return x.select(
        "series_id", F.col("h").cast("int").alias("h"), "point", *_bands(F.col("point"), F.col("sigma"), F.col("h")),
        "last_value", X.pct_change("last_value", "point").alias("pct_vs_last"),
    )
