"""Forecast playbook: several targets, one scoreboard.

Every target returns scoreboard rows with the same core columns
(target, geography, model, metric, value, baseline_value, estimate, note);
the scoreboard is their UNION ALL by name (S9) with ``delta_vs_baseline``
(M19).  A target with too little data returns one row of NULLs with a note
(M20) instead of failing.  Panels use lags over *time within a geography*
(H3); nothing is replicated to reach a minimum size.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce as X
from ..operators import aggregate as A
from ..operators import forecast as Y
from ..operators import tidy as T
from ..operators.quantile_boosting import band_loss_columns

SCORE_COLUMNS = ["target", "geography", "model", "metric", "value", "baseline_value", "estimate", "estimate_p10", "estimate_p90", "note"]
MIN_ROWS = 8
PART_ROWS = 20_000  # rows of a panel's partition
SEED = 42


def _no_rows(spark, target: str, note: str) -> DataFrame:
    """One row of NULLs with a note."""
    schema = "target string, geography string, model string, metric string, value double, baseline_value double, estimate double, estimate_p10 double, estimate_p90 double, note string"
    return spark.createDataFrame([(target, None, None, None, None, None, None, None, None, note)], schema)


def hpi_growth_target(pts: DataFrame, season: int = 12, holdout: int = 12, states: DataFrame | None = None) -> DataFrame:
    """Per series, hold out the last 12 (or 24) points, pick seasonal repeat or smoothing by MAE, forecast as far ahead from all data.

    ``states`` are the smoothing states of ``pts``, where several horizons share them.

    The interval reported is the P10-P90 range of the forecast *path* (H6), labelled as such in ``metric``.
    """
    n = pts.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("y", "t").alias("last"))
    least = season + holdout + Y.SMOOTHING_MIN_POINTS
    states = Y.smoothing_states(pts) if states is None else states
    target = f"hpi_growth_{holdout}m"

    def path(o: F.Column) -> DataFrame:
        at = n.where(F.col("n") >= least).select("series_id", "n", "last", o.alias("o"), F.explode(F.sequence(F.lit(1), F.lit(holdout))).alias("k"))
        old = pts.select("series_id", F.col("t").alias("tr"), F.col("y").alias("repeat"))
        x = at.join(states, ["series_id", "o"]).withColumn("tr", F.col("o") - season + (F.col("k") - 1) % season).join(old, ["series_id", "tr"])
        return x.withColumn("smooth", F.col("level") + F.col("k") * F.col("trend"))

    truth = pts.select("series_id", F.col("t").alias("ti"), "y")
    held = path(F.col("n") - holdout).withColumn("ti", F.col("o") + F.col("k") - 1).join(truth, ["series_id", "ti"])
    errors = held.groupBy("series_id").agg(F.avg(F.abs(F.col("repeat") - F.col("y"))).alias("m_repeat"), F.avg(F.abs(F.col("smooth") - F.col("y"))).alias("m_smooth"))
    ahead = path(F.col("n")).join(errors, "series_id").withColumn("smoothing", F.col("m_smooth") < F.col("m_repeat"))
    growth = (F.try_divide(F.when(F.col("smoothing"), F.col("smooth")).otherwise(F.col("repeat")), F.when(F.col("last") != 0, F.col("last"))) - 1.0) * 100.0
    ahead = ahead.withColumn("growth", growth)
    done = ahead.groupBy("series_id").agg(
        F.first("smoothing").alias("smoothing"), F.first("m_repeat").alias("m_repeat"), F.first("m_smooth").alias("m_smooth"),
        F.max_by("growth", "k").alias("growth"), F.percentile("growth", F.lit(0.1)).alias("p10"), F.percentile("growth", F.lit(0.9)).alias("p90"))
    out = done.select(
        F.lit(target).alias("target"), F.col("series_id").alias("geography"),
        F.when(F.col("smoothing"), "smoothing").otherwise("seasonal_repeat").alias("model"), F.lit("holdout_mae").alias("metric"),
        F.least("m_repeat", "m_smooth").alias("value"), F.col("m_repeat").alias("baseline_value"), F.col("growth").alias("estimate"),
        F.col("p10").alias("estimate_p10"), F.col("p90").alias("estimate_p90"), F.lit("path range, not error band").alias("note"))
    short = n.where(F.col("n") < least).select(F.lit(target).alias("target"), F.col("series_id").alias("geography"), F.lit("too few points").alias("note"))
    return out.unionByName(short, allowMissingColumns=True)


def small(panel: DataFrame) -> DataFrame:
    """A panel kept for its fits in as many partitions as its rows need.

    Its rows are areas times periods, but it comes in the partitions of the large shuffles that it was summed up in, and
    every one of the many jobs of a fit has a task for each of them.
    """
    kept = panel.persist()
    return kept.coalesce(-(-kept.count() // PART_ROWS) or 1).persist()


def _assembled(df: DataFrame, features: list[str]) -> list:
    """Median imputation and assembly of the features of which ``df`` knows any value (deep lags of a short panel may have none)."""
    known = df.agg(*[F.count(c).alias(c) for c in features]).first()
    features = [c for c in features if known[c]]
    imp = [f"{c}__i" for c in features]
    return [Imputer(inputCols=features, outputCols=imp, strategy="median"), VectorAssembler(inputCols=imp, outputCol="features", handleInvalid="keep")]


def change_panel(panel: DataFrame, geo: str, year: str, value: str, horizon: int) -> DataFrame:
    """Value, three lags, last change and, in ``target``, the change over the next ``horizon`` years, known in year ``_known``."""
    w = Window.partitionBy(geo).orderBy(year)
    x = panel.select(geo, year, value).withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in (1, 2, 3)})
    x = x.withColumns({"target": F.lead(value, horizon).over(w) - F.col(value), "_known": F.lead(year, horizon).over(w), "d1": F.col(value) - F.col("lag_1")})
    return x.where(F.col("target").isNotNull() & F.col("lag_1").isNotNull())


def known_cut(x: DataFrame):
    """Last of the leading four fifths of the years in which a target is known: later targets are for testing only."""
    years = [r[0] for r in x.select("_known").distinct().orderBy("_known").collect()]
    return years[max(1, int(len(years) * 0.8)) - 1] if years else None


def affordability_target(panel: DataFrame, geo: str, year: str, value: str, horizon: int = 1) -> DataFrame:
    """Change of a ratio over the next 1 to 3 years from its own lags (within each geography), boosted trees,
    +-1.64 sigma band from test residuals, median-change baseline."""
    spark = panel.sparkSession
    target = f"affordability_change_{horizon}y"
    x = small(change_panel(panel, geo, year, value, horizon))
    if x.limit(MIN_ROWS).count() < MIN_ROWS:
        return _no_rows(spark, target, "too few panel rows")
    cut = known_cut(x)
    train, test = x.where(F.col("_known") <= cut), x.where(F.col("_known") > cut)
    if test.limit(1).count() == 0:
        return _no_rows(spark, target, "no test years")
    feats = [value, "lag_1", "lag_2", "lag_3", "d1"]
    model = Pipeline(stages=[*_assembled(train, feats), GBTRegressor(featuresCol="features", labelCol="target", maxDepth=3, maxIter=50, seed=SEED)]).fit(train)
    pred = model.transform(test)
    med = A.exact_median(train, [], "target").first()[0]
    s = pred.agg(
        F.avg(F.abs(F.col("prediction") - F.col("target"))).alias("mae"),
        F.avg(F.abs(F.lit(med) - F.col("target"))).alias("base"),
        F.stddev_pop(F.col("target") - F.col("prediction")).alias("sd"),
        F.avg("prediction").alias("est"),
    )
    return s.select(
        F.lit(target).alias("target"), F.lit("all").alias("geography"), F.lit("gbt").alias("model"),
        F.lit("test_mae").alias("metric"), F.col("mae").alias("value"), F.col("base").alias("baseline_value"),
        F.col("est").alias("estimate"), (F.col("est") - 1.64 * F.col("sd")).alias("estimate_p10"),
        (F.col("est") + 1.64 * F.col("sd")).alias("estimate_p90"), F.lit(None).cast("string").alias("note"),
    )


def divergence_target(spread: DataFrame, geo: str, t: str, value: str) -> DataFrame:
    """Next step's spread change from lags, its sign (logistic, Brier against a constant rate) and its size
    (boosted trees, MAE against the mean change, +-1.64 sigma band from test residuals)."""
    spark = spread.sparkSession
    w = Window.partitionBy(geo).orderBy(t)
    x = spread.where(F.col(value).isNotNull()).withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in (1, 2, 3)})
    x = x.withColumn("size", F.lead(value, 1).over(w) - F.col(value)).withColumn("label", (F.col("size") > 0).cast("double")).na.drop(subset=["label", "lag_3"])
    if x.limit(MIN_ROWS).count() < MIN_ROWS:
        return _no_rows(spark, "divergence_sign", "too few rows")
    x = small(x.withColumn("_train", F.row_number().over(w) <= F.floor(F.count(F.lit(1)).over(Window.partitionBy(geo)) * 0.7)))
    train, test = x.where("_train"), x.where(~F.col("_train"))
    feats = [value, "lag_1", "lag_2", "lag_3"]
    from pyspark.ml.functions import vector_to_array

    rate, mean, n_train = train.agg(F.avg("label"), F.avg("size"), F.count(F.lit(1))).first()
    if n_train < MIN_ROWS or test.limit(1).count() == 0:
        return _no_rows(spark, "divergence_sign", "too few rows")
    model = Pipeline(stages=[*_assembled(train, feats), LogisticRegression(featuresCol="features", labelCol="label")]).fit(train)
    pred = model.transform(test).withColumn("p", vector_to_array("probability")[1])
    trees = Pipeline(stages=[*_assembled(train, feats), GBTRegressor(featuresCol="features", labelCol="size", maxDepth=3, maxIter=50, seed=SEED)]).fit(train)
    miss = F.col("size") - F.col("prediction")
    z = trees.transform(test).agg(
        F.avg(F.abs(miss)).alias("mae"), F.avg(F.abs(F.col("size") - F.lit(mean))).alias("base"), F.avg("prediction").alias("est"), F.stddev_pop(miss).alias("sd"))
    size = z.select(
        F.lit("divergence_size").alias("target"), F.lit("all").alias("geography"), F.lit("gbt").alias("model"), F.lit("test_mae").alias("metric"),
        F.col("mae").alias("value"), F.col("base").alias("baseline_value"), F.col("est").alias("estimate"),
        (F.col("est") - 1.64 * F.col("sd")).alias("estimate_p10"), (F.col("est") + 1.64 * F.col("sd")).alias("estimate_p90"), F.lit(None).cast("string").alias("note"))
    s = pred.agg(F.avg((F.col("p") - F.col("label")) ** 2).alias("brier"), F.avg((F.lit(rate) - F.col("label")) ** 2).alias("base"), F.avg("p").alias("est"))
    return s.select(
        F.lit("divergence_sign").alias("target"), F.lit("all").alias("geography"), F.lit("logistic").alias("model"),
        F.lit("brier").alias("metric"), F.col("brier").alias("value"), F.col("base").alias("baseline_value"),
        F.col("est").alias("estimate"), F.lit(None).cast("double").alias("estimate_p10"), F.lit(None).cast("double").alias("estimate_p90"),
        F.lit(None).cast("string").alias("note"),
    ).unionByName(size)


def trend_target(panel: DataFrame, geo: str, year: str, value: str, target: str) -> DataFrame:
    """Linear trend per geography (``regr_slope``), baseline slope 0."""
    g = panel.groupBy(geo).agg(
        F.regr_slope(F.col(value), F.col(year).cast("double")).alias("slope"),
        F.regr_r2(F.col(value), F.col(year).cast("double")).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )
    return g.select(
        F.lit(target).alias("target"), F.col(geo).cast("string").alias("geography"), F.lit("linear_trend").alias("model"),
        F.lit("r2").alias("metric"), F.col("r2").alias("value"), F.lit(0.0).alias("baseline_value"),
        F.col("slope").alias("estimate"), F.lit(None).cast("double").alias("estimate_p10"), F.lit(None).cast("double").alias("estimate_p90"),
        F.when(F.col("n") < 3, F.lit("fewer than 3 points")).alias("note"),
    )


def adoption_target(panel: DataFrame, geo: str, year: str, value: str, drivers: list[str]) -> DataFrame:
    """Yearly change of a share from the year and its drivers (linear, all geographies in one fit), MAE on the last fifth
    of the years against the mean change; the estimate is the mean change of the year after the last, drivers as they were."""
    from pyspark.ml.regression import LinearRegression

    spark = panel.sparkSession
    w = Window.partitionBy(geo).orderBy(year)
    x = small(panel.select(geo, F.col(year).cast("double").alias("_t"), *drivers, (F.col(value) - F.lag(value).over(w)).alias("delta")).where(F.col("delta").isNotNull()))
    years = [r[0] for r in x.select("_t").distinct().orderBy("_t").collect()]
    if len(years) < 2 or x.limit(MIN_ROWS).count() < MIN_ROWS:
        return _no_rows(spark, "adoption_change_1y", "too few panel rows")
    cut = years[min(max(1, int(len(years) * 0.8)), len(years) - 1) - 1]
    train, test = x.where(F.col("_t") <= cut), x.where(F.col("_t") > cut)
    feats = ["_t", *drivers]
    fitted = Pipeline(stages=[*_assembled(train, feats), LinearRegression(featuresCol="features", labelCol="delta")]).fit(train)
    mean = train.agg(F.avg("delta")).first()[0]
    miss = F.col("delta") - F.col("prediction")
    s = fitted.transform(test).agg(F.avg(F.abs(miss)).alias("mae"), F.avg(F.abs(F.col("delta") - F.lit(mean))).alias("base"), F.stddev_pop(miss).alias("sd"))
    last = x.where(F.col("_t") == years[-1]).withColumn("_t", F.col("_t") + 1.0)
    est = fitted.transform(last).agg(F.avg("prediction")).scalar()
    s = s.withColumn("est", est)
    return s.select(
        F.lit("adoption_change_1y").alias("target"), F.lit("all").alias("geography"), F.lit("linear_drivers").alias("model"), F.lit("test_mae").alias("metric"),
        F.col("mae").alias("value"), F.col("base").alias("baseline_value"), F.col("est").alias("estimate"),
        (F.col("est") - 1.64 * F.col("sd")).alias("estimate_p10"), (F.col("est") + 1.64 * F.col("sd")).alias("estimate_p90"), F.lit(None).cast("string").alias("note"))


def vacancy_class_target(df: DataFrame, id_col: str, features: list[str], delta_col: str) -> DataFrame:
    """Rising / stable / falling classes (X14), 250-tree forest, macro-F1 vs the majority class."""
    spark = df.sparkSession
    x = df.withColumn("cls", X.delta_class(delta_col)).where(F.col(delta_col).isNotNull())
    classes = [r[0] for r in x.select("cls").distinct().collect()]
    if len(classes) < 2 or x.limit(MIN_ROWS).count() < MIN_ROWS:
        return _no_rows(spark, "vacancy_pressure_class", "fewer than two classes or too few rows")
    idx = {c: float(i) for i, c in enumerate(sorted(classes))}
    x = x.withColumn("label", F.create_map(*[F.lit(v) for kv in idx.items() for v in kv])[F.col("cls")])
    x = x.withColumn("_test", F.abs(F.xxhash64(id_col)) % 10 < 3)
    train, test = x.where(~F.col("_test")), x.where(F.col("_test"))
    if test.limit(1).count() == 0:
        return _no_rows(spark, "vacancy_pressure_class", "empty test split")
    model = Pipeline(stages=[*_assembled(train, features), RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=250, seed=SEED)]).fit(train)
    pred = model.transform(test)
    majority = train.agg(F.mode("label", deterministic=True)).first()[0]
    pred = pred.withColumn("base", F.lit(majority))

    def macro_f1(col: str):
        per = [
            F.try_divide(
                (2 * F.count_if((F.col(col) == v) & (F.col("label") == v))).cast("double"),
                F.when(F.count_if(F.col(col) == v) + F.count_if(F.col("label") == v) > 0, F.count_if(F.col(col) == v) + F.count_if(F.col("label") == v)),
            )
            for v in idx.values()
        ]
        return sum((F.coalesce(p, F.lit(0.0)) for p in per), F.lit(0.0)) / len(per)

    s = pred.agg(macro_f1("prediction").alias("f1"), macro_f1("base").alias("base"))
    return s.select(
        F.lit("vacancy_pressure_class").alias("target"), F.lit("all").alias("geography"), F.lit("random_forest").alias("model"),
        F.lit("macro_f1").alias("metric"), F.col("f1").alias("value"), F.col("base").alias("baseline_value"),
        F.lit(None).cast("double").alias("estimate"), F.lit(None).cast("double").alias("estimate_p10"),
        F.lit(None).cast("double").alias("estimate_p90"), F.lit(None).cast("string").alias("note"),
    )


def scoreboard(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL by name of every target's rows, with the gain over the baseline."""
    u = T.union_all(parts)
    return u.withColumn("delta_vs_baseline", F.col("value") - F.col("baseline_value"))


def price_panel(panel: DataFrame, geo: str, year: str, value: str) -> DataFrame:
    """``geo, year, value, lag_1, lag_2, target`` of every year with a value before it; the target is next year's value (null for the last)."""
    w = Window.partitionBy(geo).orderBy(year)
    x = panel.select(geo, year, value).withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in (1, 2)}).withColumn("target", F.lead(value, 1).over(w))
    return x.where(F.col("lag_1").isNotNull())


def year_cuts(x: DataFrame, year: str, *shares: float) -> list | None:
    """Last year of each leading share of the years, or None for fewer than three years or too few rows."""
    years = [r[0] for r in x.select(year).distinct().orderBy(year).collect()]
    if len(years) < 3 or x.limit(MIN_ROWS).count() < MIN_ROWS:
        return None
    return [years[max(i + 1, int(len(years) * share)) - 1] for i, share in enumerate(shares)]


def conformal_bands(train: DataFrame, cal: DataFrame, rows: DataFrame, feats: list[str]) -> DataFrame:
    """``rows`` with p10, p50, p90: boosted trees fitted on ``train``, shifted by the residual quantiles of ``cal``."""
    model = Pipeline(stages=[*_assembled(train, feats), GBTRegressor(featuresCol="features", labelCol="target", maxDepth=3, maxIter=50, seed=SEED)]).fit(train)
    residuals = model.transform(cal).select((F.col("target") - F.col("prediction")).alias("r"))
    q = A.exact_quantiles(residuals, [], "r", {"p10": 0.1, "p90": 0.9}).first()
    scored = model.transform(rows).select(*rows.columns, F.col("prediction").alias("p50"))
    return scored.withColumns({"p10": F.col("p50") + q["p10"], "p90": F.col("p50") + q["p90"]})


def price_band_target(panel: DataFrame, geo: str, year: str, value: str) -> DataFrame:
    """P10/P50/P90 of next year's value by split conformal prediction (quantile boosting: ``targets.price_quantile_bands``).

    Boosted trees give the point (P50); the 10th/90th percentiles of
    calibration residuals give the band.  Reported: pinball loss at 0.5 and
    P10-P90 coverage on the test years, against a last-value baseline.
    """
    spark = panel.sparkSession
    x = small(price_panel(panel, geo, year, value).where(F.col("target").isNotNull()))
    cuts = year_cuts(x, year, 0.6, 0.8)
    if cuts is None:
        return _no_rows(spark, "price_band", "too few panel rows")
    fit_y, cal_y = cuts
    train, cal, test = x.where(F.col(year) <= fit_y), x.where((F.col(year) > fit_y) & (F.col(year) <= cal_y)), x.where(F.col(year) > cal_y)
    if cal.limit(1).count() == 0 or test.limit(1).count() == 0:
        return _no_rows(spark, "price_band", "empty calibration or test years")
    pred = conformal_bands(train, cal, test, [value, "lag_1", "lag_2"])
    s = pred.agg(
        *band_loss_columns("target", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), F.avg(0.5 * F.abs(F.col("target") - F.col(value))).alias("base"),
        F.avg("p50").alias("est"), F.avg("p10").alias("lo"), F.avg("p90").alias("hi"),
    )
    return s.select(
        F.lit("price_band").alias("target"), F.lit("all").alias("geography"), F.lit("gbt_conformal").alias("model"),
        F.lit("pinball_p50").alias("metric"), F.col("pinball_p50").alias("value"), F.col("base").alias("baseline_value"),
        F.col("est").alias("estimate"), F.col("lo").alias("estimate_p10"), F.col("hi").alias("estimate_p90"),
        F.format_string("p10-p90 coverage %.3f", F.col("coverage")).alias("note"),
    )


def shortfall_target(df: DataFrame, id_col: str, features: list[str], label_col: str, folds: int = 3) -> DataFrame:
    """Logistic classifier with sigmoid (Platt) calibration fitted on out-of-fold scores; Brier and AUC.

    With a single class in the data the target returns a note row (one-class fallback).
    """
    from pyspark.ml.functions import vector_to_array

    from ..operators.models import binary_metrics

    spark = df.sparkSession
    x = df.where(F.col(label_col).isNotNull()).withColumn("label", F.col(label_col).cast("double"))
    n_cls = x.select("label").distinct().count()
    if n_cls < 2 or x.limit(MIN_ROWS).count() < MIN_ROWS:
        return _no_rows(spark, "supply_shortfall", "one class only or too few rows")
    x = small(x.withColumn("fold", (F.abs(F.xxhash64(id_col)) % folds).cast("int")))
    oof = None
    for f in range(folds):
        tr, te = x.where(F.col("fold") != f), x.where(F.col("fold") == f)
        if tr.select("label").distinct().count() < 2 or te.limit(1).count() == 0:
            continue
        m = Pipeline(stages=[*_assembled(tr, features), LogisticRegression(featuresCol="features", labelCol="label")]).fit(tr)
        p = m.transform(te).select(id_col, "label", "fold", vector_to_array("rawPrediction")[1].alias("margin"))
        oof = p if oof is None else oof.unionByName(p)
    if oof is None:
        return _no_rows(spark, "supply_shortfall", "no usable folds")
    # Sigmoid calibration: a one-feature logistic on the out-of-fold margins of the other folds, so every row is
    # scored by a calibrator that has not seen it.
    oof, scored = small(oof), None
    for f in range(folds):
        others, own = oof.where(F.col("fold") != f), oof.where(F.col("fold") == f)
        if others.select("label").distinct().count() < 2 or own.limit(1).count() == 0:
            continue
        cal = Pipeline(stages=[VectorAssembler(inputCols=["margin"], outputCol="features"), LogisticRegression(featuresCol="features", labelCol="label")]).fit(others)
        s = cal.transform(own).select("label", F.round(vector_to_array("probability")[1], 6).alias("score"))
        scored = s if scored is None else scored.unionByName(s)
    if scored is None:
        return _no_rows(spark, "supply_shortfall", "no usable folds")
    scored = scored.withColumn("_all", F.lit("all"))
    met = binary_metrics(scored, ["_all"], "score", "label")
    rate = x.agg(F.avg("label")).first()[0]
    base = scored.agg(F.avg((F.lit(rate) - F.col("label")) ** 2).alias("base"))
    base_brier = base.first()["base"]
    return met.select(
        F.lit("supply_shortfall").alias("target"), F.lit("all").alias("geography"), F.lit("logistic_calibrated").alias("model"),
        F.lit("brier").alias("metric"), F.col("brier").alias("value"), F.lit(base_brier).alias("baseline_value"),
        F.col("positive_rate").alias("estimate"), F.lit(None).cast("double").alias("estimate_p10"), F.lit(None).cast("double").alias("estimate_p90"),
        F.format_string("auc %.3f", F.col("auc")).alias("note"),
    )
