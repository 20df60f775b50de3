"""Cross-section models, clustering and classifier metrics (M1-M21) on ``pyspark.ml``.

Metrics are plain aggregates so they distribute and can be checked in SQL.
Model fits use the distributed ``pyspark.ml`` estimators (trees, linear and
logistic regression, k-means, PCA); folds are a column, so cross-validation
is a filter per fold over one cached feature table.  The boosted trees of a
fold with few rows are grown in one task (``boosting``).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .aggregate import exact_median, row_mean, top_and_bottom


def binary_metrics(df: DataFrame, keys: list[str], score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """N, positive rate, Brier score, AUC (average-rank form, ties count half) and F1 per group.

    AUC sums, over distinct score levels, positives x (negatives below + half
    the negatives at the level).  The window runs over distinct score levels
    of a group (scores carry fixed precision), not over rows.
    """
    if not keys:
        df, keys, drop = df.withColumn("_all", F.lit(0)), ["_all"], True
    else:
        drop = False
    y = F.col(label).cast("double")
    s = F.col(score)
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("positive_rate"),
        F.avg((s - y) * (s - y)).alias("brier"),
        F.count_if((s >= threshold) & (y == 1)).alias("_tp"),
        F.count_if((s >= threshold) & (y == 0)).alias("_fp"),
        F.count_if((s < threshold) & (y == 1)).alias("_fn"),
        F.sum(y).alias("_pos"),
    )
    levels = df.groupBy(*keys, score).agg(F.sum(y).alias("_lp"), F.sum(1.0 - y).alias("_ln"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("_below", F.coalesce(F.sum("_ln").over(w), F.lit(0.0)))
    auc_num = levels.groupBy(*keys).agg(F.sum(F.col("_lp") * (F.col("_below") + 0.5 * F.col("_ln"))).alias("_auc_num"))
    out = base.join(auc_num, keys)
    neg = F.col("n") - F.col("_pos")
    f1_den = 2 * F.col("_tp") + F.col("_fp") + F.col("_fn")
    res = out.select(
        *keys, "n", "positive_rate", "brier",
        F.try_divide(F.col("_auc_num"), F.when((F.col("_pos") > 0) & (neg > 0), F.col("_pos") * neg)).alias("auc"),
        F.try_divide((2 * F.col("_tp")).cast("double"), F.when(f1_den > 0, f1_den)).alias("f1"),
    )
    return res.drop("_all") if drop else res


# ---------------------------------------------------------------------------
# Feature preparation and grouped cross-validation (M1-M4)
# ---------------------------------------------------------------------------

from pyspark.ml import Pipeline, regression  # noqa: E402
from pyspark.ml.clustering import BisectingKMeans, KMeans  # noqa: E402
from pyspark.ml.evaluation import ClusteringEvaluator  # noqa: E402
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler  # noqa: E402
from pyspark.ml.functions import array_to_vector, vector_to_array  # noqa: E402
from pyspark.ml.regression import LinearRegression  # noqa: E402
from pyspark.sql.types import NumericType  # noqa: E402

from .boosting import GBTRegressor  # noqa: E402

# The reference's model settings.
ELASTIC_ALPHA = 0.05
ELASTIC_L1_RATIO = 0.5
GBT_PARAMS = {"maxIter": 200, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.9}
KMEANS_STARTS = 10
SEED = 42
MAX_GROUPS = 100_000


def numeric_features(df: DataFrame, exclude: list[str]) -> list[str]:
    """numeric columns minus ids, target and a block list."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in set(exclude)]


def fold_table(df: DataFrame, group_col: str, k: int) -> DataFrame:
    """M3: grouped k-fold assignment; groups by size (desc) onto the lightest fold.

    The greedy choice needs the (group, size) pairs in one place; groups are
    regions or authorities, and more than ``MAX_GROUPS`` of them are refused.
    """
    groups = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))
    sizes = groups.orderBy(F.desc("n"), F.asc(group_col)).limit(MAX_GROUPS + 1).collect()
    if len(sizes) > MAX_GROUPS:
        raise ValueError(f"{group_col!r} has more than {MAX_GROUPS} groups; folds are made for regions or authorities")
    n_folds = max(2, min(k, len(sizes)))
    load = [0] * n_folds
    rows = []
    for r in sizes:
        f = min(range(n_folds), key=lambda i: (load[i], i))
        load[f] += r["n"]
        rows.append((r[group_col], f))
    spark = df.sparkSession
    schema = f"{group_col} {df.schema[group_col].dataType.simpleString()}, fold int"
    return spark.createDataFrame(rows, schema)


def _prep_stages(features: list[str]):
    imputed = [f"{c}__imp" for c in features]
    return [
        Imputer(inputCols=features, outputCols=imputed, strategy="median"),
        VectorAssembler(inputCols=imputed, outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
    ]


def elastic_net_params(alpha: float, l1_ratio: float, label_std: float) -> tuple[float, float]:
    """Spark's penalty on y/sd(y) that matches a scikit-learn elastic net on y."""
    l1 = alpha * l1_ratio / label_std
    l2 = alpha * (1.0 - l1_ratio)
    reg = l1 + l2
    return reg, (l1 / reg if reg > 0 else 0.0)


def grouped_cv(
    df: DataFrame,
    id_col: str,
    features: list[str],
    label: str,
    group_col: str,
    k: int = 5,
    model: str = "elastic_net",
    log_target: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """M1/M2/M4: out-of-fold predictions and per-fold metrics (r2, MAE, RMSE).

    Each fold is one distributed fit on the other folds' rows; the fold loop is
    over k (a handful), never over rows.  Returns (predictions, fold metrics);
    with ``model="gbt"`` the fold metrics also carry mean feature importances.
    """
    y = F.log1p(F.col(label)) if log_target else F.col(label).cast("double")
    data = df.select(id_col, group_col, *features, y.alias("_y")).where(F.col("_y").isNotNull())
    data = data.join(fold_table(data, group_col, k), group_col).persist()
    folds = sorted(r["fold"] for r in data.select("fold").distinct().collect())

    def fit_fold(f: int):
        train = data.where(F.col("fold") != f)
        test = data.where(F.col("fold") == f)
        if model == "elastic_net":
            sd = train.agg(F.stddev_samp("_y")).first()[0] or 1.0
            reg, mix = elastic_net_params(ELASTIC_ALPHA, ELASTIC_L1_RATIO, sd)
            est = LinearRegression(featuresCol="features", labelCol="_ys", regParam=reg, elasticNetParam=mix, standardization=False)
            fitted = Pipeline(stages=[*_prep_stages(features), est]).fit(train.withColumn("_ys", F.col("_y") / sd))
            p = fitted.transform(test).withColumn("prediction", F.col("prediction") * sd)
            imp = None
        elif model == "gbt":
            est = GBTRegressor(featuresCol="features", labelCol="_y", seed=SEED, **GBT_PARAMS)
            prep = Pipeline(stages=_prep_stages(features)).fit(train)
            # few rows are fitted in one task; else a fit runs a job per tree and level, and every task of them carries the plan behind its rows
            rows = cut_lineage(prep.transform(train).select("features", "_y"))
            fitted = est.fit(rows)
            p = fitted.transform(prep.transform(test))
            imp = fitted.featureImportances.toArray().tolist()
        else:
            raise ValueError(f"unknown model {model!r}")
        cols = p.select(id_col, group_col, "fold", F.col("_y").alias("actual"), F.col("prediction").alias("predicted"))
        return cols, (f, imp) if imp is not None else None

    # Folds are independent fits: submit them together so their jobs share the cluster.
    with ThreadPoolExecutor(max_workers=len(folds)) as pool:
        results = list(pool.map(fit_fold, folds))
    preds = [r[0] for r in results]
    importances = [r[1] for r in results if r[1] is not None]
    out = preds[0]
    for p in preds[1:]:
        out = out.unionByName(p)
    if log_target:
        out = out.withColumn("actual", F.expm1("actual")).withColumn("predicted", F.expm1("predicted"))
    out = out.withColumn("residual", F.col("actual") - F.col("predicted"))
    out = out.persist()  # predictions and metrics share the scored rows; ``data`` stays cached behind them
    metrics = fold_metrics(out)
    if importances:
        spark = df.sparkSession
        imp_df = spark.createDataFrame(
            [(f, feat, float(v)) for f, vals in importances for feat, v in zip(features, vals)],
            "fold int, feature string, importance double",
        )
        top = imp_df.groupBy("fold").agg(F.max_by("feature", "importance").alias("top_feature"))
        metrics = metrics.join(top, "fold", "left")
    return out, metrics


def fold_metrics(scored: DataFrame) -> DataFrame:
    """M4: n, r2, MAE and RMSE per fold of (fold, actual, residual) rows, in one aggregate."""
    e2 = F.sum(F.col("residual") * F.col("residual"))
    total = F.sum(F.col("actual") * F.col("actual")) - F.sum("actual") * F.sum("actual") / F.count("actual")
    return scored.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        (1 - F.try_divide(e2, total)).alias("r2"),
        F.avg(F.abs("residual")).alias("mae"),
        F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"),
    )


# ---------------------------------------------------------------------------
# Clustering and projection (M5-M9)
# ---------------------------------------------------------------------------


def scaled_vectors(df: DataFrame, array_col: str) -> DataFrame:
    """Array column -> dense vector, centred and scaled (Spark's PCA does not centre by itself)."""
    v = df.withColumn("_raw", array_to_vector(F.col(array_col)))
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(v).transform(v)


def kmeans_best_of(df: DataFrame, k: int, starts: int = KMEANS_STARTS, seed: int = SEED):
    """M5: k-means from several seeds (fitted concurrently); the least training cost wins, ties to the first seed."""

    def fit(i: int):
        m = KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(df)
        return m, m.summary.trainingCost, i

    with ThreadPoolExecutor(max_workers=min(starts, 8)) as pool:
        fits = list(pool.map(fit, range(starts)))
    best = min(fits, key=lambda r: (r[1], r[2]))
    return best[0], best[1]


def silhouette(df: DataFrame, prediction_col: str = "cluster") -> float | None:
    """M7: silhouette (squared Euclidean) when 1 < k < n."""
    k = df.select(prediction_col).distinct().count()
    n = df.count()
    if not (1 < k < n):
        return None
    return ClusteringEvaluator(featuresCol="features", predictionCol=prediction_col).evaluate(df)


def bisecting(df: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """M6 re-aimed: top-down bisecting k-means (scales; exact Ward linkage is quadratic)."""
    return BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(df).transform(df)


def pca_2d(df: DataFrame) -> tuple[DataFrame, list[float]]:
    """M8: first two principal components of centred, scaled features and their explained variance."""
    m = PCA(k=2, inputCol="features", outputCol="_pc").fit(df)
    out = m.transform(df).withColumn("_pca", vector_to_array("_pc"))
    return out.withColumn("pc1", F.col("_pca")[0]).withColumn("pc2", F.col("_pca")[1]).drop("_pc", "_pca"), list(
        m.explainedVariance.toArray()
    )


# ---------------------------------------------------------------------------
# Scenario table
# ---------------------------------------------------------------------------

SHOCK = 0.10  # fixed value: drivers move by a tenth in the low and high scenario


def driver_score(df: DataFrame, directions: dict[str, int], min_rows: int = 3) -> Column | None:
    """Mean over the non-null drivers of their z-scores, each with its direction; None if no driver has a spread."""
    stats = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(directions) for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))]).first()
    scores = []
    for i, (c, direction) in enumerate(directions.items()):
        if stats[f"n_{i}"] >= min_rows and (stats[f"s_{i}"] or 0.0) > 1e-12:
            scores.append((F.col(c) - stats[f"m_{i}"]) / stats[f"s_{i}"] * float(direction))
    return row_mean(scores) if scores else None


def shocked(df: DataFrame, directions: dict[str, int], shock: float | Column) -> DataFrame:
    """Every driver moved by ``shock`` in its direction (1: more is better supply, -1: more is more pressure)."""
    return df.withColumns({c: F.col(c) * (1.0 + shock * direction) for c, direction in directions.items()})


def scenario_table(df: DataFrame, id_col: str, directions: dict[str, int], targets: str | list[str] | None, min_target_rows: int = 3) -> DataFrame:
    """Boosted trees (depth 4) of the target on its drivers, scored on the drivers as they are, moved down and moved up.

    ``directions`` names the drivers and which way each moves in the high scenario.  The target is the first of
    ``targets`` with enough values, or the drivers' own score if none has.  It is never a driver of itself (H2).
    ``df`` has one row per id; the three scenarios are scored in one pass.
    """
    targets = [targets] if isinstance(targets, str) else list(targets or [])
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in {*targets, *directions}]).first()
    target = next((t for t in targets if counts[t] >= min_target_rows), None)
    drivers = {c: v for c, v in directions.items() if c != target and counts[c]}
    if target is None:
        score = driver_score(df, drivers, min_target_rows)
        y = F.coalesce(score, F.lit(0.0)) if score is not None else F.lit(0.0)
    else:
        middle = exact_median(df, [], target).first()[0]
        y = F.coalesce(F.col(target).cast("double"), F.lit(middle))
    data = df.withColumn("_y", y)
    trees = regression.GBTRegressor(featuresCol="features", labelCol="_y", maxDepth=4, seed=SEED)
    fitted = Pipeline(stages=[*_prep_stages(list(drivers)), trees]).fit(data)
    shocks = {"baseline": 0.0, "low": -SHOCK, "high": SHOCK}
    moves = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("shock")) for n, v in shocks.items()]))
    rows = shocked(data.select(id_col, *drivers, moves.alias("_move")), drivers, F.col("_move.shock"))
    out = fitted.transform(rows).groupBy(id_col).agg(
        *[F.max(F.when(F.col("_move.name") == n, F.col("prediction"))).alias(f"scenario_{n}") for n in shocks])
    return out.withColumns({"target_metric": F.lit(target or "proxy_driver_score"), "target_is_proxy": F.lit(target is None)})


def mean_fold_scores(folds: DataFrame) -> DataFrame:
    """Mean over the folds of every fold metric, each fold counting once."""
    names = [c for c in folds.columns if c not in ("fold", "n", "top_feature")]
    return folds.agg(F.count(F.lit(1)).alias("n_folds"), *[F.avg(c).alias(f"mean_{c}") for c in names])


def extreme_residuals(scored: DataFrame, id_col: str, k: int = 15) -> DataFrame:
    """The ``k`` highest and ``k`` lowest residuals with their place (1 is the most extreme), ties to the smaller id.

    Rows without a residual take no part; a table of fewer than ``2 k`` rows has rows on both sides.
    """
    both = top_and_bottom(scored, "residual", k, [id_col])
    sign = F.when(F.col("side") == "top", -1).otherwise(1)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy(sign * F.col("residual"), id_col)).cast("int"))
