"""Quantile boosting (M13): trees on the gradient of the pinball loss, leaf values refitted to the quantile.

``pyspark.ml`` has no quantile loss.  Each round fits one regression tree per quantile on the loss's gradient (``p`` where
the value lies above the prediction, ``p - 1`` elsewhere), replaces the tree's leaf values by the ``p``-quantile of the
residuals in the leaf, and moves every prediction a step towards them.  All quantiles share a pass: one aggregate per
round gives the leaf values of all their trees.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# The reference's settings.
ROUNDS, STEP, DEPTH = 100, 0.1, 3
SEED = 42
# Rank error of a leaf value is at most one part in this; a leaf with fewer rows gets the exact order statistic.
LEAF_ACCURACY = 10_000


def quantile_boost(df: DataFrame, features: list[str], label: str, is_train: str, probs: dict[str, float],
                   rounds: int = ROUNDS, step: float = STEP, depth: int = DEPTH) -> DataFrame:
    """``df`` with one prediction column per entry of ``probs`` (name -> probability), for training and other rows alike.

    Trees and leaf values come from rows where ``is_train`` holds and the label is known; the others are only scored.
    Null features take the training median.  A quantile is the smallest value that at least that share of rows does not
    exceed.  Without a training row every prediction is null.  Rows are scored as the rounds go, so no chain of trees is
    kept; each round is cut off in the shared checkpoint folder, so the plan does not grow with their number.
    """
    names = list(probs)
    taken = {n for n in names if n in df.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are already there")
    learn = F.coalesce(F.col(is_train), F.lit(False)) & F.col(label).isNotNull()
    train = df.where(learn)
    quantiles = F.array(*[F.lit(float(probs[n])) for n in names])
    known = train.agg(F.percentile_approx(F.col(label).cast("double"), quantiles, LEAF_ACCURACY), *[F.count(c) for c in features]).first()
    if known[0] is None:
        return df.withColumns({n: F.lit(None).cast("double") for n in names})
    used = [c for c, n in zip(features, known[1:]) if n]  # a feature without any training value says nothing
    if not used:
        return df.withColumns({n: F.lit(known[0][i]) for i, n in enumerate(names)})
    keep = list(df.columns)
    filled = [f"_in_{i}" for i in range(len(used))]
    base = df.withColumns({f: F.col(c).cast("double") for f, c in zip(filled, used)})
    base = Imputer(inputCols=filled, outputCols=filled, strategy="median").fit(base.where(learn)).transform(base)
    base = VectorAssembler(inputCols=filled, outputCol="_features").transform(base).drop(*filled)
    state = cut_lineage(base.withColumns({n: F.lit(known[0][i]) for i, n in enumerate(names)}))

    def grow(i: int):
        n, p = names[i], probs[names[i]]
        gradient = F.when(F.col(label) > F.col(n), p).otherwise(p - 1.0)
        tree = DecisionTreeRegressor(featuresCol="_features", labelCol="_gradient", predictionCol=f"_mean_{i}", leafCol=f"_leaf_{i}", maxDepth=depth, seed=SEED)
        return tree.fit(state.where(learn).select("_features", gradient.alias("_gradient")))

    with ThreadPoolExecutor(max_workers=len(names)) as pool:  # the quantiles' trees are independent fits
        for _ in range(rounds):
            placed = state
            for tree in pool.map(grow, range(len(names))):
                placed = tree.transform(placed)
            values = _leaf_values(placed.where(learn), names, label, quantiles)
            placed = placed.withColumns({n: F.col(n) + step * _looked_up(values[i], f"_leaf_{i}") for i, n in enumerate(names)})
            state = cut_lineage(placed.select(*keep, "_features", *names))
    return state.drop("_features")


def _leaf_values(train: DataFrame, names: list[str], label: str, quantiles: Column) -> list[dict[float, float]]:
    """Per quantile: leaf -> quantile of its residuals.  At most 2^depth rows a quantile reach the driver."""
    each = [F.struct(F.lit(i).alias("i"), F.col(f"_leaf_{i}").alias("leaf"), (F.col(label) - F.col(n)).alias("r")) for i, n in enumerate(names)]
    rows = train.select(F.explode(F.array(*each)).alias("e")).select("e.*")
    out: list[dict[float, float]] = [{} for _ in names]
    for r in rows.groupBy("i", "leaf").agg(F.percentile_approx("r", quantiles, LEAF_ACCURACY).alias("q")).collect():
        out[r["i"]][r["leaf"]] = r["q"][r["i"]]
    return out


def _looked_up(values: dict[float, float], leaf: str) -> Column:
    """Value of the row's leaf; one that no training row reaches moves nothing."""
    pairs = [F.lit(v) for kv in sorted(values.items()) for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(leaf)), F.lit(0.0))


def band_loss_columns(actual: str, bands: dict[str, float]) -> list[Column]:
    """Number of rows, mean pinball loss of each band column and share of values from the lowest to the highest band."""
    names = sorted(bands, key=lambda n: bands[n])
    y = F.col(actual)
    loss = lambda n: F.avg(F.greatest(bands[n] * (y - F.col(n)), (bands[n] - 1.0) * (y - F.col(n))))
    inside = F.avg(F.when(y.between(F.col(names[0]), F.col(names[-1])), 1.0).otherwise(0.0))
    return [F.count(F.lit(1)).alias("n"), *[loss(n).alias(f"pinball_{n}") for n in names], inside.alias("coverage")]


def band_losses(df: DataFrame, keys: list[str], actual: str, bands: dict[str, float]) -> DataFrame:
    """``band_loss_columns`` per group, over the rows that have a value and a full band."""
    return df.na.drop(subset=[actual, *bands]).groupBy(*keys).agg(*band_loss_columns(actual, bands))
