"""Ordered operators.

Rules used throughout:

* "first"/"latest" per key is an aggregate (``min_by``/``max_by`` over an
  explicit order struct), not a window: aggregates combine map-side, so a key
  holding a third of the rows never lands whole in one task.
* Windows partitioned by a series id are only applied to series that were
  aggregated to one row per period first, so a partition holds at most the
  number of periods (hundreds), whatever the input volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_desc(value_col: str, partition: list[str] | None = None) -> Column:
    """Rank descending, ties share the lowest rank (method ``min``), NULL value -> NULL rank.

    Without a partition this is a global rank over one row per entity
    (e.g. per local authority); callers aggregate to that grain first.
    """
    w = Window.partitionBy(*(partition or [])).orderBy(F.desc_nulls_last(value_col))
    return F.when(F.col(value_col).isNotNull(), F.rank().over(w))


def latest_rows(df: DataFrame, period_key: Column, period_col: str) -> DataFrame:
    """Rows at the latest period of the whole table (scalar subquery, then a plain filter)."""
    latest = df.agg(F.max(F.struct(period_key.alias("k"), F.col(period_col).alias("p"))).getField("p")).scalar()
    return df.where(F.col(period_col) == latest)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], cols: list[str] | None = None, last: bool = False) -> DataFrame:
    """Keep one row per key — smallest (or largest with ``last``) explicit order.

    Planned as a hash aggregate with ``min_by``/``max_by`` on a struct, so
    duplicates are collapsed map-side before the shuffle.
    """
    cols = [c for c in (cols or df.columns) if c not in keys]
    payload = F.struct(*[F.col(c) for c in cols])
    o = F.struct(*order)
    pick = F.max_by(payload, o) if last else F.min_by(payload, o)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols])


def first_last_growth(df: DataFrame, keys: list[str], order_col: str, value_col: str, min_points: int = 2) -> DataFrame:
    """First and last value in time order, number of points, growth % (base must be nonzero)."""
    d = df.where(F.col(value_col).isNotNull())
    g = d.groupBy(*keys).agg(
        F.min_by(value_col, order_col).alias("first_value"),
        F.max_by(value_col, order_col).alias("last_value"),
        F.min(order_col).alias("first_period"),
        F.max(order_col).alias("last_period"),
        F.count(F.lit(1)).alias("n_points"),
    )
    g = g.where(F.col("n_points") >= min_points)
    return g.withColumn(
        "growth_pct",
        (F.try_divide(F.col("last_value"), F.when(F.col("first_value") != 0, F.col("first_value"))) - 1.0) * 100.0,
    )


def rebase(df: DataFrame, series: list[str], period_col: str, value_col: str, base_period, out: str = "index") -> DataFrame:
    """Value / value at ``base_period`` * 100 per series (NULL if the base is missing or 0)."""
    base = (
        df.where(F.col(period_col) == F.lit(base_period))
        .groupBy(*series)
        .agg(F.max(value_col).alias("_base"))
    )
    out_df = df.join(base, series, "left")
    return out_df.withColumn(
        out, F.try_divide(F.col(value_col), F.when(F.col("_base") != 0, F.col("_base"))) * 100.0
    ).drop("_base")


def lag_features(df: DataFrame, series: list[str], order_col: str, value_col: str, lags: list[int], lead: int | None = None) -> DataFrame:
    """lag_k columns, optional lead target and first difference, row-based within a series."""
    w = Window.partitionBy(*series).orderBy(order_col)
    out = df.withColumns({f"lag_{k}": F.lag(value_col, k).over(w) for k in lags})
    if lead:
        out = out.withColumn(f"lead_{lead}", F.lead(value_col, lead).over(w))
    return out.withColumn("diff_1", F.col(value_col) - F.lag(value_col, 1).over(w))


def pct_change_lag(df: DataFrame, series: list[str], order_col: str, value_col: str, k: int, out: str) -> DataFrame:
    """Percent change against the value k rows earlier."""
    w = Window.partitionBy(*series).orderBy(order_col)
    prev = F.lag(value_col, k).over(w)
    return df.withColumn(out, (F.try_divide(F.col(value_col), F.when(prev != 0, prev)) - 1.0) * 100.0)


def dense_months(df: DataFrame, series: list[str], month_col: str) -> DataFrame:
    """Every month from a series' first to its last, with the rows it has; ``is_gap`` marks months without one."""
    span = df.groupBy(*series).agg(F.min(month_col).alias("_lo"), F.max(month_col).alias("_hi"))
    spine = span.select(*series, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias("_at")).select(*series, F.col("_at").cast("date").alias(month_col))
    return spine.join(df.withColumn("_there", F.lit(True)), [*series, month_col], "left").withColumn("is_gap", F.col("_there").isNull()).drop("_there")


def month_gaps(dense: DataFrame, series: list[str], month_col: str) -> DataFrame:
    """Months, missing months and the first missing month of each series."""
    return dense.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n_months"), F.count_if("is_gap").alias("n_missing"), F.min(F.when(F.col("is_gap"), F.col(month_col))).alias("first_missing"))


def change_by_date(df: DataFrame, series: list[str], month_col: str, value_col: str, months: int, out: str) -> DataFrame:
    """Percent change against the value of the month ``months`` earlier, found by its date (an equi-join).

    A month without a value there has no change; other months are not shifted by it.
    """
    before = df.select(*series, F.add_months(month_col, months).alias(month_col), F.col(value_col).alias("_before"))
    change = (F.try_divide(F.col(value_col), F.when(F.col("_before") != 0, F.col("_before"))) - 1.0) * 100.0
    return df.join(before, [*series, month_col], "left").withColumn(out, change).drop("_before")


def quantile_edges(df: DataFrame, value_col: str, n_bins: int = 5) -> DataFrame:
    """W12 edges: exact linear-interpolated quantiles at 0, 1/n, ..., 1 with duplicates dropped (one row)."""
    from .aggregate import exact_quantiles

    probs = {f"_q{i}": i / n_bins for i in range(n_bins + 1)}
    q = exact_quantiles(df, [], value_col, probs)
    return q.select(F.array_distinct(F.array(*[F.col(k) for k in probs])).alias("edges"))


def quantile_bin(value_col: str, edges="edges", n_bins: int = 5) -> Column:
    """W12 bin code: right-closed intervals over the edges; the minimum falls in bin 0.

    ``edges`` is a column name or a Column (e.g. the scalar subquery of
    ``quantile_edges``).  The edge count is at most ``n_bins + 1``, so the
    count of edges below the value is an unrolled sum of comparisons.
    """
    v = F.col(value_col)
    e = F.col(edges) if isinstance(edges, str) else edges
    below = sum(
        (F.coalesce((F.try_element_at(e, F.lit(i)) < v).cast("int"), F.lit(0)) for i in range(1, n_bins + 2)),
        F.lit(0),
    )
    return F.when(v.isNotNull(), F.greatest(below - 1, F.lit(0)))


def chrono_split_flag(series: list[str], order_col: str, train_share: float) -> Column:
    """First ``floor(n * share)`` rows of each series are training rows."""
    w = Window.partitionBy(*series).orderBy(order_col)
    wn = Window.partitionBy(*series)
    return F.row_number().over(w) <= F.floor(F.count(F.lit(1)).over(wn) * F.lit(train_share))
