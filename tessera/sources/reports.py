"""Backtest report documents: model choice and the report browser.

Reports are JSON documents (S8) with ``meta`` (dataset, geography, horizon,
edition, sheet) and ``summary`` (best model by MAE, per-model means).  They
are read as a DataFrame and flattened with ``explode``; selection and means
are aggregates, so thousands of reports are handled like any other table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import area_scope, horizon_bucket


def report_rows(reports: DataFrame) -> DataFrame:
    """One row per (report, model): geography, scope (X7), horizon, bucket (X13), and the model's mean metrics."""
    r = reports.select(
        "file",
        F.col("meta.dataset").alias("dataset"), F.col("meta.geography").alias("geography"),
        F.col("meta.horizon").cast("int").alias("horizon"), F.col("meta.edition").alias("edition"),
        F.col("meta.sheet").alias("sheet"), F.col("summary.best_model_mae").alias("best_model"),
        F.explode_outer("summary.summary_by_model").alias("m"),
    ).where(F.col("geography").isNotNull())
    return r.select(
        "file", "dataset", "geography", area_scope("geography").alias("scope"), "horizon",
        horizon_bucket("horizon").alias("horizon_bucket"), "edition", "sheet", "best_model",
        F.col("m.model").alias("model"), F.col("m.mae").cast("double").alias("mae"),
        F.col("m.coverage_p10_p90").cast("double").alias("coverage_p10_p90"),
        F.col("m.pinball_p50").cast("double").alias("pinball_p50"),
    )


def pick_models(rows: DataFrame, edition: str, sheet: str, horizon: int, geographies: list[str], rule: str = "best_mae") -> DataFrame:
    """Models named best in earlier reports for this edition, sheet and horizon.

    Every requested geography must have a report; otherwise ``complete`` is false
    and the caller falls back to its default models.
    """
    sel = rows.where((F.col("edition") == edition) & (F.col("sheet") == sheet) & (F.col("horizon") == horizon) & F.col("geography").isin(geographies))
    if rule != "best_mae":
        raise ValueError(f"unknown rule {rule!r}")
    best = sel.select("geography", "best_model").distinct()
    return best.agg(
        F.sort_array(F.collect_set("best_model")).alias("models"),
        (F.countDistinct("geography") == len(set(geographies))).alias("complete"),
    )


def browser_summary(rows: DataFrame, scope: str | None = None) -> DataFrame:
    """Mean metrics per (horizon bucket, model), optionally for one scope, with report counts."""
    r = rows.where(F.col("model") == F.col("best_model"))
    if scope is not None:
        r = r.where(F.col("scope") == scope)
    return r.groupBy("horizon_bucket", "model").agg(
        F.count(F.lit(1)).alias("n_reports"), F.avg("mae").alias("mae"),
        F.avg("coverage_p10_p90").alias("coverage_p10_p90"), F.avg("pinball_p50").alias("pinball_p50"),
    )
