"""Dataset explorers (B32): one declared spec per family turns filters into ordered series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import ReadError


@dataclass(frozen=True)
class Explorer:
    """Columns of a family: dimensions to filter and group by, the period with its sort key, and the measure."""

    dimensions: tuple[str, ...]
    period: str
    measure: str
    sort_key: Callable[[str], Column] = F.col


def explore(df: DataFrame, spec: Explorer, picks: dict[str, list] | None = None, split: tuple[str, ...] | None = None) -> DataFrame:
    """``series, period, position, value``: rows that pass ``picks``, one series for each value of the ``split`` dimensions.

    An empty or missing pick means all values of that dimension; an unknown one is refused.  ``position`` counts the periods
    that are left, in order, from 1; each series has the positions that it has rows for.  Measures are coerced to numbers;
    rows of one series and period are added up (null if all are null).
    """
    picks = picks or {}
    split = spec.dimensions if split is None else split
    unknown = [c for c in (*picks, *split) if c not in spec.dimensions]
    if unknown:
        raise ReadError(f"not dimensions of this family: {unknown}")
    for c, values in picks.items():
        if values:
            df = df.where(F.col(c).isin(list(values)))
    series = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in split]) if split else F.lit("all")
    points = df.groupBy(series.alias("series"), F.col(spec.period).alias("period")).agg(F.sum(F.expr(f"try_cast(`{spec.measure}` AS DOUBLE)")).alias("value"))
    periods = points.select("period").distinct().withColumn("_key", spec.sort_key("period"))
    placed = periods.withColumn("position", F.row_number().over(Window.orderBy(F.asc_nulls_last("_key"), F.asc("period"))))  # distinct labels
    return points.join(placed.drop("_key"), "period").select("series", "period", "position", "value")
