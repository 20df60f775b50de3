"""Exponential smoothing with additive trend and season.

A series is one array; a fold over it keeps level, trend, a ring of the season's terms (its head belongs to the next
period) and the squared one-step errors so far.  Weights come from a coarse grid; around the entry that is best up to a
period a finer grid is folded too, and the best of both gives the state after that period.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of level, trend and season, and the steps of the finer grid around them.
COARSE = list(product((0.2, 0.5, 0.8), (0.05, 0.2), (0.1, 0.4)))
STEPS = list(product((-0.1, 0.0, 0.1), (-0.04, 0.0, 0.04), (-0.08, 0.0, 0.08)))
MIN_POINTS = 8


def min_points(season: int) -> int:
    """Fewest points a seasonal fit is made on: two seasons and two more, eight at least."""
    return max(MIN_POINTS, 2 * season + 2)


def _fold(season: int) -> Column:
    """States (level, trend, ring, sse) after the first season and after each later point, of columns ``ys`` and ``g``."""
    s = season
    first, second = F.slice("ys", 1, s), F.slice("ys", s + 1, s)
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda a, y: a + y) / float(s)
    level0 = mean(first)
    start = F.struct(level0.alias("level"), ((mean(second) - level0) / float(s)).alias("trend"),
                     F.transform(first, lambda y: y - level0).alias("ring"), F.lit(0.0).alias("sse"))

    def step(acc: Column, y: Column) -> Column:
        last = F.element_at(acc, -1)
        term = F.element_at(last["ring"], 1)
        ahead = last["level"] + last["trend"] + term
        level = F.col("g.a") * (y - term) + (F.lit(1.0) - F.col("g.a")) * (last["level"] + last["trend"])
        trend = F.col("g.b") * (level - last["level"]) + (F.lit(1.0) - F.col("g.b")) * last["trend"]
        new = F.col("g.c") * (y - level) + (F.lit(1.0) - F.col("g.c")) * term
        ring = F.concat(F.slice(last["ring"], 2, s - 1), F.array(new))
        return F.concat(acc, F.array(F.struct(level.alias("level"), trend.alias("trend"), ring.alias("ring"),
                                              (last["sse"] + (y - ahead) * (y - ahead)).alias("sse"))))

    return F.aggregate(F.slice("ys", F.lit(s + 1), F.size("ys") - s), F.array(start), step)


def _grid(entries: list[tuple[float, float, float]]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("abc", e)]) for e in entries])


def seasonal_states(pts: DataFrame, season: int, last_only: bool = False) -> DataFrame:
    """``series_id, o, level, trend, ring, a, b, c`` after the first ``o`` points, for every o that is long enough.

    With ``last_only`` that is the state after a series' last point alone, as forecasts from the end need it.

    Errors are compared after rounding to six places, ties to the smaller weights, so equal fits are chosen alike.
    """
    least = min_points(season)
    ys = pts.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "y"))), lambda e: e["y"]).alias("ys"))
    ys = ys.where(F.size("ys") >= least)
    from_o = F.size("ys") if last_only else F.lit(least)

    def states(rows: DataFrame, *keep: str) -> DataFrame:
        each = rows.select("series_id", "g", *keep, from_o.alias("_from"), F.posexplode(_fold(season)).alias("p", "s"))
        return each.where(F.col("p") + season >= F.col("_from")).select("series_id", *keep, (F.col("p") + season).alias("o"), "g", "s")

    best = lambda value: F.min_by(value, F.struct(F.round("s.sse", 6), "g.a", "g.b", "g.c"))
    coarse = states(ys.select("series_id", "ys", F.explode(_grid(COARSE)).alias("g"))).groupBy("series_id", "o").agg(best("g").alias("base"))
    near = F.transform(_grid(STEPS), lambda d: F.struct(*[F.round(F.least(F.greatest(F.col(f"base.{n}") + d[n], F.lit(0.01)), F.lit(0.99)), 2).alias(n) for n in "abc"]))
    tried = coarse.select("series_id", "base").distinct().join(ys, "series_id").select("series_id", "base", "ys", F.explode(F.array_distinct(near)).alias("g"))
    fine = states(tried, "base").join(coarse, ["series_id", "base", "o"])
    return fine.groupBy("series_id", "o").agg(best(F.struct("s.level", "s.trend", "s.ring", "g.a", "g.b", "g.c")).alias("_best")).select(
        "series_id", "o", "_best.*")


def seasonal_path(states: DataFrame, season: int, horizon: int) -> DataFrame:
    """``series_id, o, k, pred``: forecasts k = 1..horizon after each state."""
    steps = states.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("k"))
    term = F.element_at("ring", F.pmod(F.col("k") - 1, F.lit(season)).cast("int") + 1)
    return steps.select("series_id", "o", "k", (F.col("level") + F.col("k") * F.col("trend") + term).alias("pred"))
