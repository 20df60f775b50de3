"""Stacked joins, dense months, explorers, seasonal smoothing and recursive trees against brute force."""

import datetime as dt
import math
from itertools import product

import pytest
from pyspark.errors import PySparkException
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tessera.operators import explore as E
from tessera.operators import joins as J
from tessera.operators import seasonal as S
from tessera.operators import trees as TR
from tessera.operators import windows as W
from tessera.sources.catalog import ReadError


def test_stacked_join_equals_a_chain_in_one_exchange(spark, tmpdir_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "k string, s int").write.parquet(f"{tmpdir_path}/s")
    spine = spark.read.parquet(f"{tmpdir_path}/s")
    sources = {}
    for i in range(10):
        path = f"{tmpdir_path}/t{i}"
        spark.createDataFrame([(k, float(i), f"{k}{i}") for k in "abcdz"[i % 3 : i % 3 + 3]] + [(None, -1.0, "none")],
                              f"k string, v{i} double, w{i} string").write.parquet(path)
        sources[str(i)] = spark.read.parquet(path)
    out = J.stack_left_join(spine, "k", sources | {"absent": None})
    want = J.left_chain(spine, "k", list(sources.values()))
    assert out.columns == want.columns
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # before adaptive execution adds its final plan
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(PySparkException):
        J.stack_left_join(spine, "k", {"x": spark.createDataFrame([("a", 1), ("a", 2)], "k string, x int")}).collect()
    with pytest.raises(ValueError):
        J.stack_left_join(spine, "k", {"x": spark.createDataFrame([("a", 1)], "k string, s int")})


def test_a_missing_month_shifts_no_change(spark):
    months = [dt.date(2020 + m // 12, m % 12 + 1, 1) for m in range(30)]
    rows = [("a", d, float(i + 1)) for i, d in enumerate(months) if i not in (5, 6, 20)] + [("b", months[3], 7.0)]
    dense = W.dense_months(spark.createDataFrame(rows, "g string, month date, v double"), ["g"], "month")
    assert {r.g: (r.n_months, r.n_missing, r.first_missing) for r in W.month_gaps(dense, ["g"], "month").collect()} == {"a": (30, 3, months[5]), "b": (1, 0, None)}
    got = {(r.g, r.month): r.c for r in W.change_by_date(dense, ["g"], "month", "v", 12, "c").collect()}
    values = {d: v for g, d, v in rows if g == "a"}
    for i, d in enumerate(months):
        then = values.get(months[i - 12]) if i >= 12 else None
        want = (values[d] / then - 1) * 100 if d in values and then else None
        assert (got["a", d] is None) == (want is None) and (want is None or got["a", d] == pytest.approx(want))


def test_explorer_filters_orders_and_refuses(spark):
    rows = [("x", "2021-22", "1"), ("x", "2020-21", "2.5"), ("y", "2020-21", "[c]"), ("x", "2021-22", "4"), ("z", "2019-20", "9"), (None, "2020-21", "3")]
    df = spark.createDataFrame(rows, "g string, p string, v string")
    spec = E.Explorer(("g",), "p", "v")
    got = sorted(map(tuple, E.explore(df, spec, {"g": ["x", "y"]}).collect()), key=str)
    assert got == [("x", "2020-21", 1, 2.5), ("x", "2021-22", 2, 5.0), ("y", "2020-21", 1, None)]
    assert sorted(map(tuple, E.explore(df, spec, {"g": []}, split=()).collect())) == [("all", "2019-20", 1, 9.0), ("all", "2020-21", 2, 5.5), ("all", "2021-22", 3, 5.0)]
    with pytest.raises(ReadError):
        E.explore(df, spec, {"v": ["1"]})
    assert E.explore(df.limit(0), spec).count() == 0


def fold(ys, s, a, b, c):
    """Plain additive Holt-Winters: states after s, s + 1, ... points."""
    mean = lambda v: sum(v) / len(v)
    level, trend = mean(ys[:s]), (mean(ys[s : 2 * s]) - mean(ys[:s])) / s
    ring, sse = [y - level for y in ys[:s]], 0.0
    out = [(level, trend, list(ring), sse)]
    for y in ys[s:]:
        term, ahead = ring[0], level + trend + ring[0]
        new = a * (y - term) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        level = new
        ring = ring[1:] + [c * (y - level) + (1 - c) * term]
        sse += (y - ahead) ** 2
        out.append((level, trend, list(ring), sse))
    return out


def best_state(ys, s, o):
    pick = lambda grid: min(grid, key=lambda g: (round(fold(ys[:o], s, *g)[-1][3], 6), g))
    base = pick(S.COARSE)
    near = {tuple(round(min(max(v + d, 0.01), 0.99), 2) for v, d in zip(base, step)) for step in S.STEPS}
    g = pick(sorted(near))
    return g, fold(ys[:o], s, *g)[-1]


def test_seasonal_smoothing_equals_a_plain_fold(spark):
    series = {"a": [100 + 0.5 * t + 10 * math.sin(t * math.pi / 2) + (t * 7919 % 13) / 10 for t in range(16)], "b": [5.0 + t % 4 for t in range(13)], "short": [1.0] * 9}
    pts = spark.createDataFrame([(k, t, float(y)) for k, ys in series.items() for t, y in enumerate(ys)], "series_id string, t int, y double")
    got = {(r.series_id, r.o): r for r in S.seasonal_states(pts, 4).collect()}
    assert set(got) == {(k, o) for k, ys in series.items() for o in range(10, len(ys) + 1)}
    for (k, o), r in got.items():
        g, (level, trend, ring, _) = best_state(series[k], 4, o)
        assert (r.a, r.b, r.c) == g and r.level == pytest.approx(level) and r.trend == pytest.approx(trend) and list(r.ring) == pytest.approx(ring)
    last = S.seasonal_states(pts, 4, last_only=True)
    assert {(r.series_id, r.o) for r in last.collect()} == {("a", 16), ("b", 13)}
    for r in S.seasonal_path(last, 4, 6).collect():
        _, (level, trend, ring, _) = best_state(series[r.series_id], 4, r.o)
        assert r.pred == pytest.approx(level + r.k * trend + ring[(r.k - 1) % 4])


def test_recursive_trees_equal_a_plain_recursion(spark):
    series = {f"s{i}": [50 + 10 * i + 8 * math.sin(t / 2 + i) + t for t in range(40)] for i in range(3)} | {"short": [3.0 + t % 3 for t in range(13)], "tiny": [1.0] * 5}
    pts = spark.createDataFrame([(k, t, float(y)) for k, ys in series.items() for t, y in enumerate(ys)], "series_id string, t int, y double")
    arrays = TR.series_arrays(pts).persist()
    assert {r.series_id for r in TR.of_kind(arrays, TR.SHORT_LAGS).collect()} == {"short"}
    for lags, names in ((TR.LONG_LAGS, ["s0", "s1", "s2"]), (TR.SHORT_LAGS, ["short"])):
        mine = TR.of_kind(arrays, lags)
        got = sorted((tuple(round(v, 9) for v in r.features), r.label) for r in TR.training_rows(mine, lags).collect())
        want = sorted((tuple(round(series[n][t - k], 9) for k in lags), series[n][t]) for n in names for t in range(max(lags), int(len(series[n]) * 0.8)))
        assert got == want
    model = TR.fit(TR.of_kind(arrays, TR.LONG_LAGS), TR.LONG_LAGS, depth=3, trees=3)
    rows = TR.of_kind(arrays, TR.LONG_LAGS).select("series_id", F.lit(33).alias("o"), F.slice("ys", 22, 12).alias("recent"))
    for r in TR.recursive_paths(model, rows, TR.LONG_LAGS, 5).collect():
        values = series[r.series_id][:33]
        for _ in range(5):
            values.append(model.predict(Vectors.dense([values[-k] for k in TR.LONG_LAGS])))
        assert list(r.path) == pytest.approx(values[33:])
    assert TR.fit(TR.of_kind(arrays, TR.SHORT_LAGS), TR.SHORT_LAGS) is None  # seven rows are too few


def test_tree_backtest_has_every_window(spark):
    pts = spark.createDataFrame([(f"s{i}", t, 50.0 + 9 * i + (t * 31 % 12)) for i, t in product(range(2), range(30))], "series_id string, t int, y double")
    got = TR.backtest(pts, [1, 3], 12).collect()
    assert {(r.series_id, r.horizon, r.o) for r in got} == {(f"s{i}", h, o) for i in range(2) for h in (1, 3) for o in range(24, 31 - h)}
    assert TR.backtest(pts.limit(0), [1], 12).count() == 0
