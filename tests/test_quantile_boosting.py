"""Quantile boosting against a brute-force recursion, held-out losses, and the scenario and residual reports."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import models as M
from tessera.operators import quantile_boosting as QB
from tessera.plans import playbook as PB


def lower_quantile(values, p):
    """Smallest value that at least a share ``p`` of the values does not exceed."""
    values = sorted(values)
    return values[max(0, math.ceil(p * len(values) - 1e-9) - 1)]


def brute_force(rows, p, rounds, step):
    """One feature with two values: a tree splits by it unless both sides have the same mean gradient."""
    now = {i: lower_quantile([y for _, y in rows], p) for i in range(len(rows))}
    for _ in range(rounds):
        gradient = {i: p if y > now[i] else p - 1 for i, (_, y) in enumerate(rows)}
        sides = {x: [i for i, (v, _) in enumerate(rows) if v == x] for x in (0.0, 1.0)}
        means = [sum(gradient[i] for i in side) / len(side) for side in sides.values()]
        leaves = list(sides.values()) if abs(means[0] - means[1]) > 1e-12 else [list(range(len(rows)))]
        moves = {}
        for leaf in leaves:
            q = lower_quantile([rows[i][1] - now[i] for i in leaf], p)
            moves |= {i: step * q for i in leaf}
        now = {i: now[i] + moves[i] for i in now}
    return now


def test_rounds_equal_a_brute_force_recursion(spark):
    rnd = random.Random(5)
    rows = [(float(i % 2), round(rnd.gauss(10 * (i % 2), 1 + 3 * (i % 2)), 3)) for i in range(41)]
    df = spark.createDataFrame([(i, x, y, True) for i, (x, y) in enumerate(rows)], "i int, x double, y double, t boolean")
    got = QB.quantile_boost(df, ["x"], "y", "t", {"lo": 0.1, "mid": 0.5, "hi": 0.9}, rounds=5, step=0.3).collect()
    assert len(got) == len(rows)
    for name, p in (("lo", 0.1), ("mid", 0.5), ("hi", 0.9)):
        want = brute_force(rows, p, 5, 0.3)
        for r in got:
            assert r[name] == pytest.approx(want[r.i], abs=1e-9), (name, r.i)


def test_held_out_bands_beat_constant_quantiles(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(1500):
        x = rnd.random() * 4
        rows.append((i, x, 3 * x + rnd.gauss(0, 0.2 + x), i % 3 != 0))
    df = spark.createDataFrame(rows, "i int, x double, y double, t boolean").repartition(4)
    bands = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    out = QB.quantile_boost(df, ["x"], "y", "t", bands, rounds=20, step=0.25).where(~F.col("t"))
    flat = {n: lower_quantile([r[2] for r in rows if r[3]], p) for n, p in bands.items()}
    got = QB.band_losses(out, [], "y", bands).first()
    base = QB.band_losses(df.where(~F.col("t")).withColumns({n: F.lit(v) for n, v in flat.items()}), [], "y", bands).first()
    assert got.n == base.n == 500
    assert all(got[f"pinball_{n}"] < 0.8 * base[f"pinball_{n}"] for n in bands)
    assert 0.72 < got.coverage < 0.88


def test_nulls_unknown_labels_and_empty_tables(spark):
    schema = "i int, x double, z double, y double, t boolean"
    rows = [(i, float(i % 5) if i % 7 else None, None, float(i) if i % 4 else None, True if i % 9 else None) for i in range(40)]
    out = QB.quantile_boost(spark.createDataFrame(rows, schema), ["x", "z"], "y", "t", {"m": 0.5}, rounds=2)
    assert out.columns == ["i", "x", "z", "y", "t", "m"] and out.where("m is null").count() == 0 and out.count() == 40
    assert [tuple(r)[:5] for r in out.orderBy("i").collect()] == rows
    none = QB.quantile_boost(spark.createDataFrame(rows, schema), ["z"], "y", "t", {"m": 0.5}, rounds=2)
    learn = [r[3] for r in rows if r[4] and r[3] is not None]
    assert {r.m for r in none.collect()} == {lower_quantile(learn, 0.5)}
    empty = QB.quantile_boost(spark.createDataFrame([], schema), ["x"], "y", "t", {"m": 0.5})
    assert empty.columns[-1] == "m" and empty.count() == 0
    unlabelled = QB.quantile_boost(spark.createDataFrame([(1, 1.0, 1.0, None, True)], schema), ["x"], "y", "t", {"m": 0.5})
    assert [r.m for r in unlabelled.collect()] == [None]
    with pytest.raises(ValueError):
        QB.quantile_boost(spark.createDataFrame(rows, schema), ["x"], "y", "t", {"z": 0.5})


def test_scenarios_take_the_first_target_with_enough_values(spark):
    rows = [(f"a{i}", float(i), float(i % 3), 2.0 * i if i < 2 else None, 5.0 * i) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, up double, down double, thin double, full double").persist()
    out = M.scenario_table(df, "id", {"up": 1, "down": -1}, ["thin", "full"]).collect()
    assert {r.target_metric for r in out} == {"full"} and not any(r.target_is_proxy for r in out) and len(out) == 12
    assert sum(r.scenario_high for r in out) >= sum(r.scenario_baseline for r in out) >= sum(r.scenario_low for r in out)
    proxy = M.scenario_table(df, "id", {"up": 1, "down": -1}, ["thin"]).first()
    assert proxy.target_is_proxy and proxy.target_metric == "proxy_driver_score"
    assert M.scenario_table(df, "id", {"up": 1, "full": 1}, "full").count() == 12  # a target is never its own driver


def test_extreme_residuals_and_fold_means(spark):
    rows = [(i, float(v) if v is not None else None) for i, v in enumerate([5, -3, 5, 0, None, 9, -7, 2])]
    got = M.extreme_residuals(spark.createDataFrame(rows, "id int, residual double"), "id", 3).collect()
    assert sorted((r.place, r.id) for r in got if r.side == "top") == [(1, 5), (2, 0), (3, 2)]
    assert sorted((r.place, r.id) for r in got if r.side == "bottom") == [(1, 6), (2, 1), (3, 3)]
    folds = spark.createDataFrame([(0, 10, 0.5, 1.0), (1, 1000, 0.7, 3.0)], "fold int, n long, r2 double, mae double")
    means = M.mean_fold_scores(folds).first()
    assert (means.n_folds, round(means.mean_r2, 9), means.mean_mae) == (2, 0.6, 2.0)


def test_playbook_targets_by_horizon(spark):
    rnd = random.Random(3)
    rows = [(f"a{g}", 2000 + t, 4 + 0.2 * g + 0.1 * t + rnd.gauss(0, 0.02), float(t)) for g in range(8) for t in range(12)]
    panel = spark.createDataFrame(rows, "g string, y int, v double, d double")
    for h in (1, 3):
        x = PB.change_panel(panel, "g", "y", "v", h)
        assert x.where(F.col("_known") != F.col("y") + h).count() == 0
        r = PB.affordability_target(panel, "g", "y", "v", h).first()
        assert r.target == f"affordability_change_{h}y" and abs(r.estimate - 0.1 * h) < 0.05
    r = PB.adoption_target(panel, "g", "y", "v", ["d"]).first()
    assert r.model == "linear_drivers" and r.estimate_p10 < r.estimate < r.estimate_p90
    both = {r.target for r in PB.divergence_target(panel, "g", "y", "v").collect()}
    assert both == {"divergence_sign", "divergence_size"}
    few = PB.affordability_target(panel.where("y < 2006"), "g", "y", "v", 3).first()  # no third lag before the cut
    assert few.note is None and few.value is not None
    short = PB.adoption_target(panel.limit(2), "g", "y", "v", ["d"]).first()
    assert short.note == "too few panel rows" and short.value is None


def test_playbook_fits_run_over_as_many_partitions_as_rows_need(spark, monkeypatch):
    class Reached(Exception):
        pass

    def fit(self, df):
        seen.append(df.rdd.getNumPartitions())
        raise Reached

    seen = []
    monkeypatch.setattr(PB.Pipeline, "fit", fit)
    panel = spark.range(400).selectExpr("concat('a', id % 20) as g", "cast(2000 + id div 20 as int) as y", "cast(id * 37 % 101 as double) as v")
    wide = panel.repartition(40, "g").persist()  # as it comes out of a large shuffle
    with pytest.raises(Reached):
        PB.affordability_target(wide, "g", "y", "v", 1)
    assert seen == [1]
    monkeypatch.setattr(PB, "PART_ROWS", 100)
    kept = PB.small(wide)
    assert kept.rdd.getNumPartitions() == 4 and sorted(kept.collect()) == sorted(panel.collect())
    assert PB.small(panel.limit(0)).count() == 0


def test_fold_trees_start_from_written_rows(spark, monkeypatch):
    class Trees(M.GBTRegressor):
        def fit(self, df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().fit(df)

    plans = []
    monkeypatch.setattr(M, "GBT_PARAMS", {"maxIter": 3, "stepSize": 0.05, "maxDepth": 2})
    rows = [(i, f"r{i % 4}", float(i % 17), None if i % 9 == 0 else float(i % 5), float(i * 37 % 101)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g string, a double, b double, v double").coalesce(1)
    monkeypatch.setattr(M, "GBTRegressor", Trees)
    preds, _ = M.grouped_cv(df, "id", ["a", "b"], "v", "g", k=2, model="gbt")
    assert len(plans) == 2 and not any("InMemory" in p or "Join" in p for p in plans)
    got = {r.id: r.predicted for r in preds.collect()}
    data = df.withColumn("_y", F.col("v")).join(M.fold_table(df, "g", 2), "g")
    for f in (0, 1):
        est = M.GBTRegressor(featuresCol="features", labelCol="_y", seed=M.SEED, **M.GBT_PARAMS)
        whole = M.Pipeline(stages=[*M._prep_stages(["a", "b"]), est]).fit(data.where(F.col("fold") != f))
        for r in whole.transform(data.where(F.col("fold") == f)).collect():
            assert got[r.id] == pytest.approx(r.prediction)
    assert len(got) == 120
