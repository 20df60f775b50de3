"""Reshaping, joins, aggregates and windows on inline frames (facts of the reference's tests)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregate as A
from tessera.operators import joins as J
from tessera.operators import tidy as T
from tessera.operators import windows as W


def test_clean_wide_la_checks_year_columns(spark):
    df = spark.createDataFrame([("LA", "North East", "E06000001", "Hartlepool", "10", "20")],
                               "a string, b string, c string, d string, `2019-2020` string, `2020-2021` string")
    out = T.clean_wide_la(df)
    assert out.columns[:4] == T.LA_ID_COLUMNS
    bad = spark.createDataFrame([("LA", "x", "E06", "y", "1")], "a string, b string, c string, d string, `2019-20` string")
    with pytest.raises(T.LayoutError):
        T.clean_wide_la(bad)


def test_header_contract_raises(spark):
    df = spark.createDataFrame([("a", "b")], "`Country or region code` string, `Country or region name` string")
    T.assert_headers(df, ["Country or region code", "Country or region name"])
    with pytest.raises(T.LayoutError):
        T.assert_headers(df, ["Country or region name", "Country or region code"])


def test_melt_and_band_split(spark):
    df = spark.createDataFrame([("E12000001", "North East", "1.5", "[x]")], "code string, name string, `Detached - Band A` string, `Flats and maisonettes - Band B` string")
    long = T.melt_numeric(df, ["code", "name"], None, "label", "percentage")
    parts = long.select(*T.split_label("label", T.DIM_BAND_RE, ["property_type", "epc_band"]), "percentage").collect()
    got = {(r["property_type"], r["epc_band"]): r["percentage"] for r in parts}
    assert got == {("Detached", "A"): 1.5, ("Flats and maisonettes", "B"): None}


def test_longest_prefix_split(spark):
    df = spark.createDataFrame([("Flats gas",), ("Flats and maisonettes oil",)], "label string")
    out = df.select(*T.split_by_prefix("label", ["Flats", "Flats and maisonettes"])).collect()
    assert [(r["prefix"], r["rest"]) for r in out] == [("Flats", "gas"), ("Flats and maisonettes", "oil")]


def test_two_block_sheet(spark):
    df = spark.createDataFrame(
        [("Jan 2011", "1", "2", None, "Jan 2011", "0.5", "0.6")],
        "`Time period` string, `First time buyer` string, `Former owner occupier` string, `Unnamed: 3` string, `Time period.1` string, `First time buyer.1` string, `Former owner occupier.1` string",
    )
    out = T.two_block_melt(df, ["Time period", "First time buyer", "Former owner occupier"],
                           ["Time period.1", "First time buyer.1", "Former owner occupier.1"], "time_period", ("level", "annual_change"))
    rows = {(r["table_block"], r["series"]): r["value"] for r in out.collect()}
    assert rows[("level", "First time buyer")] == 1.0 and rows[("annual_change", "Former owner occupier")] == 0.6


def test_year_property_split_and_slugs(spark):
    df = spark.createDataFrame([("2019_Detached house",)], "c string")
    r = df.select(*T.split_year_property("c")).first()
    assert (r["year"], r["property_type"]) == (2019, "Detached house")
    assert T.unique_slugs(["Sex (2 categories)", "Sex (2 categories)", "x" * 80]) == ["sex_2_categories", "sex_2_categories_1", "x" * 72]


def test_drop_empty(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "x string, y string")
    out = T.drop_empty(df)
    assert out.columns == ["x"] and out.count() == 1


def test_pivots(spark):
    df = spark.createDataFrame([("a", "m1", 1, 5.0), ("a", "m1", 0, 7.0), ("a", "m2", 0, None), ("b", "m2", 0, None)], "k string, m string, o int, v double")
    first = {r["k"]: (r["x_m1"], r["x_m2"]) for r in T.pivot_first(df, ["k"], "m", "v", ["m1", "m2"], "o", "x_").collect()}
    assert first == {"a": (7.0, None)}  # all-null key dropped (N4), first by order (N3)
    sums = {r["k"]: (r["s_m1"], r["s_m2"]) for r in T.pivot_sum(df, ["k"], "m", "v", ["m1", "m2"], "s_").collect()}
    assert sums == {"a": (12.0, 0.0), "b": (0.0, 0.0)}  # N2: all-null total is 0


def test_union_and_columns(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, "z")], "x int, y string")
    u = T.union_all([a, b])
    assert sorted(u.columns) == ["x", "y"] and u.count() == 2
    e = T.ensure_columns(a, {"y": "string"})
    assert e.columns == ["x", "y"]
    al = T.alias_columns(spark.createDataFrame([(1.0,)], "region_supply_completions double"), {"region_supply_completed": "region_supply_completions"})
    assert "region_supply_completed" in al.columns


def test_rank_min_method_and_nulls(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", 5.0), ("d", None)], "k string, v double")
    r = {x["k"]: x["r"] for x in df.select("k", W.rank_desc("v").alias("r")).collect()}
    assert r == {"a": 1, "b": 1, "c": 3, "d": None}


@pytest.mark.parametrize("values", [list(range(7)), [1, 1, 1, 2, 3, 3, 9, 9, 9, 9], [5.5, 1.25, 3.0, 3.5, 8.75, 2.0, 4.0, 7.25]])
def test_quantile_bins_match_qcut(spark, values):
    import pandas as pd

    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    edges = W.quantile_edges(df, "v", 5).first()["edges"]
    bins = [r["b"] for r in df.select("i", W.quantile_bin("v", F.lit(edges)).alias("b")).orderBy("i").collect()]
    assert bins == pd.qcut(values, 5, labels=False, duplicates="drop").tolist()


def test_exact_median_with_skewed_group(spark):
    rows = [("hot", float(i % 7)) for i in range(3000)] + [("cold", 1.0), ("cold", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    med = {r["g"]: r["m"] for r in A.exact_median(df, ["g"], "v", "m").collect()}
    assert med == {"hot": 3.0, "cold": 2.0}


def test_endpoint_delta_and_semi_anti(spark):
    df = spark.createDataFrame([("A", 2020, 100.0), ("A", 2024, 120.0), ("B", 2024, 1.0)], "k string, y int, v double")
    d = {r["k"]: r["d"] for r in A.endpoint_delta(df, "k", "y", "v", F.lit(2020), F.lit(2024), "d").collect()}
    assert d == {"A": 20.0}
    keys = spark.createDataFrame([("A",)], "k string")
    assert J.keep_keys(df, keys, "k").count() == 2
    assert J.missing_keys_count(df, keys, "k").first()["n_missing"] == 1


def test_first_last_growth_and_rebase(spark):
    rows = [("England", dt.date(2020, 1, 1), 100.0), ("England", dt.date(2020, 2, 1), 110.0)]
    df = spark.createDataFrame(rows, "g string, m date, v double")
    g = W.first_last_growth(df, ["g"], "m", "v").first()
    assert round(g["growth_pct"], 9) == 10.0 and g["n_points"] == 2
    r = {x["m"]: x["index"] for x in W.rebase(df, ["g"], "m", "v", F.lit(dt.date(2020, 1, 1))).collect()}
    assert r[dt.date(2020, 2, 1)] == pytest.approx(110.0)


def test_top_k_ties_keep_key_order(spark):
    df = spark.createDataFrame([("b", 5.0), ("a", 5.0), ("c", 1.0), ("d", None)], "k string, v double")
    assert [r["k"] for r in A.top_k(df, "v", 2, ["k"]).collect()] == ["a", "b"]
    tb = A.top_and_bottom(df, "v", 1, ["k"]).collect()
    assert {(r["side"], r["k"]) for r in tb} == {("top", "a"), ("bottom", "c")}


def test_arg_best_breaks_ties_by_text(spark):
    df = spark.createDataFrame([("g", 2.0, "z"), ("g", 2.0, "b"), ("g", 1.0, "a"), ("h", None, "c")], "k string, v double, t string")
    assert [tuple(r) for r in A.arg_best(df, ["k"], "v", "t", ["t"]).collect()] == [("g", "b")]
    assert [tuple(r) for r in A.arg_best(df, ["k"], "v", "t", ["t"], largest=False).collect()] == [("g", "a")]


def test_salted_join_keeps_every_match(spark):
    big = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1)], "k string, i int")
    other = spark.createDataFrame([("hot", "H"), ("cold", "C"), ("none", "N")], "k string, v string")
    out = J.salted_join(big, other, "k", salts=8)
    assert out.count() == 501
    assert out.where("k = 'hot'").select("i").distinct().count() == 500
    left = J.salted_join(big.union(spark.createDataFrame([("x", 9)], "k string, i int")), other, "k", salts=4, how="left")
    assert left.where("k = 'x'").first()["v"] is None and left.count() == 502


def test_bucketed_tables_join_without_exchange(spark, tmpdir_path):
    from tessera.sources.layout import bucketed_tables

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(1000).selectExpr("id % 100 as k", "id as v")
        b = spark.range(100).selectExpr("id as k", "id * 2 as w")
        t = bucketed_tables(spark, {"bk_a": a, "bk_b": b}, "k", 8, tmpdir_path)
        joined = t["bk_a"].join(t["bk_b"], "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exact_quantiles_bracket_path_matches_numpy(spark):
    import random

    import numpy as np

    rng = random.Random(1)
    rows = [("big", rng.random() * 100) for _ in range(20000)] + [("small", v) for v in (1.0, 3.0, 3.0, 7.0)] + [("tied", 5.0)] * 3000
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r["g"]: r for r in A.exact_quantiles(df, ["g"], "v", probs, accuracy=500).collect()}
    for g in ("big", "small", "tied"):
        vals = np.array([v for k, v in rows if k == g])
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(float(np.quantile(vals, p)), abs=1e-9), (g, name)


def test_exact_quantiles_of_a_million_distinct_values(spark):
    import numpy as np

    df = spark.range(1_100_000).select((F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / 1e6 + F.exp(F.rand(3) * 20)).alias("v")).cache()
    probs = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    q = A.exact_quantiles(df, [], "v", probs)
    got = q.first()
    vals = df.toPandas()["v"].to_numpy()
    assert len(np.unique(vals)) > 1_000_000
    for name, p in probs.items():
        assert got[name] == pytest.approx(float(np.quantile(vals, p)), rel=1e-12), name
    df.unpersist()


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_exact_quantiles_plan_gathers_nothing(spark, keys):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    plan = A.exact_quantiles(df, keys, "v", {"a": 0.2, "b": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
