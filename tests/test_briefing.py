"""Briefing products against figures worked out in pandas, and labels on edge values."""

import pandas as pd
from oracle_harness import SF_SMALL

from tessera.plans import briefing as B


def table(name, *cols):
    return pd.read_parquet(f"{SF_SMALL}/{name}.parquet", columns=list(cols))


def test_labels_of_every_style(spark):
    d = spark.createDataFrame([(1234567.4,), (-0.04,), (None,)], "v double")
    shown = {s: [r[0] for r in d.select(B.metric_label(s, d.v)).collect()] for s in ("count", "share", "decimal", "pound", "signed")}
    assert shown["count"] == ["1,234,567", "0", "—"] and shown["share"][0] == "1,234,567.4" and shown["decimal"][0] == "1,234,567.40"
    assert shown["pound"][0] == "£1,234,567" and shown["signed"][0] == "+1,234,567.4"
    assert {v[2] for v in shown.values()} == {"—"}


def test_mapped_metrics_rank_and_bin_every_metric(spark):
    got = B.mapped_metrics(spark, SF_SMALL).toPandas()
    n = len(table("nation", "n_nationkey"))
    assert set(got.metric) == set(B.METRICS) and len(got) == n * len(B.METRICS)
    for _, m in got.groupby("metric"):
        there = m[m.value.notna()]
        assert (m.n_values == len(there)).all() and (m[m.value.isna()].label == "—").all()
        if there.empty:
            assert m.median_value.isna().all() and m.bin.isna().all()
            continue
        assert m.is_top.sum() == m.is_bottom.sum() == min(B.TOP, len(there))
        assert there[there.is_top].value.min() >= there[~there.is_top].value.max() if len(there) > B.TOP else True
        assert abs(there.value.median() - m.median_value.iloc[0]) < 1e-3
        want = pd.qcut(there.value, B.BINS, labels=False, duplicates="drop")
        if there.value.nunique() > 1:
            assert (want.to_numpy() == there.bin.to_numpy()).all()


def test_rolling_shares_count_every_line_of_five_years(spark):
    li, p = table("lineitem", "l_partkey", "l_suppkey", "l_shipdate"), table("part", "p_partkey", "p_size")
    x = li.merge(p, left_on="l_partkey", right_on="p_partkey").merge(table("supplier", "s_suppkey"), left_on="l_suppkey", right_on="s_suppkey")
    x["year"] = pd.to_datetime(x.l_shipdate).dt.year
    got = B.energy_trend(spark, SF_SMALL).toPandas()
    got = got[got.geography == B.NATIONAL].set_index("rolling_period").abc_share
    first, last = x.year.min(), x.year.max()
    assert list(got.sort_index().index) == [f"{y - 4} to {y}" for y in range(first + 4, last + 1)]
    for y in range(first + 4, last + 1):
        window = x[x.year.between(y - 4, y)]
        assert abs(got[f"{y - 4} to {y}"] - 100.0 * window.p_size.between(1, 21).mean()) < 1e-5


def test_explorer_totals_add_up(spark):
    got = B.starts_explorer(spark, SF_SMALL).toPandas()
    total = got[got.label == "total_starts"].value.iloc[0]
    for panel, count in (("by_year", "n_years"), ("by_la", "n_las")):
        part = got[got.panel == panel].sort_values("position")
        assert abs(part.value.sum() - total) < 0.1 and len(part) == got[got.label == count].value.iloc[0]
        assert list(part.position) == list(range(1, len(part) + 1))
    assert got[got.panel == "by_la"].sort_values("position").value.is_monotonic_decreasing


def test_watchlist_medians_and_findings(spark):
    o = table("orders", "o_custkey", "o_totalprice", "o_orderdate").merge(table("customer", "c_custkey", "c_nationkey"), left_on="o_custkey", right_on="c_custkey")
    o = o.merge(table("nation", "n_nationkey", "n_name"), left_on="c_nationkey", right_on="n_nationkey")
    want = o.assign(year=pd.to_datetime(o.o_orderdate).dt.year).groupby(["n_name", "year"]).o_totalprice.median()
    got = B.price_watchlist(spark, SF_SMALL).collect()
    assert got and {r.lad_name for r in got} <= set(B.WATCHLIST)
    assert all(abs(r.median_price - want[(r.lad_name, r.year)]) < 1e-3 for r in got)
    found = B.findings_by_topic(spark, SF_SMALL).toPandas()
    assert set(found.topic) == {"affordability", "entry", "regions", "supply", "energy"} and not found.duplicated(["topic", "position"]).any()
