"""Sources and sinks on files written to a scratch folder."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import tidy as T
from tessera.sources import catalog as C
from tessera.sources import files as S
from tessera.sources import manifest as MF
from tessera.sources import sinks as K
from tessera.sources import workbook as WB

from xlsx_fixture import write_xlsx


def test_workbook_cells_and_epc_layout(spark, tmpdir_path):
    rows = [["Table 1a"], ["note"], [], ["source"],
            ["Country or region code", "Country or region name", "Band A", "Band B"],
            ["E92000001", "England", 1.5, "[x]"], ["W92000004", "Wales", 2, 3.25]]
    write_xlsx(os.path.join(tmpdir_path, "ons_epc_march2025.xlsx"), {"1a": rows, "Notes": [["n"]]})
    cells = WB.read_cells(spark, tmpdir_path)
    assert cells.where(F.col("sheet") == "1a").count() == 15
    wide = WB.sheet_frame(cells, "1a", header_row=5)
    T.assert_headers(wide, ["Country or region code", "Country or region name"])
    long = T.melt_numeric(wide, ["Country or region code", "Country or region name"], None, "label", "percentage")
    got = {(r["Country or region name"], r["epc_band"]): r["percentage"]
           for r in long.select("Country or region name", *T.split_label("label", T.BAND_RE, ["epc_band"]), "percentage").collect()}
    assert got == {("England", "A"): 1.5, ("England", "B"): None, ("Wales", "A"): 2.0, ("Wales", "B"): 3.25}


def test_two_row_header(spark, tmpdir_path):
    rows = [["LA Name", "LA Code", 2019, 2019], [None, None, "Detached", "Flat"], ["Hartlepool", "E06000001", 150000, 90000]]
    write_xlsx(os.path.join(tmpdir_path, "explorer.xlsx"), {"s": rows})
    wide = WB.sheet_frame(WB.read_cells(spark, tmpdir_path), "s", header_row=1, header_rows=2)
    assert wide.columns == ["LA Name", "LA Code", "2019_Detached", "2019_Flat"]


def test_census_csv(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "census.csv")
    with open(p, "w") as f:
        f.write("Lower tier local authorities Code,Lower tier local authorities,Sex (2 categories) Code,Sex (2 categories),Observation\n")
        f.write("E06000001,Hartlepool,1,Female,47000\nE06000001,Hartlepool,2,Male,45000\n")
    df = S.read_census_csv(spark, p)
    assert df.count() == 2 and df.agg(F.sum("Observation")).first()[0] == 92000
    bad = os.path.join(tmpdir_path, "bad.csv")
    with open(bad, "w") as f:
        f.write("a,b\n1,2\n")
    with pytest.raises(T.LayoutError):
        S.read_census_csv(spark, bad)


def test_rents_contract(spark):
    cols = ["v4_1", "Data Marking", "mmm-yy", "Time", "administrative-geography", "Geography", "index-and-year-change", "IndexAndYearChange"]
    df = spark.createDataFrame([("101.5", " ", "Jul-17", "Jul-17", "E92000001", "England", "index", "Index")], ", ".join(f"`{c}` string" for c in cols))
    out = S.rents_contract(df).first()
    assert out["value"] == 101.5 and out["data_marking"] is None and out["geography_name"] == "England"
    renamed = df.withColumnRenamed("v4_1", "v4_2")
    assert S.rents_contract(renamed).count() == 1
    with pytest.raises(T.LayoutError):
        S.rents_contract(df.withColumnRenamed("Geography", "Place"))


def test_json_reports_skip_broken_files(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "ts_backtest_a.json"), "w") as f:
        json.dump({"meta": {"geography": "London", "horizon": 3}, "summary": {"best_model_mae": "ets"}}, f)
    with open(os.path.join(tmpdir_path, "ts_backtest_b.json"), "w") as f:
        f.write("{not json")
    df = S.read_reports(spark, tmpdir_path)
    assert [r["meta"]["geography"] for r in df.collect()] == ["London"]


def test_geojson_bounds(spark, tmpdir_path):
    gj = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"LAD22CD": " e06000001 "}, "geometry": {"type": "Polygon", "coordinates": [[[-1.5, 54.5], [-1.0, 54.7], [-1.2, 54.9], [-1.5, 54.5]]]}},
    ]}
    p = os.path.join(tmpdir_path, "b.geojson")
    with open(p, "w") as f:
        json.dump(gj, f)
    feats = S.read_geojson(spark, p)
    assert feats.first()["code"] == "E06000001"
    b = S.geojson_bounds(feats).first()
    assert (b["min_lon"], b["min_lat"], b["max_lon"], b["max_lat"]) == (-1.5, 54.5, -1.0, 54.9)


def test_manifest_and_incremental(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out = os.path.join(tmpdir_path, "t")
    df.coalesce(1).write.parquet(out)
    man = MF.file_manifest(spark, out).collect()
    assert len(man) == 1
    path = man[0]["path"].replace("file:", "")
    assert man[0]["sha256"] == hashlib.sha256(open(path, "rb").read()).hexdigest()
    assert MF.parquet_row_counts(spark, out).first()["num_rows"] == 2
    m = MF.file_manifest(spark, out)
    assert MF.new_or_changed(m, m).count() == 0
    assert MF.fingerprint(m).first()["fingerprint"] == MF.fingerprint(m).first()["fingerprint"]
    req = spark.createDataFrame([("la", "supply"), ("la", "fuel"), ("region", "supply")], "tab string, input string")
    have = spark.createDataFrame([("supply",)], "input string")
    got = {r["tab"]: (r["n_missing"], r["ready"]) for r in MF.missing_inputs(req, have).collect()}
    assert got == {"la": (1, False), "region": (0, True)}


def test_partitioned_sink_overwrites_only_written_partitions(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "tidy")
    a = spark.createDataFrame([("e1", "1a", 1.0), ("e1", "1b", 2.0)], "edition string, table_id string, value double")
    K.write_tidy(a, out)
    b = spark.createDataFrame([("e1", "1a", 9.0)], "edition string, table_id string, value double")
    K.write_tidy(b, out)
    got = {(r["table_id"], r["value"]) for r in spark.read.parquet(out).collect()}
    assert got == {("1a", 9.0), ("1b", 2.0)}


def test_export_caps_and_json_rows(spark):
    df = spark.range(10).withColumn("x", F.when(F.col("id") == 3, F.lit(float("nan"))).otherwise(F.col("id").cast("double")))
    assert K.bounded_export(df, ["id"], 5, "csv").count() == 5
    with pytest.raises(C.ReadError):
        K.bounded_export(df, ["id"], 6000, "json")
    js = [json.loads(r["json"]) for r in K.json_rows(df.where("id = 3")).collect()]
    assert js == [{"id": 3, "x": None}]


def test_catalog_page_guards(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "d")
    spark.range(100).withColumn("g", (F.col("id") % 3).cast("string")).write.parquet(out)
    ds = C.Dataset("d", out, order_by=["id"], filter_columns={"group": "g"})
    page = C.read_page(spark, ds, ["id", "g"], {"group": ["1"]}, offset=2, limit=3).collect()
    assert [r["id"] for r in page] == [7, 10, 13] and page[0]["total_rows"] == 33
    with pytest.raises(C.ReadError):
        C.read_page(spark, ds, ["nope"])
    with pytest.raises(C.ReadError):
        C.check_page_size(20000)


def test_incremental_stream_processes_only_new_files(spark, tmpdir_path):
    from tessera.streaming.incremental import edition_from_path, load_new_releases

    src = os.path.join(tmpdir_path, "releases")
    os.makedirs(src)
    out = os.path.join(tmpdir_path, "tidy")
    sheet = [["code", "value"], ["E1", 1], ["E2", 2]]
    write_xlsx(os.path.join(src, "fam_e1.xlsx"), {"1a": sheet})

    def transform(cells):
        return cells.where(F.col("row") > 1).groupBy("path", "row").pivot("col", [1, 2]).agg(F.first("text")).select(
            edition_from_path().alias("edition"), F.lit("1a").alias("table_id"), F.col("1").alias("code"), F.col("2").cast("double").alias("value")
        )

    load_new_releases(spark, src, out, transform, name="t1")
    assert spark.read.parquet(out).count() == 2
    write_xlsx(os.path.join(src, "fam_e2.xlsx"), {"1a": sheet})
    load_new_releases(spark, src, out, transform, name="t1")
    got = spark.read.parquet(out).groupBy("edition").count().collect()
    assert {(r["edition"], r["count"]) for r in got} == {("e1", 2), ("e2", 2)}


def test_changed_releases_are_reloaded_under_their_old_name(spark, tmpdir_path):
    from tessera.streaming.incremental import edition_from_path, load_changed_releases

    src, out, state = (os.path.join(tmpdir_path, x) for x in ("releases", "tidy", "state"))
    os.makedirs(src)

    def transform(cells):
        return cells.where(F.col("row") > 1).groupBy("path", "row").pivot("col", [1, 2]).agg(F.first("text")).select(
            edition_from_path().alias("edition"), F.lit("1a").alias("table_id"), F.col("1").alias("code"), F.col("2").cast("double").alias("value"))

    def load():
        n = load_changed_releases(spark, src, out, transform, state)
        return n, sorted((r["edition"], r["value"]) for r in spark.read.parquet(out).collect())

    write_xlsx(os.path.join(src, "fam_e1.xlsx"), {"1a": [["code", "value"], ["E1", 1], ["E2", 2]]})
    assert load() == (1, [("e1", 1.0), ("e1", 2.0)])
    assert load() == (0, [("e1", 1.0), ("e1", 2.0)])
    write_xlsx(os.path.join(src, "fam_e1.xlsx"), {"1a": [["code", "value"], ["E1", 5]]})
    write_xlsx(os.path.join(src, "fam_e2.xlsx"), {"1a": [["code", "value"], ["E1", 7]]})
    assert load() == (2, [("e1", 5.0), ("e2", 7.0)])


def test_geojson_points_with_altitude(spark):
    f = spark.createDataFrame([("[[[1.5,50.25,10.0],[-2.5,51.0,3]]]",), ("[[[0.5,49.75]]]",)], "_c string")
    b = S.geojson_bounds(f).first()
    assert tuple(b) == (-2.5, 49.75, 1.5, 51.0)


def test_export_of_all_rows_is_whole_or_refused(spark):
    assert K.bounded_export(spark.range(20), ["id"], None, "csv").count() == 20
    with pytest.raises(C.ReadError):
        K.bounded_export(spark.range(6000), ["id"], None, "json")


def test_workbook_family_stacks_sheets(spark, tmpdir_path):
    rows = [["title"], ["Country or region code", "Country or region name", "Band A"], ["E92000001", "England", 1.5]]
    write_xlsx(os.path.join(tmpdir_path, "fam.xlsx"), {"1a": rows, "1b": rows})
    cells = WB.read_cells(spark, tmpdir_path)

    def t(wide):
        long = T.melt_numeric(wide, ["Country or region code", "Country or region name"], None, "label", "percentage")
        return long.select("Country or region name", *T.split_label("label", T.BAND_RE, ["epc_band"]), "percentage")

    out = WB.workbook_family(cells, {"1a": WB.SheetSpec(2, t), "1b": WB.SheetSpec(2, t)}, "march2025")
    got = sorted((r["table_id"], r["edition"], r["epc_band"], r["percentage"]) for r in out.collect())
    assert got == [("1a", "march2025", "A", 1.5), ("1b", "march2025", "A", 1.5)]


def test_report_browser_and_model_pick(spark, tmpdir_path):
    from tessera.sources import reports as R

    def rep(name, geo, h, best, maes):
        doc = {"meta": {"dataset": "uk_hpi_monthly", "geography": geo, "horizon": h, "edition": "e1", "sheet": "1"},
               "summary": {"best_model_mae": best, "summary_by_model": [{"model": m, "mae": v, "coverage_p10_p90": 0.8, "pinball_p50": v / 2} for m, v in maes.items()]}}
        with open(os.path.join(tmpdir_path, f"ts_backtest_{name}.json"), "w") as f:
            json.dump(doc, f)

    rep("a", "London", 3, "ets", {"ets": 1.0, "sarima": 2.0})
    rep("b", "United Kingdom", 3, "sarima", {"ets": 3.0, "sarima": 2.0})
    rep("c", "Wales", 12, "ets", {"ets": 4.0})
    rows = R.report_rows(S.read_reports(spark, tmpdir_path))
    assert {(r["geography"], r["scope"]) for r in rows.select("geography", "scope").distinct().collect()} == {
        ("London", "English region"), ("United Kingdom", "UK aggregate"), ("Wales", "Country")}
    pick = R.pick_models(rows, "e1", "1", 3, ["London", "United Kingdom"]).first()
    assert pick["models"] == ["ets", "sarima"] and pick["complete"] is True
    assert R.pick_models(rows, "e1", "1", 3, ["London", "Scotland"]).first()["complete"] is False
    summ = {(r["horizon_bucket"], r["model"]): r["mae"] for r in R.browser_summary(rows).collect()}
    assert summ == {(3, "ets"): 1.0, (3, "sarima"): 2.0, (12, "ets"): 4.0}


def test_snapshot_and_backtest_sinks(spark, tmpdir_path):
    snap = spark.createDataFrame([("E06000001", 1.0)], "lad_code string, v double")
    K.write_snapshot(snap, os.path.join(tmpdir_path, "snap"), {"editions": {"supply": "e1"}, "caveat": "x"})
    assert spark.read.parquet(os.path.join(tmpdir_path, "snap", "data")).count() == 1
    meta = json.loads(spark.read.text(os.path.join(tmpdir_path, "snap", "meta")).first()[0])
    assert meta["editions"]["supply"] == "e1"
    w = spark.createDataFrame([("s", "m", 36, 1.0)], "series_id string, model string, o int, mae double")
    K.write_backtest(w, w.groupBy("series_id", "model").count(), os.path.join(tmpdir_path, "bt"))
    assert spark.read.parquet(os.path.join(tmpdir_path, "bt", "backtest_summary")).count() == 1


def test_registry_snapshot_marks_availability(spark):
    reg = spark.createDataFrame([("a.parquet", "A"), ("b.parquet", "B")], "path string, title string")
    man = spark.createDataFrame([("a.parquet", 10, 0, "abc")], "path string, size_bytes long, mtime long, sha256 string")
    got = {r["title"]: r["available"] for r in MF.registry_snapshot(reg, man).collect()}
    assert got == {"A": True, "B": False}
