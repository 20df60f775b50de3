"""Versions of several tables at once, additive fingerprints, deep pages from an index, large sheets."""

import os
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from oracle_harness import SF_SMALL
from tessera.sources import catalog as C
from tessera.sources import manifest as MF
from tessera.sources import pages as PG
from tessera.sources import sinks as K
from tessera.sources import workbook as WB

from xlsx_fixture import write_xlsx


def test_a_version_is_seen_whole_or_not_at_all(spark, tmpdir_path, monkeypatch):
    snap = lambda v: spark.createDataFrame([("E06000001", v)], "lad_code string, v double")
    with pytest.raises(C.ReadError):
        K.published(spark, tmpdir_path)
    first = K.publish_snapshot(snap(1.0), tmpdir_path, {"period": "2023-24", "tables": "own"})
    whole = spark.createDataFrame

    def breaks_at_meta(data, schema=None, *a, **k):
        if schema == "value string":
            raise RuntimeError("lost between data and metadata")
        return whole(data, schema, *a, **k)

    second = snap(2.0)
    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", breaks_at_meta)
        with pytest.raises(RuntimeError):
            K.publish_snapshot(second, tmpdir_path, {"period": "2024-25"})
    tables, meta = K.published(spark, tmpdir_path)
    assert tables["data"].first().v == 1.0 and meta["period"] == "2023-24" and meta["tables"] == ["data"]
    K.publish_snapshot(second, tmpdir_path, {"period": "2024-25"})
    tables, meta = K.published(spark, tmpdir_path)
    assert tables["data"].first().v == 2.0 and meta["period"] == "2024-25"
    assert K.published(spark, tmpdir_path, first)[0]["data"].first().v == 1.0


def test_backtest_tables_belong_together(spark, tmpdir_path):
    w = spark.createDataFrame([("s", "m", 36, 1.0)], "series_id string, model string, o int, mae double")
    K.publish_backtest(w, w.groupBy("series_id", "model").count(), tmpdir_path, predictions=w, metrics=w, calibration=w, meta={"h": 3})
    tables, meta = K.published(spark, tmpdir_path)
    assert set(tables) == {"backtest_windows", "backtest_summary", "predictions", "metrics", "calibration"} and meta["h"] == 3
    assert all(t.count() == 1 for t in tables.values())


def test_fingerprint_in_any_order_changes_with_any_file(spark):
    rows = [(f"file:/data/{a}/{b}.parquet", i, i * 10) for i, (a, b) in enumerate((a, b) for a in "xyz" for b in "abcd")]
    make = lambda r, parts=3: spark.createDataFrame(r, "path string, mtime long, size_bytes long").repartition(parts)
    one = lambda r, parts=3: MF.fingerprint(make(r, parts)).first()["fingerprint"]
    whole = one(rows)
    assert one(rows[::-1], 7) == whole == one(rows[5:] + rows[:5], 1)
    changed = {one(rows[:i] + [(rows[i][0], rows[i][1], rows[i][2] + 1)] + rows[i + 1:]) for i in (0, 5, 11)}
    assert len(changed | {whole, one(rows[1:]), one(rows + rows[:1])}) == 6
    folders = lambda r: {x.folder: (x.n_files, x.fingerprint) for x in MF.folder_fingerprints(make(r)).collect()}
    before, after = folders(rows), folders(rows[:-1] + [(rows[-1][0], 99, 0)])
    assert {f for f in before if before[f] != after[f]} == {"", "file:", "file:/data", "file:/data/z"}
    assert before["file:/data/x"][0] == 4
    plan = MF.folder_fingerprints(make(rows))._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan


def lines(d=SF_SMALL):
    order = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate", "l_suppkey"]
    return C.Dataset("lineitem", f"{d}/lineitem.parquet", order_by=order, filter_columns={"flag": "l_returnflag"}), order


@pytest.mark.parametrize("filters", [None, {"flag": ["A"]}])
def test_indexed_pages_equal_sorted_pages(spark, tmpdir_path, filters):
    ds, order = lines()
    index = PG.build_page_index(spark, ds, os.path.join(tmpdir_path, "idx"), filters, range_rows=300)
    base = C.apply_filters(spark.read.parquet(ds.path), ds, filters)
    want = sorted(tuple(r) for r in base.select(*order).collect())
    assert index.count() > 3 and index.agg(F.sum("n_rows")).first()[0] == len(want)
    for offset in (0, 299, 300, 777, len(want) - 5, len(want), len(want) + 10):
        got = PG.indexed_page(spark, ds, index, order, filters, offset, 40).collect()
        assert [tuple(r)[:-2] for r in got] == want[offset : offset + 40]
        assert all(r.total_rows == len(want) and r.fingerprint for r in got)


def test_a_deep_page_reads_only_its_ranges(spark, tmpdir_path):
    ds, order = lines()
    index = PG.build_page_index(spark, ds, os.path.join(tmpdir_path, "idx"), range_rows=300)
    plan = PG.indexed_page(spark, ds, index, order, None, 5000, 40)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_orderkey" in plan and "rangepartitioning" not in plan


def test_pages_of_one_hot_key_of_an_empty_table_and_of_changed_files(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "d")
    spark.createDataFrame([(1, i % 3) for i in range(500)] + [(2, 0)], "k int, v int").write.parquet(path)
    ds = C.Dataset("d", path, order_by=["k", "v"])
    index = PG.build_page_index(spark, ds, os.path.join(tmpdir_path, "i"), range_rows=20)
    got = [tuple(r)[:2] for o in range(0, 501, 100) for r in PG.indexed_page(spark, ds, index, ["k", "v"], None, o, 100).collect()]
    assert got == sorted([(1, i % 3) for i in range(500)] + [(2, 0)])
    spark.createDataFrame([(9, 9)], "k int, v int").write.mode("append").parquet(path)
    with pytest.raises(C.ReadError):
        PG.indexed_page(spark, ds, index, ["k", "v"], None, 0, 10)
    none = C.Dataset("n", os.path.join(tmpdir_path, "n"), order_by=["k"])
    spark.createDataFrame([], "k int").write.parquet(none.path)
    assert PG.indexed_page(spark, none, PG.page_index(spark, none), ["k"]).count() == 0
    assert PG.page_index(spark, none).count() == 0


def test_sheets_are_dealt_out_and_read_in_batches(spark, tmpdir_path):
    rows = [[f"name {r % 50}", r, None, r / 2] for r in range(1, 3001)]
    write_xlsx(os.path.join(tmpdir_path, "big.xlsx"), {"a": rows, "b": rows[:10], "empty": []})
    cells = WB.read_cells(spark, tmpdir_path)
    assert {(r.sheet, r["count"]) for r in cells.groupBy("sheet").count().collect()} == {("a", 9000), ("b", 30)}
    got = {(r.row, r.col): r.text for r in cells.where("sheet = 'a' and row = 3000").collect()}
    assert got == {(3000, 1): "name 0", (3000, 2): "3000", (3000, 4): "1500.0"}


def test_memory_is_flat_on_a_sheet_of_a_million_cells(tmpdir_path):
    def workbook(n):
        path = os.path.join(tmpdir_path, f"{n}.xlsx")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for r in range(1, n // 10 + 1):
                f.write(f'<row r="{r}">'.encode() + b"".join(f'<c r="{c}{r}"><v>{r}</v></c>'.encode() for c in "ABCDEFGHIJ") + b"</row>")
            f.write(b"</sheetData></worksheet>")
        return path

    def peak(n):
        path = workbook(n)
        tracemalloc.start()
        with zipfile.ZipFile(path) as z:
            count = sum(b.num_rows for b in WB._cell_batches("p", "s", WB.sheet_cells(z, "xl/worksheets/sheet1.xml", [])))
        _, top = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert count == n
        return top

    small, large = peak(100_000), peak(1_000_000)
    assert large < 1.3 * small + (1 << 20)
