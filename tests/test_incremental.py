"""Corrected, withdrawn and unchanged releases that share partitions, in batch and as a stream."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.streaming import incremental as I

from xlsx_fixture import write_xlsx


def transform(partitioned=True, keep_path=True):
    def run(cells):
        wide = cells.where(F.col("row") > 1).groupBy("path", "row").pivot("col", [1, 2, 3]).agg(F.first("text"))
        out = [F.col("3").alias("edition"), F.lit("007").alias("table_id")] if partitioned else []
        return wide.select(*out, F.col("1").alias("code"), F.col("2").cast("double").alias("value"), *(["path"] if keep_path else []))

    return run


def sheet(edition, *rows):
    return {"1a": [["code", "value", "edition"], *[[c, v, edition] for c, v in rows]]}


def rows(spark, out):
    return sorted((r.code, r.value) for r in spark.read.parquet(out).collect())


@pytest.mark.parametrize("partitioned,keep_path", [(True, True), (False, True), (True, False), (False, False)])
def test_corrected_withdrawn_and_unchanged_files_of_one_partition(spark, tmpdir_path, partitioned, keep_path):
    src, out, state = (os.path.join(tmpdir_path, x) for x in ("in", "out", "state"))
    os.makedirs(src)
    load = lambda: I.load_changed_releases(spark, src, out, transform(partitioned, keep_path), state)
    write_xlsx(f"{src}/a.xlsx", sheet("e 1/x", ("A", 1), ("A", 2)))
    write_xlsx(f"{src}/b.xlsx", sheet("e 1/x", ("B", 3)))
    write_xlsx(f"{src}/c.xlsx", sheet("e 1/x", ("C", 4)))
    write_xlsx(f"{src}/d.xlsx", sheet("e2", ("D", 5)))
    assert load() == 4 and load() == 0
    write_xlsx(f"{src}/a.xlsx", sheet("e 1/x", ("A", 9)))  # corrected
    os.remove(f"{src}/b.xlsx")  # withdrawn
    os.remove(f"{src}/d.xlsx")  # withdrawn, the only file of its partition
    assert load() == 3 and rows(spark, out) == [("A", 9.0), ("C", 4.0)]
    assert load() == 0 and rows(spark, out) == [("A", 9.0), ("C", 4.0)]
    write_xlsx(f"{src}/c.xlsx", sheet("e3", ("C", 7)))  # corrected, moves to another partition
    write_xlsx(f"{src}/d.xlsx", sheet("e2", ("D", 6)))  # comes back
    assert load() == 2 and rows(spark, out) == [("A", 9.0), ("C", 7.0), ("D", 6.0)]
    if partitioned:
        assert {r.edition for r in spark.read.parquet(out).collect()} == {"e 1/x", "e2", "e3"}


def test_untouched_partitions_are_not_written_again(spark, tmpdir_path):
    src, out, state = (os.path.join(tmpdir_path, x) for x in ("in", "out", "state"))
    os.makedirs(src)
    write_xlsx(f"{src}/a.xlsx", sheet("e1", ("A", 1)))
    write_xlsx(f"{src}/b.xlsx", sheet("e2", ("B", 2)))
    I.load_changed_releases(spark, src, out, transform(), state)
    files = lambda e: sorted(f for f in os.listdir(f"{out}/edition={e}/table_id=007") if f.endswith(".parquet"))
    before = files("e1"), files("e2")
    write_xlsx(f"{src}/b.xlsx", sheet("e2", ("B", 3)))
    I.load_changed_releases(spark, src, out, transform(), state)
    assert files("e1") == before[0] and files("e2") != before[1]


def test_a_load_that_breaks_off_is_finished_or_repeated(spark, tmpdir_path, monkeypatch):
    src, out, state = (os.path.join(tmpdir_path, x) for x in ("in", "out", "state"))
    os.makedirs(src)
    load = lambda: I.load_changed_releases(spark, src, out, transform(), state)
    write_xlsx(f"{src}/a.xlsx", sheet("e1", ("A", 1)))
    write_xlsx(f"{src}/b.xlsx", sheet("e1", ("B", 2)))
    load()
    write_xlsx(f"{src}/a.xlsx", sheet("e1", ("A", 5)))

    def broken(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # before the journal: nothing has changed
        m.setattr(I, "commit", broken)
        with pytest.raises(RuntimeError):
            load()
    assert rows(spark, out) == [("A", 1.0), ("B", 2.0)]
    with monkeypatch.context() as m:  # after it: the next load finishes
        m.setattr(I, "publish_stage", broken)
        with pytest.raises(RuntimeError):
            load()
    assert rows(spark, out) == [("A", 1.0), ("B", 2.0)]
    assert I.finish_pending(spark, out, state) and rows(spark, out) == [("A", 5.0), ("B", 2.0)]
    assert load() == 0 and not I.finish_pending(spark, out, state)


@pytest.mark.parametrize("keep_path", [True, False])
def test_stream_batches_share_partitions(spark, tmpdir_path, keep_path):
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    os.makedirs(src)
    name = f"share-{os.path.basename(tmpdir_path)}"
    load = lambda: I.load_new_releases(spark, src, out, transform(keep_path=keep_path), name, max_files_per_trigger=1)
    for i in range(3):
        write_xlsx(f"{src}/f{i}.xlsx", sheet("e1", (f"F{i}", i)))
    load()
    assert rows(spark, out) == [("F0", 0.0), ("F1", 1.0), ("F2", 2.0)]
    write_xlsx(f"{src}/f3.xlsx", sheet("e1", ("F3", 3)))
    load()
    load()
    assert rows(spark, out) == [("F0", 0.0), ("F1", 1.0), ("F2", 2.0), ("F3", 3.0)]
