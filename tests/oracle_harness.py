"""Run a registered query in Spark and its DuckDB statement, and compare results.

Comparison mirrors the driver: column names sorted, row count, and an
order-insensitive multiset of rows with doubles rounded.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = os.environ.get("TESSERA_TEST_SF", SF_SMALL)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == int(v) and abs(v) < 2**53:
            return int(v)
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con=None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_pdf = sdf.toPandas()
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_pdf), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck(sf_dir)
    d_pdf = con.execute(sql).df()
    res["oracle_rows"] = len(d_pdf)
    if sorted(s_pdf.columns) != sorted(d_pdf.columns):
        res["status"] = "columns"
        res["detail"] = f"spark={sorted(s_pdf.columns)} oracle={sorted(d_pdf.columns)}"
        return res
    sr, dr = rows_of(s_pdf), rows_of(d_pdf)
    if len(sr) != len(dr):
        res["status"] = "rowcount"
        return res
    if sr != dr:
        res["status"] = "values"
        diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
        res["detail"] = f"cols={sorted(s_pdf.columns)} first diffs={diff}"
        return res
    # declared types must agree: Spark schema vs DuckDB result types
    smap = {"IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
            "BooleanType": "BOOLEAN", "DateType": "DATE", "FloatType": "FLOAT", "ShortType": "SMALLINT"}
    rel = con.sql(sql)
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    bad = {}
    for f in sdf.schema.fields:
        st = smap.get(type(f.dataType).__name__, f.dataType.simpleString())
        if st != dtypes.get(f.name):
            bad[f.name] = (st, dtypes.get(f.name))
    if bad:
        res["status"] = "types"
        res["detail"] = str(bad)
        return res
    res["status"] = "ok"
    return res


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from tessera.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = local_session(8, 8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            r = compare(spark, name, fn, sqls.get(name), sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": name, "status": "error", "detail": f"{type(e).__name__}: {str(e)[:800]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
