"""Compare a Spark query with its DuckDB oracle (used by tests and bench checks)."""

from __future__ import annotations

import datetime as dt
import decimal
import math

from looplake.sources.fixtures import BASE_TABLES


def _norm(v, places: int = 6):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        r = round(f, places)
        return 0.0 if r == 0 else r
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, places) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x, places)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True), places)
    return v


def normalize(columns, rows, places: int = 6):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = [tuple(_norm(r[i], places) for i in order) for r in rows]
    out.sort(key=repr)
    return cols, out


def duckdb_run(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    rows = cur.fetchall()
    con.close()
    return cols, rows


def compare(spark, sf_dir: str, entry, places: int = 6):
    df = entry.build(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    o_cols, o_rows = duckdb_run(sf_dir, entry.sql)
    sc, sr = normalize(s_cols, s_rows, places)
    oc, orows = normalize(o_cols, o_rows, places)
    return {
        "columns_match": sc == oc,
        "rows_spark": len(sr),
        "rows_oracle": len(orows),
        "values_match": sr == orows,
        "spark_cols": sc,
        "oracle_cols": oc,
        "spark_sample": sr[:3],
        "oracle_sample": orows[:3],
        "diff": [r for r in sr if r not in set(orows)][:3] if sc == oc and sr != orows else [],
        "diff_oracle": [r for r in orows if r not in set(sr)][:3] if sc == oc and sr != orows else [],
    }


def main(argv=None):
    import argparse
    import json
    import time

    from looplake.plans.registry import load_all
    from looplake.session import get_session

    ap = argparse.ArgumentParser()
    ap.add_argument("keys", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--places", type=int, default=6)
    a = ap.parse_args(argv)
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    reg = load_all()
    keys = a.keys or sorted(reg)
    bad = 0
    for k in keys:
        e = reg[k]
        t = time.time()
        try:
            if e.sql is None:
                n = e.build(spark, a.sf).count()
                print(f"ROWS {k}: {n} ({time.time() - t:.1f}s)")
                continue
            r = compare(spark, a.sf, e, a.places)
            ok = r["columns_match"] and r["values_match"]
            bad += not ok
            print(("OK  " if ok else "BAD ") + f"{k}: rows {r['rows_spark']}/{r['rows_oracle']} ({time.time() - t:.1f}s)")
            if not ok:
                print(json.dumps({x: r[x] for x in ("spark_cols", "oracle_cols", "diff", "diff_oracle",
                                                    "spark_sample", "oracle_sample")}, default=str)[:3000])
        except Exception as ex:  # report and continue
            bad += 1
            print(f"ERR {k}: {type(ex).__name__}: {str(ex)[:1500]}")
    print(f"failed: {bad}")


if __name__ == "__main__":
    main()
