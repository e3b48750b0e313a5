"""Run registered queries and their SQL side by side: `python tests/compare.py [sf] [name ...]`."""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object).where(pdf.notna(), None)
    rows = sorted(map(repr, (tuple(x.item() if hasattr(x, "item") else x for x in r)
                             for r in pdf.itertuples(index=False))))
    return list(pdf.columns), rows


def check(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    rows = fn(spark, sf_dir)
    got = rows.toPandas()
    for f in rows.schema.fields:  # pandas turns whole numbers beside nulls into floats, DuckDB does not
        if f.dataType.typeName() in ("integer", "long") and got[f.name].dtype.kind == "f":
            got[f.name] = got[f.name].astype("Int64")
    t1 = time.time()
    if sql is None:
        return True, f"{len(got)} rows (no SQL)  spark {t1 - t0:.1f}s"
    want = con.execute(sql).fetchdf()
    t2 = time.time()
    gc, gr = normal(got)
    wc, wr = normal(want)
    note = f"{len(got)} rows  spark {t1 - t0:.1f}s  duckdb {t2 - t1:.1f}s"
    if gc != wc:
        return False, f"columns {gc} vs {wc}"
    if gr != wr:
        gs, ws = set(gr), set(wr)
        only = [x for x in gr if x not in ws][:3], [x for x in wr if x not in gs][:3]
        kinds = dict(got.dtypes.items()), dict(want.dtypes.items())
        return False, f"{note} vs {len(want)}\n   got {only[0]}\n   want {only[1]}\n   {kinds if not only[0] else ''}"
    diff = [c for c in gc if (got[c].dtype != want[c].dtype and "object" not in (str(got[c].dtype), str(want[c].dtype))
                              and got[c].dtype.kind != want[c].dtype.kind or got[c].dtype.kind == "i"
                              and got[c].dtype != want[c].dtype)]
    return True, note + (f"  TYPES {[(c, str(got[c].dtype), str(want[c].dtype)) for c in diff]}" if diff else "")


def main(argv):
    from ramify.plans.oracle import oracle_sql
    from ramify.plans.queries import QUERIES
    from ramify.session import build_session

    sf_dir = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    spark = build_session(8)
    con, sqls = connect(sf_dir), oracle_sql()
    for name, fn in QUERIES.items():
        if len(argv) > 1 and not any(name.startswith(a) for a in argv[1:]):
            continue
        try:
            ok, note = check(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
