"""DuckDB beside Spark."""

from collections import Counter
from pathlib import Path

import duckdb


def duck_rows(sf, sql, columns):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return Counter(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
