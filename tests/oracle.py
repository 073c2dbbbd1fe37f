"""Compare a Spark result with DuckDB on the same parquet tables.

Run ``python tests/oracle.py [sf_dir] [name …]`` for a timed report.
"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else float(f"{v:.12g}"))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in data)


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, otherwise a short description."""
    got_columns = spark_df.columns
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} vs {sorted(want_columns)}"
    want = rows_of(want_columns, cursor.fetchall())
    got = rows_of(got_columns, [tuple(r) for r in spark_df.collect()])
    if got == want:
        types = dict(zip(want_columns, [str(d[1]) for d in cursor.description]))
        loose = [(c, t, types[c]) for c, t in spark_df.dtypes if not _same_type(t, types[c])]
        return f"types {loose}" if loose else None
    extra, lacking = got - want, want - got
    return (
        f"rows {sum(got.values())} vs {sum(want.values())}; only spark {str(list(extra)[:3])[:900]}; "
        f"only sql {str(list(lacking)[:3])[:900]}"
    )


def _same_type(spark_type: str, duck_type: str) -> bool:
    families = {
        "string": ("VARCHAR", "STRING"), "bigint": ("BIGINT",), "int": ("INTEGER",), "double": ("DOUBLE", "FLOAT"),
        "boolean": ("BOOLEAN",), "date": ("DATE",), "timestamp_ntz": ("TIMESTAMP", "DATETIME"), "timestamp": ("TIMESTAMP", "DATETIME"),
    }
    return any(duck_type.upper().startswith(k) for k in families.get(spark_type, (duck_type.upper(),)))


def main() -> None:
    import __spark_entry__ as contract
    from tabprep.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(contract.queries())
    spark = build_session(
        "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = contract.queries()[name](spark, sf_dir)
            sql = contract.oracle_sql().get(name)
            problem = difference(df, con, sql) if sql else None
            note = "ok" if sql else f"rows {df.count()}"
        except Exception as error:  # noqa: BLE001 - a report, not a handler
            problem, note = f"{type(error).__name__}: {str(error)[:1500]}", ""
        bad += problem is not None
        print(f"{name:34s} {time.time() - start:6.1f}s  {problem or note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
