"""Run queries on both engines and compare names, kinds of types, and values.

    python tests/compare.py [folder] [key ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def kind_of(arrow_type) -> str:
    import pyarrow.types as t
    if t.is_boolean(arrow_type):
        return "bool"
    if t.is_integer(arrow_type):
        return "int"
    if t.is_floating(arrow_type):
        return "float"
    if t.is_string(arrow_type) or t.is_large_string(arrow_type) or "string" in str(arrow_type):
        return "text"
    return str(arrow_type)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return float(v) if isinstance(v, Decimal) else v


def rows_of(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    rows = sorted(([plain(v) for v in r] for r in zip(*cols)), key=lambda r: [("" if v is None else str(v)) for v in r])
    return names, {n: kind_of(table.schema.field(n).type) for n in names}, rows


def views(folder):
    import duckdb
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, con, folder, build, sql) -> tuple[str, int]:
    got = build(spark, folder).toArrow()
    if sql is None:
        return "no oracle", got.num_rows
    want = con.execute(sql).to_arrow_table()
    a, b = rows_of(got), rows_of(want)
    if a[0] != b[0]:
        return f"NAMES {a[0]} vs {b[0]}", len(a[2])
    if a[1] != b[1]:
        return "TYPES " + str({n: (a[1][n], b[1][n]) for n in a[0] if a[1][n] != b[1][n]}), len(a[2])
    if len(a[2]) != len(b[2]):
        return f"ROWS {len(a[2])} vs {len(b[2])}", len(a[2])
    for x, y in zip(a[2], b[2]):
        if x != y:
            diff = [(n, p, r) for n, p, r in zip(a[0], x, y) if p != r]
            return f"VALUES {str(diff)[:600]} in {str(x)[:200]}", len(a[2])
    return "ok", len(a[2])


if __name__ == "__main__":
    import __spark_entry__ as entry
    from guardlake.spark import build_session
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(cores="8")
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles, con = entry.queries(), entry.oracle_sql(), views(folder)
    bad = 0
    for key, build in queries.items():
        if wanted and not any(key == w or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            verdict, n = compare(spark, con, folder, build, oracles.get(key))
        except Exception as e:  # noqa: BLE001
            verdict, n = "ERROR " + str(e)[:700].replace("\n", " "), -1
        bad += verdict not in ("ok", "no oracle")
        print(f"{key:32s} {n:7d} {time.time() - t:6.1f}s {verdict}", flush=True)
    print("not equal:", bad)
