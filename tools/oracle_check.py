"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Compares column names, row count and the sorted rows (doubles rounded to 6).
"""

from __future__ import annotations

import sys
import time

sys.path.insert(0, ".")

import duckdb  # noqa: E402

from feedpulse.plans.compare import rows_of  # noqa: E402
from feedpulse.plans.registry import ORACLE, QUERIES, load_all  # noqa: E402
from feedpulse.session import build_session  # noqa: E402
from feedpulse.sources.tables import TABLES  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    load_all()
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in names or sorted(QUERIES):
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = ORACLE.get(name)
        if sql is None:
            print(f"rows {name}: {len(srows)} rows, cols={cols} ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(sql)
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(cols) != sorted(ocols):
            print(f"FAIL {name}: columns spark={cols} duck={ocols}")
            bad += 1
            continue
        a, b = rows_of(cols, srows), rows_of(ocols, orows)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print(f"FAIL {name}: rows spark={len(a)} duck={len(b)} first diffs={diff}")
            bad += 1
        else:
            print(f"ok   {name}: {len(a)} rows ({ts:.1f}s)")
    print(f"{bad} failing of {len(names or QUERIES)}")
    spark.stop()


if __name__ == "__main__":
    main()
