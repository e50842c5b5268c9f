"""Compare Spark result types with DuckDB oracle result types for every registered query."""

from __future__ import annotations

import sys

sys.path.insert(0, ".")

from feedpulse.plans.compare import connect_duckdb, spark_types  # noqa: E402
from feedpulse.plans.registry import ORACLE, QUERIES, load_all  # noqa: E402
from feedpulse.session import build_session  # noqa: E402

def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    load_all()
    names = sys.argv[2:] or sorted(ORACLE)
    spark = build_session("local[4]", shuffle_partitions=8)
    con = connect_duckdb(sf)
    bad = 0
    for name in names:
        df = QUERIES[name](spark, sf)
        s = spark_types(df)
        rel = con.sql(ORACLE[name])
        d = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        diff = {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if s.get(c) != d.get(c)}
        if diff:
            bad += 1
            print(f"{name}: {diff}")
    print(f"{bad} queries with type differences")


if __name__ == "__main__":
    main()
