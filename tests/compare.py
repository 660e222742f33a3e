"""Run registered queries beside their SQL and compare columns, types and values.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE",
}


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if value is None:
        return "\0"
    return str(value)


def compare(df, con, sql: str) -> tuple[str, int]:
    """'' when equal, else what differs; and the row count."""
    names = sorted(df.columns)
    result = con.execute(sql)
    types = {d[0]: str(d[1]) for d in result.description}
    rows = result.fetchall()
    if sorted(types) != names:
        return f"columns {names} against {sorted(types)}", len(rows)
    wrong = {
        f.name: (f.dataType.simpleString(), types[f.name]) for f in df.schema
        if SAME_TYPE.get(f.dataType.simpleString()) != types[f.name]
    }
    order = [list(types).index(n) for n in names]
    theirs = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    ours = sorted(tuple(_norm(v) for v in r) for r in df.select(*names).collect())
    if ours != theirs:
        only_ours, only_theirs = sorted(set(ours) - set(theirs))[:2], sorted(set(theirs) - set(ours))[:2]
        return f"values: {len(ours)} rows against {len(theirs)}\n   ours {only_ours}\n   sql  {only_theirs}", len(ours)
    return (f"types {wrong}" if wrong else ""), len(ours)


def main() -> int:
    import __spark_entry__ as entry
    from veilgrid.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                problem, n = compare(df, con, oracle[name])
            else:
                problem, n = "", len(df.collect())
        except Exception as error:  # report and go on with the others
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        failed += bool(problem)
        mark = "FAIL" if problem else ("same" if name in oracle else "rows")
        print(f"{mark} {name:32s} {n:8d} rows {time.time() - start:6.2f}s {problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
