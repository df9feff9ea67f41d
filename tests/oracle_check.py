"""Run registered queries and their SQL counterparts on the same tables.

    python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows),
        key=lambda t: tuple((x is not None, str(type(x)), str(x)) for x in t),
    )


_FAMILY = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def compare(spark, con, name: str, query, oracle: str, sf_dir: str) -> tuple[str, int]:
    """('' or a description of the first difference, row count)."""
    df = query(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    rel = con.sql(oracle)
    want = _rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}", len(got)
    spark_types = {c: _FAMILY.get(t, t) for c, t in df.dtypes}
    sql_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    types = [(c, spark_types[c], sql_types[c]) for c in df.columns if spark_types[c] != sql_types[c]]
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}", len(got)
    for a, b in zip(got, want):
        if a != b:
            return f"columns {sorted(df.columns)}\n   spark {a}\n   sql   {b}", len(got)
    return (f"types {types}" if types else ""), len(got)


def main() -> int:
    from tidewire.registry import ORACLES, QUERIES, load_all
    from tidewire.session import get_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    load_all()
    spark = get_session(
        "oracle-check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in args or list(QUERIES):
        began = time.time()
        try:
            if name in ORACLES:
                problem, n = compare(spark, con, name, QUERIES[name], ORACLES[name], sf)
            else:
                problem, n = "", QUERIES[name](spark, sf).count()
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += bool(problem)
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'BAD' if problem else 'ok '} {name} [{kind}] rows={n} {time.time() - began:.1f}s {problem}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
