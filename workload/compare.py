"""Run a query in Spark and its oracle in DuckDB and compare the rows, whatever their order."""

from __future__ import annotations

import os
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def compare(spark, sf_dir: str, name: str, query, sql: str | None, con=None):
    """(seconds, Spark rows, problem or None)."""
    begin = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    took = time.time() - begin
    if sql is None:
        return took, len(got), None
    con = con or oracle(sf_dir)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return took, len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if a != b:
        only_a = sorted(set(a) - set(b))[:3]
        only_b = sorted(set(b) - set(a))[:3]
        return took, len(got), f"rows {len(a)} != {len(b)}\n  spark {only_a}\n  duckdb {only_b}"
    fits = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "FLOAT": "float",
            "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "TINYINT": "tinyint",
            "SMALLINT": "smallint", "BOOLEAN": "boolean"}
    odd = {n: (t, types[n]) for n, t in df.dtypes if fits.get(types[n]) != t}
    return took, len(got), f"types {odd}" if odd else None


def main(argv: list[str]) -> int:
    from geohour.session import local_session
    from workload import ORACLES, QUERIES

    sf_dir = argv[0]
    chosen = argv[1:] or list(QUERIES)
    spark, con, bad = local_session(), oracle(sf_dir), 0
    for name in chosen:
        try:
            took, n, problem = compare(spark, sf_dir, name, QUERIES[name], ORACLES.get(name), con)
        except Exception as e:  # a broken query must not hide the others
            took, n, problem = 0.0, 0, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name} rows={n} {took:.2f}s {problem or ''}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} fine")
    return bad


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
