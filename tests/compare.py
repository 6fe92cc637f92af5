"""Run registered queries in Spark and their SQL in DuckDB, and compare the values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """(problem or None, number of rows)"""
    df = fn(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return None, len(got)
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(set(df.columns) ^ set(columns))}", len(got)
    kinds = dict(df.dtypes)
    theirs = {c[0]: str(c[1]) for c in cur.description}
    same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}
    for c, k in kinds.items():
        if k in same and theirs[c] != same[k]:
            return f"type of {c}: {k} / {theirs[c]}", len(got)
    a, b = table_of(df.columns, got), table_of(columns, want)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}", len(got)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        where = [c for c, p, q in zip(sorted(columns), x, y) if p != q]
        return f"{len(bad)} differing rows in {where}: {x} / {y}", len(got)
    return None, len(got)


def force_scale_routes(rows: int = 25) -> None:
    """Make every operator take the routes meant for large and skewed input."""
    from rigsense.operators import features, scale

    scale.fits_one_task = features.fits_one_task = lambda df: False
    scale.BLOCK_ROWS = rows


def main(sf_dir: str, names: list[str]) -> int:
    from rigsense.queries import load
    from rigsense.session import local_session

    queries, oracle = load()
    spark = local_session("compare", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    if "--scale" in names:
        names.remove("--scale")
        force_scale_routes()
    chosen = [n for n in queries if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    for n in chosen:
        t = time.time()
        try:
            problem, count = compare(spark, con, queries[n], oracle.get(n), sf_dir)
        except Exception as e:
            problem, count = f"{type(e).__name__}: {str(e)[:700]}", -1
        failed += problem is not None
        mark = "BAD " if problem else ("ok  " if n in oracle else "rows")
        print(f"{mark} {n:32s} {count:6d} {time.time() - t:6.2f}s {problem or ''}", flush=True)
    print(f"{len(chosen)} queries, {failed} bad")
    return failed


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
