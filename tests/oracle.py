"""Runs a registered query and its SQL on the same tables and compares all values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        extra = set(map(repr, got)) ^ set(map(repr, want))
        return f"rows {len(got)} != {len(want)}; e.g. {[e[:300] for e in list(extra)[:4]]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ ({sorted(names)}); e.g. {str(bad[0][0])[:700]} != {str(bad[0][1])[:700]}"
    return None


def main(argv: list[str]) -> int:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = make_session()
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, fn, oracle[name], sf_dir)
                note = "ok"
            else:
                note = f"rows {len(fn(spark, sf_dir).collect())}"
                problem = None
        except Exception as e:  # noqa: BLE001
            problem, note = f"{type(e).__name__}: {str(e)[:900]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'pass'} {name} {time.time() - t:.1f}s {problem or note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
