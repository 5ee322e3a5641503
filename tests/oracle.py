"""Run registered queries against DuckDB on the same parquet tables and report differences.

    python -m tests.oracle [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.01"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return ("0null",)
    if isinstance(v, bool):
        return ("bool", str(v))
    if isinstance(v, int):
        return ("int", str(v))
    if isinstance(v, float):
        if math.isnan(v):
            return ("float", "nan")
        return ("float", repr(v + 0.0 if v != 0 else 0.0))
    if isinstance(v, Decimal):
        return ("dec", str(v.normalize()))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return ("ts", v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v.isoformat())
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return ("list",) + tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return ("struct",) + tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return ("struct",) + tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return (type(v).__name__, str(v))


def compare(spark, con, key: str, run, sql: str, sf_dir: str) -> tuple[str, float, int]:
    t0 = time.time()
    df = run(spark, sf_dir)
    names = df.columns
    rows = df.collect()
    took = time.time() - t0
    cur = con.execute(sql)
    onames = [d[0] for d in cur.description]
    orows = cur.fetchall()
    if sorted(names) != sorted(onames):
        return f"columns differ: spark={sorted(names)} sql={sorted(onames)}", took, len(rows)
    order = sorted(names)
    si, oi = [names.index(c) for c in order], [onames.index(c) for c in order]
    a = sorted(tuple(_norm(r[i]) for i in si) for r in rows)
    b = sorted(tuple(_norm(r[i]) for i in oi) for r in orows)
    if len(a) != len(b):
        return f"row counts differ: spark={len(a)} sql={len(b)}", took, len(rows)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        sa, sb = set(a), set(b)
        only_a = [x for x in a if x not in sb][:2]
        only_b = [y for y in b if y not in sa][:2]
        return f"{len(bad)} of {len(a)} rows differ\n  {order}\n  spark {only_a}\n  sql   {only_b}", took, len(rows)
    return "", took, len(rows)


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tilewater.session import local_session

    args = sys.argv[1:]
    sf_dir = SF
    if args and args[0].startswith("/"):
        sf_dir = args.pop(0)
    spark = local_session(8)
    con = connect(sf_dir)
    runs, sqls = entry.queries(), entry.oracle_sql()
    keys = args or sorted(runs)
    failed = 0
    for key in keys:
        try:
            if key in sqls:
                msg, took, n = compare(spark, con, key, runs[key], sqls[key], sf_dir)
                kind = "S"
            else:
                t0 = time.time()
                n = len(runs[key](spark, sf_dir).collect())
                msg, took, kind = "", time.time() - t0, "r"
        except Exception as exc:  # report and go on with the next key
            msg, took, n, kind = f"error {type(exc).__name__}: {str(exc)[:900]}", 0.0, 0, "?"
        if n == 0 and not msg:
            msg = "no rows"
        failed += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {kind} {key:28s} {took:6.2f}s {n:8d} {msg}", flush=True)
    print(f"{len(keys) - failed} of {len(keys)} fine")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
