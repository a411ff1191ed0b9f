"""Compare registered queries with their SQL twins in DuckDB.

Run as ``python tests/oracle.py FOLDER [NAME ...]`` for a report.
"""

from __future__ import annotations

import datetime
import math
import os
import signal
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from contentloom.plans.registry import BASE  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, folder: str, plan, sql: str | None) -> tuple[str, int]:
    df = plan(spark, folder)
    got = canonical(df.columns, df.collect())
    if sql is None:
        return "", len(got[1])
    cur = con.execute(sql)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} instead of {want[0]}", len(got[1])
    if got[1] != want[1]:
        have, need = set(got[1]), set(want[1])
        extra, lacking = sorted(have - need, key=repr)[:3], sorted(need - have, key=repr)[:3]
        return f"{len(got[1])} rows instead of {len(want[1])}; extra {extra}; lacking {lacking}", len(got[1])
    return "", len(got[1])


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from contentloom.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(folder)
    plans, sqls = queries(), oracle_sql()
    bad = 0

    def late(*_):
        raise TimeoutError("query took too long")

    signal.signal(signal.SIGALRM, late)
    for name, plan in plans.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        at = time.time()
        signal.alarm(90)
        try:
            text, n = differences(spark, con, folder, plan, sqls.get(name))
        except Exception as e:  # report and go on
            text, n = f"{type(e).__name__}: {str(e)[:700]}" + ("" if "pyspark" in type(e).__module__ or "duckdb" in type(e).__module__ or "Exception" in type(e).__name__ else traceback.format_exc()[-600:]), -1
            spark.sparkContext.cancelAllJobs()
        finally:
            signal.alarm(0)
        bad += bool(text)
        print(f"{'FAIL' if text else 'ok  '} {name} {n} rows {time.time() - at:.2f}s {'' if name in sqls else '(rows only) '}{text[:1500]}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
