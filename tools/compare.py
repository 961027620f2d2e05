"""Run catalogue queries on Spark and their SQL on DuckDB, and compare.

    python tools/compare.py SF [name-prefix ...]
"""

import os
import sys
import time
import traceback
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from catalog import load  # noqa: E402
from sunward.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(path):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]
    rows = []
    for values in frame.itertuples(index=False, name=None):
        out = []
        for v in values:
            if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
                out.append("[" + ",".join(map(str, v)) + "]")
            elif v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                out.append("~")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                out.append(str(bool(v)))
            elif isinstance(v, float):
                out.append(repr(v + 0.0) if v != int(v) or abs(v) > 1e15 else str(int(v)))
            else:
                out.append(str(v))
        rows.append("|".join(out))
    return sorted(rows)


def kinds(frame):
    short = {"i": "int", "u": "int", "f": "float", "b": "bool", "M": "time", "O": "obj"}
    return {c: short.get(frame[c].dtype.kind, "?") for c in sorted(frame.columns)}


def check(spark, con, q, path):
    start = time.time()
    got = q.run(spark, path).toPandas()
    took = time.time() - start
    if q.sql is None:
        return f"rows {len(got)}", took, True
    want = con.cursor().execute(q.sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} vs {sorted(want.columns)}", took, False
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"ROWS {len(a)} vs {len(b)}\n   {a[:3]}\n   {b[:3]}", took, False
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"VALUES {len(bad)} of {len(a)} e.g.\n   {sorted(got.columns)}\n   {bad[0][0]}\n   {bad[0][1]}", took, False
    note = "" if kinds(got) == kinds(want) else f" TYPES {kinds(got)} vs {kinds(want)}"
    return f"ok {len(a)} rows{note}", took, True


def main():
    path = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    queries = [q for n, q in load().items() if not wanted or any(n.startswith(w) for w in wanted)]
    spark, con = local_session(), duck(path)
    spark.sparkContext.setLogLevel("ERROR")

    def one(q):
        try:
            return (q.name, *check(spark, con, q, path))
        except Exception as e:
            text = str(e).split("JVM stacktrace")[0]
            return q.name, f"ERROR {type(e).__name__}: {text[:700]}", 0.0, False

    with ThreadPoolExecutor(int(os.environ.get("COMPARE_THREADS", "6"))) as pool:
        results = list(pool.map(one, queries))
    failed = [r for r in results if not r[2 + 1]]
    verbose = os.environ.get("COMPARE_VERBOSE")
    for name, text, took, good in results:
        if verbose or not good or "TYPES" in text or text in ("ok 0 rows", "rows 0"):
            print(f"{'' if good else 'FAIL '}{name} [{took:.1f}s] {text}")
    print(f"{len(results) - len(failed)} of {len(results)} good")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
