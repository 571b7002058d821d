"""Run registered queries against their SQL: python tests/check.py [prefix ...] [--sf DIR]"""

import os
import sys
import time
import traceback

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

import oracle
from sievegate.session import local_session

import __spark_entry__ as entry

if __name__ == "__main__":
    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if "--sf" in args:
        at = args.index("--sf")
        folder = args[at + 1]
        del args[at:at + 2]
    spark = local_session("8", **{"spark.sql.shuffle.partitions": os.environ.get("CHECK_PARTITIONS", "8"), "spark.driver.memory": "8g"})
    con = oracle.connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t0, took = time.time(), 0.0
        try:
            if name in oracles:
                frame = fn(spark, folder)
                got = oracle.table(frame.columns, [tuple(r) for r in frame.collect()])
                took = time.time() - t0
                diff = oracle.compare(frame, con, oracles[name], got)
                state = "ok" if diff is None else "DIFF " + diff[:1500]
            else:
                rows = fn(spark, folder).collect()
                state = f"rows-only {len(rows)} {rows[:2]}"[:400]
        except Exception as err:
            state = "ERROR " + str(err)[:1500]
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += state.startswith(("DIFF", "ERROR"))
        print(f"{name:34s} {took or time.time() - t0:6.2f}s {state}", flush=True)
    print("bad", bad)
