"""Run registered queries against their SQL: python tests/run_oracles.py [sf] [name ...]

A name ending in "." must match exactly.
"""

import sys
import threading
import time

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

import __spark_entry__ as entry
from compare import connect, diff
from wiretrace.session import local_session

SQL_SECONDS = 40

if __name__ == "__main__":
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:]
    spark = local_session()
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    failures = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w == name + "." or (w in name) for w in wanted):
            continue
        start = time.time()
        spent = checked = 0.0
        try:
            df = fn(spark, sf_dir)
            rows = df.collect()
            spent = time.time() - start
            if name in sql:
                stop = threading.Timer(SQL_SECONDS, con.interrupt)
                stop.start()
                problem = diff(df.columns, rows, con, sql[name])
                stop.cancel()
                checked = time.time() - start - spent
            else:
                problem = None if rows else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += problem is not None
        print(
            f"{'FAIL' if problem else 'ok  '} {name} {spent:.2f}s sql {checked:.2f}s {'' if name in sql else '(rows only)'} {problem or ''}",
            flush=True,
        )
    print("failures:", failures)
