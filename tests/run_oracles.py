"""``python tests/run_oracles.py [pattern] [sf_dir]``: check registered queries, print times."""

from __future__ import annotations

import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
import oracle  # noqa: E402
from tracelab.session import local_session  # noqa: E402


def main() -> int:
    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = oracle.connect(sf), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if not re.search(pattern, name):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = oracle.compare(fn(spark, sf), con, sqls[name])
            else:
                n = len(fn(spark, sf).collect())
                problem = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        took = time.time() - start
        print(f"{'ok  ' if problem is None else 'FAIL'} {took:6.2f}s {name}{'' if name in sqls else ' (rows only)'}", flush=True)
        if problem:
            failed.append(name)
            print("     ", problem, flush=True)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
