"""Check registered queries against DuckDB: python tests/check_queries.py [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import compare  # noqa: E402
import __spark_entry__ as entry  # noqa: E402
from techfolio.session import build_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = compare.connect(sf)
    bad, tally = 0, {}
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            sql = entry.oracle_sql().get(name)
            if sql is None:
                verdict, detail = "rows", f"{df.count()} rows"
            else:
                verdict, detail = compare.compare(df, con, sql)
        except Exception as e:  # noqa: BLE001
            verdict, detail = "error", str(e)[:1200]
        tally[verdict] = tally.get(verdict, 0) + 1
        if verdict in ("diff", "error"):
            bad += 1
        print(f"{verdict:6} {time.time() - start:6.2f}s {name}: {detail}", flush=True)
    print(tally)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
