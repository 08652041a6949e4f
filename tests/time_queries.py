"""Time registered queries through the noop sink: python tests/time_queries.py sf_dir name-prefix ..."""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402
from techfolio.session import build_session  # noqa: E402


def main() -> None:
    sf, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = build_session("time")
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        times = []
        for _ in range(2):
            start = time.time()
            fn(spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        print(f"{times[0]:7.2f} {times[1]:7.2f} {name}", flush=True)


if __name__ == "__main__":
    main()
