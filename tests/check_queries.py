"""Compare named queries (all by default) with their SQL and print the time each takes.

    python -m tests.check_queries [--sf DIR] [name ...]
"""

from __future__ import annotations

import sys
import time

from tabwright.catalog import ORACLE, QUERIES, load_all
from tabwright.session import local_session
from tests.compare import difference, duck


def main(arguments: list[str]) -> int:
    folder = "/root/testdata/sf0.001"
    if arguments and arguments[0] == "--sf":
        folder, arguments = arguments[1], arguments[2:]
    load_all()
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    names = [n for n in QUERIES if not arguments or any(n.startswith(a) for a in arguments)]
    bad = 0
    for name in names:
        started = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLE:
                verdict = difference(df, con, ORACLE[name]) or "ok"
            else:
                verdict = f"rows {df.count()}"
        except Exception as error:  # the report goes on with the next query
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        if verdict != "ok" and not verdict.startswith("rows "):
            bad += 1
        if verdict.startswith("rows ") and "!=" in verdict:
            bad += 1
        print(f"{name:40s} {time.time() - started:6.2f}s  {verdict}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
