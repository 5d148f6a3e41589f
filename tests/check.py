"""Runs registered jobs against their oracles: python -m tests.check [name-prefix ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from plumbline.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    sf = os.environ.get("CHECK_SF", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    jobs, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, job in jobs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = job(spark, sf)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                state = f"ok {len(con.execute(oracles[name]).fetchall())} rows" if problem is None else "DIFF " + problem
            else:
                problem, state = None, f"rows {df.count()}"
        except Exception as exc:  # report and go on with the next job
            problem, state = exc, "ERROR " + "".join(traceback.format_exception_only(exc))[:1500]
        bad += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {state}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
