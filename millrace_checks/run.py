"""``python -m millrace_checks.run [sf_dir] [name ...]``: run queries against their SQL."""

from __future__ import annotations

import sys
import time
import traceback


def main() -> int:
    from millrace_checks.all_checks import ORACLES, QUERIES
    from millrace_checks.compare import differences, duck
    from millrace.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session("checks", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = differences(df, con, ORACLES[name])
                note = problem or "ok"
            else:
                problem, note = None, f"rows only: {df.count()}"
        except Exception:
            problem = note = traceback.format_exc(limit=-4)[-1500:]
        bad += problem is not None
        print(f"{'FAIL' if problem else 'pass'} {name} {time.time() - start:.2f}s {note}", flush=True)
    print(f"{len(names)} run, {bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
