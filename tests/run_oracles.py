"""Command line: python tests/run_oracles.py [sf] [name substring ...]"""

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from compare import compare, duck  # noqa: E402
from tracelake.registry import all_queries  # noqa: E402
from tracelake.session import build_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/{sf}"
    spark = build_session(master="local[8]", extra={
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name, q in all_queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            df = q(spark, folder)
            if q.oracle:
                problems = compare(df, q.oracle, con)
                note = "ok" if not problems else "; ".join(problems)
                rows = con.execute(f"select count(*) from ({q.oracle})").fetchall()[0][0]
            else:
                rows, problems, note = len(df.collect()), [], "ok (rows only)"
        except Exception as exc:  # report and go on with the next query
            problems, rows = [str(exc)], -1
            note = "ERROR " + str(exc)[:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'pass'} {name} rows={rows} {time.time()-started:.2f}s spark={getattr(compare, 'spark_seconds', 0):.2f}s {'' if not problems else note[:1800]}",
              flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
