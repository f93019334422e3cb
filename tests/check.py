"""Run registered queries next to their SQL: ``python tests/check.py [sf] [name prefix ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import connect, spark_rows, sql_rows  # noqa: E402

from millrace.session import build_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    import __spark_entry__ as entry

    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    db = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            names, rows = spark_rows(run(spark, sf_dir))
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name} {len(rows)} rows {took:.1f}s")
                if len(wanted):
                    print("     ", names, rows[:3])
                continue
            sql_names, expected = sql_rows(db, oracles[name])
        except Exception:
            bad += 1
            print(f"ERROR {name}")
            print(traceback.format_exc()[-1800:])
            continue
        if names == sql_names and rows == expected:
            print(f"ok    {name} {len(rows)} rows {took:.1f}s")
        else:
            bad += 1
            print(f"DIFF  {name} {names} {sql_names} {len(rows)} {len(expected)}")
            shown = 0
            for got, want in zip(rows, expected, strict=False):
                if got != want and shown < 3:
                    shown += 1
                    print("   spark", str(got)[:400])
                    print("   sql  ", str(want)[:400])
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
