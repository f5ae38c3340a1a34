"""python tests/check_all.py [folder] [name ...]: every query against its SQL text."""

from __future__ import annotations

import os
import sys
import time
import traceback

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

import __spark_entry__ as entry  # noqa: E402
from compare import difference, duck  # noqa: E402
from tidemark import build_session  # noqa: E402


def main(folder: str, names: list[str]) -> int:
    spark = build_session(master="local[8]", shuffle_partitions=8, extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, bad = duck(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            df = run(spark, folder)
            text = oracles.get(name)
            problem = f"no oracle, {df.count()} rows" if text is None else difference(df, connection, text)
            bad += text is not None and problem is not None
        except Exception as error:
            bad += 1
            problem = f"{type(error).__name__}: {str(error)[:700]}"
            if names:
                traceback.print_exc()
        print(f"{name:36} {time.time() - began:6.2f}s  {problem or 'equal'}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    sys.exit(1 if main(where, sys.argv[2:]) else 0)
