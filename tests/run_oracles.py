"""Compare registered queries by name: python tests/run_oracles.py [name ...]"""

import os
import sys
import tempfile
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from oracle import DATA, compare, connect  # noqa: E402

if __name__ == "__main__":
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-")).getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = connect()
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [a for a in sys.argv[1:] if not a.startswith("@")]
    groups = [a[1:] for a in sys.argv[1:] if a.startswith("@")]
    bad = 0
    for name in names or queries:
        if groups and not any(QUERY in name for QUERY in groups):
            continue
        t = time.time()
        try:
            if name in oracles:
                diff = compare(spark, con, queries[name], oracles[name])
            else:
                diff = None if queries[name](spark, DATA).count() else "no rows"
        except Exception as e:  # report and go on
            diff = f"{type(e).__name__}: {str(e)[:600]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {name} {time.time() - t:.2f}s {diff or ''}", flush=True)
    print("bad", bad)
    spark.stop()
