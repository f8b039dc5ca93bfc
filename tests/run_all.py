"""Compares every catalogue query with its SQL: python tests/run_all.py SF_DIR [name ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from flowlens.catalog import catalog  # noqa: E402
from tests.compare import compare, connect  # noqa: E402


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name, query in catalog().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, query, sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
            if names:
                traceback.print_exc()
        bad += bool(problem)
        kind = "S" if query.sql else "R"
        if problem or names or time.time() - start > 3:
            print(f"{'FAIL' if problem else 'ok  '} {kind} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print("failures:", bad)


main()
