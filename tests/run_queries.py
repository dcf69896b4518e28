"""Compare queries with their SQL, one line each: run_queries.py FOLDER [NAME ...]."""

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tests.compare import check, connect  # noqa: E402


def main(folder, names):
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), oracle_sql(), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = check(fn(spark, folder), con, sql[name]) if name in sql else f"no SQL, {fn(spark, folder).count()} rows"
        except Exception as error:  # one failing query must not hide the others
            problem = f"{type(error).__name__}: {str(error)[:400]}"
        bad += problem is not None and not problem.startswith("no SQL")
        print(f"{name:24s} {time.time() - start:6.1f}s  {problem or 'ok'}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
