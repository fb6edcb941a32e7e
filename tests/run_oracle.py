"""Compare registered queries with their SQL: python tests/run_oracle.py SF_DIR [name ...]."""

import os
import sys
import time
import traceback

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

import __spark_entry__ as entry
from oracle import compare, connect
from stockloom.session import local_session


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session("8", **dict(pair.split("=") for pair in os.environ.get("SPARK_CONF", "").split(",") if pair))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        try:
            start = time.time()
            mine = queries[name](spark, sf_dir).toArrow()
            took = time.time() - start
            if name not in oracles:
                print(f"{name}: {took:.1f}s {mine.num_rows} rows, no SQL", flush=True)
                continue
            start = time.time()
            theirs = con.sql(oracles[name]).to_arrow_table()
            sql_took = time.time() - start
            problem = compare(mine, theirs)
            print(f"{name}: {took:.1f}s/{sql_took:.2f}s {mine.num_rows} rows {problem or 'equal'}", flush=True)
            bad += problem is not None
        except Exception as error:
            bad += 1
            print(f"{name}: FAILED {type(error).__name__}: {str(error)[:600]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{bad} not equal")


main()
