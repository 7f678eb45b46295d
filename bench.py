"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

    python bench.py [QUERY...]            Spark: once to warm up, then the median of 3
    python bench.py --duckdb [QUERY...]   the same queries' SQL in DuckDB, median of 5

Each query is planned and run to the end (all rows, no result kept on the driver).
"""

import json
import os
import sys
import tempfile
import time
from statistics import median

from lavka.plans.oracle import ORACLE
from lavka.plans.registered import QUERIES
from lavka.plans.views import SOURCES
from lavka.session import local_session

HEADLINE = (
    "order_list", "order_documents", "order_text_parse", "catalog_list", "catalog_search",
    "catalog_combined", "catalog_cards", "manufacturer_names", "clean_products", "clean_orders",
    "items_strict", "orders_imported", "orders_inserted", "orders_replaced", "products_updated",
    "constraint_audit", "signin_matches",
)


def timed(run):
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def spark_runner(sf, cpus):
    """Intermediate tables go to a folder of this run."""
    spark = local_session(cpus, partitions=8, folder=tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return lambda name: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()


def duckdb_runner(sf, cpus):
    import duckdb

    connection = duckdb.connect(config={"threads": int(cpus) if cpus.isdigit() else os.cpu_count()})
    for table in SOURCES:
        connection.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    return lambda name: connection.execute(f"create or replace temp table result as {ORACLE[name]}")


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [a for a in sys.argv[1:] if a != "--duckdb"] or HEADLINE
    in_duckdb = "--duckdb" in sys.argv
    run = (duckdb_runner if in_duckdb else spark_runner)(sf, cpus)
    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(median(timed(lambda: run(name)) for _ in range(5 if in_duckdb else 3)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")), **({"engine": "duckdb"} if in_duckdb else {}),
    }))


if __name__ == "__main__":
    main()
