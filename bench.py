"""Time every report; prints one JSON line.

The retail table is stored once, as in practice, and each report then runs
over it to its last row with the output discarded; ``queries`` holds these
times and that of storing the table. ``view_queries`` holds the times of the
same reports with the table left as a view over the star tables, so that each
includes the joins. Times are the best of ``BENCH_RUNS`` runs (2) in a warm
session. ``BENCH_ORACLE=1`` adds the times of the SQL engine used for checking,
over the same stored table and over the same view.
"""

from __future__ import annotations

import json
import os
import time

from tillroll.plans import ORACLE_SQL, REPORTS, publish, run_report
from tillroll.plans.oracle import SALES_SQL
from tillroll.session import local_session, remove_at_exit, scratch_path
from tillroll.sources import read_retail, save_retail, star_sales
from tillroll.sources.versions import version_folders

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
WARM_UP = ("month_over_month", "top_products_by_country_rank", "quartile_share")


def best_time(action) -> float:
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return round(min(times), 3)


def discard(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def sql_times(table_path: str) -> dict[str, dict[str, float]]:
    import duckdb

    con = duckdb.connect()
    con.execute(f"SET threads = {CPUS}")
    for file in sorted(os.listdir(FOLDER)):
        view = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{FOLDER}/{file}')")
    stored = f"SELECT * FROM read_parquet('{table_path}/*.parquet')"

    def times(change) -> dict[str, float]:
        return {
            name: best_time(lambda: con.sql(change(sql)).to_arrow_table())
            for name, sql in ORACLE_SQL.items()
        }

    return {
        "queries": times(lambda sql: sql.replace(SALES_SQL, stored)),
        "view_queries": times(lambda sql: sql),
    }


def main() -> None:
    spark = local_session("tillroll-bench", CPUS, os.environ.get("BENCH_MEMORY", "12g"))
    for name in WARM_UP:
        discard(run_report(name, spark, FOLDER))

    path = scratch_path(spark, "bench")
    queries = {
        "save_table": best_time(
            lambda: save_retail(star_sales(spark, FOLDER), path, mode="overwrite")
        )
    }
    remove_at_exit(spark, path)
    table = read_retail(spark, path)
    for name, report in REPORTS.items():
        queries[name] = best_time(lambda: discard(publish(report(table))))
    views = {n: best_time(lambda: discard(run_report(n, spark, FOLDER))) for n in REPORTS}
    line = {
        "metric": "total_report_time",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": os.path.basename(FOLDER).removeprefix("sf"),
        "view_queries": views,
        "view_value": round(sum(views.values()), 3),
    }
    if os.environ.get("BENCH_ORACLE") == "1":
        line["sql_engine"] = sql_times(version_folders(spark, path)[0])
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
