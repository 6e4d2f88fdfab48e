"""Seconds per headline query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``BENCH_QUERIES`` picks other keys (comma separated, or ``all``).
"""

from __future__ import annotations

import json
import os
import sys
import time

from dyadspark import get_spark
from dyadspark.plans import load_all
from dyadspark.plans.registry import QUERIES

HEADLINE = [
    "trade_panel",
    "agg_stats",
    "agg_count",
    "win_group_total",
    "win_latest",
    "win_cumsum",
    "win_filldown",
    "win_dense_id",
    "shared_groups",
    "panel_complete",
    "country_year_panel",
    "typology_dist",
    "neighbour_profile",
    "mentions_all",
    "html_links",
    "shared_boundary",
    "group_linear_fit",
    "ame_dydx",
    "fit_multinomial",
    "vcov_cluster",
    "impute_chained",
]


def run(spark, key: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    wanted = os.environ.get("BENCH_QUERIES", "")
    load_all()
    keys = list(QUERIES) if wanted == "all" else [k for k in wanted.split(",") if k] or HEADLINE
    spark = get_spark("bench", cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # warm the JVM
    spark.range(64).mapInPandas(lambda batches: batches, "id long").count()  # and the Python workers
    times = {}
    for key in keys:
        times[key] = run(spark, key, folder)
        if wanted:
            print(key, times[key], file=sys.stderr, flush=True)
    line = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times}
    print(json.dumps(line | {"sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
