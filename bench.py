"""Times the headline queries and prints one JSON line.

``$BENCH_SF_DIR`` names the data (default /root/testdata/sf0.1), ``$BENCH_CPUS`` the number of cores.
Every query is run once to its last row; the catalogue build is timed on its own, as the start of a
search service would be.  One query on a small directory beside it warms the JVM up before that.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES, prepared  # noqa: E402

HEADLINE = (
    "search_topk", "scoped_search_topk", "search_all_hits", "search_wide_threshold", "name_search_topk",
    "query_log_answers", "pair_scores", "component_list", "signature_nodes", "name_search_urls", "hit_links",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(job) -> float:
    start = time.perf_counter()
    job()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = session(os.environ.get("BENCH_CPUS", "8"))

    def run(name: str, directory: str) -> None:
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()

    small = Path(sf_dir).parent / "sf0.001"
    if small.is_dir():
        run("search_topk", str(small))
    times = {"build_catalog": timed(lambda: prepared(spark, sf_dir))}
    for name in HEADLINE:
        times[name] = timed(lambda: run(name, sf_dir))
    print(json.dumps({
        "metric": "catalogue build and headline searches, total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
