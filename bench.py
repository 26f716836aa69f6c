"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with seconds a query."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from profseg.plans.queries import QUERIES

HEADLINE = ("series_stats", "feat_summary", "asof_unit", "adaptive_kappa", "segment_graph", "match_boundaries", "feat_stft", "bocpd_univariate", "bocpd_hazard_spec", "bocpd_grid", "bocpd_long_profiles", "feat_fft")


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["profile_stats"](spark, sf_dir).count()  # starts the JVM's machinery
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
