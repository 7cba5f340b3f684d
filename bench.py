"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line. Each query runs twice untimed, then three times;
the median counts."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from semspark.queries import QUERIES

HEADLINE = [
    "net_revenue_by_region", "fulfilled_lines_by_nation", "net_revenue_europe_1995", "net_revenue_by_brand_asia", "net_of_refunds", "net_of_refunds_by_segment", "customers_with_urgent_orders", "gross_vs_net", "densified_daily_events", "avg_with_absence",
    "event_type_anomalies", "region_subtree", "revenue_in_subtree", "latest_event_per_user", "events_as_of", "supplier_set_by_nation", "orders_with_returns", "allocated_revenue", "balance_period_end", "median_discount", "key_uniqueness_lineitem",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        took = []
        for n in range(5):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if n > 1:
                took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "total seconds of headline queries (median of 3 warm runs each)", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
