"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from airgrid.plans import registered  # noqa: F401  (fills the catalog)
from airgrid.plans.catalog import QUERIES
from airgrid.session import build_session

HEADLINE = ["hourly_average", "daily_weighted_average", "seasonal_weighted_mean", "nearest_cell_join",
            "mean_by_cell_day", "bilinear_regrid", "regrid_between_satellites", "matched_table", "point_in_polygon_join", "clip_to_region",
            "focal_mean", "regression_scores", "aqi_category_shares", "robust_limits", "boxplot_stats", "hexbin_counts",
            "kde_curve", "group_kfold", "kfold_assign", "ml_linear", "cross_val_linear", "grid_scoring"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="16g", spark__log__level="ERROR")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["regression_scores"](spark, sf_dir).collect()  # start the engine before the clock
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # every row is worked out and thrown away; none comes to the driver
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)  # what is done stays known if the rest is stopped
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
