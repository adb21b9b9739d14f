"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tremor.plans.registry import QUERIES

NAMES = ["a9_rasterise_grid", "b5_utm", "b10_near_trace", "c7_signed_distance", "d3_block_means", "e3_covariogram", "f1_gaussian", "f5_rotated_strain", "f8_bilinear", "g1_extract", "g9_robust_stack",
         "g10_step", "h5_apply_shift", "h6_stack", "h10_straighten", "i3_offset", "j6_plane_cut", "k1_rectangle_pairs", "k12_normal_equations", "l3_modes", "l6_correlations", "l8_moment"]


def main() -> None:
    here = os.path.dirname(os.path.abspath(__file__))  # for the Python workers, wherever this is started from
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [here, os.environ.get("PYTHONPATH")]))
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["g9_robust_stack"](spark, sf).collect()  # warm-up
    took = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
