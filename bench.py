"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ramify.plans.queries import QUERIES  # noqa: E402
from ramify.session import build_session  # noqa: E402

HEADLINE = [
    "A1_class_profile", "A4_ap_median_skew", "A9_orientation_hist", "A10_feature_table", "A18_group_ci",
    "J10_branch_neighbors", "J13_connect_candidates", "J8_correct_tertiary", "W7_branch_geometry",
    "W11_gaussian_blur", "M1_standardize", "M2_pca",
]

# The costly half, timed by `python bench.py more` at two sizes; rows are those of the table the query starts from.
MORE = {
    "I3_fill_holes": "embeddings", "I4_skeletonize": "lineitem", "I7_merge_fragments": "lineitem", "I8_reconstruct_branches": "lineitem",
    "J16_resample_grid": "events", "J17_straighten_stack": "events", "M9_smote": "lineitem", "W12_stencil_degree": "lineitem",
    "J10_branch_neighbors": "lineitem", "A4_ap_median_skew": "lineitem",
}


def timed(spark, name, sf_dir):
    start = time.time()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def more(spark):
    """Seconds and source rows a second at sf0.01 and sf0.1; the first run of each query only warms up."""
    for name, source in MORE.items():
        out = {"query": name}
        timed(spark, name, "/root/testdata/sf0.001")
        for size in ("sf0.01", "sf0.1"):
            sec = timed(spark, name, f"/root/testdata/{size}")
            rows = spark.read.parquet(f"/root/testdata/{size}/{source}.parquet").count()
            out[size] = {"sec": sec, "rows_per_sec": round(rows / sec)}
        print(json.dumps(out), flush=True)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, partitions=2 * int(cpus) if cpus.isdigit() else 16, app="bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    if "more" in sys.argv[1:]:
        more(spark)
        spark.stop()
        return
    times = {}
    for name in HEADLINE:
        times[name] = timed(spark, name, sf_dir)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
