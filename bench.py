"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brightloom.queries import QUERIES, base  # noqa: E402
from brightloom.session import local_session  # noqa: E402

HEADLINE = [
    "pipe_optimize", "join_candidates", "join_candidates_feasible", "win_best_per_dispatch", "win_runner_up", "pipe_insights",
    "agg_skill_shortage", "agg_time_of_day", "agg_tech_utilization", "join_history_tech", "prj_final_score",
    "ml_feature_matrix", "agg_auc_metrics", "set_stratified_split", "cube_regrid_nearest", "cube_align_add",
    "cube_median_filter", "pipe_cube_ratio", "pair_potential", "pair_force_plummer_like", "pair_force_multipole",
    "agg_quadtree_cells", "join_within_radius",
]

SHARED = {"setup_optimized": base.optimized, "setup_best": base.best}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores=cores)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    # tables that several queries read are built first, each timed by itself
    for name, build in SHARED.items():
        start = time.time()
        build(spark, sf_dir)
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
