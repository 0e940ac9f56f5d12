"""Time the registered queries and print one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from biascomp.session import local_session
from biascomp.plans import queries

#: One query per operator family, from plain scans to the whole model.
HEADLINE = [
    "agg_sum", "join_left_meta", "assemble_long", "pivot_wider", "collapse_replicates", "dedupe_best",
    "rollup_with_other", "filter_percent_experiment", "filter_calibration_complete", "lump_other", "threshold_scan",
    "closure", "clr", "agg_median", "summary_quantiles", "ecdf", "fill_downup", "spearman", "p_adjust",
    "particle_biomass", "bias_fit", "gamma_scan", "amp_effs_all", "predict_cycle0", "predict_cycle0_draws",
    "residual_covariance", "bias_log2", "cor_grid", "hotspots", "top_n",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE
    if keys == ["all"]:
        keys = list(queries())
    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session(cores, int(cores))
        spark.sparkContext.setLogLevel("ERROR")
        queries()["agg_sum"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
        seconds = {}
        for key in keys:
            start = time.perf_counter()
            queries()[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[key] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "total wall time of the headline queries, every row computed",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": cores,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
