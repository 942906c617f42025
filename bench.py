"""Headline timings: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time
import warnings

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
warnings.simplefilter("ignore")

from edgeloom.plans import inputs, tasks  # noqa: E402
from edgeloom.plans.queries import QUERIES  # noqa: E402
from edgeloom.session import local_session, ship_package  # noqa: E402

HEADLINE = [
    "inferred_network", "line_network", "edge_zscores", "fdr_bh", "gram_matrix", "pearson_edges", "npn_chain",
    "spearman_edges", "ensemble_ci", "stars_instability", "grouped_fits", "ggl_edges", "glasso_edges",
    "evaluate_predictions", "degree", "betweenness", "knockout_impact", "diffusion_signal", "ora_hypergeom",
    "benchmark_summary",
]
FITS = [("desparsified", "n100p50"), ("desparsified", "n237p78"), ("desparsified", "n513p164"),
        ("gglasso", "n100p50"), ("gglasso", "n237p78"), ("gglasso", "n513p164"),
        ("glasso", "n100p50"), ("glasso", "n237p78"), ("piglasso", "n100p50")]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, cores)
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    inputs.chain_matrix(spark, sf_dir).count()  # start the JVM and the Python workers
    QUERIES["line_network"](spark, sf_dir).collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    fits: dict[str, float] = {}
    for method, config in FITS:  # the published unit: one fit of one simulated data set
        row = tasks.synthetic_task(spark, "hub", config, method, 0).first()
        fits[f"{method}_{config}"] = round(row["wall_seconds"], 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "fits": fits, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
