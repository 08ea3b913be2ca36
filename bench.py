"""Time the headline queries; one JSON line on stdout.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the best time
counts. Results go to Spark's no-op sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from twinlens.catalog import load
from twinlens.session import local_session

HEADLINE = (
    "wasserstein_judge",
    "wasserstein_by_column",
    "js_divergence",
    "kl_divergence",
    "corr_matrix",
    "corr_similarity",
    "mmd_rbf",
    "kde_overlay",
    "linkability",
    "k_anonymity",
    "column_profile",
    "column_describe",
    "quantile_grid",
    "gen_healthcare",
    "gen_finance",
    "laplace_noise",
    "sanitise_table",
    "fold_assign",
    "trace_timeline",
    "segment_scorecards",
    "judge_decision",
    "certificate_text",
    "synth_marginals",
    "synth_copula",
    "knn_embeddings",
    "recommend_model",
    "utility_tstr",
    "pair_scorecard",
    "mia_attack",
    "mwem_histogram",
    "pilot_scores",
    "ensemble_mix",
    "feature_importance",
    "utility_bayes",
    "attack_bayes",
    "importance_bayes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES")
    registry = load()
    names = list(registry) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)
    spark = local_session(cpus, "bench", shuffle_partitions=cpus if cpus.isdigit() else "8")
    times = {}
    for name in names:
        best = None
        for i in range(runs + 1):
            start = time.perf_counter()
            registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            if i and (best is None or spent < best):
                best = spent
        times[name] = round(best, 3)
        print(f"{name} {best:.2f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
