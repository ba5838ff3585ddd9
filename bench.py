"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed to completion with the ``noop`` sink (the whole plan
runs, nothing is collected). Timings are wall-clock seconds per query, taken
after one untimed pass of the same queries over the smallest fixture
(``$BENCH_WARMUP_DIR``, default sf0.001; empty disables it), so JIT and
Python-worker start-up are not charged to whichever query runs first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "win1_monthly_running",     # minimum slice: dense months + running total
    "prf3_describe",            # exact quartiles via range-partitioned order statistics
    "agg5_crosstab",            # pivot crosstab
    "agg10_box_stats",          # grouped exact box statistics
    "agg14_word_frequencies",   # text explode + group
    "tst3_chi_square_rxc",      # chi-square on a contingency table
    "tst4_anova_sweep",         # 9 one-way ANOVAs in one pass
    "reg1_ols_coefficients",    # one-pass Gram regression with dummies
    "reg14_best_subsets",       # exhaustive subsets from one Gram
    "spl1_exact_split",         # exact-size shuffled split (global positions)
    "bal1_oversample_minority", # hash-drawn over-sampling
    "ml10_roc_curve",           # exact ROC with a distributed running sum
    "ml10_auc",                 # exact AUC (Mann-Whitney with ties)
    "ml6_classification_report",
    "ml9_knn_error_curve",      # exact top-39 neighbours, k = 1..39
    "txt10_rouge_n",            # ROUGE-1/2 by n-gram joins
    "txt12_bigram_perplexity",  # smoothed bigram model + per-document perplexity
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from statfold.plans.catalog import QUERIES
    from statfold.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=2 * cpus, app_name="statfold-bench")
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm_dir and os.path.isdir(warm_dir):
        for name in HEADLINE:
            if name in QUERIES:
                try:
                    QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
                except Exception:  # noqa: BLE001 - a failing query is reported by the timed pass
                    pass
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # noqa: BLE001
            failed[name] = str(exc)[:200]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus,
           "shuffle_partitions": 2 * cpus}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
