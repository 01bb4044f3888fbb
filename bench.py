"""Benchmark: runs the headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) with
local[$BENCH_CPUS] and prints one JSON line. Each query is fully computed through the no-op sink
(every row produced, nothing collected)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "js_by_group", "js_report", "js_by_two_groups", "value_shares", "crosstab_rownorm", "join_base_grouper_left",
    "join_pool_left", "fallback_fill", "positional_zip", "label_encode", "encode_shared_vocab", "split_stratified",
    "sample_stratified_n", "sample_n", "sample_weighted_replace", "ipf_weights", "ipf_population",
    "conditional_independent", "autoregressive_generate", "label_by_probability", "group_sample_list",
    "markov_transitions", "freq_itemsets", "mutual_information", "classification_report", "roc_auc", "tstr",
    "utility_grid", "nn_join_1", "nn_join_k", "privacy_report", "dbscan", "scan_tsv",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from cohortforge.plans.fixtures import encounters
    from cohortforge.plans.registry import QUERIES, load_all
    from cohortforge.session import get_session

    spark = get_session(f"local[{cpus}]", int(cpus) * 2, app="cohortforge-bench")
    load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    # the ingestion stage that the encounter queries read, apart from them
    t0 = time.perf_counter()
    encounters(spark, sf_dir)
    times["gold_build"] = round(time.perf_counter() - t0, 3)
    for name in only or HEADLINE:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report and continue
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_sec_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "cpus": int(cpus)}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
