"""Benchmark: run the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS], print one JSON line.

Every query is executed in full with the ``noop`` sink (the whole plan runs,
nothing is collected). Seconds are wall-clock per query after one warm-up
query; ``value`` is their sum.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # corpus preparation
    "clause_split", "sft_build", "sft_features", "segment_profile", "clause_profile",
    # parsing model output
    "final_sql", "extract_reflection", "output_quality",
    # evaluation and rewards
    "exact_match_rate", "execution_match", "reward_execution", "eval_summary", "reward_ngram", "reward_schema",
    "reward_total", "rollout_rewards",
    # guarded execution of SQL text
    "sql_batch_rows",
    # retrieval
    "route_topk", "rank_tables", "prune_columns", "fewshot_topk", "fewshot_vectors", "rag_link", "rag_link_vectors",
    # reflection and rollout groups
    "reflection_prompt", "group_advantage", "clipped_objective", "training_log",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    os.environ.setdefault("SQLFORGE_MASTER", f"local[{cpus}]")
    os.environ.setdefault("SQLFORGE_SHUFFLE_PARTITIONS", str(max(8, 2 * int(cpus))))

    from sqlforge.plans.queries import Q
    from sqlforge.session import get_session

    spark = get_session(app_name="sqlforge-bench")
    Q["clause_split"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times, errors = {}, {}
    for n in names:
        t0 = time.perf_counter()
        try:
            Q[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[n] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # report, keep going
            errors[n] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {"metric": "headline_queries_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": int(cpus), "engine": f"pyspark {spark.version} local[{cpus}]"}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
