"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores,
BENCH_QUERIES (optional, comma-separated) the queries.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "candidate_groups",
    "candidate_groups_nested",
    "grouping_stats",
    "valid_candidates",
    "verify_join",
    "pass_rate",
    "execution_worklist",
    "attach_completions",
    "generate_and_verify",
    "parse_ranking",
    "reward",
    "reward_summary",
    "group_advantage",
    "selection_report",
    "generation_prompt",
    "extract_code_strict",
    "flatten_test_cases",
    "training_record",
    "train_val_split",
    "group_and_split",
    "sweep_summary",
)
WARM_UP = "length_check"


def main():
    from gradeweave.plans.queries import registry
    from gradeweave.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, "bench", **{"spark.driver.memory": "20g"})
    queries = registry()
    # The first query of a session pays for starting it; that is not the queries' time.
    queries[WARM_UP](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        # Every column of every row is computed; nothing is brought to the driver.
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "candidate_set_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
