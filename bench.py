"""Headline queries, timed. One JSON line on standard output.

Every query is built and run in full into the no-op sink; after one warm-up run
the median of the timed runs counts (fewer runs once the time budget is used up).
Building a query is part of its time, since some write intermediate tables.
The orders lie in one row group, which one task would read; the survey made of them is
dealt out over the cores by the setting `surveyloom.survey.partitions`.
"""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from registry.queries import REGISTRY  # noqa: E402
from surveyloom.operators.candidates import generate_candidates  # noqa: E402
from surveyloom.operators.clean import drop_missing, filter_applicable, codes_to_null  # noqa: E402
from surveyloom.sources import demo, scratch  # noqa: E402

HEADLINE = [
    "prepare_numeric", "missing_code_counts", "contingency", "mutual_information", "select_features",
    "semi_join_ids", "label_maps", "assign_quota", "exact_sample", "shuffle_index", "kfold_assign",
    "generate_candidates", "compile_text", "training_set", "covariance_matrix", "covariance_report",
    "binary_metrics", "token_arrays", "token_length_histogram", "pad_batches", "loss_mask",
    "argmax_scores", "evaluate_fold",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
BUDGET = float(os.environ.get("BENCH_BUDGET", "300"))


def ten_fold_candidates(spark, sf_dir):
    """Scale-out: ten candidates per respondent."""
    num = scratch.materialise(demo.survey_num(spark, sf_dir), "survey")
    answered = drop_missing(filter_applicable(codes_to_null(num), demo.TARGETS), demo.TARGETS)
    return generate_candidates(answered, demo.TARGETS, demo.LABELS, 10 * answered.count(), mode="num")


def timed(query, spark, sf_dir):
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("surveyloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config(demo.PARTS_CONF, os.environ.get("BENCH_PARTS", cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))  # one machine: local[n]
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: REGISTRY[name] for name in HEADLINE}
    queries["generate_candidates_x10"] = ten_fold_candidates
    seconds, counts, began = {}, {}, time.perf_counter()
    for name, query in queries.items():
        timed(query, spark, sf_dir)
        runs = [timed(query, spark, sf_dir)]
        while len(runs) < RUNS and time.perf_counter() - began < BUDGET:
            runs.append(timed(query, spark, sf_dir))
        seconds[name], counts[name] = round(statistics.median(runs), 3), len(runs)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": counts,
            }
        )
    )


if __name__ == "__main__":
    main()
