"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the input, BENCH_CPUS the number of local cores.
Names given as arguments replace the headline list. Each result is computed in full and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from textprep.catalog import QUERIES

HEADLINE = [
    "clean_text",
    "clean_web_text",
    "normalize_text",
    "script_variant",
    "rule_override",
    "parse_text_label",
    "relabel_rule",
    "value_counts",
    "classification_report",
    "dedup_first",
    "prepare_corpus",
    "distributed_rank",
    "undersample",
    "oversample",
    "stratified_split",
    "shuffled_rows",
    "parse_and_balance",
    "parse_and_relabel",
    "clean_table",
    "word_tokens",
    "ngrams",
    "term_counts",
    "vocabulary",
    "tfidf",
    "train_baseline",
    "encode_splits",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("textprep-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("quality").count().collect()

    names = sys.argv[1:] or HEADLINE
    seconds = {}
    # The first round warms up the JVM; the second one counts.
    for timed in (False, True):
        for name in names:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
            print(name, seconds[name], "timed" if timed else "warm-up", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
