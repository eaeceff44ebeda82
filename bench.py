"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabguard.session import local_session  # noqa: E402
from workload import all_queries  # noqa: E402

HEADLINE = [
    "k_anonymity_summary", "l_diversity_by_attribute", "t_closeness_by_attribute", "privacy_audit", "exact_row_leakage",
    "load_parquet_profile", "impute_median", "column_role_detection", "range_validate", "apply_profile", "compliance_report",
    "numeric_summary", "categorical_summary", "histogram", "correlation_difference", "ks_test", "flip_test",
    "closest_record_report", "closest_record_lineitem", "noisy_table_gaussian", "sample_copula_rows", "fhir_bundle_entries",
    "annotations_current", "experiment_lineage", "page_search", "highlight_segments", "registry_retention", "dataset_fingerprint",
    "request_admission", "trailing_request_count",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, app="bench")
    queries = all_queries()
    # Start the JVM, a shuffle and the Python workers once, outside the measured queries.
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    spark.range(8).mapInPandas(lambda batches: batches, "id long").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale.group(1)) if scale else None, "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
