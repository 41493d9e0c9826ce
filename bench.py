"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR  folder with the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES optional comma-separated query names, or "all"
"""

from __future__ import annotations

import json
import os
import sys
import time

from catalumen.plans import QUERIES
from catalumen.session import build_session

HEADLINE = (
    # text and identity
    "ws_normalize", "word_tokens", "field_tokens", "title_audit", "length_stats", "chunk_tokens", "hash_split",
    "record_ids", "fingerprint", "row_numbers",
    # taxonomy, labels, splits, audits
    "taxonomy_nodes", "level_accuracy", "unseen_children", "label_canonical", "class_universe", "admissibility",
    "component_split", "leakage", "split_overlap", "lookup_join", "image_counts", "reference_audit", "stage_diff",
    "trace_counts", "duplicates", "quality_counters", "eligibility_funnel", "signal_matrix", "json_field_presence",
    # vectors, fusion, reliability
    "prototype_distance", "confidence_signals", "signal_stats", "class_report", "fusion_sweep", "fusion_compare",
    "view_ablation", "transfer_sweep", "calibration_scores", "temperature", "coverage_risk", "routing",
    # text models and streams
    "tfidf_unigrams", "tfidf_bigrams", "tfidf_capped", "nb_text", "nb_transfer", "stream_ingest", "stream_score",
    # heavier ones
    "component_leakage", "nearest_prototype", "permutation_control", "tsv_numbered", "page_manifest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = list(HEADLINE) if not wanted else list(QUERIES) if wanted == "all" else wanted.split(",")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    # One throw-away query, so that JVM start-up is not charged to the first one.
    QUERIES["hash_split"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{seconds[name]:8.3f}s {name}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "driver_memory": "16g"}))
    spark.stop()


if __name__ == "__main__":
    main()
