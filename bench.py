"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from larkspur.plans import catalogue
from larkspur.session import session

HEADLINE = (
    "cross_split_duplicates stable_hash_split account_greedy_split group_spans_splits pk_violations fk_attribute_disagreement "
    "qc_reasons label_runs majority_label_per_window centered_vote sliding_windows sessions nearest_beat beat_alignment_score "
    "zscore_embeddings nearest_centroid topk_neighbours r_precision rank_auc linear_quantiles same_source_components sequence_summary stitched_labels spans_within_runs confusion_matrix permutation_p largest_deficit_split pool_best_share phrase_starts"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalogue.queries(), {}
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
