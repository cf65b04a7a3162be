"""Seconds per headline query; one JSON line on stdout.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores, BENCH_QUERIES (comma
separated) other queries than the usual ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tabwright.catalog import QUERIES, load_all
from tabwright.session import ensure_checkpoint_dir, local_session

HEADLINE = (
    "profile_lineitem",
    "scan_score_blanked",
    "corr_matrix_lineitem",
    "order_stats_lineitem",
    "iqr_outliers_lineitem",
    "duplicate_rows_documents",
    "histogram_totalprice",
    "fill_missing_auto",
    "clip_outliers",
    "remove_outliers_sequential",
    "scale_standard",
    "one_hot_long_part",
    "tfidf_documents",
    "ridge_extendedprice",
    "gaussian_nb_returnflag",
    "knn_embeddings",
    "classification_metrics",
    "kfold_linear",
    "stratified_folds_orders",
    "rank_entries",
    "run_number",
    "user_usage",
    "usage_totals",
    "snapshot_upsert",
    "zscore_events",
    "isolation_forest_orders",
    "lof_embeddings",
    "davies_bouldin_embeddings",
    "silhouette_embeddings",
    "kmeans_orders",
    "dbscan_part",
    "attributions_linear",
    "local_surrogate_forest",
    "random_forest_price",
    "gradient_boosting_price",
    "ranked_regressors_price",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    load_all()
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    spark.read.parquet(f"{folder}/region.parquet").groupBy("r_name").count().collect()
    seconds = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds over the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
