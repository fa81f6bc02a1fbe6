"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names (default: the list below)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from topicloom.plans.catalog import all_queries  # noqa: E402
from topicloom.session import local_session  # noqa: E402

HEADLINE = [
    "clean_text",
    "segment_paragraph",
    "segment_sentence",
    "prepare_posts",
    "class_term_counts",
    "class_tfidf_bm25",
    "sentence_topics",
    "embed_static",
    "knn_exact",
    "reduce_pca",
    "reduce_umap",
    "cluster_kmeans",
    "cluster_hdbscan",
    "topic_centroids",
    "find_topics",
    "representative_docs",
    "fit_topics",
    "describe_topics",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = all_queries(), {}
    # start the Python workers and warm the file cache once
    spark.read.parquet(f"{folder}/documents.parquet").mapInPandas(lambda it: it, "doc_id long, text string, lang string, source string, n_chars long").write.format("noop").mode("overwrite").save()
    for name in names:
        start = time.time()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_wall_time", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
