"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
# For Python workers, wherever this is started from.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

HEADLINE = [
    "term_counts",
    "stop_filtered_counts",
    "document_frequency",
    "normalised_tf",
    "tfidf_top_terms",
    "postings",
    "posting_lists",
    "hash_cells",
    "double_hash_cells",
    "feature_vectors",
    "book_documents_by_rules",
    "best_edition",
    "edition_profiles",
    "line_documents_by_rules",
    "metadata_subjects",
    "subject_labels",
    "vector_size_cells",
    "tfidf_large_vocabulary",
    "scanned_metadata",
    "learning_rows",
    "naive_bayes_errors",
    "shallow_tree_errors",
]


def main() -> None:
    from checks import inputs
    from checks.queries import QUERIES, written_metadata
    from checks.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS"), "bench")
    # Start-up of the JVM, its workers and compilers is not part of any query.
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    # The given tables are one row group each; a table of many splits is what the queries are made for.
    inputs.PARTS = int(os.environ.get("BENCH_CPUS", "8"))
    # The files that are scanned are there before any query starts.
    written_metadata(spark, sf_dir)
    QUERIES["term_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
