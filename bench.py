"""Time the headline queries: one JSON line, median of warm runs per query."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import families  # noqa: E402
from checks.sessions import local_session  # noqa: E402

HEADLINE = [
    "agg_flagship", "normalize_row", "ingest_files", "parse_date", "stem_tokens",
    "extract_keywords", "infer_date_formats", "infer_context_types", "filter_compare_number",
    "filter_bool_chain", "search_any_cell", "paginate", "slice_sort", "agg_multi_metric",
    "agg_top_groups", "drilldown", "cosine_topk", "ann_topk", "semantic_search",
    "keyword_match_counts", "embed_rows", "score_highlights", "cite_results",
    "link_value_filters", "answer_questions", "verify_answers", "visible_datasets",
    "list_tables", "name_conflicts", "claim_unique_names", "resolve_dataset",
    "apply_cell_edits", "index_status",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    cpus = os.environ.get("BENCH_CPUS", "8")
    budget = float(os.environ.get("BENCH_BUDGET_SEC", "900"))
    spark = local_session(cpus)
    queries = families.queries()
    started, times = time.time(), {}
    for name in HEADLINE:
        taken = []
        for _ in range(1 + runs):  # the first run warms up
            start = time.time()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - start)
            if time.time() - started > budget:
                break
        times[name] = round(statistics.median(taken[1:] or taken), 3)
        if time.time() - started > budget:
            break
    print(json.dumps({
        "metric": "sum of median query seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf.rstrip("/")),
        "cpus": cpus,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "complete": len(times) == len(HEADLINE),
    }))


if __name__ == "__main__":
    main()
