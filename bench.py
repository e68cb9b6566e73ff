"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "evidence_rank", "evidence_stats", "dimension_support", "signal_profile", "text_facts", "leading_evidence", "priority_rank",
    "evidence_dedupe7", "source_dedupe_provenance", "quote_grounding", "quote_corpus_search", "keyword_groups",
    "keyword_table_join", "page_text", "redaction", "leak_scan", "url_canonical", "host_tier_join", "radar_gates", "radar_top5",
    "radar_replay", "last_nonempty_merge", "pool_stats", "pool_page", "import_preview", "history_flatten", "discovery_rollup",
    "reconcile_batch", "coverage_matrix", "status_rollup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    from factloom.plans import catalog

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("factloom-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
             # Small files with one row group still feed every core.
             .config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.files.openCostInBytes", "0")
             .config("spark.sql.maxPlanStringLength", "5000")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/nation.parquet").count()
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        start = time.time()
        try:
            catalog.run(name, spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        except Exception as error:  # a failed query is reported, the others still run
            errors[name] = str(error)[:200]
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
