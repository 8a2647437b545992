"""Headline queries, the median of three runs each after a warm-up; one line of JSON."""

import json
import os
import statistics
import time

from brinewell.plans import registry
from brinewell.session import local_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "events_after_linking", "event_link_anchored", "counterparty_spend", "recurring_charges", "entity_top_aliases", "sender_census_coverage",
    "attachment_state", "interval_conflicts", "nearest_match", "thread_rollup", "activity_batches", "shrunk_rating", "upsert_latest",
    "merge_columnwise", "incremental_equals_full", "incremental_touched_keys", "rule_cascade", "domain_fields", "canonical_product",
    "fts_and_match", "fts_bm25", "content_copies",
]
#: What is kept and read by others: the full-text index and the first run's tables, timed once while they are made.
KEPT = ["fts_index", "incremental_first_run"]


def timed(spark, name: str) -> float:
    start = time.perf_counter()
    registry.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, "16g", int(CPUS), "brinewell-bench")
    for name in ("spend_by_kind", "events_after_linking"):  # starts the JVM's compiler and the Python workers
        timed(spark, name)
    made = {name: round(timed(spark, name), 3) for name in KEPT}
    times = {name: round(statistics.median(timed(spark, name) for _ in range(3)), 3) for name in HEADLINE}
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "made_once": made, "sf": float(os.path.basename(SF.rstrip("/")).removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
