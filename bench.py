"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each job is run once untimed (derived fixtures are materialized, the JVM warms
up), then timed ``$BENCH_REPEAT`` times (default 2); the median is reported.
A run forces full evaluation with the ``noop`` sink (nothing is collected).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "score_pages",        # flagship: pages -> text/links/contacts -> audit -> score
    "scrape_report",      # per-page scrape view over the rich page table
    "audit_seo",          # audit over the rich page table
    "extract_emails",     # contacts over documents
    "discover_channels",  # all discovery channels over the search hits
    "run_search",         # plan -> discover -> merge -> cap -> enrich -> score
    "upsert_leads",       # full outer join upsert by domain
    "lead_stats",         # dashboard aggregates
    "list_leads",         # filtered, sorted lead list
    "stream_enrich",      # Structured Streaming page pipeline
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    names = sys.argv[1:] or HEADLINE

    from leadlake.session import get_spark
    scratch = tempfile.mkdtemp(prefix="leadlake-bench-")
    spark = get_spark(master=f"local[{cpus}]", app="leadlake-bench", shuffle_partitions=max(8, cpus * 2),
                      extra={"spark.checkpoint.dir": scratch, "spark.driver.memory": "12g"})
    from leadlake.plans.jobs import JOBS

    def run(name: str) -> float:
        t0 = time.perf_counter()
        JOBS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    per: dict[str, float] = {}
    for n in names:
        run(n)  # warm-up: fixtures, code generation
        per[n] = round(statistics.median(run(n) for _ in range(repeat)), 3)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_jobs_total", "value": round(sum(per.values()), 3), "unit": "sec",
           "queries": per, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
