"""Wall time of the headline queries: one JSON line, warm runs, median of the repeats."""

import json
import os
import statistics
import time

from pagemill.plans import catalog
from pagemill.session import local_session

HEADLINE = (
    "tokenize", "build_documents", "score_candidates", "canonicalize_urls", "classify_addresses",
    "verify_blobs", "revalidate", "concurrency_audit", "redirect_chains", "mark_duplicates",
    "terminal_state", "upsert_facts", "content_dedup", "retained",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cpus)
    jobs = catalog.queries()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(repeats + 1):
            started = time.perf_counter()
            jobs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
