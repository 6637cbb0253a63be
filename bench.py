"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.

The session is warmed up on the first query; each query is then timed whole, planning included
(the median of $BENCH_REPEATS runs, one by default).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from maskwright.plans import catalog  # noqa: E402
from maskwright.session import local_session  # noqa: E402

HEADLINE = (
    "document_spans", "record_spans", "redacted_documents", "leak_scan", "url_templates", "page_elements", "view_changes",
    "score_totals", "state_visits", "study_report", "floor_percentiles", "parsed_replies", "task_feed", "running_totals", "private_names",
    "fused_elements", "redacted_views", "word_chunks",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    seconds: dict[str, float] = {}
    catalog.QUERIES[names[0]](spark, folder).write.format("noop").mode("overwrite").save()
    for name in names:
        times = []
        for _ in range(repeats):
            start = time.time()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
