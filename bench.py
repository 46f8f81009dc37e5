"""Headline queries, timed: prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose the data and the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.compare import session  # noqa: E402
from inkveil.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "findings_redact", "findings_scan", "findings_strict", "redact_text_pipeline", "redact_document_pipeline",
    "verify_text_pipeline", "redaction_report", "count_per_category", "count_per_page", "lang_detect",
]


def run(fn, spark, sf_dir: str) -> float:
    started = time.time()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.time() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    run(QUERIES["findings_redact"], spark, sf_dir.rsplit("/", 1)[0] + "/sf0.001")  # start-up and code generation
    seconds = {name: run(QUERIES[name], spark, sf_dir) for name in HEADLINE}
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
