"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores (default 8). Every query
is run once to warm up and once timed, into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from siteferry.plans import registry
from siteferry.session import session

HEADLINE = (
    "cpu_summary",
    "capture_verdict",
    "cpu_notes",
    "baseline_diff",
    "diff_keys",
    "diff_rows",
    "secret_hits",
    "secret_summary",
    "redact_corpus",
    "dump_roundtrip_orders",
    "dump_roundtrip_lineitem",
    "dump_roundtrip_documents_mysql",
    "dump_files",
    "dump_bytes",
    "load_failures",
    "dump_classify",
    "render_values",
    "width_audit",
    "survey_fold",
    "findings",
    "config_findings",
    "probe_verdict",
    "status_record",
    "read_captures",
    "corpus_scan",
    "inventory_files",
    "copy_plan",
    "verify_backup",
    "missing_required",
    "gate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = session(
        "bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total of warm runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
