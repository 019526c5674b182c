"""Time the headline queries and print one JSON line.

Each query runs once to warm up and once on the clock, every row computed and none kept. For
JSON ingest the throughput is added, the one figure that compares with published ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from catalog import QUERIES  # noqa: E402
from catalog.ingest import event_lines, scratch  # noqa: E402
from signalspark import build_session  # noqa: E402
from signalspark.sinks.files import write_noop  # noqa: E402
from signalspark.sources.jsonl import read_events_jsonl  # noqa: E402

HEADLINE = [
    "m1_dau",
    "m4_active_users_by",
    "m8_top_sessions_country",
    "m13_stickiness_dau_mau",
    "m18_event_property_breakdown",
    "m19_custom_event_metric",
    "m23_top_logs_service",
    "m29_dau_compared",
    "r9_latest_users",
    "r13_events_with_context",
    "s1_events_jsonl",
    "x2_filter_all",
    "x12_redact_scan",
    "x13_redact_text",
    "x15_pseudonym",
    "x18_pii_report",
    "x23_reduce_window",
    "x24_reduce_messages",
    "x28_template_logs",
    "x29_cluster",
    "x31_registry",
    "l6_tail_rate",
    "c2_revenue",
    "q6_sql_join",
]


def jsonl_throughput(spark, sf_dir: str, copies: int = 10) -> int:
    """Events per second from JSON-lines files to parsed rows; writing the files is off the clock."""
    path = scratch(spark, "jsonl")
    lines = event_lines(spark, sf_dir).select("value", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    lines.select("value").write.text(path)
    total, best = spark.read.text(path).count(), float("inf")
    for _ in range(3):
        began = time.perf_counter()
        write_noop(read_events_jsonl(spark, path, 0)[0])
        best = min(best, time.perf_counter() - began)
    return round(total / best)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            write_noop(QUERIES[name](spark, sf_dir))
            seconds[name] = round(time.perf_counter() - began, 3)
    ingest = jsonl_throughput(spark, sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "jsonl_events_per_sec": ingest,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
