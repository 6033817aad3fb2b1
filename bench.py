"""Time every registered query: one JSON line on standard output.

Each query runs once to warm up and then several times; the median counts.
Streaming queries write a new table on every run, so they are timed fewer times,
and include creating their input.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from clickloom.plans.registered import QUERIES
from clickloom.session import build_session
from clickloom.sources.fixtures import fixture_events
from clickloom.sources.messages import encode
from clickloom.sources.scratch import fresh_folder
from clickloom.sources.streams import read_message_files
from clickloom.streaming.pipeline import start_ingest

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
STREAM_RUNS = 1
STREAMS = {
    "ingest_stream", "quarantine_stream", "recovery_stream", "batch_counts", "rate_capped_ingest",
    "dedup_stream", "table_by_name", "folded_month", "live_minutes", "running_funnel", "final_minutes",
    "journey_funnel", "unique_ingest", "progress_table", "offset_audit", "user_layout_summaries", "user_layout_events",
}
# Several batches with state each: run once, without a run to warm up.
LONG = {"final_minutes", "journey_funnel", "unique_ingest"}


def writes(name: str) -> bool:
    """Whether a query first writes a table or runs a stream."""
    return name in STREAMS


def drain(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def median_seconds(run, times: int, warm: bool = True) -> float:
    if warm:
        run()
    taken = []
    for _ in range(times):
        start = time.perf_counter()
        run()
        taken.append(time.perf_counter() - start)
    return statistics.median(taken)


def ingest_rate(spark) -> float:
    """Rows per second from message files into the table."""
    source = fresh_folder(spark, "bench")
    events = fixture_events(spark, SF_DIR, whole_seconds=False)
    encode(events).repartition(int(CPUS)).write.text(source)
    rows = events.count()

    def run() -> None:
        folder = fresh_folder(spark, "bench")
        start_ingest(
            read_message_files(spark, source), f"{folder}/table", f"{folder}/checkpoint", every=None
        ).awaitTermination()

    return rows / median_seconds(run, 3)


def main() -> None:
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{CPUS}]",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {
        name: round(
            median_seconds(
                lambda: drain(query(spark, SF_DIR)), STREAM_RUNS if writes(name) else RUNS, name not in LONG
            ), 4
        )
        for name, query in QUERIES.items()
    }
    result = {
        "metric": "sum of median query times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "ingest_rows_per_sec": round(ingest_rate(spark)),
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
