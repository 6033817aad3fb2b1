"""The ingest job for spark-submit: Kafka topic to event table, until stopped."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from clickloom.session import build_session
from clickloom.sources.streams import TOPIC, read_kafka
from clickloom.streaming.pipeline import TRIGGER, start_ingest
from clickloom.streaming.progress import ProgressTable


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--servers", required=True, help="Kafka bootstrap servers")
    parser.add_argument("--topic", default=TOPIC)
    parser.add_argument("--table", required=True, help="folder of the event table")
    parser.add_argument("--checkpoint", required=True, help="folder of this job's checkpoint")
    parser.add_argument("--every", default=TRIGGER, help="time between micro-batches; empty to work off what is there and stop")
    parser.add_argument("--max-offsets", type=int, help="messages per micro-batch at most")
    parser.add_argument("--min-partitions", type=int, help="tasks reading the topic at least")
    parser.add_argument("--unique-within", help='leave out copies of an event, e.g. "10 minutes"')
    parser.add_argument("--unique", action="store_true", help="leave out copies of any event stored before")
    parser.add_argument("--name", help="register the table under this name and keep it complete")
    parser.add_argument("--quarantine", help="folder for malformed messages")
    parser.add_argument("--rollup", help="folder of an hourly rollup")
    parser.add_argument("--offsets", help="folder for the ranges of offsets stored")
    parser.add_argument("--progress", help="folder for a report of each micro-batch")
    return parser.parse_args(argv)


def start(messages: DataFrame, options: argparse.Namespace) -> StreamingQuery:
    if options.progress is not None:
        ProgressTable(messages.sparkSession, options.progress).attach()
    return start_ingest(
        messages, options.table, options.checkpoint, options.every or None, unique_within=options.unique_within,
        name=options.name, quarantine=options.quarantine, rollup=options.rollup, unique=options.unique,
        offsets=options.offsets,
    )


def main(argv: list[str] | None = None) -> None:
    options = arguments(argv)
    logging.basicConfig(level=logging.INFO)
    messages = read_kafka(
        build_session("ingest"),
        options.servers,
        topic=options.topic,
        max_offsets_per_trigger=options.max_offsets,
        min_partitions=options.min_partitions,
    )
    start(messages, options).awaitTermination()


if __name__ == "__main__":
    main()
