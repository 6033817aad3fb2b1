"""Unbounded inputs. Each returns a streaming frame with a ``value`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TOPIC = "events"


def kafka_options(
    servers: str,
    topic: str = TOPIC,
    max_offsets_per_trigger: int | None = None,
    min_partitions: int | None = None,
) -> dict[str, str]:
    """Options of the Kafka source: from the earliest offset, tolerating lost data.

    ``max_offsets_per_trigger`` caps a micro-batch; ``min_partitions`` lets one
    large topic partition be read by several tasks.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
    }
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    return options


def read_kafka(spark: SparkSession, servers: str, **options) -> DataFrame:
    """Messages of a Kafka topic. Needs the spark-sql-kafka package on the cluster."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, **options)).load()


def read_message_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Messages from text files appearing under ``path``, one per line."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path)
