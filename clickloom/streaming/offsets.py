"""An audit of source offsets: which ranges of a topic were never stored, and which more than once.

The Kafka source is told to go on when messages are gone, so that nothing shows
that some are missing. Here each batch leaves the ranges of offsets it stored;
laid beside each other, they show gaps and overlaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.streaming.state import file_batch, read_filed

RANGES_DDL = "topic STRING, partition INT, first BIGINT, last BIGINT, times BIGINT"
# Offsets are first joined to ranges within blocks of so many, each a task's matter, then blocks with each other.
BLOCK = 4096


def ranges(messages: DataFrame) -> DataFrame:
    """(topic, partition, first, last, times): maximal ranges of offsets that came equally often."""
    block = F.floor(F.col("offset") / BLOCK)
    counted = messages.groupBy("topic", "partition", "offset").agg(F.count("*").alias("times"))
    within = W.partitionBy("topic", "partition", "block", "times").orderBy("offset")
    islands = counted.withColumn("block", block).withColumn("island", F.col("offset") - F.row_number().over(within))
    pieces = islands.groupBy("topic", "partition", "block", "times", "island").agg(
        F.min("offset").alias("first"), F.max("offset").alias("last")
    )
    return _joined(pieces.select("topic", "partition", "first", "last", "times"))


def _joined(pieces: DataFrame) -> DataFrame:
    """Pieces that follow each other without a gap and came equally often, as one range."""
    order = W.partitionBy("topic", "partition").orderBy("first")
    follows = (F.col("first") == F.lag("last").over(order) + 1) & (F.col("times") == F.lag("times").over(order))
    numbered = pieces.withColumn("begins", F.when(follows, 0).otherwise(1))
    numbered = numbered.withColumn("number", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("topic", "partition", "number", "times").agg(
        F.min("first").alias("first"), F.max("last").alias("last")
    ).select("topic", "partition", "first", "last", "times")


def file_ranges(messages: DataFrame, folder: str, query_id: str, batch_id: int) -> None:
    """Keep the offset ranges of one batch's messages, with columns topic, partition and offset."""
    found = ranges(messages.select("topic", F.col("partition").cast("int"), F.col("offset").cast("long")))
    file_batch(found, folder, query_id, batch_id)


def audit(spark: SparkSession, folder: str, query_id: str) -> DataFrame:
    """(topic, partition, kind, first, last, times): ranges lost, stored ``times`` 0, or doubled, more than once.

    Lost is what lies between the least and the greatest offset stored. Each
    range adds its times where it begins and takes them off where it ends; the
    running sum between two such places is how often these offsets were stored.
    """
    stored = read_filed(spark, folder, RANGES_DDL, query_id)
    edges = stored.select("topic", "partition", F.col("first").alias("at"), F.col("times").alias("change")).unionByName(
        stored.select("topic", "partition", (F.col("last") + 1).alias("at"), (-F.col("times")).alias("change"))
    )
    places = edges.groupBy("topic", "partition", "at").agg(F.sum("change").alias("change"))
    order = W.partitionBy("topic", "partition").orderBy("at")
    swept = places.select(
        "topic", "partition", F.col("at").alias("first"), (F.lead("at").over(order) - 1).alias("last"),
        F.sum("change").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("times"),
    )
    odd = _joined(swept.where("last IS NOT NULL AND times <> 1"))
    kind = F.when(F.col("times") == 0, "lost").otherwise("doubled")
    return odd.select("topic", "partition", kind.alias("kind"), "first", "last", "times")
