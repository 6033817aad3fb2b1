"""A key with half of all rows is split over tasks by every join that meets it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clickloom.llm import exact_dedup, graph, mixing, quality, repeated_phrases, simhash, warc

# Spark's own thresholds, scaled to small tables; no broadcast, which would need no split.
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.shuffle.partitions": "8",
}
ROWS = 12_000


@pytest.fixture
def small(spark):
    before = {key: spark.conf.get(key, None) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def half_alike(spark, words):
    own = F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.concat(F.lit("w"), (i * F.col("id")).cast("string")))
    common = " ".join(f"word{i}" for i in range(words))
    return spark.range(1, ROWS + 1).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, common).otherwise(F.array_join(own, " ")).alias("text"),
        F.lit("en").alias("lang"), F.when(F.col("id") % 2 == 0, "hot/a").otherwise(F.concat(F.lit("h"), "id")).alias("source"),
    )


def star(spark, hub):
    """A hub tied to half of all nodes, and pairs."""
    other = F.when(F.col("id") % 2 == 0, hub).otherwise(F.col("id") + 10 * ROWS)
    return spark.range(1, ROWS + 1).select(other.alias("a"), F.col("id").alias("b"))


def labels(spark):
    return spark.range(1, 200).select(
        F.col("id").alias("doc_id"), (F.col("id") % 3 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic")
    )


JOINS = {
    "exact dedup": lambda s: exact_dedup.verdicts(half_alike(s, 3)),
    "repeated phrases": lambda s: repeated_phrases._recurring(
        half_alike(s, 40).withColumn("k1", F.xxhash64("doc_id")), 35, 8, 200_000),
    "simhash": lambda s: simhash.near_duplicates(half_alike(s, 4)),
    "quality": lambda s: quality.assess(half_alike(s, 4), labels(s)),
    "archives": lambda s: warc.records(half_alike(s, 3).selectExpr("doc_id AS page_id", "'http://a/' AS url", "text AS html")),
    "mixing": lambda s: mixing.plan_mix(half_alike(s, 4)),
    "large star": lambda s: graph._large_star(star(s, 0)),
    "small star": lambda s: graph._small_star(star(s, 100 * ROWS)),
}


@pytest.mark.parametrize("name", JOINS)
def test_hot_key_is_split(small, name):
    frame = JOINS[name](small)
    frame.collect()
    assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
