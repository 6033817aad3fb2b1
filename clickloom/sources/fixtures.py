"""The driver's tables seen as events.

``events.parquet`` supplies the rows and ``part.parquet`` the product
categories; FIXTURES.md gives the mapping.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.times import use_utc


RAW_EVENTS_DDL = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
RAW_PARTS_DDL = "p_partkey BIGINT, p_type STRING"


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows as they are. The schema is given, which saves the job that would infer it."""
    return use_utc(spark).read.schema(RAW_EVENTS_DDL).parquet(f"{sf_dir}/events.parquet")


def latest_second(spark: SparkSession, sf_dir: str, before: datetime | None = None) -> datetime:
    """The time of the newest event in whole seconds, the ``as_of`` of a replay; or of the newest ``before`` a time."""
    events = raw_events(spark, sf_dir)
    if before is not None:
        events = events.where(F.col("ts") < F.lit(before).cast("timestamp_ntz"))
    newest = events.agg(F.max("ts")).first()[0]
    return newest.replace(microsecond=0)


def bind_columns(raw: DataFrame, categories: DataFrame | None, whole_seconds: bool = True) -> DataFrame:
    """Event columns from raw rows; without ``categories`` the category is empty."""
    bound, category = raw, "''"
    if categories is not None:
        # No broadcast hint: the planner broadcasts this side while its size
        # allows, and otherwise merge-joins, splitting hot keys at run time.
        dim = categories.selectExpr("p_partkey", "lower(p_type) AS p_type")
        bound = raw.join(dim, F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT) = p_partkey"), "left")
        category = "coalesce(p_type, '')"
    time = "CAST(date_trunc('second', ts) AS TIMESTAMP_NTZ)" if whole_seconds else "ts"
    return bound.selectExpr(
        "CAST(event_id AS STRING) AS event_id",
        "event_type",
        "concat('u_', user_id) AS user_id",
        "concat('p_', get_json_object(props, '$.k')) AS product_id",
        "value AS price",
        f"{time} AS timestamp",
        f"{category} AS category",
        "'' AS ip_address",
    )


def fixture_events(
    spark: SparkSession,
    sf_dir: str,
    reachable: Column | None = None,
    with_category: bool = True,
    whole_seconds: bool = True,
    merged: bool = False,
) -> DataFrame:
    """The events table. ``reachable`` is a condition on the raw columns for the scan to use.

    With ``merged`` the categories are never broadcast, however few. The condition must hold for every row the caller's operator keeps. For a window that
    is ``ts >= start``, as a truncated time is never later than the raw one.
    """
    raw = raw_events(spark, sf_dir)
    if reachable is not None:
        raw = raw.where(reachable)
    categories = None
    if with_category:
        categories = spark.read.schema(RAW_PARTS_DDL).parquet(f"{sf_dir}/part.parquet")
        categories = categories.hint("merge") if merged else categories
    return bind_columns(raw, categories, whole_seconds)
