"""Derived views of already aggregated or limited results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.aggregates import ratio
from clickloom.vocabulary import PURCHASE, RANK_BY, one_of


def product_share(products: DataFrame, by: str = "revenue") -> DataFrame:
    """A ``top_products`` result with the metric ``by`` as a percentage of the best row's.

    The window has no partitions: its input is a top list, never the event table.
    """
    one_of("by", by, RANK_BY)
    with_best = products.withColumn("best", F.max(by).over(Window.partitionBy()))
    return with_best.withColumn("share_pct", F.least(ratio(by, "best") * 100, F.lit(100.0))).drop("best")


def category_share(categories: DataFrame) -> DataFrame:
    """A ``top_categories`` result with revenue as a percentage of the best category's.

    The best is a scalar subquery, which shares the aggregation's shuffle, so
    that the number of categories need not be small.
    """
    with_best = categories.withColumn("best", categories.agg(F.max("revenue")).scalar())
    return with_best.withColumn("share_pct", ratio("revenue", "best") * 100).drop("best")


def category_profile(categories: DataFrame) -> DataFrame:
    """The five measures a category is compared by."""
    return categories.select("category", "views", "purchases", F.col("cvr_pct").alias("cvr"), "revenue", "aov")


def cvr_band(cvr_pct: Column) -> Column:
    """Conversion in three bands: at least 3 is good, at least 1 fair, else poor."""
    return F.when(cvr_pct >= 3, "good").when(cvr_pct >= 1, "fair").otherwise("poor")


def page_info(page: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """First and last row number of a page, its size, and whether another page may follow."""
    size = page.agg(F.count("*").alias("row_count"))
    return size.select(
        F.lit(offset + 1).cast("bigint").alias("first_row"),
        (F.col("row_count") + F.lit(offset)).alias("last_row"),
        "row_count",
        (F.col("row_count") == F.lit(limit)).alias("has_next"),
    )


def shown_price(event_type: Column, price: Column) -> Column:
    """The price of a purchase; null for any other event."""
    return F.when(event_type == F.lit(PURCHASE), price)
