"""Positions within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.llm.common import settle

# Of monotonically_increasing_id, the bits that number a partition's rows.
_ROW_BITS = 33


def ranked(rows: DataFrame, group: list[str], order: list[str], purpose: str) -> DataFrame:
    """The rows with ``idx``, their place from 0 in their group, and ``n``, the group's size.

    Rows are dealt by ranges of (group, order) and numbered where they land, so
    a group may span any number of tasks; how many rows of a group lie in
    earlier ranges is summed over a table of one row per group and range. Nulls
    come first. Rows equal in ``order`` are told apart by a number stored with
    them, so that a task run again numbers them as before.
    """
    rows = settle(rows.withColumn("_serial", F.monotonically_increasing_id()), purpose)
    keys = [*group, *order, "_serial"]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = placed.withColumn("_place", F.monotonically_increasing_id()).withColumns(
        {"_part": F.shiftright("_place", _ROW_BITS), "_at": F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}
    )
    placed = settle(placed.drop("_serial", "_place"), f"{purpose}-placed")
    counts = placed.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_own"))
    whole = W.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(
        F.col("_part").alias("_of"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        (F.coalesce(F.sum("_own").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_own").over(whole).alias("n"),
    )
    same = F.col("_part") == F.col("_of")
    for i, column in enumerate(group):
        same = same & F.col(column).eqNullSafe(F.col(f"_g{i}"))
    joined = placed.join(settle(counts, f"{purpose}-ranges"), same)
    idx = (F.col("_at") + F.col("_shift")).alias("idx")
    return joined.select(*[c for c in placed.columns if c not in ("_part", "_at")], idx, "n")
