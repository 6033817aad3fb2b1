"""Mix sources to target weights by repeating documents.

Words are summed per source with partial sums before the shuffle, targets
follow from the per-source table, and every document is emitted floor(rate)
times plus one copy by a coin seeded with its id. Only sums over sources reach
the driver, never a row per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import numbered, pick, restore, settle, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix"


def ranked_sources(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(source, source_size, weight): weights repeat over sources in code point order, null last.

    The rank comes from a range-partitioned sort and one count per partition.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = per_source.orderBy(F.asc_nulls_last("source"))
    schema = T.StructType([*ordered.schema.fields, T.StructField("weight", T.DoubleType())])
    weighed = ordered.rdd.zipWithIndex().map(lambda x: (*x[0], float(weights[x[1] % len(weights)])))
    return sizes.sparkSession.createDataFrame(weighed, schema)


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    All sources together get ``share`` of all sizes, by weight. No target passes
    ``most`` times its source's size; what is cut off is shared out again by
    weight among the others until none is above. Each round is one aggregate of
    the per-source table and fixes at least one more source.
    """
    table = settle(ranked_sources(sizes, weights), "sources")
    cap = F.col("source_size") * F.lit(most)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while total:
        over = F.col("weight") * F.lit(level) > cap
        cut, left, n = table.agg(
            F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)
        ).first()
        if n == before or not left:
            break
        level, before = (share * total - (cut or 0.0)) / left, n
    return table.select(
        "source", "source_size",
        F.when(F.col("weight") * F.lit(level) > cap, cap).otherwise(F.col("weight") * F.lit(level)).alias("target"),
    )


def coin(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan_mix(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken.

    ``size`` counts words, none for null text. A document without words takes
    part and takes nothing. Rows with the same id toss the same coin. A null
    source is a source of its own, the last in order.
    """
    rows = pick(docs, doc_id="doc_id", source="source", text="text")
    rows = settle(rows.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    goals = targets(rows, **settings).withColumnRenamed("source", "of_source")
    joined = rows.join(goals, F.col("source").eqNullSafe(F.col("of_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        joined.withColumn("rate", rate)
        .withColumn("copies", copies("rate", "doc_id"))
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def copies(rate: str, doc_id: str) -> Column:
    extra = coin(F.col(doc_id)) < F.col(rate) - F.floor(rate)
    return F.floor(rate) + F.when(extra, 1).otherwise(0)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents themselves: every column, each document as often as it is taken.

    Cases as in ``plan_mix``. Needs no shuffle of texts: documents meet only the
    table of rates per source.
    """
    sizes = pick(docs, source="source", text="text")
    sizes = settle(sizes.select("source", word_count(F.col("text")).alias("size")), "sizes")
    goals = targets(sizes, **settings).select(
        F.col("source").alias("of_source"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )
    rows, names = numbered(docs, doc_id="doc_id", source="source")
    joined = rows.join(goals, F.col("source").eqNullSafe(F.col("of_source")))
    taken = joined.withColumn("n", copies("rate", "doc_id").cast("int")).where("n > 0")
    return restore(taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))), names)
