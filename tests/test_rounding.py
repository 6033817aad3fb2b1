"""Rounding and money sums against plain Python."""

import math
import random
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from clickloom.functions.aggregates import money_sum, round_cents


def rounded(spark, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, x DOUBLE")
    return [r.y for r in frame.select("i", round_cents("x").alias("y")).orderBy("i").collect()]


def test_ties(spark):
    values = [3.125, 0.375, 0.015, 1.005, 2.675, 0.125, 100.0 * 3 / 20000, -0.015, -3.125, 0.0, 12.5]
    assert rounded(spark, values) == [round(v, 2) for v in values]
    assert rounded(spark, [3.125, 0.015]) == [3.12, 0.01]


def test_every_small_percentage(spark):
    values = [100.0 * n / d for d in range(1, 260) for n in range(0, 2 * d + 1)]
    values += [n / 200 for n in range(200_000)]
    assert rounded(spark, values) == [round(v, 2) for v in values]


def test_special_values(spark):
    got = rounded(spark, [None, math.inf, -math.inf, math.nan, 1e300, 2.0**46 + 0.25])
    assert got[0] is None and got[1] == math.inf and got[2] == -math.inf and math.isnan(got[3])
    assert got[4:] == [1e300, round(2.0**46 + 0.25, 2)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-7e13, max_value=7e13), min_size=1, max_size=200))
def test_any_double(spark, values):
    assert rounded(spark, values) == [round(v, 2) for v in values]


def total(spark, values, parts=4):
    frame = spark.createDataFrame([(v,) for v in values], "x DOUBLE").repartition(parts)
    return frame.agg(money_sum("x").alias("t")).first().t


def test_money_is_exact_in_any_order(spark):
    rng = random.Random(3)
    cents = [rng.randrange(1, 250_000) for _ in range(20_000)]
    wanted = float(Decimal(sum(cents)) / 100)
    values = [c / 100 for c in cents]
    assert total(spark, values) == wanted
    assert total(spark, values[::-1], 7) == wanted


def test_numbers_that_are_not_money_still_count(spark):
    assert total(spark, [0.001, 0.002, 1.25]) == 1.253
    assert total(spark, [2e6, 1e15, 0.5]) == 1e15 + 2e6 + 0.5
    assert math.isnan(total(spark, [1.0, math.nan]))
    assert total(spark, [1.0, math.inf]) == math.inf
    assert total(spark, [None, None]) == 0.0
    assert total(spark, [None, 1.5]) == 1.5


def test_money_does_not_depend_on_order(spark):
    import random

    rng = random.Random(4)
    amounts = [rng.uniform(1e6, 1e7) for _ in range(3000)] + [rng.uniform(0, 1) for _ in range(500)] + [3e14 + 0.25, -2e13]
    sums = set()
    for _ in range(4):
        rng.shuffle(amounts)
        frame = spark.createDataFrame([(x,) for x in amounts], "x double").repartition(3)
        sums.add(frame.agg(money_sum("x")).first()[0])
    assert len(sums) == 1 and abs(sums.pop() - math.fsum(amounts)) < 1e-2


def test_money_beyond_numbers(spark):
    for odd, wanted in ((float("inf"), float("inf")), (1e300, 1e300)):
        assert spark.createDataFrame([(odd,), (1.0,), (None,)], "x double").agg(money_sum("x")).first()[0] == wanted
    assert math.isnan(spark.createDataFrame([(math.nan,), (1.0,)], "x double").agg(money_sum("x")).first()[0])
