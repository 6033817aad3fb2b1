"""Column expressions shared by the operators.

Written as SQL text where they only concern named columns: building a Column
piece by piece costs a call into the JVM per piece, which adds up for short
queries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.vocabulary import PURCHASE, STAGE_COLUMNS


def count_of(event_type: str) -> Column:
    return F.count_if(F.col("event_type") == F.lit(event_type))


def stage_counts() -> list[Column]:
    return [F.expr(f"count_if(event_type = '{stage}') AS {name}") for name, stage in STAGE_COLUMNS.items()]


def money_parts(amount: str) -> dict[str, str]:
    """SQL aggregates, by name, whose totals can be added up over any grouping and read by ``money_total``.

    A plain double sum depends on the order in which tasks finish. Here each
    amount is taken apart into whole numbers, whose sums do not: its cents, and
    what is left of it in units of 2**-62, which is nothing for two-decimal
    amounts; each in two parts, so that no sum overflows. From 4e13 on, where cents
    are no longer exact, amounts are added as decimals; only from 1e30 on, and
    for NaN and infinities, as doubles.
    """
    cents = f"CAST(CASE WHEN abs({amount}) < 4e13D THEN rint(({amount}) * 100) ELSE 0D END AS BIGINT)"
    rest = f"CAST(CASE WHEN abs({amount}) < 4e13D THEN rint((({amount}) - {cents} / 100D) * {2**62}D) ELSE 0D END AS BIGINT)"
    large = f"CASE WHEN abs({amount}) >= 4e13D AND abs({amount}) < 1e30D THEN {amount} END"
    return {
        "cents_high": f"sum({cents} div {2**20})", "cents_low": f"sum({cents} % {2**20})",
        "rest_high": f"sum({rest} div {2**24})", "rest_low": f"sum({rest} % {2**24})",
        "large": f"sum(CAST({large} AS DECIMAL(38, 2)))",
        "huge": f"sum(CASE WHEN abs({amount}) >= 1e30D THEN {amount} END)",
    }


def money_total(parts: dict[str, str]) -> Column:
    """The amount that the parts' totals, given as SQL by name, stand for; 0.0 when nothing was added."""
    return F.expr(
        f"coalesce(({parts['cents_high']} * {2**20}D + {parts['cents_low']}) / 100D"
        f" + ({parts['rest_high']} * {2**24}D + {parts['rest_low']}) / {2**62}D"
        f" + coalesce(CAST({parts['large']} AS DOUBLE), 0D)"
        f" + coalesce({parts['huge']}, 0D), 0D)"
    )


def money_sum(amount: str) -> Column:
    """Sum of a DOUBLE amount, given as a column name or SQL; 0.0 when there is nothing to add.

    The sum does not depend on task order; see ``money_parts``.
    """
    return money_total(money_parts(amount))


def purchase_revenue() -> Column:
    return money_sum(f"CASE WHEN event_type = '{PURCHASE}' THEN price END")


def ratio(part: str, whole: str) -> Column:
    """part / whole, and 0.0 where whole is zero."""
    return F.expr(f"CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE 0D END")


def percent(part: str, whole: str) -> Column:
    return ratio(f"100D * {part}", whole)


def round_cents(x: str) -> Column:
    """Round a double column to two places the way IEEE arithmetic means it.

    A value exactly half way goes to the even cent. Whether it *is* half way is
    decided on the binary value, not on its shortest decimal text, which is
    where this differs from ``bround``: 0.015 is stored slightly below half way
    and becomes 0.01, not 0.02.
    """
    # Split x into a high and a low half, so that each half times 100 is exact
    # and the sign of the distance to the half-way point is exact too.
    high = f"({x} * 134217729D - ({x} * 134217729D - {x}))"
    down = f"CAST(floor({x} * 100) AS DOUBLE)"
    past_half = f"(({high} * 100 - {down} - 0.5D) + ({x} - {high}) * 100)"
    # From 2**46 on doubles are further apart than cents.
    return F.expr(
        f"""CASE WHEN abs({x}) < {2**46}D THEN
                CASE WHEN {past_half} > 0 OR ({past_half} = 0 AND pmod({down}, 2D) = 1)
                     THEN {down} + 1 ELSE {down} END / 100D
            ELSE {x} END"""
    )
