"""Exact money arithmetic: decimals all the way, rounded half-up once, where a result is named."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from payproof.schemas import money

# Least common multiple of 1..12: a sum of n/12, n/11 ... n/1 shares stays a whole number of cents.
SHARE_UNIT = 27720


def as_money(col: Column, precision: int = 16) -> Column:
    return col.cast(money(precision))


def zero(precision: int = 16) -> Column:
    return F.lit(Decimal("0.00")).cast(money(precision))


def sum_when(condition: Column, amount: Column | str) -> Column:
    """Conditional sum of an amount of two decimals; 0 when no row qualifies.

    Added up as whole cents: a sum of decimals this wide would rewrite every buffer of the aggregate as a big
    number for every row. Overflow raises, as for decimals.
    """
    amount = F.col(amount) if isinstance(amount, str) else amount
    cents = (amount * F.lit(100)).cast("bigint")
    total = F.coalesce(F.sum(F.when(condition, cents)), F.lit(0))
    return as_money(total * F.lit(Decimal("0.01")), 24)


def weighted_sum_when(condition: Column, amount: Column) -> Column:
    """Conditional sum of amounts in shares, which would leave the range of whole cents."""
    return F.coalesce(F.sum(F.when(condition, amount)), F.lit(Decimal("0.00")))


def twelfth(col: Column, precision: int = 16) -> Column:
    return as_money(col / F.lit(Decimal(12)), precision)


def share_weight(month: Column, until: int) -> Column:
    """Part of an amount paid in ``month`` that is due by ``until`` when it is spread to December, in 1/SHARE_UNIT."""
    return (F.lit(SHARE_UNIT) / (F.lit(13) - month) * (F.lit(until + 1) - month)).cast("int")


def from_shares(weighted_sum: Column) -> Column:
    """Total of weighted amounts: summed first, divided once, rounded once."""
    return as_money(weighted_sum.cast(money(24)) / F.lit(Decimal(SHARE_UNIT)))


def at_most(amount: Column, limit: Column) -> Column:
    """``amount`` clamped from above. A null amount stays null, also against a null-skipping ``least``."""
    return F.when(amount > limit, limit).otherwise(amount)
