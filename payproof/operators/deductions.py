"""Deductions declared by the employee: dependants and general deductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payproof.functions.bounds import with_row
from payproof.functions.money import as_money, zero
from payproof.operators.limits import limit_name
from payproof.params import (
    ALLOWANCE_LIMITED,
    AMOUNT_LIMITED,
    CHILD,
    CHILD_CODES,
    DEDUCTION_CODES,
    DISABLED_CHILD,
    DISABLED_CHILD_CODES,
    LEAVER,
    LEAVER_ONLY,
    PERCENT,
    NET_GAIN_LIMITED,
    NET_GAIN_LIMIT_RATE,
    SPOUSE,
    SPOUSE_CODES,
    RunParams,
)


def _priced(dependants: DataFrame, allowances: DataFrame, p: RunParams) -> DataFrame:
    """``dependants`` with their class, whether they apply in the month, and their price; no class, no price."""
    kinship = F.col("kinship")
    kind = (
        F.when(kinship.isin(*SPOUSE_CODES), SPOUSE)
        .when(kinship.isin(*CHILD_CODES), CHILD)
        .when(kinship.isin(*DISABLED_CHILD_CODES), DISABLED_CHILD)
    )
    allowance = (
        F.when(F.col("kind") == SPOUSE, F.col("allowance.spouse"))
        .when(F.col("kind") == CHILD, F.col("allowance.child"))
        .when(F.col("kind") == DISABLED_CHILD, F.col("allowance.disabled_child"))
    )
    outside = ~F.lit(p.month).between(F.col("month_from"), F.col("month_to"))
    classified = dependants.withColumns({"kind": kind, "applies": F.when(outside, 0).otherwise(1)})
    price = allowance * F.col("pct") * F.lit(PERCENT) * F.col("applies")
    return with_row(classified, "allowance", allowances.select("spouse", "child", "disabled_child")).withColumn(
        "price", price.cast(T.DecimalType(18, 4))
    )


def dependant_deductions(dependants: DataFrame, allowances: DataFrame, p: RunParams) -> DataFrame:
    """Each dependant classified, tested against the month and priced; no class, no amount."""
    return _priced(dependants, allowances, p).select(
        "tax_id", "kinship", "kind", "applies", "pct", "month_from", "month_to", F.col("price").alias("amount")
    )


def dependant_totals(priced: DataFrame) -> DataFrame:
    """Deduction for dependants per employee."""
    return (
        priced.where(F.col("applies") == 1)
        .groupBy("tax_id")
        .agg(as_money(F.sum("amount"), 12).alias("amount"))
    )


# Signed sums of the declared amounts that the income tax takes off, next to the columns by code.
GROUP, GROUP_BEFORE_NET_GAIN = "group", "group_before_net_gain"


# The many sums and limits are SQL expressions: one call to the JVM each, where a column is built from a dozen.
def _total(cents: str, precision: int) -> str:
    """Conditional sum in whole cents as an amount, 0 without any; see ``sum_when``."""
    return f"CAST(CAST(coalesce(sum({cents}), 0) * 0.01BD AS DECIMAL(24,2)) AS DECIMAL({precision},2))"


CENTS = "CAST(amount * 100 AS BIGINT)"


def _sum_of(code: int) -> str:
    return _total(f"CASE WHEN code = {code} THEN {CENTS} END", 14)


def _signed_sum(codes: list[int]) -> str:
    """The first code minus the others."""
    others = ", ".join(str(code) for code in codes[1:])
    return _total(f"CASE WHEN code = {codes[0]} THEN {CENTS} WHEN code IN ({others}) THEN -{CENTS} END", 16)


def general_deductions_wide(deductions: DataFrame) -> DataFrame:
    """One column per deduction code; other codes are dropped.

    Conditional sums rather than ``pivot``: one aggregation, combined before the shuffle.
    """
    return deductions.groupBy("tax_id").agg(
        *(F.expr(f"{_sum_of(code)} AS {name}") for code, name in DEDUCTION_CODES.items())
    )


def declared_by_employee(entries: DataFrame, allowances: DataFrame, p: RunParams) -> DataFrame:
    """All an employee declared, in one row: the total for dependants, and the wide deductions with two groups of them.

    Null for dependants without any that apply, and for the deductions without any declared.

    The group is written "first - second - third ...", and the group as a whole is subtracted from the
    base. So only its first term lowers the base. Kept as the default reading.
    """
    before = [code for code in DEDUCTION_CODES if code not in NET_GAIN_LIMITED]
    sums = {DEDUCTION_CODES[code]: _sum_of(code) for code in DEDUCTION_CODES}
    sums |= {GROUP: _signed_sum(list(DEDUCTION_CODES)), GROUP_BEFORE_NET_GAIN: _signed_sum(before)}
    family = F.sum(F.when(F.col("applies") == 1, F.col("price")))
    return _priced(entries, allowances, p).groupBy("tax_id").agg(
        as_money(family, 12).alias("dependants"),
        *(F.expr(f"CASE WHEN count(code) > 0 THEN {total} END AS `{name}`") for name, total in sums.items()),
    )


def declared(name: str) -> str:
    """Column of the amount as declared, next to the limited one that carries the plain name."""
    return f"declared_{name}"


def _subtracted(group: str, codes: list[int], p: RunParams) -> Column:
    """What the codes take off the base: the declared group, or in the corrected reading all limited amounts."""
    if not p.corrected:
        return F.coalesce(declared(group), zero())
    total = F.col(DEDUCTION_CODES[codes[0]])
    for code in codes[1:]:
        total = total + F.col(DEDUCTION_CODES[code])
    return total.cast(T.DecimalType(20, 4))


def deduction_group(p: RunParams) -> Column:
    return _subtracted(GROUP, list(DEDUCTION_CODES), p)


def capped_deductions(base: DataFrame, limits: DataFrame, p: RunParams) -> DataFrame:
    """The declared deductions after their limits, and the net-gain limit itself.

    Needs ``pay_total``, ``social_deductions``, ``status`` and the ``declared_*`` columns. Deductions under
    the net-gain limit come last, as it depends on the others.
    """

    def granted(code: int, amount: str) -> str:
        return f"CASE WHEN status = '{LEAVER}' THEN {amount} ELSE 0.00BD END" if code in LEAVER_ONLY else amount

    def limited(amount: str, limit: str) -> str:
        """Clamped from above, 0 when not declared. Holds for negative limits too."""
        return f"CASE WHEN {amount} > {limit} THEN {limit} ELSE coalesce({amount}, 0.00BD) END"

    limited_codes = AMOUNT_LIMITED + ALLOWANCE_LIMITED
    first, last = {}, {}
    for code, name in DEDUCTION_CODES.items():
        amount = declared(name)
        if code in NET_GAIN_LIMITED:
            last[name] = F.expr(f"CAST({granted(code, limited(amount, 'net_gain_limit'))} AS DECIMAL(16,2))")
            continue
        given = limited(amount, f"limits.{limit_name(code)}") if code in limited_codes else f"coalesce({amount}, 0.00BD)"
        scale = 4 if code in ALLOWANCE_LIMITED else 2
        first[name] = F.expr(f"CAST({granted(code, given)} AS DECIMAL(16,{scale}))")

    before = [code for code in DEDUCTION_CODES if code not in NET_GAIN_LIMITED]
    subtracted = _subtracted(GROUP_BEFORE_NET_GAIN, before, p)
    net_gain = F.col("pay_total") - F.col("social_deductions") - subtracted
    net_gain_limit = as_money(net_gain * F.lit(NET_GAIN_LIMIT_RATE), 10)
    return (
        with_row(base, "limits", limits.select(*(limit_name(code) for code in limited_codes)))
        .withColumns(first)
        .withColumn("net_gain_limit", net_gain_limit)
        .withColumns(last)
        .drop("limits")
    )
