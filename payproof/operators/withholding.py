"""Pension and health-plan withholding of a month against what it should be."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payproof.functions.bounds import with_row
from payproof.functions.money import as_money, at_most, sum_when
from payproof.operators.employees import resum, sums_by_employee
from payproof.operators.limits import single_cap
from payproof.params import (
    HEALTH,
    HEALTH_RATE,
    NON_TAXABLE,
    PENSION,
    PENSION_RATE,
    PENSIONER_HEALTH_RATE,
    PENSIONER_PENSION_RATE,
    SAC,
    STATUS_TOLERANCE,
    TAXABLE,
    UNION,
    RunParams,
)
from payproof.sources.payroll import to_date

SUMS = ("pension", "health", "union_dues", "pay", "sac", "non_taxable")
PROFILE = ("pensioner", "agreement", "health_plan", "union_name", "union_member")
# Half a cap of odd cents has three decimals; the base is not rounded before the rates apply.
BASE = T.DecimalType(17, 3)

REPORT = (
    "tax_id", "surname", "name", "base", "pension_ctrl", "health_ctrl", "pension", "health", "union_dues",
    "pay", "sac", "non_taxable", "pensioner", "agreement", "health_plan", "union_name", "union_member",
)


def half(amount: Column) -> Column:
    return (amount * F.lit(Decimal("0.5"))).cast(BASE)


def withholding_base(
    classified: DataFrame, identities: DataFrame, profiles: DataFrame, caps: DataFrame, p: RunParams
) -> DataFrame:
    """Month sums per employee, and the contribution base: pay between floor and cap, 13th salary up to half the cap."""
    category, subcategory = F.col("category"), F.col("subcategory")
    sums = sums_by_employee(
        classified.where(to_date(p) & (F.col("month") == p.month)),
        {
            "pension": sum_when(subcategory == PENSION, "deduction"),
            "health": sum_when(subcategory == HEALTH, "deduction"),
            "union_dues": sum_when(subcategory == UNION, "deduction"),
            "pay": sum_when((category == TAXABLE) & (subcategory != SAC), "earning"),
            "sac": sum_when(subcategory == SAC, "earning"),
            "non_taxable": sum_when(category == NON_TAXABLE, "earning"),
        },
    )
    joined = sums.join(identities, "employee_id").join(profiles, "employee_id")
    whole = resum(joined, ("employee_id", "tax_id", "surname", "name", *PROFILE), SUMS)
    pay, cap, floor = F.col("pay"), F.col("limits.cap"), F.col("limits.floor")
    clamped = F.when(pay > cap, cap).when(pay < floor, floor).otherwise(pay)
    return with_row(whole, "limits", single_cap(caps)).select(
        "tax_id",
        "surname",
        "name",
        *(as_money(F.col(name)).alias(name) for name in SUMS),
        *PROFILE,
        (clamped + at_most(F.col("sac"), half(cap))).cast(BASE).alias("base"),
    )


def withholding_control(base: DataFrame, caps: DataFrame) -> DataFrame:
    """What should have been withheld minus what was: positive is too little, negative too much."""
    pension_rate = F.when(~F.col("pensioner"), PENSION_RATE).otherwise(PENSIONER_PENSION_RATE)
    health_rate = F.when(~F.col("pensioner"), HEALTH_RATE).otherwise(PENSIONER_HEALTH_RATE)
    minimum = F.col("limits.floor") * F.lit(2)
    health_due = F.when(F.col("base") < minimum, minimum * F.lit(HEALTH_RATE)).otherwise(
        F.col("base") * health_rate
    )
    return (
        with_row(base, "limits", single_cap(caps))
        .withColumn("pension_ctrl", as_money(F.col("base") * pension_rate - F.col("pension"), 10))
        .withColumn("health_ctrl", as_money(health_due - F.col("health"), 10))
        .select(*REPORT)
        .distinct()
        .withColumn("health_plan", F.substring("health_plan", 1, 6))  # shown short, but told apart in full
    )


def order_control(control: DataFrame) -> DataFrame:
    """Report order: what needs attention first. The tax id only breaks ties."""
    pension, health = F.col("pension_ctrl"), F.col("health_ctrl")
    return control.orderBy(
        F.when((pension != 0) & (health == 0), 1).otherwise(0),
        pension.desc_nulls_last(),
        health.desc_nulls_last(),
        F.asc_nulls_last("surname"),
        F.asc_nulls_last("name"),
        "tax_id",
    )


def _status(control: Column) -> Column:
    return (
        F.when(control == 0, "match")
        .when(control <= STATUS_TOLERANCE, "refund")
        .when(control >= STATUS_TOLERANCE, "difference")
    )


def control_status(control: DataFrame) -> DataFrame:
    """Each control amount with its verdict; the first rule that fits wins."""
    return control.withColumns(
        {
            "pension_status": _status(F.col("pension_ctrl")),
            "health_status": _status(F.col("health_ctrl")),
        }
    )


def control_reference_values(caps: DataFrame) -> DataFrame:
    """The limits printed next to the control: one row."""
    return single_cap(caps).select(
        "cap",
        "floor",
        half(F.round("cap", 2)).alias("sac_cap"),
        as_money(F.round("floor", 2) * F.lit(2), 12).alias("health_minimum"),
    )
