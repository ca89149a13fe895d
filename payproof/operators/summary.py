"""Pay summary of a month, its totals, and the self-check of the totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payproof.functions.money import as_money, sum_when
from payproof.operators.employees import resum, sums_by_employee
from payproof.params import (
    ADVANCE,
    GARNISHMENT,
    HEALTH,
    NON_TAXABLE,
    OTHER_DEDUCTION,
    PENSION,
    TAX,
    TAXABLE,
    UNION,
    RunParams,
)
from payproof.sources.payroll import to_date

EARNINGS = ("taxable", "non_taxable")
WITHHELD = ("pension", "health", "union_dues", "advances", "garnishments", "other", "income_tax")


def pay_summary(classified: DataFrame, identities: DataFrame, p: RunParams) -> DataFrame:
    """Earnings, deductions and net pay per employee in the month."""
    category, subcategory = F.col("category"), F.col("subcategory")
    sums = sums_by_employee(
        classified.where(to_date(p) & (F.col("month") == p.month)),
        {
            "taxable": sum_when(category == TAXABLE, "earning"),
            "non_taxable": sum_when(category == NON_TAXABLE, "earning"),
            "pension": sum_when(subcategory == PENSION, "deduction"),
            "health": sum_when(subcategory == HEALTH, "deduction"),
            "union_dues": sum_when(subcategory == UNION, "deduction"),
            "advances": sum_when(subcategory == ADVANCE, "deduction"),
            "garnishments": sum_when(subcategory == GARNISHMENT, "deduction"),
            "other": sum_when(subcategory == OTHER_DEDUCTION, "deduction"),
            "income_tax": sum_when(F.col("tax_class") == TAX, "deduction"),
        },
    )
    keys = ("employee_id", "tax_id", "surname", "name")
    whole = resum(sums.join(identities, "employee_id"), keys, EARNINGS + WITHHELD)
    net = F.col("taxable") + F.col("non_taxable")
    for name in WITHHELD:
        net = net - F.col(name)
    return whole.withColumn("net", net).select(
        "tax_id", "surname", "name", *(as_money(F.col(name)).alias(name) for name in EARNINGS + WITHHELD + ("net",))
    )


def pay_summary_totals(summary: DataFrame) -> DataFrame:
    """Grand totals of the pay summary: one row."""
    return summary.agg(
        *(as_money(F.sum(name), 24).alias(name) for name in EARNINGS + WITHHELD + ("net",))
    )


def totals_running_balance(totals: DataFrame) -> DataFrame:
    """The totals as rows with a running balance: earnings add, deductions and net pay take away.

    The balance after net pay must be 0. The ten rows are built from the one totals row in place.
    """
    running = F.lit(0).cast("decimal(24,2)")
    rows = []
    for ord_, name in enumerate(EARNINGS + WITHHELD + ("net",), start=1):
        running = running + F.col(name) if name in EARNINGS else running - F.col(name)
        balance = as_money(running, 24)
        status = F.when(balance == 0, "match").otherwise("difference") if name == "net" else F.lit(None)
        rows.append(
            F.struct(
                F.lit(ord_).alias("ord"),
                F.lit(name).alias("concept"),
                F.col(name).alias("amount"),
                balance.alias("running"),
                status.cast("string").alias("status"),
            )
        )
    return totals.select(F.inline(F.array(*rows)))
