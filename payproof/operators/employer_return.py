"""Taxable bases of the employer's monthly return."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payproof.functions.bounds import with_row
from payproof.functions.money import as_money, at_most, sum_when
from payproof.operators.employees import resum, sums_by_employee
from payproof.operators.limits import single_cap
from payproof.operators.withholding import half
from payproof.params import NON_TAXABLE, SAC, TAXABLE, RunParams
from payproof.sources.payroll import to_date


def f931_bases(classified: DataFrame, identities: DataFrame, caps: DataFrame, p: RunParams) -> DataFrame:
    """Bases R1 to R10 per employee settled this year; zeros for those idle in the month."""
    in_month = F.col("month") == p.month
    taxable = in_month & (F.col("category") == TAXABLE)
    sums = sums_by_employee(
        classified.where(to_date(p)),
        {
            "pay": sum_when(taxable & (F.col("subcategory") != SAC), "earning"),
            "sac": sum_when(taxable & (F.col("subcategory") == SAC), "earning"),
            "flagged": sum_when(in_month & F.col("r9"), "earning"),
            "non_taxable": sum_when(in_month & (F.col("category") == NON_TAXABLE), "earning"),
            "total": sum_when(in_month, "earning"),
        },
    )
    whole = resum(
        sums.join(identities, "employee_id"),
        ("tax_id", "surname", "name"),
        ("pay", "sac", "flagged", "non_taxable", "total"),
    )
    cap = F.col("limits.cap")
    capped = as_money(at_most(F.col("pay"), cap) + at_most(F.col("sac"), half(cap)))
    uncapped = as_money(F.col("pay") + F.col("sac"))
    none = F.lit(Decimal("0")).cast(T.DecimalType(2, 2))
    return with_row(whole, "limits", single_cap(caps)).select(
        "tax_id",
        "surname",
        "name",
        capped.alias("r1"),
        uncapped.alias("r2"),
        uncapped.alias("r3"),
        capped.alias("r4"),
        none.alias("r6"),
        none.alias("r7"),
        uncapped.alias("r8"),
        as_money(F.col("flagged")).alias("r9"),
        as_money(uncapped - F.lit(p.r10_allowance)).alias("r10"),
        as_money(F.col("non_taxable")).alias("non_taxable"),
        as_money(F.col("total")).alias("total"),
    )
