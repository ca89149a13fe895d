"""Year-to-date income-tax control."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payproof.functions.bounds import interval_of, only_match, with_intervals, with_sheet
from payproof.functions.money import as_money, from_shares, share_weight, sum_when, twelfth, weighted_sum_when, zero
from payproof.operators.deductions import (
    GROUP,
    GROUP_BEFORE_NET_GAIN,
    capped_deductions,
    declared,
    deduction_group,
)
from payproof.operators.employees import resum, sums_by_employee
from payproof.params import (
    ACTIVE,
    DEDUCTION_CODES,
    EXEMPT,
    IRREGULAR,
    LEAVER,
    PERCENT,
    REGULAR,
    SAC,
    SAC_ANNUAL,
    SOCIAL_CLASSES,
    TAX,
    RunParams,
)
from payproof.sources.payroll import of_type, to_date

# Brackets of the scale of a month and of December together; more fail the run.
BRACKETS = 1000

DEDUCTIONS = tuple(DEDUCTION_CODES.values())
PAY_PARTS = ("regular_h1", "regular_h2", "irregular_h1", "irregular_h2", "sac_h1", "sac_h2")

BASE = (
    "tax_id", "surname", "name", "month", "status", "regular_h1", "regular_h2", "irregular_h1",
    "irregular_h2", "exempt", "sac_h1", "sac_h2", "social_deductions", "tax_withheld",
)

NET_GAIN = (
    "tax_id", "surname", "name", "month", "status", "regular_h1", "regular_h2", "irregular_h1",
    "irregular_h2", "exempt", "sac_h1", "sac_h2", "pay_total", "gni", "special", "dependants", "twelfth",
    "social_deductions", *DEDUCTIONS, "net_gain_limit", "taxable_gain", "tax_withheld",
)

# Report order: the balance first.
REPORT = (
    "balance", "tax_id", "surname", "name", "month", "status", "regular_h1", "regular_h2", "irregular_h1",
    "irregular_h2", "exempt", "sac_h1", "sac_h2", "pay_total", "gni", "special", "social_deductions",
    "dependants", "twelfth", *DEDUCTIONS, "net_gain_limit", "taxable_gain", "fixed", "rate", "excess",
    "variable", "tax_due", "tax_withheld",
)


def _status(p: RunParams):
    """The month of the end date decides; its year is not looked at."""
    return F.when(F.month("end_date") == p.month, LEAVER).otherwise(ACTIVE)


def taxable_pay_base(
    classified: DataFrame,
    identities: DataFrame,
    profiles: DataFrame,
    p: RunParams,
    watch: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Pay by semester, social deductions and tax already withheld, from January to the month of the run.

    ``watch`` is given the joined rows, one for each employee, tax id and attribute row.
    """
    month, tax_class = F.col("month"), F.col("tax_class")
    h1, h2 = month.between(1, 6), month.between(7, 12)

    irregular = tax_class == IRREGULAR
    if p.prorate_irregular:
        shares = F.col("earning") * share_weight(month, p.month)
        irregular_h1, irregular_h2 = (weighted_sum_when(h & irregular, shares) for h in (h1, h2))
    else:
        irregular_h1, irregular_h2 = (sum_when(h & irregular, "earning") for h in (h1, h2))

    sums = sums_by_employee(
        classified.where(to_date(p)),
        {
            "regular_h1": sum_when(h1 & (tax_class == REGULAR), "earning"),
            "regular_h2": sum_when(h2 & (tax_class == REGULAR), "earning"),
            "irregular_h1": irregular_h1,
            "irregular_h2": irregular_h2,
            "exempt": sum_when(tax_class == EXEMPT, "earning"),
            "sac_h1": sum_when(h1 & (tax_class == SAC), "earning"),
            "sac_h2": sum_when(h2 & (tax_class == SAC), "earning"),
            "social_deductions": sum_when(tax_class.isin(*SOCIAL_CLASSES), "deduction"),
            "tax_withheld": sum_when(tax_class == TAX, "deduction"),
        },
    )
    measures = [*PAY_PARTS, "exempt", "social_deductions", "tax_withheld"]
    joined = sums.join(identities, "employee_id").join(profiles, "employee_id")
    whole = resum(joined, ("employee_id", "tax_id", "surname", "name", "end_date"), measures, watch)

    final = {name: as_money(F.col(name)) for name in measures}
    if p.prorate_irregular:
        final["irregular_h1"] = from_shares(F.col("irregular_h1"))
        final["irregular_h2"] = from_shares(F.col("irregular_h2")) if p.month >= 7 else zero()
    whole = whole.withColumns(final)
    if p.sac_is_estimated:
        whole = whole.withColumns(
            {
                "sac_h1": twelfth(F.col("regular_h1") + F.col("irregular_h1")),
                "sac_h2": twelfth(F.col("regular_h2") + F.col("irregular_h2")),
            }
        )
    return whole.withColumns({"month": F.lit(p.month), "status": _status(p)}).select(*BASE)


def taxable_pay_base_by_month(
    classified: DataFrame, identities: DataFrame, profiles: DataFrame, p: RunParams
) -> DataFrame:
    """``taxable_pay_base`` of every month of the year, from one pass over its lines.

    Lines are summed by employee and month; running sums over an employee's months give the base of each. The part of an
    irregular amount that is due by a month is linear in it, so two running sums give it for all: with U shares a year, an
    amount e of month m has U / (13 - m) * (M + 1 - m) * e due by M. An employee stands in a month if there are lines up to it.
    """
    tax_class, month = F.col("tax_class"), F.col("month")
    halves = {"h1": month.between(1, 6), "h2": month.between(7, 12)}
    share = F.col("earning") * share_weight(month, month)  # U / (13 - m)
    sums: dict[str, Column] = {}
    for half, inside in halves.items():
        irregular = inside & (tax_class == IRREGULAR)
        sums[f"regular_{half}"] = sum_when(inside & (tax_class == REGULAR), "earning")
        sums[f"irregular_{half}"] = sum_when(irregular, "earning")
        sums[f"sac_{half}"] = sum_when(inside & (tax_class == SAC), "earning")
        sums[f"share_{half}"] = weighted_sum_when(irregular, share)
        sums[f"begun_{half}"] = weighted_sum_when(irregular, share * month)
    sums["exempt"] = sum_when(tax_class == EXEMPT, "earning")
    sums["social_deductions"] = sum_when(tax_class.isin(*SOCIAL_CLASSES), "deduction")
    sums["tax_withheld"] = sum_when(tax_class == TAX, "deduction")

    of_year = classified.where(of_type(p) & (F.col("year") == p.year))
    monthly = of_year.groupBy("employee_id", "month").agg(*(col.alias(name) for name, col in sums.items()))
    by_month = Window.partitionBy("employee_id").orderBy("month")
    so_far = by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = monthly.select(
        "employee_id",
        "month",
        (F.lead("month", 1, 13).over(by_month) - 1).alias("until"),
        *(F.sum(name).over(so_far).alias(name) for name in sums),
    )
    joined = running.join(identities, "employee_id").join(profiles, "employee_id")
    whole = resum(joined, ("employee_id", "tax_id", "surname", "name", "end_date", "month", "until"), list(sums))
    # What holds from a month with lines to the next one stands for every month between.
    each = whole.withColumn("month", F.explode(F.sequence("month", "until")))

    for half in halves:
        due = (month + 1) * F.col(f"share_{half}") - F.col(f"begun_{half}")
        irregular = from_shares(due) if p.prorate_irregular else as_money(F.col(f"irregular_{half}"))
        each = each.withColumns({f"irregular_{half}": irregular, f"regular_{half}": as_money(F.col(f"regular_{half}"))})
        estimated = F.lit(True) if p.sac_mode == SAC_ANNUAL else month < 6
        estimate = twelfth(F.col(f"regular_{half}") + F.col(f"irregular_{half}"))
        each = each.withColumn(f"sac_{half}", F.when(estimated, estimate).otherwise(as_money(F.col(f"sac_{half}"))))
    whole_amounts = {name: as_money(F.col(name)) for name in ("exempt", "social_deductions", "tax_withheld")}
    leaves = F.when(F.month("end_date") == month, LEAVER).otherwise(ACTIVE)
    return each.withColumns(whole_amounts | {"status": leaves}).select(*BASE)


def _rows_by_status(sheet: DataFrame, p: RunParams) -> DataFrame:
    """The sheet rows an employee's status points to: the month's for active ones, December's for leavers."""
    month, kind = F.month("period"), F.col("type")
    status = F.when((month == p.month) & (kind == 0), ACTIVE).when(
        (month == 12) & (kind == p.leaver_type), LEAVER
    )
    of_year = sheet.where(F.year("period") == p.year).withColumn("status", status)
    return of_year.where(F.col("status").isNotNull())


def match_personal_deductions(base: DataFrame, personal: DataFrame, p: RunParams) -> DataFrame:
    """Allowances of the employee's status; null where the sheet has no row."""
    rows = _rows_by_status(personal, p).select("status", "gni", "special")
    row = only_match(F.col("allowances"), lambda r: r["status"] == F.col("status"), "personal deductions")
    matched = with_sheet(base, "allowances", rows).withColumn("allowance", row)
    return matched.select(*base.columns, "allowance.gni", "allowance.special")


def attach_f572(base: DataFrame, declarations: DataFrame) -> DataFrame:
    """What was declared, by tax id without dashes; dependants 0 and the others null without a declaration."""
    amounts = declarations.select(
        F.col("tax_id").alias("plain_id"),
        "dependants",
        *(F.col(name).alias(declared(name)) for name in (*DEDUCTIONS, GROUP, GROUP_BEFORE_NET_GAIN)),
    )
    return (
        base.withColumn("plain_id", F.replace("tax_id", F.lit("-"), F.lit("")))
        .join(amounts, "plain_id", "left")
        .drop("plain_id")
        .withColumn("dependants", F.coalesce("dependants", zero(12)))
    )


def deduction_columns(
    base: DataFrame,
    personal: DataFrame,
    limits: DataFrame,
    declarations: DataFrame,
    p: RunParams,
) -> DataFrame:
    """The base with allowances, dependants, total pay, the extra twelfth and the limited deductions."""
    pay_total = sum((F.col(name) for name in PAY_PARTS[1:]), F.col(PAY_PARTS[0]))
    allowances = F.col("gni") + F.col("special") + F.col("dependants")
    attached = attach_f572(match_personal_deductions(base, personal, p), declarations).withColumns(
        {"pay_total": as_money(pay_total), "twelfth": twelfth(allowances, 12)}
    )
    return capped_deductions(attached, limits, p)


def taxable_net_gain(
    base: DataFrame,
    personal: DataFrame,
    limits: DataFrame,
    declarations: DataFrame,
    p: RunParams,
) -> DataFrame:
    """Net gain subject to the scale, floored at 0; null where the sheet has no allowances."""
    gain = (
        F.col("pay_total")
        - F.col("gni")
        - F.col("special")
        - F.col("social_deductions")
        - F.col("dependants")
        - F.col("twelfth")
        - deduction_group(p)
    )
    columns = deduction_columns(base, personal, limits, declarations, p)
    return (
        columns.withColumn("gain", as_money(gain))
        .withColumn("taxable_gain", F.when(F.col("gain") < 0, zero()).otherwise(F.col("gain")))
        .select(*NET_GAIN)
    )


def match_bracket(net_gain: DataFrame, brackets: DataFrame, p: RunParams) -> DataFrame:
    """The scale row with ``lower < gain <= upper`` for the employee's status; a gain of 0 has none.

    A scale whose brackets overlap fails the run.
    """
    rows = _rows_by_status(brackets, p).select("status", "lower", "upper", "fixed", "rate", "excess")
    indexed = with_intervals(net_gain, "scale", rows, "status", "lower", "upper", BRACKETS)
    matched = interval_of(indexed, "bracket", "scale", "status", "taxable_gain", "upper", BRACKETS)
    return matched.select(*net_gain.columns, "bracket.fixed", "bracket.rate", "bracket.excess")


def income_tax_control(net_gain: DataFrame, brackets: DataFrame, p: RunParams) -> DataFrame:
    """Tax due on the net gain minus tax withheld; no scale row, no tax."""
    matched = match_bracket(net_gain, brackets, p)
    rate = F.col("rate").cast("decimal(3,0)") * F.lit(PERCENT)
    variable = F.coalesce(as_money((F.col("taxable_gain") - F.col("excess")) * rate, 14), zero(14))
    return (
        matched.withColumn("variable", variable)
        .withColumn("tax_due", F.coalesce(as_money(F.col("fixed") + F.col("variable")), zero()))
        .withColumns(
            {
                "fixed": F.coalesce("fixed", zero(10)),
                "rate": F.coalesce("rate", F.lit(0)),
                "excess": F.coalesce("excess", zero(10)),
                "balance": as_money(F.col("tax_due") - F.col("tax_withheld")),
            }
        )
        .select(*REPORT)
    )
