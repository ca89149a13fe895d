"""Payroll tables: periods, catalogue, settlement lines, employees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payproof.params import PENSIONER_CONDITION, TAX_ID_DOCUMENT, RunParams
from payproof.functions.money import zero
from payproof.schemas import money


def of_type(p: RunParams) -> Column:
    if p.settlement_type is None:
        return F.lit(True)
    return F.col("settlement_type") == p.settlement_type


def to_date(p: RunParams) -> Column:
    """January to the month of the run."""
    return of_type(p) & (F.col("year") == p.year) & (F.col("month") <= p.month)


def period_years(settlements: DataFrame, p: RunParams) -> DataFrame:
    """The five latest years with settlements, latest first."""
    years = settlements.where(of_type(p)).select("year").distinct()
    return years.orderBy(F.desc_nulls_last("year")).limit(5)


def period_months(settlements: DataFrame, p: RunParams) -> DataFrame:
    """The months of the year that have settlements, ascending."""
    of_year = settlements.where(of_type(p) & (F.col("year") == p.year))
    return of_year.select("month").distinct().orderBy(F.asc_nulls_last("month"))


def item_catalog(items: DataFrame) -> DataFrame:
    return items.select("item_id", "name")


def line_keys(lines: DataFrame) -> list[str]:
    """What lines and headers share: the number, and the type where each type numbers its own settlements."""
    return ["settlement_id"] + [name for name in ("settlement_type",) if name in lines.columns]


def joined_lines(settlements: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines with their header. Neither side carries a hint: both grow with the payroll, and Spark picks the
    join from their sizes and splits a settlement with very many lines at run time."""
    return settlements.join(lines, line_keys(lines)).select(
        "employee_id",
        "settlement_id",
        "kind",
        "settlement_type",
        "year",
        "month",
        "item_id",
        "quantity",
        F.coalesce(F.col("earning").cast(money(14)), zero(14)).alias("earning"),
        F.coalesce(F.col("deduction").cast(money(14)), zero(14)).alias("deduction"),
        "item_name",
    )


def period_lines(settlements: DataFrame, lines: DataFrame, p: RunParams) -> DataFrame:
    """Lines of the year up to the month of the run; the filter is applied to the headers before the join."""
    return joined_lines(settlements.where(to_date(p)), lines)


def identities(persons: DataFrame, documents: DataFrame) -> DataFrame:
    """Employees with their tax id; one row per tax-id document."""
    tax_ids = documents.where(F.col("document_type") == TAX_ID_DOCUMENT)
    return persons.join(tax_ids, "employee_id").select(
        "employee_id", "surname", "name", F.col("number").alias("tax_id")
    )


def settlement_lines(period: DataFrame, people: DataFrame) -> DataFrame:
    """Period lines with the employee's name and tax id."""
    return period.join(people, "employee_id").select(
        "employee_id",
        "surname",
        "name",
        "settlement_id",
        "kind",
        "item_id",
        "quantity",
        "earning",
        "deduction",
        "item_name",
        "month",
        "tax_id",
    )


def employee_profiles(
    labour: DataFrame, persons: DataFrame, items: DataFrame, agreements: DataFrame
) -> DataFrame:
    """Distinct labour attributes per employee, whether or not the employee was settled.

    The names of the health plan and the union live in the item catalogue.
    """
    plans = items.select(F.col("item_id").alias("health_item_id"), F.col("name").alias("health_plan"))
    unions = items.select(F.col("item_id").alias("union_item_id"), F.col("name").alias("union_name"))
    agreement_names = agreements.select("agreement_id", F.col("name").alias("agreement"))
    return (
        labour.join(persons.select("employee_id", "end_date"), "employee_id")
        .join(plans, "health_item_id", "left")
        .join(unions, "union_item_id", "left")
        .join(agreement_names, "agreement_id", "left")
        .select(
            "employee_id",
            F.coalesce(F.col("condition") == PENSIONER_CONDITION, F.lit(False)).alias("pensioner"),
            "agreement",
            "health_plan",
            "union_name",
            "union_member",
            "end_date",
        )
        .distinct()
    )


def settled_employees(settlements: DataFrame, lines: DataFrame, p: RunParams) -> DataFrame:
    """Employees with a settlement line in the year.

    Lines only prove existence, so their ids are made distinct before they are shuffled.
    """
    keys = line_keys(lines)
    with_lines = lines.select(*keys).distinct()
    of_year = settlements.where(of_type(p) & (F.col("year") == p.year))
    return of_year.join(with_lines, keys, "left_semi").select("employee_id").distinct()


def employee_attributes(profiles: DataFrame, settled: DataFrame) -> DataFrame:
    """Profiles of the employees settled in the year."""
    return profiles.join(settled, "employee_id", "left_semi")
